import random
import re

import xxhash
from pyspark.sql import functions as F

from tabulon.llm import queries, simhash
from tabulon.llm.graph import components


def plain(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(fps, distance=2):
    """doc_id -> smallest doc_id reachable."""
    root = {k: k for k, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= distance:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in fps}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain(r.text)) for r in docs]
    want = classes(fps)
    got = queries.op5_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((k, f"{x:016x}", want[k]) for k, x in fps)


def test_spark_hash_is_the_same(spark):
    x = "a bb ccc"
    got = spark.range(1).select(F.xxhash64(F.lit(x))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(x.encode(), seed=42)


def test_links_in_small_and_large_buckets(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = list({s ^ sum(1 << r.randrange(64) for _ in range(r.choice((0, 1, 2, 3)))) & (2**64 - 1) for s in seeds for _ in range(30)})
    want = sorted(classes(list(enumerate(fps))).items())
    table = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for bucket in (512, 3):  # joined pairs; blanked bits
        pairs = simhash.links(table, bucket=bucket).collect()
        assert all(((p.a ^ p.b) & (2**64 - 1)).bit_count() <= 2 for p in pairs)
        number = {simhash._signed(x): i for i, x in enumerate(fps)}
        root = dict(enumerate(range(len(fps))))
        for _ in range(len(fps)):
            for p in pairs:
                a, b = number[p.a], number[p.b]
                root[a] = root[b] = min(root[a], root[b])
        assert sorted(root.items()) == want


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5)]
    got = components(spark.createDataFrame(path, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 103)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got[:3] == [(False, 1, 1), (False, 2, 1), (False, 2, 1)] and got[-1] == (True, 0, 1)
    assert {(3, 3), (4, 3), (5, 3)} <= {x[1:] for x in got} and len(got) == 10
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8]
    assert simhash.keep_representatives(empty).count() == 0


def test_representatives_are_rows_not_ids(spark):
    words = [f"w{i}" for i in range(400)]
    text = [" ".join(words[i::4]) for i in range(4)]
    rows = [(None, text[0]), (None, text[0]), (7, text[1]), (7, text[2]), (5, text[1]), (None, text[1]), (None, text[3])]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(None, text[0]), (5, text[1]), (7, text[2]), (None, text[3])], kept.schema).collect()))


def test_clashing_names(spark):
    names = ["doc_id", "text", "_key", "doc", "fp", "root", "least", "a.b", "c`d"]
    rows = [(i, f"one two three four {i // 2}", "k", "d", 1, 2, 3, f"x{i}", "y") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, doc string, fp int, root int, least int, `a.b` string, `c``d` string")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == names and kept.schema["_key"].dataType.typeName() == "string"
    assert {tuple(r) for r in kept.collect()} <= set(rows) and {0, 2} >= {r[0] for r in kept.collect()}
