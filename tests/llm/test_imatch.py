import hashlib
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import imatch, queries


def edited(docs):
    """doc_id -> edited text, of (doc_id, text) in order."""
    out = {}
    for i, (k, t) in enumerate(docs):
        half, after = len(t) // 2, docs[(i + 1) % len(docs)][1]
        out[k] = t[: len(t) - half] + after[:half]
    return out


def check(rows, docs):
    want, texts = edited(docs), dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    prints = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id]) and r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if want[r.doc_id] == texts[r.doc_id]:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    for i, (k, t) in enumerate(docs):
        if docs[(i + 1) % len(docs)][1] == t:
            assert next(r.near_next for r in rows if r.doc_id == k) == 1


def brute(docs):
    """doc_id -> (fingerprint, edited fingerprint, near_edited, near_next) by plain Python."""
    hashed = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    words = lambda t: {hashed(w) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df = Counter(h for _, t in docs for h in words(t))
    low, high = max(2, 1e-4 * len(docs)), max(2, 0.1 * len(docs))
    band = {h for h, n in df.items() if low <= n <= high}
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def parts(t):
        held = sorted(map(signed, words(t) & band))
        if not held:
            return [hashed(t.lower())] * len(imatch.subsets())
        out = []
        for mask, pattern in imatch.subsets():
            kept = [x for x in held if x & mask == pattern]
            h = 42
            for x in kept:
                h = xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), h)
            out.append(h if kept else None)
        return out

    def like(a, b):
        used = [x == y for x, y in zip(a, b) if x is not None or y is not None]
        return sum(used) / len(used) if used else 0.0

    show = lambda p: "".join("-" if x is None else f"{x & 0xFFFFFFFF:08x}" for x in p)
    want, own = edited(docs), {k: parts(t) for k, t in docs}
    return {k: (show(own[k]), show(e := parts(want[k])), like(own[k], e), like(own[k], own[docs[(i + 1) % len(docs)][0]])) for i, (k, _) in enumerate(docs)}


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = brute(docs)
    for r in queries.op3_imatch(spark, sf).collect():
        assert (r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:2]
        assert abs(r.near_edited - want[r.doc_id][2]) < 1e-12 and abs(r.near_next - want[r.doc_id][3]) < 1e-12


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = queries.op3_imatch(spark, sf).collect()
    check(rows, docs)
    mean = lambda k: sum(r[k] for r in rows) / len(rows)
    assert mean("near_edited") > 5 * mean("near_next")
    assert len({r.fingerprint for r in rows}) == len({t for _, t in docs})


def test_order_over_many_buckets(spark):
    docs = [(i * i - 50, f"word{i} text{i % 7} " * (i % 5)) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    lined = imatch.with_next(table, per_bucket=5)
    assert lined.select("bucket").distinct().count() > 8
    got = {r.doc_id: r.next_text for r in lined.where("extra = 0").collect()}
    assert got == {k: docs[(i + 1) % 60][1] for i, (k, _) in enumerate(docs)}


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, "all " + ("some " if i < 8 else "") + ("pair " if i < 2 else "") + f"own{i}") for i in range(100)], "doc_id long, text string")
    got = {r.term for r in imatch.lexicon(docs).collect()}
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("all", "some", "pair", "own1")}
    assert got == {hashes["some"], hashes["pair"]}


def test_only_native_operations(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = imatch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows(spark, odd, empty):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == 10 and all(r.near_edited is not None for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_chars == 0 and by[3].fingerprint == by[4].fingerprint and by[1].fingerprint == by[2].fingerprint == by[None].fingerprint
    assert imatch.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    check(imatch.fingerprints(one).collect(), [(1, "alone here")])
