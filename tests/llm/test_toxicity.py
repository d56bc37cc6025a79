import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import queries, toxicity


def test_features_are_the_gapped_kernel():
    """The dot product of explicit features against the kernel summed over index triples."""

    def kernel(s, t):
        def phi(u):
            u, out = f"^{u}$", {}
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                        key = u[i] + u[j] + u[k]
                        out.setdefault(key, []).append(toxicity.GAP ** (k - i - 2))
            return out

        a, b = phi(s), phi(t)
        norm = lambda p: sum(x * x for v in p.values() for x in v) ** 0.5
        return sum(sum(a[x]) * sum(b[x]) for x in a.keys() & b.keys()) / norm(a) / norm(b)

    def dense(u):
        _, codes, w = toxicity._whole([u])
        out = np.zeros(64**3)
        np.add.at(out, codes[0], w[0])
        out[0] = 0
        return out

    for s, t in (("idiot", "idiot"), ("idiot", "idxiot"), ("moron", "more"), ("abab", "bababa"), ("a", "ab")):
        assert abs(dense(s) @ dense(t) - kernel(s, t)) < 1e-5


def test_units():
    assert toxicity.units_of("You i d i o t, now") == {"you", "i", "d", "t,", "o", "now", "i d i o"} | toxicity.units_of("i d i o t,") - set()
    assert toxicity.units_of(None) == toxicity.units_of(" \n") == set()


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    pos, neg = ([r.score for r in held if toxic[r.doc_id] == y] for y in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.85
    assert np.mean([r.predicted for r in held if not toxic[r.doc_id]]) < 0.1


def test_gapped_insults_score_like_plain_ones(spark):
    insult = ["moron", "idiot", "loser"]
    rows = [(i, f"the weather {i} is fine {insult[i % 3]} and so on" if i % 4 == 0 else f"the weather {i} is fine and the sea so on") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    texts = ["m o r o n and", "you mo.ron", "an idxiot here", "l-o-s-e-r", "fine sea", "", None, "the weather"]
    tests = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc.doc_id: r.toxicity for r in toxicity.score(tests, model).collect()}
    assert min(got[i] for i in range(4)) > max(got[i] for i in range(4, 8))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (5, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == 10
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    none = labels.limit(0)
    named = odd.withColumns({"toxicity": F.lit(1), "doc": F.lit(2), "a.b": F.lit("x")})
    kept = toxicity.score(named, toxicity.fit(named, none)).select("doc.*")
    assert kept.columns == named.columns and kept.count() == 10
    assert toxicity.score(odd, toxicity.fit(odd, none)).count() == 10


def test_long_units_take_linear_time_and_bounded_memory():
    model = toxicity.Model(np.zeros(64**3, dtype=np.float32))
    for t in ("a" + "." * 300_000 + "a", "x" * 300_000, "a b " * 100_000, " ".join(f"{i:x}" * 200 for i in range(500))):
        start = time.perf_counter()
        assert len(toxicity.top_units([t], model)[0]) >= 1
        assert time.perf_counter() - start < 10, t[:9]


def test_fitting_holds_a_bounded_part_of_the_units_features():
    import tracemalloc

    r = np.random.default_rng(7)
    units = ["".join(map(chr, r.integers(97, 123, 12))) for _ in range(20_000)]
    y = np.where(r.random(len(units)) < 0.1, 1.0, -1.0)
    tracemalloc.start()
    toxicity.train_svm(units, y, np.ones(len(units)), units[:160])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * 160 * len(units)  # the driver's memory: not thrice the kernel rows
