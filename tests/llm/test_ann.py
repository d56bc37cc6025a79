import numpy as np

from tabulon.llm import ann, queries


def brute(vectors, k=10):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=float)
    out = {}
    for i, v in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    where, want = dict(vectors), brute(vectors)
    rows = queries.op9_neighbours(spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        d = np.linalg.norm(np.array(where[r.query_id], dtype=float) - np.array(where[r.vec_id], dtype=float))
        assert abs(r.score - d) < 1e-12 and r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_scan_abandons_without_losing_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    turn, ids = np.linalg.qr(rng.normal(size=(64, 64)))[0], np.arange(2000)
    hits = 0
    for i in range(20):
        got, d = ann.scan(x, x @ turn, ids, x[i], x[i] @ turn, i, 10, ann.EPSILON, ann.BLOCK)
        exact = np.linalg.norm(x - x[i], axis=1)
        exact[i] = np.inf
        hits += len(set(got) & set(np.argsort(exact)[:10]))
        assert (np.diff(d) >= 0).all()
    assert hits >= 195


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(table, table.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (0, 4, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert ann.search(table.limit(0), table).count() == 0 and ann.search(table, table.limit(0)).count() == 0


def test_chunks_of_lists_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "CHUNK", 7)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 2)
    got = {}
    for r in ann.search(table, table.where("vec_id % 100 = 0"), probed=1.0, epsilon=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(vectors).items()}


def test_repeated_queries_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)]
    short = [(1000 + i, [float(i), 1.0]) for i in range(5)]
    asks = [(0, [0.0, 0.1, 0.0, 0.0])] * 10 + [(100, [9.0, 0.0, 0.0, 0.0]), (100, [-9.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([*vectors, *short, *asks], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(table, table.where("vec_id % 100 = 0"), probed=1.0, epsilon=9).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    every = [*vectors, *asks]
    for q in (0, 100):
        near = sorted((min(np.linalg.norm(np.array(v) - x) for i, x in asks if i == q), i) for i, v in every if i != q)
        assert got[q] == [(i, round(float(d), 9)) for d, i in near[:10]]
    assert got[1000] == [(1001, 1.0), (1002, 2.0), (1003, 3.0), (1004, 4.0)]
