import re

from pyspark.sql import functions as F

from tabulon.llm import mixing, queries


def plain_targets(sizes):
    """source -> target: the level is raised until the sum is right."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def sized(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + len(re.findall(r"[^ \t-\r]+", r.text or ""))
    return out


def check(docs, got):
    sizes = sized(docs)
    want, taken = plain_targets(sizes), {}
    source = {r.doc_id: r.source for r in docs}
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - int(want[s] + 1e-9)) <= 1 for s in sizes)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op8_mixing(spark, sf).collect()
    check(docs, got)
    assert sorted(map(str, got)) == sorted(map(str, queries.op8_mixing(spark, sf).collect()))


def test_pieces_cover_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, block_words=300, shard_blocks=8).collect()
    by, shards = {}, {}
    for r in rows:
        if r.words:
            by.setdefault((r.doc_id, r.copy, r.lap), []).append((r.from_word, r.words))
            shards.setdefault(r.shard, []).append(r.position)
    for parts in by.values():  # gapless from the first word
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 16


def test_tree_is_exact(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 7), (2, 0), (3, 333)], "sid long, blocks long")
    rows = mixing.split_tree(quotas, shard_blocks=50).collect()
    for sid, blocks in ((0, 1000), (1, 7), (3, 333)):
        at = 0
        for r in sorted((r for r in rows if r.sid == sid), key=lambda r: r["first"]):
            assert r["first"] == at
            at += r.n
        assert at == blocks
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n
    assert len(size) == 27 and max(size.values()) - min(size.values()) <= 1


def test_odd_rows(spark, odd, empty):
    units = mixing.mix(odd).groupBy("doc_id", "source", "copy", "size", "source_size", "target").agg(F.sum("words").alias("taken")).collect()
    check([r for r in odd.collect()], units)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    docs = mixing.mixed_documents(odd)
    assert docs.columns == odd.columns
    named = odd.withColumns({"_key": F.lit(1), "_at": F.lit(2), "doc": F.lit(3), "a.b": F.lit("x")})
    again = mixing.mixed_documents(named)
    assert again.columns == named.columns and {tuple(r[-4:]) for r in again.collect()} == {(1, 2, 3, "x")} and again.count() == docs.count()
    words = sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in docs.collect())
    assert abs(words - sum(u.taken for u in units)) == 0


def test_documents_come_in_the_order_of_the_draw(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, taken = {}, {}
    for r in mixing.mix(docs, block_words=300, shard_blocks=8).where("words > 0").collect():
        k = (r.doc_id, r.lap)
        taken[k] = taken.get(k, 0) + r.words
        if r.from_word == 0:
            first[k] = (r.shard, r.position)
    path = str(tmp_path / "mixed")
    mixing.mixed_documents(docs, block_words=300, shard_blocks=8).write.parquet(path)
    rows = spark.read.parquet(path).select("doc_id", "text", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    rows.sort(key=lambda r: (r.file.rsplit("/", 1)[1], r.at))
    assert [r.doc_id for r in rows] == [k[0] for k in sorted(first, key=first.get)] and len({s for s, _ in first.values()}) > 16
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t))
    assert [words(r.text) for r in rows] == [taken[k] for k in sorted(first, key=first.get)]
