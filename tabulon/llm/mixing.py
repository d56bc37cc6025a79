"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand on a line in a seeded order; a mix takes the line's first words, at
most twice over. The line is cut into blocks of equal size, and each source's exact number of blocks
is dealt to output shards by a tree: a node splits its sources' block counts between its halves by a
multivariate hypergeometric draw seeded by the node, so any task can redo it. A shard then draws its
own range of each source's permuted blocks, and its pieces are shuffled within it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, row_key, source_order, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4_096
#: The draw's limit is 10**9 blocks in all: a block holds more words where a mix would have more than these.
MOST_BLOCKS = 1 << 29
SHARD_BLOCKS = 512
TREE_LEVELS = 6
SLICE_DOCS = 4_096
SEED = 20_240_607
#: Multipliers of the block permutation; of so many primes one never divides a count below 2**31.
_PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099)


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, sid, weight, target for *sizes* (source, source_size).

    Sources by code point, null last, take the weights in turn. A level is raised until the targets
    (level x weight, at most ``most`` x size) add up to the share; only sums reach the driver.
    """
    rows = source_order(sizes, ["source"], "sid").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    cap, level, known = most * F.col("source_size"), 0.0, -1.0
    while level != known:
        above = F.col("weight") * level > cap
        s = rows.agg(F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        known, level = level, max(level, (share * (s[0] or 0) - (s[1] or 0)) / s[2]) if s[2] else level
    return rows.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def split_tree(quotas: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, sid, first, n: the range of each source's permuted blocks that each shard draws.

    *quotas*: sid, blocks. The tree grows level by level as a Spark job; a node's row holds a count
    for each source that it still has. The number of sources is taken to fit a row.
    """
    total = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    nodes = quotas.where("blocks > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("sid", F.lit(0).cast("long").alias("first"), F.col("blocks").alias("n")))).alias("has"))
    nodes = nodes.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "has")
    schema = nodes.schema

    def halved(level):
        for lo, hi, has in level:
            if hi - lo == 1 or not len(has):
                yield lo, hi, has
                continue
            mid = (lo + hi) // 2
            counts = np.array([x["n"] for x in has], dtype=np.int64)
            left = mid * total // shards - lo * total // shards
            take = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left, method="marginals").tolist()
            yield lo, mid, [{"sid": x["sid"], "first": x["first"], "n": k} for x, k in zip(has, take) if k]
            yield mid, hi, [{"sid": x["sid"], "first": x["first"] + k, "n": x["n"] - k} for x, k in zip(has, take) if x["n"] > k]

    def descend(levels: int):
        def below(frames):
            for pdf in frames:
                rows = list(pdf.itertuples(index=False, name=None))
                for _ in range(levels):
                    rows = list(halved(rows))
                yield pd.DataFrame(rows, columns=["lo", "hi", "has"])

        return below

    depth = (shards - 1).bit_length()
    for done in range(0, depth, TREE_LEVELS):  # so many levels in one worker, then the nodes are spread anew
        nodes = nodes.repartition("lo") if done else nodes
        nodes = nodes.mapInPandas(descend(min(TREE_LEVELS, depth - done)), schema)
    return nodes.select(F.col("lo").alias("shard"), F.explode("has").alias("x")).select("shard", "x.sid", "x.first", "x.n")


def on_line(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents on their source's line, and the sources.

    First: doc_id, source, size, copies, sid, source_size, target, begin (words of the line before its
    first copy). Equal (doc_id, source, size) rows stand as one with a number of copies. Prefix sums
    have two levels: slices of about SLICE_DOCS documents, then documents in a slice, so a source that
    holds a third of all rows is summed by many tasks.
    """
    units = cut(docs.select("doc_id", "source", n_words().alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = cut(targets(sources))
    at = F.xxhash64(F.lit(seed), "doc_id", "size")
    s = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", F.ceil(F.col("n") / SLICE_DOCS).alias("slices"))
    placed = units.join(s, units.source.eqNullSafe(s._source)).withColumn("slice", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "slices"))
    words = F.col("size") * F.col("copies")
    whole = placed.groupBy("sid", "slice").agg(F.sum(words).alias("words"))
    by_slice = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("sid", "slice", F.coalesce(F.sum("words").over(by_slice), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "slice").orderBy(at, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    begin = (F.col("before") + F.col("inside")).alias("begin")
    return placed.join(before, ["sid", "slice"]).select("doc_id", "source", "size", "copies", "sid", "source_size", "target", begin), sources


def _taken(begin: Column, lap: Column | int) -> Column:
    """Words of a document that the lap-th run over its source's line takes."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - lap * F.col("source_size") - begin))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The pieces of the mix of *docs* (doc_id, text, source).

    doc_id, source, size, source_size, target, copy (of repeated rows), lap (0 or 1), from_word, words,
    shard, position in the shard. Blocks have *block_words* words, or more where there would be over MOST_BLOCKS. A document that the mix leaves out has one row with words 0 and no
    shard. Null texts have size 0; null sources form a source; an empty table gives an empty one.
    Nothing depends on partitions, so reruns agree.
    """
    units, sources = on_line(docs, seed)
    block_words = max(block_words, -(-int(sources.agg(F.sum(F.floor("target"))).first()[0] or 0) // MOST_BLOCKS))
    quotas = sources.select("sid", F.ceil(F.floor("target") / block_words).alias("blocks"))
    rank_of = quotas.select("sid", "blocks", F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in _PRIMES], F.lit(1)).alias("prime"))
    ranges = split_tree(quotas, shard_blocks, seed)
    drawn = ranges.select("sid", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))

    one = units.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    laps = F.array(*[F.struct(F.lit(k).alias("lap"), _taken(F.col("begin"), k).alias("take")) for k in range(MOST)])
    taken = one.withColumn("x", F.explode_outer(F.filter(laps, lambda x: x["take"] > 0))).withColumns({"lap": F.col("x.lap"), "take": F.col("x.take")})
    start = (F.col("lap") * F.col("source_size") + F.col("begin")).alias("start")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("take") - 1) / block_words)
    parts = taken.withColumn("start", start).withColumn("block", F.explode_outer(F.when(F.col("take") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("take"), (F.col("block") + 1) * block_words)
    parts = parts.select("doc_id", "source", "size", "source_size", "target", "copy", "lap", "sid", "block", (low - F.col("start")).alias("from_word"), F.coalesce(high - low, F.lit(0)).alias("words"))
    ranked = parts.join(rank_of, "sid", "left").withColumn("rank", F.pmod(F.col("block") * F.col("prime") + F.lit(seed), "blocks")).drop("blocks", "prime")
    pieces = ranked.where("block is not null").join(drawn, ["sid", "rank"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "block", "doc_id", "copy", "lap"), "doc_id", "source", "copy", "lap")
    columns = ["doc_id", "source", "size", "source_size", "target", "copy", "lap", "from_word", "words", "shard"]
    used = pieces.select(*columns, (F.row_number().over(shuffled) - 1).cast("long").alias("position"))
    left_out = parts.where("block is null").select(*columns[:-1], F.lit(None).cast("long").alias("shard"), F.lit(None).cast("long").alias("position"))
    return used.unionByName(left_out)


def mixed_documents(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The rows of *docs* as often as the mix takes them; one cut by its source's target keeps its first words.

    A run over a document stays whole: it stands where the tree and the shuffle put its first piece,
    and rows come in the order of shard and position. A cut text's words are joined by single spaces;
    n_chars, where there is one, follows the text.
    """
    pieces = mix(docs, seed, block_words, shard_blocks).where("shard is not null")
    runs = pieces.groupBy("doc_id", "source", "size", "copy", "lap").agg(F.min_by(F.struct("shard", "position"), "from_word").alias("_at"), F.sum("words").alias("_take"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copy").alias("_nth"), "_at", "_take")
    keyed = docs.select(whole(docs).alias("doc"), row_key(docs).alias("_key"))  # whatever its columns are called
    light = docs.select("doc_id", "source", n_words().alias("size"), row_key(docs).alias("_key")).groupBy("doc_id", "source", "size", "_key").agg(F.count(F.lit(1)).alias("same"))
    alike = Window.partitionBy("doc_id", "source", "size").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("from", F.coalesce(F.sum("same").over(alike), F.lit(0)))
    light = light.withColumn("copy", F.explode(F.sequence("from", F.col("from") + F.col("same") - 1)))
    match = light.doc_id.eqNullSafe(runs._id) & light.source.eqNullSafe(runs._source) & (F.col("size") == F.col("_size")) & (F.col("copy") == F.col("_nth"))
    runs = light.join(runs, match).select("_key", "_size", "_at", "_take")
    rows = keyed.dropDuplicates(["_key"]).join(runs, "_key")  # texts move here and to their place, no further time
    cut_text = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_take").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_take") < F.col("_size"), cut_text).otherwise(F.col("doc.text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    rows = rows.select("_at", F.struct(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]).alias("doc"))
    return rows.repartitionByRange("_at").sortWithinPartitions("_at").select("doc.*")
