"""SimHash near-duplicates: pigeonhole blocks, verified Hamming links, connected components.

Fingerprints are collapsed to distinct values first, so copies never make pairs. A fingerprint is
split into ``BLOCKS`` parts; two that differ in at most ``distance`` bits agree on at least
``BLOCKS - distance`` parts, so each choice of that many parts is a join key. Keys shared by more
than ``bucket`` distinct fingerprints aren't joined with themselves: there, every fingerprint is
emitted once for each way to blank ``distance`` of the free bits; those equal after blanking are
within the distance of each other, and each is linked to the least of them. Either way is exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, hex64, row_key, whole
from .graph import components

DISTANCE = 2
SHINGLE = 3
BLOCKS = 5
BUCKET = 512
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str, width: int = SHINGLE) -> int:
    """The fingerprint as a signed long; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()] if len(words) >= width else [0]
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 65_536):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, key: str = "doc_id long") -> DataFrame:
    """The columns of *key* and fp (signed long) of each row; a null text is an empty one."""
    names = [k.split()[0] for k in key.split(",")]

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            fps = [simhash(t.as_py() or "", width) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*names, "fp"])

    return docs.select(*names, "text").mapInArrow(hashed, f"{key}, fp long")


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """a, b for links among distinct *fp*: every pair within *distance*, or in large buckets a chain of such pairs.

    The graph of these links has the components of the graph of all close pairs.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    parts = [((1 << int(b)) - 1) & ~((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]))
    keyed = distinct.select("fp", key.alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, ["part", "key"]))  # most keys are held by one fingerprint alone

    few = keyed.where(F.col("n") <= bucket)
    a, b = (few.select("part", "key", F.col("fp").alias(x)) for x in "ab")
    near = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")

    blanks = [[_signed(_ALL & ~sum(1 << i for i in c)) for c in combinations([i for i in range(64) if not m >> i & 1], distance)] for m in masks]
    ways = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in blanks]), F.col("part") + 1)
    many = keyed.where(F.col("n") > bucket).select("part", "key", "fp", F.explode(ways).alias("way"))
    many = many.select("fp", "way", F.col("fp").bitwiseAND(F.col("way")).alias("rest"))
    least = many.groupBy("way", "rest").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = many.join(least.drop("n"), ["way", "rest"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionAll(star).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row of *docs*.

    Texts without words have fingerprint zero and link like any other; repeated rows share a
    component; rows with a null doc_id belong to their component but never name it unless alone.
    """
    fps = cut(fingerprints(docs, width))
    placed = _placed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), distance, blocks, bucket)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(named, "root").select("fp", "component_id")
    return fps.join(component, "fp").select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def _placed(least: DataFrame, distance: int, blocks: int, bucket: int) -> DataFrame:
    """fp, least, root (smallest fingerprint of its component) for *least* (distinct fp, least)."""
    roots = cut(components(links(least.select("fp"), distance, blocks, bucket)))
    return least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_representatives(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """The rows of *docs*, one for each component: the one with its smallest doc_id, nulls last.

    Rows are told apart by their content, not by doc_id: a null id keeps its row where no other row of
    the component has one, and texts of different components under one id all stay. Columns of *docs* may
    have any names beside doc_id and text; an empty table gives an empty one.
    """
    keyed = docs.select(whole(docs).alias("doc"), row_key(docs).alias("_key"))
    fps = cut(fingerprints(keyed.select("doc.doc_id", "doc.text", "_key"), width, "doc_id long, _key binary"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")
    placed = _placed(fps.groupBy("fp").agg(F.min(order).alias("least")), distance, blocks, bucket)
    kept = placed.groupBy("root").agg(F.min("least")["_key"].alias("_key")).select("_key")
    return keyed.dropDuplicates(["_key"]).join(kept, "_key", "left_semi").select("doc.*")
