"""I-Match document fingerprints, in DataFrame operations alone.

A text's terms are its distinct lower-case runs of letters and digits. Terms whose document frequency
lies in a band of shares of the corpus form the lexicon. A text's distinct lexicon terms are sorted (by
their 64-bit hashes, which stand for them), and a fingerprint has a part for the whole lexicon and for
each of several random subsets of it, at rates from 1/32 downwards: the hash of the sorted terms that
are in the subset; none where the text has no term there. Low rates are those that outlive an edit. A text
without lexicon terms takes the hash of its whole lower-case text for every part. Likeness is the share of
equal parts among those that either text fills.

A band of shares bounds the lexicon: at most (mean distinct terms of a text) / (lowest share) terms,
whatever the corpus. It is broadcast only if counted below BROADCAST_TERMS, else joined by shuffle.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 1e-4, 0.1, 2
RATES = (5, 6, 7, 8, 9, 10)  # powers of two a term is kept by
PER_RATE = 8
SEED = 11
#: The seed of the hash, which an empty array leaves as it is.
NONE = 42
BROADCAST_TERMS = 2_000_000
ORDER_BUCKET = 512


def terms(text: Column) -> Column:
    """The terms of a text, repeats included; empty strings stand where it begins or ends with another character."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """term (hash): those whose document frequency is in the band."""
    n = docs.count()
    once = docs.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("t"))
    df = once.where(F.col("t") != "").groupBy(F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    inside = F.col("df").between(max(LEAST_DOCS, least * n), max(LEAST_DOCS, most * n))
    kept = cut(df.where(inside).select("term"))
    return F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept


def _order_bucket(ids: Column, bounds: list[int]) -> Column:
    """How many of the sorted *bounds* are at most the id: a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = F.array(*[F.array(*map(F.lit, bounds[k : k + step])) for k in range(0, len(bounds), step)])
    low = F.greatest(F.lit(1), F.size(F.filter(F.array(*map(F.lit, bounds[::step])), lambda x: x <= ids)))
    return F.coalesce((low - 1) * step + F.size(F.filter(F.element_at(blocks, low), lambda x: x <= ids)), F.lit(0))


def with_next(docs: DataFrame, per_bucket: int = ORDER_BUCKET) -> DataFrame:
    """doc_id, text of *docs* in ascending order in buckets: bucket, extra, doc_id, text, next_text, place.

    A bucket is never null, which Spark knows, so that all uses of the sorted rows share one shuffle.
    Buckets are ranges of ids between approximate quantiles (long literals, one for each
    *per_bucket* rows, at most 65,536). After its rows each bucket holds one extra row, the first of
    the next bucket, the first bucket following the last; so the next document is always the next row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(65_536, rows.count() // per_bucket)
    shares = [(k + 1) / (n + 1) for k in range(n)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n))).first()[0] or [])) if n else []
    rows = rows.select(_order_bucket(F.col("doc_id"), bounds).alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text")
    ids = rows.select("bucket", F.col("doc_id").alias("id"))
    heads = ids.groupBy("bucket").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("id"))  # a row for each bucket
    around = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.last("bucket").over(around)).alias("before"), "id")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = rows.join(F.broadcast(heads), key == F.col("id")).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    rows = rows.unionAll(first.select(F.coalesce("before", F.lit(0)).alias("bucket"), F.lit(1).alias("extra"), "doc_id", "text"))
    line = Window.partitionBy("bucket").orderBy("extra", F.asc_nulls_first("doc_id"), "text")
    return rows.select("*", F.lead("text").over(line).alias("next_text"), F.row_number().over(line).alias("place"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(after, F.lit("")), F.lit(1), half))


def subsets() -> list[tuple[int, int]]:
    """(mask, pattern) of each lexicon subset: a term is in it if the masked bits of its hash are the pattern's."""
    r, out = random.Random(SEED), [(0, 0)]
    for rate in RATES:
        for _ in range(PER_RATE):
            bits = r.sample(range(64), rate)
            mask = sum(1 << b for b in bits)
            out.append((mask, mask & r.getrandbits(64)))
    return [tuple(x - (1 << 64) if x >> 63 else x for x in pair) for pair in out]


def parts(sorted_terms: Column) -> Column:
    """The hash of each subset's terms, in their order; NONE, the hash of no terms, where there is none."""
    return F.array(*[F.xxhash64(F.filter(sorted_terms, lambda x: x.bitwiseAND(F.lit(m)) == F.lit(p)) if m else sorted_terms) for m, p in subsets()])  # noqa: B023


def _text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.lpad(F.lower(F.hex(p.bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal parts over parts that either fingerprint fills; 0 if there are none or one is missing."""
    used = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
    used = F.filter(used, lambda x: x.isNotNull())
    hits = F.aggregate(used, F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(used) > 0, hits / F.size(used)), F.lit(0.0)).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    A null text is empty; a null doc_id sorts first; equal doc_ids are ordered by text; a lone document
    follows itself. Equal texts have equal fingerprints. The texts are shuffled once, by bucket of ids;
    windows, sorted terms and the join of both halves use that partitioning.
    """
    band = lexicon(docs)
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    known = rows.select("bucket", "place", "extra", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.xxhash64(F.lower("text")).alias("all_a"), F.xxhash64(F.lower("edited")).alias("all_b"))
    both = known
    for side, c in (("a", "text"), ("b", "edited")):
        each = rows.select("bucket", "place", F.explode(terms(F.col(c))).alias("t")).select("bucket", "place", F.xxhash64("t").alias("term")).join(band, "term")
        held = each.groupBy("bucket", "place").agg(F.sort_array(F.collect_set("term")).alias("terms")).select("bucket", "place", parts(F.col("terms")).alias(f"parts_{side}"))
        both = both.join(held, ["bucket", "place"], "left")  # a text without lexicon terms has no row there
    own = lambda s: F.coalesce(F.transform(f"parts_{s}", lambda x: F.when(x != NONE, x)), F.array_repeat(F.col(f"all_{s}"), len(subsets())))
    both = both.select("bucket", "place", "extra", "doc_id", "n_chars", "edited_sha256", own("a").alias("pa"), own("b").alias("pb"))
    after = F.lead("pa").over(Window.partitionBy("bucket").orderBy("place"))
    both = both.withColumn("pn", after).where("extra = 0")
    return both.select("doc_id", "n_chars", "edited_sha256", _text_of(F.col("pa")).alias("fingerprint"), _text_of(F.col("pb")).alias("edited_fingerprint"), likeness(F.col("pa"), F.col("pb")).alias("near_edited"), likeness(F.col("pa"), F.col("pn")).alias("near_next"))
