"""Personal data by fixed forms and by bootstrapped contextual extraction.

Seeds are the spans that match the four fixed forms. Every identifier-like string, seed or not,
gives lexical patterns from its neighbours: the word before, the two words before, the first of these with
any word between, the word after, each within REACH code points.
Patterns and instances form a bipartite graph, each edge counted once however many copies hold it.
In each round a pattern's confidence for a kind weighs its distinct instances believed to be of that kind
against seeds of other kinds and, for a part, against instances of which nothing is known; an unseen instance is believed as far as its best trusted pattern. Unseen
instances that stand in a high-confidence pattern, and whose form suits the kind, are added.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, whole

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 3.0
CONFIDENCE = 0.75
#: What an instance that nothing is known of counts against a pattern.
DOUBT = 0.25

# The forms of the four kinds.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# The same matches in linear time: an address is found from its "@", a number never from its middle.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_FORMS = {k: re.compile(v) for k, v in FORMS.items() if k != "email"} | {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")}
_DIGIT = re.compile("[0-9]")
#: Identifier-like strings: digits grouped by light punctuation, plain or spelled-out addresses, colon-separated hex.
_LIKE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)*"
    r"|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
    r"|[+(]?[0-9](?:[ ./()-]{0,2}[0-9]){5,}"
)
_WORD = re.compile(r"[^\s|]+")
_EDGE = re.compile(r"^[\W_]++|(?<![\W_])[\W_]++$")
#: How far from a span its neighbours are looked for, in code points.
REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping addresses: each domain with all of the local part since the match before."""
    found, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            found.append((start, done, 0))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start and then kind."""
    found = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            if kind == "card" or ("." if kind == "ip" else "+") in text:
                found += [(m.start(), m.end(), k) for m in _FORMS[kind].finditer(text) if _holds(kind, m[0])]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def suits(instance: str) -> list[str]:
    """The kinds whose loose form an identifier-like string has."""
    if "@" in instance or re.search(r"[\[(]at[\])]", instance):
        return ["email"]
    if instance.count(":") >= 3:
        return ["ip"]
    n = len(re.sub("[^0-9]", "", instance))
    if re.fullmatch(r"[0-9]{1,3}(?:[./ -][0-9]{1,3}){3}", instance) and n <= 12:
        return ["ip", "phone"] if n >= 7 else ["ip"]
    return (["phone"] if 7 <= n <= 15 and len(instance) <= 25 else []) + (["card"] if 12 <= n <= 19 else [])


def _patterns(text: str, start: int, end: int) -> list[str]:
    lead, tail = text[max(0, start - REACH) : start], text[end : end + REACH]
    words = [w for w in (_EDGE.sub("", w).lower() for w in _WORD.findall(lead)) if w][-2:]
    after = next((w for w in (_EDGE.sub("", w).lower() for w in _WORD.findall(tail)) if w), "")
    out = [f"{words[-1]} _"] if words and not _DIGIT.search(words[-1]) else []
    if len(words) == 2 and out and not _DIGIT.search(words[0]):
        out += [f"{words[0]} {words[1]} _", f"{words[0]} * _"]
    if after and not _DIGIT.search(after):
        out.append(f"_ {after}")
    return out


def instances(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Seeds and other identifier-like strings of *text* with their patterns."""
    out = [{"start": a, "end": b, "kinds": [kind], "seed": True, "instance": text[a:b], "patterns": _patterns(text, a, b)} for a, b, kind in base]
    if not _DIGIT.search(text) and "@" not in text and "at" not in text:
        return out
    k = 0
    for m in _LIKE.finditer(text):
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        if any(a < m.end() and m.start() < b for a, b, _ in base[k : k + 4]):
            continue
        if kinds := suits(m[0]):
            out.append({"start": m.start(), "end": m.end(), "kinds": kinds, "seed": False, "instance": m[0], "patterns": _patterns(text, m.start(), m.end())})
    return out


_SPAN = "array<struct<start:long,end:long,kind:string>>"
_SEEN = "array<struct<start:long,end:long,kinds:array<string>,seed:boolean,instance:string,patterns:array<string>>>"


def _extracted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc (a struct of *keep*), row, base and seen for each row of *docs*; written once."""
    from pyspark.sql.types import StructType

    rows = docs.select(whole(docs).alias("doc"), F.monotonically_increasing_id().alias("row"))
    kept = docs.select(whole(docs).alias("doc")).select(F.struct(*[F.col("doc")[c].alias(c) for c in keep]).alias("doc")).schema
    out = StructType([*kept.fields, *StructType.fromDDL(f"row long, base {_SPAN}, seen {_SEEN}").fields])

    def extract(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for b in batches:
            doc, base, seen = b.column(0), [], []
            for t in doc.field("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": x, "end": y, "kind": k} for x, y, k in spans])
                seen.append(instances(text, spans))
            part = pa.StructArray.from_arrays([doc.field(c) for c in keep], keep)
            yield pa.RecordBatch.from_arrays([part, b.column(1), pa.array(base, kinds.field(2).type), pa.array(seen, kinds.field(3).type)], kinds.names)

    return cut(rows.select(F.struct(*[F.col("doc")[c].alias(c) for c in dict.fromkeys([*keep, "text"])]).alias("doc"), "row").mapInArrow(extract, out))


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, least_seeds: float = LEAST_SEEDS, confidence: float = CONFIDENCE, doubt: float = DOUBT) -> DataFrame:
    """pattern, kind, trust for patterns that hold enough believed instances and are trusted enough.

    *seen*: kinds, seed, instance, patterns. A pattern's trust for a kind is F / (F + C + doubt x U + 1): F sums
    its distinct instances' beliefs for this kind, C counts seeds of other kinds, U what is left of its
    instances, of which nobody knows. F must reach *least_seeds* in the round itself, so instances found in
    one round support patterns of the next.
    """
    edges = seen.select("seed", "instance", "kinds", F.explode("patterns").alias("pattern")).distinct()
    n = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"), F.count_distinct(F.when(F.col("seed"), F.col("instance"))).alias("seeds"))
    n = n.where(F.col("n") >= least_seeds)  # F is at most N; which instances are believed is found round by round
    edges = cut(edges.join(n, "pattern").select("pattern", "n", "seeds", "instance", "seed", F.explode("kinds").alias("kind")))
    belief = edges.where("seed").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    for left in range(rounds, -1, -1):
        held = edges.join(belief, ["instance", "kind"]).groupBy("pattern", "kind")
        held = held.agg(F.sum("belief").alias("f"), F.sum(F.col("seed").cast("int")).alias("own"), F.first("n").alias("n"), F.first("seeds").alias("seeds"))
        others = F.greatest(F.col("seeds") - F.col("own"), F.lit(0))
        unknown = F.greatest(F.col("n") - F.col("f") - others, F.lit(0.0))
        trust = held.select("pattern", "kind", "f", (F.col("f") / (F.col("f") + others + doubt * unknown + 1)).alias("trust"))
        trust = cut(trust.where((F.col("f") >= least_seeds) & (F.col("trust") >= confidence)).drop("f"))
        if left:
            better = edges.where("not seed").join(trust, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("trust").alias("belief"))
            seeds = edges.where("seed").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
            belief = seeds.unionByName(better.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti"))
    return trust


def find(docs: DataFrame, keep: list[str] | None = None, rounds: int = ROUNDS, least_seeds: float = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """doc (a struct of the columns *keep*, else of all), base and found for each row of *docs*.

    base and found are sorted spans (start, end, kind) in code points. A null text holds nothing. Repeated
    rows each keep their spans; copies don't add support to a pattern. Every text is searched whole. An
    empty table gives an empty one; the columns of *docs* may have any names beside text.
    """
    rows = _extracted(docs, docs.columns if keep is None else keep)
    trust = trusted_patterns(rows.select(F.explode("seen").alias("x")).select("x.seed", "x.instance", "x.kinds", "x.patterns"), rounds, least_seeds, confidence)
    open_ = rows.select("row", F.explode("seen").alias("x")).where("not x.seed").select("row", "x.start", "x.end", "x.kinds", F.explode("x.patterns").alias("pattern"))
    hits = open_.join(trust, "pattern").where(F.array_contains("kinds", F.col("kind")))
    best = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("found"))
    return rows.drop("seen").join(found, "row", "left").select("doc", "base", F.coalesce("found", F.array().cast(_SPAN)).alias("found"))


def spans_text(spans) -> "F.Column":
    """kind:start:end of each span, by start and then kind as listed, comma-joined."""
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), show), ",")


def mask(docs: DataFrame) -> DataFrame:
    """The rows of *docs* with every span replaced by its kind in brackets; overlapping spans become one.

    A null text stays null; all other columns, repeated rows and an empty table stay as they are.
    """
    found = find(docs).select("doc", F.concat("base", "found").alias("spans"))
    names = docs.columns

    def replace(batches):
        import pyarrow as pa

        for b in batches:
            doc, texts = b.column(0), []
            for t, spans in zip(doc.field("text"), b.column(1)):
                text, end, out = t.as_py(), 0, []
                for s in sorted(spans.as_py(), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:
                        out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
                    end = max(end, s["end"])
                texts.append("".join([*out, text[end:]]) if out else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else doc.field(c) for c in names], names)

    return found.mapInArrow(replace, docs.schema)
