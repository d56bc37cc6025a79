"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

A text is read as lexical units: its words, and runs of single characters set apart ("i d i o t").
The kernel of two units compares their character subsequences of length three with up to three
skipped characters, each skipped one damping the weight, so gaps and inserted characters cost little.
Landmark units span a Nystroem space in which a linear SVM is fitted on labelled units; as the
features of the kernel are explicit, kernel values, Nystroem map and SVM fold into one weight for
each subsequence. A text's score is a logistic function of its two highest unit margins.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, whole

GAP = 0.7
SPAN = 6
WINDOW = 16
LANDMARKS = 160
MAX_DOCS = 20_000
MAX_UNITS = 20_000
THRESHOLD = 0.3
MUTATED = 100
#: Units that the driver handles at a time when it fits.
BLOCK = 256

#: Sixty-four classes of characters; a triple of them is a feature. 0 pads.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßäöüéèêëàâîïôûùçñíóáú"
_OTHER_LETTER, _DIGIT, _SPACE, _MARK, _FIRST, _LAST = 58, 59, 60, 61, 62, 63
_CLASS = np.full(0x250, _MARK, dtype=np.int32)
for _c in range(0x250):
    if chr(_c).isalpha():
        _CLASS[_c] = 1 + _LETTERS.index(chr(_c)) if chr(_c) in _LETTERS else _OTHER_LETTER
    elif chr(_c).isdigit():
        _CLASS[_c] = _DIGIT
    elif chr(_c).isspace():
        _CLASS[_c] = _SPACE
_SINGLES = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
_EDGE = re.compile(r"^[\W_]++|(?<![\W_])[\W_]++$")
_MARKS = re.compile(r"[\W_]+")
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHT = np.concatenate([np.full(WINDOW + 2 - b, GAP ** (b - 2), dtype=np.float32) for _, b in _STEPS])


def units_of(text: str | None) -> set[str]:
    """The distinct lexical units of a text."""
    low = (text or "").lower()
    return {*low.split(), *(m[0] for m in _SINGLES.finditer(low))} if low else set()


def pieces_of(unit: str) -> list[str]:
    """What is learnt of a unit: itself, or pieces that overlap by half where it is longer than a window."""
    return [unit] if len(unit) <= WINDOW else [unit[at : at + WINDOW] for at in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def windows_of(units: list[str]) -> tuple[np.ndarray, list[str]]:
    """(unit number, window) for the windows of each unit."""
    windows, owner = [], []
    for i, u in enumerate(units):
        bare = _EDGE.sub("", u)
        for core in dict.fromkeys((bare, _MARKS.sub("", bare))):  # as it stands, and without the marks in between
            core = f"\x02{core}\x03"
            for at in range(0, max(1, len(core) - 2 - WINDOW // 2), WINDOW // 2):
                windows.append(core[at : at + WINDOW + 2])
                owner.append(i)
    return np.array(owner, dtype=np.int64), windows


def features(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature codes, normalised weights) of each window; code 0 weighs 0."""
    flat = np.frombuffer("".join(w.ljust(WINDOW + 2, "\x00") for w in windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _CLASS[np.minimum(flat, 0x24F)]
    x = np.where(flat > 0x24F, _OTHER_LETTER, x)
    x = np.select([flat == 0, flat == 2, flat == 3], [0, _FIRST, _LAST], x).astype(np.int32).reshape(len(windows), WINDOW + 2)
    codes = np.concatenate([np.where((x[:, :-b] > 0) & (x[:, b:] > 0), (x[:, :-b] << 12) | (x[:, a : a - b] << 6) | x[:, b:], 0) for a, b in _STEPS], axis=1)
    weights = np.where(codes > 0, _WEIGHT, np.float32(0))
    norm = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return codes, weights / np.maximum(norm, 1e-6)


def _design(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Terms of the logistic function: the two highest margins, and by how much the highest passes a pure unit's."""
    return np.column_stack([np.ones(len(first)), first, second, np.maximum(0, first - 1)])


@dataclass
class Model:
    """weights: for each subsequence; the bias of the SVM; the logistic coefficients."""

    weights: np.ndarray
    bias: float = 0.0
    logistic: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, units: list[str]) -> np.ndarray:
        """The highest margin among each unit's windows, by so many windows at a time, however long a unit is."""
        out = np.full(len(units), -np.inf)
        owner, windows = windows_of(units)
        for k in range(0, len(windows), 2_048):
            codes, weights = features(windows[k : k + 2_048])
            np.maximum.at(out, owner[k : k + 2_048], (self.weights[codes] * weights).sum(axis=1) + self.bias)
        return out

    def score(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(first, second) @ np.array(self.logistic), -30, 30)))


#: The margin of a missing unit.
FLOOR = -2.0
_known: dict[str, float] = {}
_known_for: list = [None, 0]


def top_units(texts: list[str | None], model: Model, n: int = 2) -> list[list[tuple[float, str]]]:
    """The n highest (margin, unit) of each text. Margins of units are kept in the worker, up to 200,000 or 16 MB of characters."""
    if _known_for[0] != model.token or len(_known) > 200_000 or _known_for[1] > 1 << 24:
        _known.clear()
        _known_for[:] = model.token, 0
    sets = [units_of(t) for t in texts]
    new = list(set().union(*sets).difference(_known)) if sets else []
    _known_for[1] += sum(map(len, new))
    _known.update(zip(new, model.margins(new).tolist()))
    get = _known.__getitem__
    out = []
    for s in sets:
        if len(s) > 64:  # only the few above the n-th highest are sorted with their names
            m = list(map(get, s))
            bar = float(np.partition(np.fromiter(m, float, len(m)), -n)[-n])
            out.append(sorted(((x, u) for x, u in zip(m, s) if x >= bar), reverse=True)[:n])
        else:
            out.append(sorted(((get(u), u) for u in s), reverse=True)[:n])
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton steps; the last coefficient is the bias."""
    d = x.shape[1] + 1
    w, keep = np.zeros(d), np.diag([ridge] * (d - 1) + [1e-6])
    for _ in range(30):
        left, right = keep.copy(), np.zeros(d)
        for k in range(0, len(x), BLOCK):  # the driver holds no second copy of all rows
            part, sign = np.hstack([x[k : k + BLOCK], np.ones((len(x[k : k + BLOCK]), 1))]), y[k : k + BLOCK]
            on = sign * (part @ w) < 1
            b = part[on] * weight[k : k + BLOCK][on, None]
            left += b.T @ part[on]
            right += b.T @ sign[on]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return w


def train_svm(units: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> Model:
    """Fit on labelled units. Kernel rows against the landmarks, Nystroem whitening, SVM, folded weights."""
    _, codes, w = _whole(landmarks)
    used = np.unique(np.append(0, codes))  # only these subsequences can have a weight
    basis = np.zeros((len(used), len(landmarks)))
    np.add.at(basis, (np.searchsorted(used, codes).ravel(), np.repeat(np.arange(len(landmarks)), codes.shape[1])), w.ravel())
    basis[0] = 0
    values, vectors = np.linalg.eigh(basis.T @ basis)
    keep = values > 1e-4 * values.max()
    white = basis @ (vectors[:, keep] / np.sqrt(values[keep]))
    place = np.zeros(64**3, dtype=np.int64)
    place[used] = np.arange(len(used))
    rows = np.empty((len(units), white.shape[1]))
    for k in range(0, len(units), BLOCK):
        _, codes, w = _whole(units[k : k + BLOCK])
        phi = np.zeros((len(codes), len(used)), dtype=np.float32)
        np.add.at(phi, (np.repeat(np.arange(len(codes)), codes.shape[1]), place[codes].ravel()), w.ravel())
        rows[k : k + BLOCK] = phi @ white.astype(np.float32)
    coef, bias = _svm(rows, y, weight)
    folded = np.zeros(64**3, dtype=np.float32)
    folded[used] = white @ coef
    return Model(folded, bias)


def _whole(units: list[str]):
    """The features of each unit's window; units to train on are no longer than one."""
    owner, windows = windows_of(units)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[first], *features([windows[k] for k in first])


def _learnable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, part for labelled rows that may be learnt from: crc32 of the id mod 4 is not 2."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = labels.where("doc_id is not null and toxic is not null").withColumn("part", part).where("part <> 2")
    return rows.groupBy("doc_id", "part").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_units: int = MAX_UNITS, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most about *max_docs* labelled documents (by hash of the id) and *max_units* units a class.

    *landmarks* units span the Nystroem space. Without toxic or without clean labels the score is the prior.

    Statistics of units are Spark aggregations over the sample; the driver gets bounded lists of units.
    A unit is labelled toxic if its share among toxic documents is significantly high; units of clean
    documents are labelled clean, and those that a first model mistakes are added. Texts that no toxic
    unit explains give their best unit as a witness for the second fit.
    """
    lab = cut(_learnable(labels))
    n = lab.count()
    share = min(1.0, max_docs / max(1, n))
    lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id"))  # at most about max_docs labels
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(64**3, dtype=np.float32), FLOOR, (float(np.log((n1 + 0.5) / (n0 + 0.5))), 0.0, 0.0, 0.0))

    def distinct_units(frames):
        for pdf in frames:
            pairs = [(u, y) for t, y in zip(pdf["text"], pdf["toxic"]) for u in {v for w in units_of(t) for v in pieces_of(w)}]
            yield pd.DataFrame(pairs, columns=["unit", "toxic"])

    units = sample.select("text", "toxic").mapInPandas(distinct_units, "unit string, toxic int")
    units = cut(units.groupBy("unit").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")))
    prior = n1 / (n1 + n0)
    p = F.col("a") / (F.col("a") + F.col("b"))
    gain = F.col("a") * F.log(F.greatest(p, F.lit(1e-9)) / prior) + F.col("b") * F.log(F.greatest(1 - p, F.lit(1e-9)) / (1 - prior))
    lift = (F.col("a") / n1) / ((F.col("b") + 0.5) / n0)
    toxic = units.withColumn("gain", gain).where((lift > 4) & (F.col("gain") > 9)).orderBy(F.desc("gain"), "unit").limit(max_units // 4).collect()
    clean = units.where("b > 0").orderBy(F.xxhash64("unit"), "unit").limit(max_units // 2).union(units.where("b > 0").orderBy(F.desc("b"), "unit").limit(max_units // 4)).where("a / %d < 2 * b / %d" % (n1, n0)).distinct().collect()
    if not toxic:
        toxic = units.withColumn("gain", gain).where("a >= 1").orderBy(F.desc("gain"), "unit").limit(20).collect()
    pos = {r.unit: r.a for r in toxic}
    pure = {r.unit: r.a / (r.a + r.b) for r in toxic}
    neg = {r.unit: 1.0 for r in clean if r.unit not in pos}

    def fitted() -> Model:
        order = sorted(pos, key=lambda u: -pos[u])
        marks = order[: landmarks // 2]
        marks += sorted(neg, key=lambda u: (-neg[u], hash_of(u)))[: landmarks - len(marks)]
        # A unit counts for either class by its shares, so its margin tends to twice its purity less one.
        padded = [(v, 0.1 * pos[u] ** 0.5 * pure[u]) for u in order[:MUTATED] for v in mutations(u) if v not in neg]
        rows = [(u, 1.0, a**0.5 * pure[u]) for u, a in pos.items()] + [(v, 1.0, w) for v, w in padded]
        rows += [(u, -1.0, a**0.5 * (1 - pure[u])) for u, a in pos.items() if pure[u] < 1]
        up = max(1.0, 0.5 * sum(neg.values()) / sum(w for *_, w in rows))
        rows = [(u, y, w * up) for u, y, w in rows] + [(u, -1.0, w) for u, w in neg.items()]
        names, y, w = [u for u, *_ in rows], np.array([y for _, y, _ in rows]), np.array([w for *_, w in rows])
        return train_svm(names, y, w, marks)

    for _ in range(2):
        model = fitted()
        best = _tops(sample, model)
        hard = best.where("toxic = 0").select(F.explode("tops").alias("t")).where("t.margin > -0.7").groupBy("t.unit").agg(F.count(F.lit(1)).alias("n"))
        for r in hard.orderBy(F.desc("n"), "unit").limit(max_units // 4).collect():
            for v in pieces_of(r.unit):
                if v not in pos:
                    neg[v] = neg.get(v, 1.0) + 2.0
    model = fitted()
    rows = _tops(sample, model).select("part", "toxic", *[F.coalesce(F.get("tops", F.lit(k))["margin"], F.lit(FLOOR)).alias(f"m{k}") for k in range(2)]).toPandas()
    held = rows[rows["part"] == 3]
    rows = held if (held["toxic"] == 1).sum() >= 30 else rows
    x = _design(rows["m0"].to_numpy(), rows["m1"].to_numpy())
    model.logistic = tuple(_logistic(x, rows["toxic"].to_numpy(float)).tolist())
    return model


def mutations(unit: str) -> list[str]:
    """*unit* with a character put in, once between each two of its own."""
    return [unit[:k] + "x.e-a*s"[k % 7] + unit[k:] for k in range(1, len(unit))]


def hash_of(unit: str) -> int:
    import zlib

    return zlib.crc32(unit.encode("utf-8", "surrogatepass"))


def _tops(rows: DataFrame, model: Model, n: int = 2) -> DataFrame:
    """part, toxic and the n best units of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 64**3 weights: a megabyte at any size of the corpus

    def tops(frames):
        for pdf in frames:
            got = top_units(pdf["text"].tolist(), shared.value, n)
            yield pd.DataFrame({"part": pdf["part"], "toxic": pdf["toxic"], "tops": [[{"margin": m, "unit": u} for m, u in g] for g in got]})

    return rows.select("part", "toxic", "text").mapInPandas(tops, "part long, toxic int, tops array<struct<margin:double,unit:string>>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc (a struct of all columns of *docs*, whatever their names) and toxicity, 0 to 1, for each row.

    A null or empty text, or one without units, scores as one far from any insult; repeated rows score
    alike; an empty table gives an empty one. Every text is read whole.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole(docs).alias("doc"))

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            texts, first, second = b.column(0).field("text"), [], []
            for k in range(0, len(texts), 256):
                for g in top_units(texts.slice(k, 256).to_pylist(), shared.value):
                    first.append(g[0][0] if g else FLOOR)
                    second.append(g[1][0] if len(g) > 1 else FLOOR)
            values = shared.value.score(np.array(first, dtype=float), np.array(second, dtype=float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], ["doc", "toxicity"])

    return rows.mapInArrow(scored, StructType([*rows.schema.fields, StructField("toxicity", DoubleType())]))
