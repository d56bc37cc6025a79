"""String functions of ``Series.str``, as Column -> Column; nulls stay null."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"\s"


def _whole(pattern: str):
    return lambda c: c.rlike(f"^{pattern}$")


def title(c: Column) -> Column:
    """Upper case for every letter after a non-letter, lower case for the others."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def swapcase(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def _class(chars: str | None) -> str:
    return _WHITE if chars is None else "[" + "".join(re.escape(x) for x in chars).replace("^", r"\^") + "]"


def lstrip(c: Column, to_strip: str | None = None) -> Column:
    return F.regexp_replace(c, f"^{_class(to_strip)}+", "")


def rstrip(c: Column, to_strip: str | None = None) -> Column:
    return F.regexp_replace(c, f"{_class(to_strip)}+$", "")


def strip(c: Column, to_strip: str | None = None) -> Column:
    return rstrip(lstrip(c, to_strip), to_strip)


def pad(c: Column, width: int, side: str = "left", fillchar: str = " ") -> Column:
    n = F.length(c)
    if side == "left":
        return F.when(n < width, F.lpad(c, width, fillchar)).otherwise(c)
    if side == "right":
        return F.when(n < width, F.rpad(c, width, fillchar)).otherwise(c)
    gap = width - n
    left = F.floor(gap / 2) + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.when(n < width, F.concat(F.repeat(F.lit(fillchar), left.cast("int")), c, F.repeat(F.lit(fillchar), (gap - left).cast("int")))).otherwise(c)


def zfill(c: Column, width: int) -> Column:
    signed = c.rlike("^[+-]")
    body = F.when(signed, F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise("")
    return F.when(F.length(c) < width, F.concat(sign, F.repeat(F.lit("0"), F.lit(width) - F.length(c)), body)).otherwise(c)


def contains(c: Column, pat: str, case: bool = True, regex: bool = True) -> Column:
    if not regex:
        return c.contains(pat) if case else F.lower(c).contains(pat.lower())
    return c.rlike(pat if case else f"(?i){pat}")


def match(c: Column, pat: str, case: bool = True) -> Column:
    return c.rlike(("" if case else "(?i)") + f"^(?:{pat})")


def find(c: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = F.locate(sub, c if end is None else F.substring(c, 1, end), start + 1) - 1
    return at.cast("long")


def rfind(c: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    part = c if end is None else F.substring(c, 1, end)
    back = F.locate(sub[::-1], F.reverse(part)) - 1
    at = F.length(part) - back - len(sub)
    return F.when(back < 0, -1).when(at < start, -1).otherwise(at).cast("long")


def index(c: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = find(c, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("long")).otherwise(at)


def rindex(c: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = rfind(c, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("long")).otherwise(at)


def replace(c: Column, pat: str, repl: str, n: int = -1, case: bool = True, regex: bool = True) -> Column:
    flags = "" if case else "(?i)"
    pattern = flags + (pat if regex else re.escape(pat))
    repl = re.sub(r"\\(\d)", r"$\1", repl) if regex else repl.replace("\\", "\\\\").replace("$", "\\$")
    if n < 0:
        return F.regexp_replace(c, pattern, repl)
    out = c
    for _ in range(n):  # one at a time; a replaced text is not looked at again as long as it doesn't match
        out = F.regexp_replace(out, f"^(?s)(.*?)(?:{pattern})", "$1" + repl)
    return out


def slice_(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    n = F.length(c)
    at = lambda k, other: F.lit(other) if k is None else F.lit(k) if k >= 0 else F.greatest(n + k, F.lit(0))
    if step in (None, 1):
        a, b = at(start, 0), n if stop is None else F.least(at(stop, 0), n)
        return F.substring(c, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))
    chars = F.split(c, "")
    if step > 0:
        last = n if stop is None else F.least(at(stop, 0), n)
        kept = F.filter(chars, lambda x, i: (i >= at(start, 0)) & (i < last) & ((i - at(start, 0)) % step == 0))
        return F.array_join(kept, "")
    first = F.least(n - 1, n - 1 if start is None else at(start, 0))
    end = F.lit(-1) if stop is None else at(stop, 0)
    kept = F.filter(chars, lambda x, i: (i <= first) & (i > end) & ((first - i) % -step == 0))
    return F.array_join(F.reverse(kept), "")


def slice_replace(c: Column, start: int | None = None, stop: int | None = None, repl: str = "") -> Column:
    return F.concat(slice_(c, 0, start or 0), F.lit(repl), slice_(c, stop) if stop is not None else F.lit(""))


def split(c: Column, pat: str | None = None, n: int = -1) -> Column:
    """Parts as an array; without a pattern, by runs of white space."""
    body, sep = (strip(c), r"\s+") if pat is None else (c, re.escape(pat) if len(pat) == 1 else pat)
    out = F.split(body, sep, n + 1 if n > 0 else -1)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(out) if pat is None else out


def rsplit(c: Column, pat: str | None = None, n: int = -1) -> Column:
    parts = split(c, pat)
    if n <= 0:
        return parts
    sep, extra = " " if pat is None else pat, F.size(parts) - n
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(extra, F.lit(1))), sep)
    return F.when(extra > 1, F.concat(F.array(head), F.slice(parts, extra + 1, F.lit(n)))).otherwise(parts)


def partition(c: Column, sep: str = " ", last: bool = False) -> Column:
    at = rfind(c, sep) if last else find(c, sep)
    none = F.array(F.lit(""), F.lit(""), c) if last else F.array(c, F.lit(""), F.lit(""))
    cut = F.array(F.substring(c, F.lit(1), at.cast("int")), F.lit(sep), F.substring(c, at.cast("int") + len(sep) + 1, F.length(c)))
    return F.when(at < 0, none).otherwise(cut)


def wrap(c: Column, width: int) -> Column:
    """Greedy lines of at most *width*: words are added to a line while they fit, longer ones are cut."""
    words = F.flatten(F.transform(F.split(strip(c), r"\s+"), lambda w: F.regexp_extract_all(w, F.lit(f"(.{{1,{width}}})"), F.lit(1))))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    fits = lambda s, w: F.length(s["line"]) + 1 + F.length(w) <= width
    step = lambda s, w: F.when(s["line"] == "", F.struct(s["done"].alias("done"), w.alias("line"))).when(fits(s, w), F.struct(s["done"].alias("done"), F.concat(s["line"], F.lit(" "), w).alias("line"))).otherwise(F.struct(F.concat(s["done"], s["line"], F.lit("\n")).alias("done"), w.alias("line")))
    return F.aggregate(words, start, step, lambda s: F.concat(s["done"], s["line"]))


def get(c: Column, i: int) -> Column:
    return slice_(c, i, None if i == -1 else i + 1)


def translate(c: Column, table: dict) -> Column:
    """Characters (or code points) mapped to text or None."""
    name = lambda k: chr(k) if isinstance(k, int) else k
    one = {name(k): name(v) for k, v in table.items() if v is not None and len(name(v)) == 1}
    gone = "".join(name(k) for k, v in table.items() if v is None)
    out = F.translate(c, "".join(one) + gone, "".join(one.values()))
    for k, v in table.items():
        if v is not None and len(name(v)) != 1:
            out = F.replace(out, F.lit(name(k)), F.lit(name(v)))
    return out


def normalize(c: Column, form: str) -> Column:
    """Unicode normalisation; Spark has no such function, so an Arrow batch function does it."""
    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return normalised(c)


FUNCTIONS = {
    "lower": F.lower, "upper": F.upper, "capitalize": capitalize, "title": title, "swapcase": swapcase, "startswith": lambda c, pattern: c.startswith(pattern), "endswith": lambda c, pattern: c.endswith(pattern),
    "strip": strip, "lstrip": lstrip, "rstrip": rstrip, "get": get, "isalnum": _whole(r"[\p{L}\p{N}]+"), "isalpha": _whole(r"\p{L}+"), "isdigit": _whole(r"\p{Nd}+"), "isspace": _whole(r"\s+"),
    "isnumeric": _whole(r"\p{N}+"), "isdecimal": _whole(r"\p{Nd}+"), "islower": lambda c: (c == F.lower(c)) & c.rlike(r"\p{Ll}"), "isupper": lambda c: (c == F.upper(c)) & c.rlike(r"\p{Lu}"), "istitle": lambda c: (c == title(c)) & c.rlike(r"\p{Lu}"),
    "center": lambda c, width, fillchar=" ": pad(c, width, "both", fillchar), "ljust": lambda c, width, fillchar=" ": pad(c, width, "right", fillchar), "rjust": lambda c, width, fillchar=" ": pad(c, width, "left", fillchar), "pad": pad, "zfill": zfill,
    "contains": contains, "match": match, "count": lambda c, pat: F.regexp_count(c, F.lit(pat)).cast("long"), "find": find, "index": index, "rfind": rfind, "rindex": rindex,
    "findall": lambda c, pat: F.regexp_extract_all(c, F.lit(f"({pat})"), F.lit(1)), "join": lambda c, sep: F.array_join(c, sep), "len": lambda c: F.length(c).cast("long"), "normalize": normalize, "repeat": lambda c, repeats: F.repeat(c, repeats),
    "replace": replace, "slice": slice_, "slice_replace": slice_replace, "split": split, "rsplit": rsplit, "translate": translate, "wrap": wrap, "decode": lambda c, encoding: F.decode(c, encoding), "encode": lambda c, encoding: F.encode(c, encoding),
    "partition": partition, "rpartition": lambda c, sep=" ": partition(c, sep, True),
}
