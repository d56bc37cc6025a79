"""Merges and alignment. Spark chooses the physical join; ``hint`` and ``broadcast`` pass through."""

from __future__ import annotations

import operator
from functools import reduce as fold

from pyspark.sql import functions as F

from ..frame import ROW, Frame, _aligned, as_list, key_column, physical
from ..functions import scalar as S

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "left_outer": "left", "right_outer": "right", "full_outer": "full"}


def merge(left: Frame, right: Frame, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, suffixes=("_x", "_y")) -> Frame:
    """Equi-join on labels or index. Null keys match nothing; a key of the same label on both sides appears once."""
    if how not in HOW:
        raise ValueError(f"how is one of {sorted(HOW)}")
    if on is None and left_on is None and right_on is None and not (left_index or right_index):
        on = [x for x in left._labels if x in right._labels]
        if not on:
            raise ValueError("there is no common label to merge on")
    lk = as_list(on) if on is not None else as_list(left_on) if left_on is not None else []
    rk = as_list(on) if on is not None else as_list(right_on) if right_on is not None else []
    lcols = [F.col(f"`l{left._cols.index(left._where_label(k))}`") for k in lk] if not left_index else [F.col(f"lk{i}") for i in range(len(left._keys))]
    rcols = [F.col(f"`r{right._cols.index(right._where_label(k))}`") for k in rk] if not right_index else [F.col(f"rk{i}") for i in range(len(right._keys))]
    if len(lcols) != len(rcols):
        raise ValueError("as many keys are needed on either side")
    a = left.df.select(*[F.col(k).alias(f"lk{i}") for i, k in enumerate(left._keys)], *[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left._cols)])
    b = right.df.select(*[F.col(k).alias(f"rk{i}") for i, k in enumerate(right._keys)], *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(right._cols)])
    rows = a.join(b, fold(operator.and_, [x == y for x, y in zip(lcols, rcols)]), HOW[how])
    shared = {k for k, r in zip(lk, rk) if k == r} if not (left_index or right_index) else set()
    data = {}
    for i, x in enumerate(left._labels):
        j = right._labels.index(x) if x in right._labels else None
        if x in shared:
            data[x] = F.coalesce(F.col(f"l{i}"), F.col(f"r{j}")) if HOW[how] in ("right", "full") else F.col(f"l{i}")
        else:
            data[physical(x) + suffixes[0] if j is not None else x] = F.col(f"l{i}")
    for i, x in enumerate(right._labels):
        if x in shared:
            continue
        name = physical(x) + suffixes[1] if x in left._labels else x
        if name in data:
            raise ValueError(f"the label {name!r} occurs twice; give suffixes")
        data[name] = F.col(f"r{i}")
    keys, names = None, None
    if left_index and right_index:
        keys, names = [F.coalesce(x, y) for x, y in zip(lcols, rcols)], left._s["names"]
    elif left_index:
        keys, names = [F.col(f"rk{i}") for i in range(len(right._keys))], right._s["names"]
    elif right_index:
        keys, names = [F.col(f"lk{i}") for i in range(len(left._keys))], left._s["names"]
    out = rows.select(*[k.alias(key_column(i)) for i, k in enumerate(keys or [])], *[c.alias(physical(n)) for n, c in data.items()])
    if keys is None:
        return Frame(out)._new(labels=list(data))
    out = out.withColumn(ROW, F.monotonically_increasing_id())
    return Frame(_state={"df": out, "keys": [key_column(i) for i in range(len(keys))], "names": list(names), "labels": list(data), "cols": [physical(n) for n in data], "order": [ROW]})


def combine_first(left: Frame, right: Frame) -> Frame:
    """Left's values where valid, else right's; the union of rows and labels."""
    frame, found = _aligned(left, [right[x] for x in right._labels])
    theirs, data = {s.name: s for s in found}, {}
    for x in sorted({*left._labels, *right._labels}, key=physical):
        mine = F.col(f"`{frame._where_label(x)}`") if x in left._labels else None
        other = theirs[x].col if x in theirs else None
        data[x] = other if mine is None else mine if other is None else F.coalesce(S.valid(mine, left._series(x).kind), other)
    return frame._select(data)


def align(left: Frame, right: Frame, join="outer", axis=None):
    """Both tables over the joined index, and over the joined labels."""
    labels = left._labels if axis in (0, "index") else [x for x in left._labels if x in right._labels] if join == "inner" else list(dict.fromkeys([*left._labels, *right._labels]))
    frame, found = _aligned(left, [right[x] for x in right._labels], join if axis in (None, 0, "index") else "left")
    theirs = {s.name: s.col for s in found}
    none = F.lit(None).cast("double")
    a = frame._select({x: F.col(f"`{frame._where_label(x)}`") if x in left._labels else none for x in labels})
    b = frame._select({x: theirs.get(x, none) for x in (right._labels if axis in (0, "index") else labels)})
    return a, b
