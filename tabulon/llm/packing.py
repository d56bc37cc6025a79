"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document's ids are cut into full windows and a remainder. The remainders are dealt evenly into
groups of about ``group_pieces``; in each group, longest first, every remainder goes to the open
window with the least room that still holds it, found by a segment tree indexed by remaining
capacity. Only lengths travel: ids never leave the task that made them unless asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from .tokens import TOKENIZER, encoder

WINDOW = 1_024
GROUP_PIECES = 65_536
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows counted by remaining capacity; finds the least capacity of at least a given size."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, size: int) -> int:
        """The least occupied capacity >= size, or -1."""
        k, count = self.leaves + size, self.count
        if count[k]:
            return size
        while k > 1:  # up until a right sibling holds something, then down its left edge
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; *lengths* must be decreasing and at most *window*."""
    tree, open_by = CapacityTree(window), [[] for _ in range(window + 1)]
    bins, offsets, made = [], [], 0
    for size in lengths:
        room = tree.tightest(size)
        if room < 0:
            at, room, made = made, window, made + 1
        else:
            at = open_by[room].pop()
            tree.add(room, -1)
        bins.append(at)
        offsets.append(window - room)
        if room > size:
            open_by[room - size].append(at)
            tree.add(room - size, 1)
    return bins, offsets


def tokenised_pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Full windows and remainders of each document's ids, the separator appended.

    doc_id, start, length, ids_crc32 (of little-endian 32-bit ids), doc_tokens; with ``with_ids``
    also the ids as bytes. A null or empty text is the separator alone.
    """

    def tokenise(batches):
        import pyarrow as pa

        e = encoder(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        for b in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = b"".join([*e.pieces(text.as_py() or ""), np.uint32(separator).astype("<u4").tobytes()])
                for start in range(0, len(ids), 4 * window):
                    part = ids[start : start + 4 * window]
                    for column, value in zip(out, (doc_id, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(tokenise, PIECE + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place every piece of *docs* (doc_id, text): its columns, sequence_id, offset.

    sequence_id is the group's number times 2**32 plus the window's number there; offsets in a window
    run without gaps from 0. Pieces are dealt by a hash of their place in the written table, so
    repeated rows, one document of any length and many small files spread evenly. Empty tables give an empty one.
    """
    pieces = cut(tokenised_pieces(docs, window, tokenizer, with_ids=with_ids))
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].tolist(), window)
        number = pdf.pop("grp").astype("int64") * (1 << 32) + np.array(bins, dtype=np.int64)
        return pdf.assign(sequence_id=number, offset=np.array(offsets, dtype=np.int64))

    schema = PIECE + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(place, schema)
