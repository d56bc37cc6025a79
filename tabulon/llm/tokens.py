"""Token counts by overlap resynchronisation.

A text no longer than ``chunk_chars`` is encoded at once. A longer one is read in chunks that end with a
proven pre-token or, where pre-tokens aren't known beforehand, is encoded in overlapping chunks with
offsets. Two neighbouring chunks are spliced at a boundary that both encodings have and
that is proven stable: the code point before it is a letter or a number and the one after it is of
another class, so whatever precedes, a pre-token ends there. Where the encodings disagree the overlap is
doubled; where the chunk holds no such boundary it is doubled itself, so that the work stays linear. The ids
are those of the whole text; only one chunk's encoding is held at a time.

All ids come from the library for the tokenizer's file. Of the byte-level vocabulary, whose pre-tokens are
encoded one by one by its model, a worker keeps the ids of those that it has seen.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.json"
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 128
#: Pre-tokens that a worker keeps, and the longest of them.
KNOWN, KNOWN_CHARS = 400_000, 64
#: A pre-token that ends so many code points before a chunk's end is the same in the whole text (the pattern looks no further).
LOOKAHEAD = 4


def _stable(text: str, p: int, special: tuple[str, ...]) -> bool:
    """Whether a pre-token ends at *p* whatever stands before it."""
    before, after = unicodedata.category(text[p - 1])[0], unicodedata.category(text[p])
    if before not in "LN" or after[0] == before or after in ("Cn", "Co", "Cs"):  # a library may class unassigned ones otherwise
        return False
    return not any(s in text[max(0, p - len(s) + 1) : p + len(s) - 1] for s in special)


def _boundary(text: str, low: int, high: int, special: tuple[str, ...]) -> int:
    """The last proven stable boundary above *low* and below *high*; 0 if there is none."""
    return next((p for p in range(high - 1, low, -1) if _stable(text, p, special)), 0)


def spliced(text: str, encode: Callable, chunk: int, overlap: int, special: tuple[str, ...] = ()) -> Iterator[np.ndarray]:
    """Yield the ids of *text*, chunk by chunk. ``encode(str)`` returns (ids, end offsets in code points)."""
    n, base, done = len(text), 0, 0  # the chunk at hand starts at base; its tokens up to done are out
    end = min(n, chunk)
    ids, ends = encode(text[:end])
    while end < n:
        at, reach = _boundary(text, done, end, special), overlap
        while at:
            start, stop = max(base, at - reach), min(n, at + chunk)
            right, right_ends = encode(text[start:stop])
            right_ends = right_ends + start
            if _has(ends, at) and _has(right_ends, at):
                break
            if start > base:
                reach *= 2
            else:
                at, reach = _boundary(text, done, at, special), overlap
        if at:
            yield ids[np.searchsorted(ends, done, "right") : np.searchsorted(ends, at, "right")]
            base, done, end, ids, ends = start, at, stop, right, right_ends
        else:
            end = min(n, 2 * end - base)
            ids, ends = encode(text[base:end])
            ends = ends + base
    yield ids[np.searchsorted(ends, done, "right") :]


def _has(ends: np.ndarray, at: int) -> bool:
    k = np.searchsorted(ends, at)
    return bool(k < len(ends) and ends[k] == at)


def _pattern(limit: int) -> str:
    """The byte-level pre-token pattern, its classes spelled out up to *limit*; contractions can't follow a space."""
    letters, numbers = (re.escape("".join(c for c in map(chr, range(limit)) if unicodedata.category(c)[0] == k)) for k in "LN")
    return rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"


#: The byte-level alphabet: a visible Latin-1 character for each byte, so that no vocabulary entry holds a blank.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(_VISIBLE)))}


class Known(dict):
    """The ids of byte-level pre-tokens as little-endian 32-bit integers; the library's model is asked for those not yet seen.

    When full, the half that came first stays: frequent pre-tokens come early.
    """

    def __init__(self, tokenize: Callable, whole: Callable):
        self.tokenize, self.whole = tokenize, whole

    def __missing__(self, word: str) -> bytes:
        if len(word) > KNOWN_CHARS:
            return self.whole(word).tobytes()
        found = [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        if len(self) >= KNOWN:
            first = list(islice(self.items(), KNOWN // 2))
            self.clear()
            self.update(first)
        self[word] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids


class Encoder:
    """Ids of whole texts, as the library for the tokenizer's file gives them."""

    def __init__(self, name: str, chunk: int, overlap: int):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap, self.special, self.words = chunk, overlap, (), None
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            self.whole, self.chunk = lambda text: np.array(model.encode(text, num_threads=1), dtype="<u4"), float("inf")
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.whole = lambda text: np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        if name != TOKENIZER:  # stable boundaries are proven for the byte-level pattern only
            self.chunk = float("inf")
            return
        self.words = re.compile(_pattern(0x250)).findall
        #: Beyond U+024F the pattern and the library may class a code point otherwise (those up to it are compared in the tests).
        beyond = re.compile("[^\x00-ɏ]").search
        self.beyond = lambda text: any(s in text for s in self.special) or bool(beyond(text))
        self.known = Known(self.library.model.tokenize, self.whole)

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of *text*, read a chunk at a time: those that end right before a chunk's end are read again with the next."""
        at, n, reach = 0, len(text), self.chunk
        while at < n:
            end = min(n, at + reach)
            words, done = self.words(text, at, end), end
            while end < n and words and done > end - LOOKAHEAD:
                done -= len(words.pop())
            if words:
                yield words
                at, reach = done, self.chunk
            else:
                reach *= 2

    def raw(self, text: str) -> bytes:
        """The ids of *text*, encoded at once, as little-endian 32-bit integers."""
        if self.words is None or self.beyond(text):
            return self.whole(text).tobytes()
        return b"".join(map(self.known.__getitem__, self.words(text)))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of *text* and where the token, or the pre-token that it belongs to, ends."""
        if self.beyond(text):
            e = self.library.encode(text, add_special_tokens=False)
            return np.array(e.ids, dtype="<u4"), np.array([b for _, b in e.offsets], dtype=np.int64)
        words = self.words(text)
        parts = list(map(self.known.__getitem__, words))
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.repeat(ends, [len(p) // 4 for p in parts])

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of *text*, a part at a time, as little-endian 32-bit integers."""
        if len(text) > self.chunk and self.words is not None and not self.beyond(text):
            for words in self._pretokens(text):
                yield b"".join(map(self.known.__getitem__, words))
        elif len(text) > self.chunk:
            for ids in spliced(text, self.offsets, self.chunk, self.overlap, self.special):
                yield ids.tobytes()
        elif text:
            yield self.raw(text)

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) // 4

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)), dtype="<u4")


@lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(name, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of *docs* (doc_id, text; other columns are ignored).

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table
    gives an empty one. One narrow pass: no shuffle, no state beyond a chunk and the known pre-tokens.
    """

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        e = encoder(tokenizer, chunk_chars, overlap_chars)
        for b in batches:
            texts = b.column(1)
            n = [e.count(t.as_py()) if t.is_valid else 0 for t in texts]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
