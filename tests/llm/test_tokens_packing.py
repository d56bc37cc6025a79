import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import packing, queries, tokens

PARTS = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "23", ".", "!!", "<|endoftext|>", "日", "本", "x" * 7, "'re", " ", "😀"]


def test_known_pre_tokens_agree_on_every_code_point_they_take():
    e = tokens.encoder()
    for c in map(chr, range(0x250)):
        for t in (f"a{c}b", c, f"1{c}2", f" {c} ", f"a{c}{c} b", f"'{c}", f"{c}\n{c} \n", f"{c} a{c}\n\n1"):
            assert e.raw(t) == e.whole(t).tobytes(), repr(t)


def test_known_pre_tokens_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    r, e = random.Random(3), tokens.Encoder(tokens.TOKENIZER, 10**9, 8)
    for _ in range(200):
        t = "".join(r.choice([*PARTS[:11], "y" * 100, " zz", "\t", "0" * 70]) + str(r.randint(0, 99)) for _ in range(60))
        if not e.beyond(t):
            assert e.raw(t) == e.whole(t).tobytes(), t


def test_each_pre_token_is_asked_for_once_and_long_texts_are_read_in_chunks():
    r, e = random.Random(5), tokens.Encoder(tokens.TOKENIZER, 30, 8)
    asked, ask = Counter(), e.known.tokenize
    e.known.tokenize = lambda w: asked.update([w]) or ask(w)
    for _ in range(300):
        t = "".join(r.choice([*PARTS[:11], "'ll", "'ve", "'", "\t \n", " ab", "é ", "y" * 20]) for _ in range(r.randint(30, 200)))
        parts = list(e.pieces(t))
        assert b"".join(parts) == e.whole(t).tobytes(), t
        assert len(parts) > 1 or len(t) < 60
    assert asked and max(asked.values()) == 1


@pytest.mark.parametrize("part", [" ", "!", "a", "\u0301", "日", "ab1 "])
def test_splicing_is_linear(part):
    e, took = tokens.encoder(), []
    for n in (500_000, 2_000_000):
        text = part * (n // len(part))
        start = time.process_time()
        got = e.count(text)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 2
    assert got == len(e.whole(text))


def test_splicing_equals_whole_text():
    r, e = random.Random(1), tokens.encoder()
    small = tokens.Encoder(tokens.TOKENIZER, 40, 8)
    for _ in range(800):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(30, 160)))
        assert list(small.ids(t)) == list(e.whole(t)), t
    for t in ("a" * 3000, " " * 3000, "!" * 3000, "ab1" * 1000):  # overlaps must widen, or chunks lengthen
        assert list(small.ids(t)) == list(e.whole(t))


@pytest.mark.parametrize("name", [tokens.TOKENIZER, "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_rows(odd, empty, name):
    e = tokens.encoder(name)
    got = tokens.count_tokens(odd, name).collect()
    assert len(got) == 10
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(e.whole(texts[r.doc_id])))
    assert tokens.count_tokens(empty, name).count() == 0


def test_query_counts(spark, sf):
    e = tokens.encoder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_token_counts(spark, sf).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(k, len(t.encode()), n := len(e.whole(t)), n > 512) for k, t in texts.items()}


def test_best_fit_is_the_tightest():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 64) for _ in range(500)), reverse=True)
    bins, offsets = packing.best_fit(lengths, 64)
    room = {}
    for size, b, o in zip(lengths, bins, offsets):
        fits = [x for x in room.values() if x >= size]
        assert (room[b] == min(fits)) if fits else b not in room
        assert 64 - room.get(b, 64) == o
        room[b] = room.get(b, 64) - size
    assert min(room.values()) >= 0


def check_packed(rows, texts, e):
    for doc in {r.doc_id for r in rows}:
        ids = np.append(e.whole(texts[doc]), 0).astype("<u4")
        mine = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc})
        at = 0
        for start, length, crc, n in mine:
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing(spark, sf, odd, empty):
    e = tokens.encoder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_packing(spark, sf).collect()
    used = check_packed(rows, texts, e)
    assert sum(r.length for r in rows) / (1024 * used) > 0.97
    check_packed(packing.pack(odd).collect(), {r.doc_id: r.text or "" for r in odd.collect()}, e)
    assert packing.pack(empty).count() == 0
    kept = packing.pack(odd, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)
    many = packing.pack(odd, group_pieces=4).collect()
    check_packed(many, {r.doc_id: r.text or "" for r in odd.collect()}, e)


def test_pieces_of_many_small_files_are_dealt_evenly(spark):
    docs = spark.range(0, 2_000, numPartitions=200).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    rows = packing.pack(docs, group_pieces=125).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 2_000 and len(sizes) == 16 and max(sizes.values()) < 250
