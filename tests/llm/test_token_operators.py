"""Packing and Huffman-coded ids: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest_llm import odd_rows
from ragtide.llm import huffman_ids, packing
from ragtide.llm.encode_ids import Encoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_library(path):
    enc = Encoder(path)
    texts = [r[1] or "" for r in odd_rows()] + [
        "  a  b\n\n c ", "it's DON'T we'll 'S", "<|endoftext|> hi", "a\x1cb\x85c\x1f", "x²y½ 12", "…—“q” 'tis", "ǅ İ", "tab\t\tx ", " "]
    flat, n = enc.encode(texts)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_are_the_library_s(spark, path):
    """Against a freshly loaded tokenizer: literal added tokens are one id each, also within packing and blocks."""
    fresh = Tokenizer.from_file(path)
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a<|startoftext|>b", "x <|ENDOFTEXT|> y", "<|endoftext|><|endoftext|>  it's", "no token here",
             "naïve 日本語 <|endoftext|>", "<|endoftext", "", "a <| b"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert fresh.token_to_id("<|endoftext|>") in want[0]
    flat, n = Encoder(path).encode(texts)
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = {i: (len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for i, w in enumerate(want)}
    packed = packing.pack(docs, path, 2, 4096).where("length = doc_tokens").collect()
    assert packed and all((r.doc_tokens, r.ids_crc32) == crc[r.doc_id] for r in packed)
    folder = huffman_ids.fresh_folder(spark)
    huffman_ids.write_ids(docs, folder, path, 2, block_ids=10)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in huffman_ids.read_ids(spark, folder).collect()} == crc


def by_hand(path, end):
    enc = Encoder(path)
    rows = [(r[0], enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in odd_rows()]
    return rows


@pytest.mark.parametrize("window,buffer", [(4096, 1 << 20), (64, 300)])
def test_packing(odd, window, buffer, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_IDS", buffer)
    rows = packing.pack(odd, WORD, 2, window).collect()
    want = sorted((tuple(ids) for _, ids in by_hand(WORD, 2)))
    texts, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = []
    for parts in texts.values():  # repeated rows follow one another: a new one starts at 0
        for start, ids in parts:
            if start == 0:
                got.append([])
            assert start == len(got[-1])
            got[-1] += ids
    assert sorted(map(tuple, got)) == want
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window


def test_windows_are_the_cheapest():
    """The monotone queue finds what trying all cuts finds."""
    rng = random.Random(3)
    for _ in range(30):
        window, n = 32, rng.randrange(40, 120)
        place = np.array([0, *sorted(rng.sample(range(1, n), min(n - 1, n // 2))), n])
        if np.diff(place).max() > window:
            continue
        cost = np.array([0.0] + [rng.choice([0, 1, 5]) for _ in place[1:]])
        best = {0: 0.0}
        for j in range(1, len(place)):
            best[j] = min(best[i] + (window - (place[j] - place[i])) for i in range(j) if place[j] - place[i] <= window)
            fee = [best[i] + window / 8 for i in range(j) if place[j] - place[i] in (16, 8, 4, 2)]
            best[j] = min([best[j], *fee]) + cost[j]
        ends = packing.best_windows(place, cost, window, False)
        at = {int(p): k for k, p in enumerate(place)}
        total, last = 0.0, 0
        for e in ends:
            pad = window - (e - last)
            total += min(pad, window / 8 if e - last in (16, 8, 4, 2) else pad) + cost[at[e]]
            last = e
        assert abs(total - best[at[ends[-1]]]) < 1e-9


def test_huffman_round_trip(spark, odd, none):
    folder = huffman_ids.fresh_folder(spark)
    huffman_ids.write_ids(odd, folder, BYTE, 0, block_ids=500)
    got = huffman_ids.read_ids(spark, folder).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert sorted(map(str, ((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got))) == sorted(map(str, by_hand(BYTE, 0)))
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named)
    empty = huffman_ids.fresh_folder(spark)
    huffman_ids.write_ids(none, empty, BYTE, 0)
    assert huffman_ids.read_ids(spark, empty).count() == 0
    assert packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("bits", [4, 6, 18])
def test_code_lengths(bits):
    rng = np.random.default_rng(bits)
    counts = np.zeros(40, np.int64)
    counts[:16] = (2.0 ** np.arange(16)).astype(int)
    lengths = huffman_ids.code_lengths(counts, bits)
    assert lengths.max() <= bits and (lengths[16:] == 0).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0  # the code is full
    ids = rng.integers(0, 16, 5000).astype(np.uint32)
    data = huffman_ids.encode_block(ids, [5, None], np.array([4000, 1000]), huffman_ids.canonical_codes(lengths), lengths)
    names, n, back = huffman_ids.decode_block(data, *huffman_ids.decode_table(lengths))
    assert names == [5, None] and n.tolist() == [4000, 1000] and (back == ids).all()


def test_one_id_only():
    lengths = huffman_ids.code_lengths(np.array([0, 9]))
    data = huffman_ids.encode_block(np.ones(9, np.uint32), [1], np.array([9]), huffman_ids.canonical_codes(lengths), lengths)
    assert huffman_ids.decode_block(data, *huffman_ids.decode_table(lengths))[2].tolist() == [1] * 9
