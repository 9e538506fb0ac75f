import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from streetlens.llm.pieces import Pieces, Segments, char_length, decode, decode_pieces, encode_pieces, stream

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = Pieces(PATH)


def best(text):
    """Highest total score by trying all pieces at all places; ties go to the longer last piece."""
    data = (" " + text).encode() if text else b""
    found = {0: (0, None)}
    for end in range(1, len(data) + 1):
        if end < len(data) and data[end] & 0xC0 == 0x80:
            continue
        for start in sorted(found):
            known = PIECES.by_bytes.get(data[start:end])
            if known or char_length(data[start]) == end - start:
                score = found[start][0] + (known[1] if known else PIECES.unknown)
                if end not in found or score > found[end][0]:
                    found[end] = score, start
    out, end = [], len(data)
    while end:
        start = found[end][1]
        known = PIECES.by_bytes.get(data[start:end])
        out = ([known[0]] if known else [int(PIECES.byte_ids[b]) for b in data[start:end]]) + out
        end = start
    return out


def samples():
    rng = random.Random(2)
    texts = ["", " ", "a" * 300, "ab" * 90, "日本 ▁ é𝔸", "\n\n x"]
    texts += ["".join(rng.choice("etha in\né.9日") for _ in range(rng.randrange(80))) for _ in range(80)]
    return texts + ["".join(rng.choice("ethaionrs") for _ in range(rng.randrange(33, 150))) for _ in range(20)]


def test_lanes_and_streams_find_the_best_path():
    texts = samples()
    ids, counts, flat, edges = Segments(PIECES).encode(pa.array(texts))
    stops = np.cumsum(counts)
    for text, stop, count in zip(texts, stops, counts, strict=True):
        assert ids[stop - count:stop].tolist() == best(text)
        if text:
            assert list(stream(PIECES, (" " + text).encode())) == best(text)
    back, ends = decode(PIECES, ids, counts)
    assert np.array_equal(back, flat) and np.array_equal(ends, edges)


def test_ids_are_given_out_before_the_text_ends():
    given = stream(PIECES, b" the same words and more words" * 200)
    assert [next(given) for _ in range(50)] == best("the same words and more words" + " the same words and more words" * 199)[:50]


def test_documents(spark, clashing, no_documents):
    encoded = encode_pieces(clashing, PATH, clashing.columns)
    rows = encoded.collect()
    assert len(rows) == clashing.count()
    for r in rows:
        if len(r.row.text or "") < 2000:
            assert r.ids == best(r.row.text or "")
        assert r.round_trip and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for r in decode_pieces(encoded, PATH).collect():
        assert r.text == (r.row.text or "")
    assert encode_pieces(no_documents, PATH).count() == 0
