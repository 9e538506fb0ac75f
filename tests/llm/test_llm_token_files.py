import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetlens.llm import token_files
from streetlens.llm.token_files import PieceEncoder, SequenceFile, read_documents, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = PieceEncoder(PATH)


def whole(text):
    return ENCODER.whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_files_hold_all_ids_in_order(spark, clashing, tmp_path):
    manifest = write_token_files(clashing, PATH, str(tmp_path / "ids"), length=16, batch_rows=4)
    rows = clashing.select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    want, start = [], 0
    for r in order:
        ids = whole(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in read_documents(spark, manifest).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    everything = [i for r in order for i in whole(r.text)]
    for file in manifest.collect():
        tokens = SequenceFile(file.path)
        last = (file.n_ids - 1) // 16
        ids, mask = tokens.sequence(last)
        real = file.n_ids - 16 * last
        assert mask.tolist() == [True] * real + [False] * (16 - real)
        assert ids[:real].tolist() == everything[file.start + 16 * last:file.start + file.n_ids]
        assert tokens.ids(3, min(70, file.n_ids)).tolist() == everything[file.start + 3:file.start + min(70, file.n_ids)]


def test_no_documents(spark, no_documents, tmp_path):
    manifest = write_token_files(no_documents, PATH, str(tmp_path / "none"))
    assert manifest.count() == 0 and read_documents(spark, manifest).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcXYZÀéß×÷ .,!'<|>019\n\t\u0301日İΣ", "<|endoftext|>", "'ll"]), max_size=40).map("".join), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()), 1)
    assert ids.tolist() == [i for t in texts for i in whole(t)]
    assert counts.tolist() == [len(whole(t)) for t in texts]


def test_a_small_table_of_pieces_gives_the_same_ids():
    encoder = PieceEncoder(PATH, keep=3)
    for texts in (["one two three four five", None], ["five six", "one"], [""], ["two two 77 two", "Zoë"]):
        ids, counts = encoder.encode(pa.array(texts, pa.string()), 1)
        assert ids.tolist() == [i for t in texts for i in whole(t)]
        assert counts.tolist() == [len(whole(t)) for t in texts]


def test_texts_longer_than_a_piece_of_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_BYTES", 64)
    texts = ["short", "a longer text, " * 40, None, "", "Ünïcode wörds 123 " * 30, "x" * 500, "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in read_documents(spark, write_token_files(docs, PATH, str(tmp_path / "ids"), length=8, batch_rows=2)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = whole(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
