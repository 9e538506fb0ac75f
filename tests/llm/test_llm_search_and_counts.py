import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetlens.llm import components
from streetlens.llm.components import connected_components, value_filter
from streetlens.llm.token_counts import Counter, TokenTree, edited_token_counts
from streetlens.llm.topk_search import Best, max_score_search, search_shard

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
COUNTER = Counter(RANKS, PATTERN)


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (7, 4096), (16, 3)])
def test_search_equals_brute_force(spark, shard, block):
    rng = random.Random(shard)
    rows = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.25, 0.3, 0.9]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (250, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (None, [0.5] * 6), (400, []), (450, [0.9, 0.9])]
    rows += [rows[7], rows[7]]
    vectors = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id bigint, embedding array<float>, rank string, score string").repartition(3)
    got = {}
    for r in max_score_search(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=shard, block_queries=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.vec_id not in (200, 250, 300, 350)]
    good = [(i, [int(256 * x // 1) for x in v]) for i, v in good if v is not None]
    want = {}
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:5]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert max_score_search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert max_score_search(vectors, vectors.filter("vec_id = -1")).count() == 0


@pytest.mark.parametrize("size", [4e5, 3e6, 7e6])
def test_large_scores_are_exact(spark, size):
    """Sums around 2**53 and more, which doubles do not hold."""
    rows = [(0, [size, size, 1.0])] + [(i, [size, size - i % 3, float(-i)]) for i in range(1, 40)] + [(50, [-size, 3.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in max_score_search(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=9).collect()}
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:5]
            assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]


def test_scores_beyond_a_long_are_an_error():
    best = Best(1, 2)
    vectors = np.full((3, 2), 2**40, np.int64)
    with pytest.raises(OverflowError):
        search_shard(best, np.array([0]), vectors[:1], np.array([1, 2, 3]), vectors)
    # terms of both signs may go beyond a long on the way
    vectors = np.array([[2**40, 2**40], [2**40, -2**40 + 3]], np.int64)
    search_shard(best, np.array([0]), vectors[:1], np.array([0, 2]), vectors)
    assert best.ids[0].tolist() == [2] and best.scores[0].tolist() == [3 * 2**40]


def test_trees_follow_edits():
    rng = random.Random(5)
    signs = "ab c  d\n\n 's12 é!?.日 \t'll"
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 60, 300])))
        tree = TokenTree(text, COUNTER)
        for _ in range(rng.randrange(1, 8)):
            start, removed = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 4, 60, 900])
            inserted = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 50])))
            tree.edit(start, removed, inserted)
            text = text[:start] + inserted + text[start + removed:]
            assert tree.text() == text and tree.signs == len(text) and tree.tokens == len(COUNTER.encode(text))


def test_an_edit_counts_little_anew():
    tree = TokenTree("some words of a long text. " * 5000, COUNTER)
    tree.edit(60_000, 4, "new")
    assert tree.recounted < 12


def test_documents_with_edits(spark, clashing, no_documents):
    edits = """[{"start": 3, "removed": 2, "inserted": " in"}, null, {"removed": 1, "inserted": "x"},
        {"start": 1000000, "inserted": " end"}, {"start": 0, "removed": 1}]"""
    kind = "array<struct<start:int,removed:int,inserted:string>>"
    docs = clashing.withColumn("edits", F.when(F.col("doc_id") != 4, F.from_json(F.lit(edits), kind)))
    for r in edited_token_counts(docs, RANKS, PATTERN, ["doc_id", "text"]).collect():
        text = r.row.text or ""
        assert r.n_before == len(COUNTER.encode(text))
        if r.row.doc_id not in (4, None):
            text = ((text[:3] + " in" + text[5:]) + " end")[1:]
        assert (r.n_tokens, r.n_chars, r.n_edits) == (len(COUNTER.encode(text)), len(text), 0 if r.row.doc_id in (4, None) else 3)
    empty = no_documents.withColumn("edits", F.lit(None).cast(kind))
    assert edited_token_counts(empty, RANKS, PATTERN).count() == 0


def test_components(spark):
    links = [(5, 3), (3, 5), (3, 8), (20, 21), (30, 30), (None, 3), (9, None)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {5: 3, 3: 3, 8: 3, 20: 20, 21: 20, 30: 30} | {i: 100 for i in range(100, 141)} | {i: 1000 for i in range(1000, 1060)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_filters_never_drop_a_member(spark):
    values = np.arange(-5000, 5000) * 977_331
    bits = value_filter(spark.createDataFrame([(int(v),) for v in values], "v bigint")).value
    assert components.maybe(bits, values).all()
    assert components.maybe(bits, values + 1).mean() < 0.01


def test_filters_grow_with_their_values(spark):
    assert components.filter_bits(0) == components.filter_bits(1) == 8 * components.SLICE_BYTES
    assert components.filter_bits(1 << 20) == 1 << 24 and components.filter_bits(1 << 40) == components.MOST_BITS
    values = np.arange(100_000) * 48_271
    known = spark.range(100_000).selectExpr("id * 48271 AS v").repartition(5)
    bits = value_filter(known.union(known)).value
    assert 8 * len(bits) == 1 << 22 and components.maybe(bits, values).all() and components.maybe(bits, values + 1).mean() < 1 / 16
    none = value_filter(spark.createDataFrame([(None,)], "v bigint")).value
    assert not components.maybe(none, values).any()
