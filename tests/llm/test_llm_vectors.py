"""Whitening and product codes: linear algebra and brute force on small vectors, odd rows, SQL."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetlens.llm import vector_codes
from streetlens.llm.queries import ORACLES
from streetlens.llm.vector_codes import codebooks_digest, compress_vectors, nearest, with_label_errors
from streetlens.llm.whitening import eigenvalues_above, leading_pairs, products, square_sums, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, `meta.x` string, error string, component string"


def table(spark, vectors, labels=None, ids=None):
    rows = [(ids[i] if ids else i, v, labels[i] if labels else None, "r", "m", "e", "c") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, 0.2, d)).astype(np.float32)


@pytest.fixture(scope="module")
def mixed(spark):
    """Sound vectors with repeats, and every kind of unusable one."""
    sound = vectors(1, 60, 6)
    rows = [v.tolist() for v in sound] + [sound[3].tolist()] * 20
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], [1e30] * 6]
    labels = [i % 3 if i % 4 else None for i in range(len(rows) + len(bad))]
    return table(spark, rows + bad, labels), np.floor(1024 * np.array(rows, float)).astype(np.int64), labels[:len(rows)]


@pytest.mark.parametrize("seed", range(6))
def test_counts_follow_the_spectrum(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((9, 9))
    a = a + a.T
    if seed % 2:
        a[0, 0] = a[1, 1] = a[2, 2] = 0
    values = np.linalg.eigvalsh(a)
    for shift in [*((values[1:] + values[:-1]) / 2), -100.0, 0.0, 100.0]:
        assert eigenvalues_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("spectrum", [
    [9, 5, 4, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [1e12, 1, 1e-3, 0], [3, 3, 3, 1], [0, 0, 0, 0], [7, 0, 0, 0], [2.5e-9, 2e-9, 1e-9, 0.5e-9]])
def test_leading_pairs(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((len(spectrum), len(spectrum))))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, found = leading_pairs(a, 3)
    top = max(spectrum)
    assert len(values) == sum(s > 1e-14 * top for s in spectrum[:3])
    assert np.allclose(values, spectrum[:len(values)], rtol=0, atol=1e-13 * top)
    assert np.allclose(a @ found, found * values, atol=1e-13 * top) and np.allclose(found.T @ found, np.eye(len(values)), atol=1e-12)


def test_exact_sums_of_large_entries():
    z = np.array([[1 << 47, -3], [5, 1 << 30], [(1 << 47) - 1, 7]])
    wide = z.astype(object)
    assert (products(z) == wide.T @ wide).all()
    assert square_sums(z) == [None, (1 << 60) + 25, None]
    assert square_sums(z[1:2]) == [(1 << 60) + 25]


def test_whitening_equals_eigenvectors(mixed, spark):
    df, x, _ = mixed
    got = whiten(df, 3, carry=["vec_id", "meta.x"])
    rows = got.select("row.vec_id", "row.`meta.x`", *[c for c in got.columns if c != "row"]).collect()
    n, s = len(x), x.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vecs = values[::-1][:3], vecs[:, ::-1][:, :3]
    want = (x - x.mean(axis=0)) @ vecs / np.sqrt(values)
    assert len(rows) == 3 * n
    for r in rows:
        assert r.n == n and r.deviation == ((n * x[r.vec_id] - s) ** 2).sum() and r["meta.x"] == "m"
        assert abs(abs(r.whitened) - abs(want[r.vec_id, r.component - 1])) < 1e-10
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(np.cov(x.T, bias=True)))
        assert r.identity_error < 1e-12
    signs = {(r.component, r.whitened * want[r.vec_id, r.component - 1] > 0) for r in rows if abs(r.whitened) > 1e-9}
    assert len(signs) == 3


@pytest.mark.parametrize("rows", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_whitening_without_variance(spark, rows):
    got = whiten(table(spark, rows))
    assert got.columns == ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_whitening_of_a_line(spark):
    rows = whiten(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(5)])).collect()
    assert {r.component for r in rows} == {1} and all(abs(r.explained - 1) < 1e-12 for r in rows)


def brute(rows, entries):
    distance = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return distance.argmin(axis=1), distance.min(axis=1)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 80), st.integers(1, 5), st.integers(1, 30), st.sampled_from([2, 5, 1000, 4_000_000]), st.sampled_from([1, 4, 1024]))
def test_trie_finds_the_nearest(seed, n, width, k, spread, subtree):
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(-spread, spread, (n, width)), axis=0)
    entries = rng.integers(-spread, spread, (k, width))
    before, vector_codes.SUBTREE = vector_codes.SUBTREE, subtree
    try:
        got = nearest(rows, entries)
    finally:
        vector_codes.SUBTREE = before
    want = brute(rows, entries)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def reference(x, order, parts, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry."""
    pad = -x.shape[1] % parts
    x = np.pad(x, ((0, 0), (0, pad)))
    width = x.shape[1] // parts
    codes, error, books = [""] * len(x), np.zeros(len(x), np.int64), []
    for p in range(parts):
        part = x[:, p * width:(p + 1) * width]
        book = part[order[:entries]].copy()
        for _ in range(rounds):
            near, _ = brute(part, book)
            for j in set(near.tolist()):
                book[j] = part[near == j].sum(axis=0) // (near == j).sum()
        near, far = brute(part, book)
        codes, error = [c + f"{j:02x}" for c, j in zip(codes, near)], error + far
        books.append(book)
    return codes, error, np.stack(books)


@pytest.mark.parametrize("parts, entries", [(2, 16), (3, 256), (4, 5), (6, 1)])
def test_codes_equal_brute_force(mixed, parts, entries):
    df, x, labels = mixed
    coded = with_label_errors(compress_vectors(df, parts, entries, carry=["label", "meta.x"]))
    codes, error, books = reference(x, np.arange(len(x)), parts, entries, 4)
    sums = collections.Counter()
    for name, e in zip(labels, error):
        sums[name] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    got = {r.row.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in coded.collect()}
    assert got == {i: (codes[i], error[i], sums[labels[i]], digest) for i in range(len(x))}
    assert codebooks_digest(books) == digest


def test_codes_of_null_and_repeated_ids(spark):
    x = vectors(3, 12, 4)
    ids = [None, None, 5, 5, 5, 1, 0, 9, 8, 7, 6, 4]
    coded = compress_vectors(table(spark, x.tolist(), ids=ids), 2, 4)
    whole = np.floor(1024 * x.astype(float)).astype(np.int64)
    order = np.array(sorted(range(12), key=lambda i: (ids[i] is None, ids[i] or 0, whole[i].tolist())))
    codes, error, _ = reference(whole, order, 2, 4, 4)
    assert sorted((str(r.row.vec_id), r.code, r.error) for r in coded.collect()) == sorted((str(i), c, e) for i, c, e in zip(ids, codes, error))


def test_codes_of_no_vectors(spark):
    got = with_label_errors(compress_vectors(table(spark, [None, []]), carry=["label"]))
    assert got.columns == ["row", "code", "error", "codebooks_sha256", "label_error"] and got.collect() == []


def test_codes_equal_sql(spark):
    from streetlens.llm.queries import op13_vector_codes

    path = "/root/testdata/sf0.001"
    got = op13_vector_codes(spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.execute(ORACLES["op13_vector_codes"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
