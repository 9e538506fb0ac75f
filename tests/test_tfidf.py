"""TF-IDF over the whole vocabulary: equal to the definition, however few terms are sent to the tasks."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from streetlens.operators import tfidf
from streetlens.tasks import terms

STOPS = ["the", "of"]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["the", "of", "q"]
    rows = [" ".join(rng.choice(words[: rng.choice([4, 12, 27])]) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return rows + [rows[0]] * 3 + [None, "", "   ", "the of the", "x y z", "Only ONE, text; says this!", "tie pair", "tie pair"]


def expected(texts, k, max_terms=None, min_df=2, max_df=0.8):
    texts = [t for t in texts if t]
    n, counts = len(texts), []
    for t in texts:
        w = [x for x in "".join(c for c in t.lower() if c.isascii() and c.isalpha() or c == " ").split() if len(x) >= 2 and x not in STOPS]
        counts.append(collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, total = collections.Counter(x for c in counts for x in c), collections.Counter()
    for c in counts:
        total.update(c)
    kept = [x for x in df if min_df <= df[x] <= max_df * n]
    if max_terms is not None:
        kept = sorted(kept, key=lambda x: (-total[x], x))[:max_terms]
    idf = {x: math.log((1 + n) / (1 + df[x])) + 1 for x in kept}
    score = collections.Counter()
    for c in counts:
        w = {x: c[x] * idf[x] for x in c if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for x, v in w.items():
            score[x] += v / norm / n
    return sorted(((x, round(v, 10)) for x, v in score.items()), key=lambda p: (-p[1], p[0]))[:k]


@pytest.fixture(scope="module")
def texts():
    return corpus(1, 80)


@pytest.fixture(scope="module")
def reviews(spark, texts):
    return spark.createDataFrame([(t, "x") for t in texts], "review_text string, h string").repartition(3)


def found(reviews, k, **kwargs):
    return [(r.text, round(r.weight, 10)) for r in tfidf.tfidf_keywords(reviews, k, stop_words=STOPS, **kwargs).collect()]


def test_equals_the_definition(reviews, texts):
    assert found(reviews, 40) == expected(texts, 40)


@pytest.mark.parametrize("frequent, scored, norms", [(0, 0, 10**6), (30, 5, 0), (30, 30, 10**6), (10**6, 3, 10**6)])
@pytest.mark.parametrize("k", [3, 10**4])
def test_any_number_of_frequent_terms(reviews, texts, frequent, scored, norms, k, monkeypatch):
    for name, value in (("FREQUENT_TERMS", frequent), ("SCORED_TERMS", scored), ("SENT_NORMS", norms)):
        monkeypatch.setattr(tfidf, name, value)
    assert found(reviews, k) == expected(texts, k)


@pytest.mark.parametrize("max_terms", [1, 7, 40, 10**6])
def test_bounded_vocabulary(reviews, texts, max_terms):
    assert found(reviews, 25, max_terms=max_terms) == expected(texts, 25, max_terms)


def test_bounds_of_frequency(reviews, texts):
    assert found(reviews, 60, min_df=1, max_df=0.1) == expected(texts, 60, None, 1, 0.1)


def test_few_bits_lose_nothing(reviews, texts, monkeypatch):
    monkeypatch.setattr(tfidf, "LARGEST_BITS", 1 << 15)
    monkeypatch.setattr(tfidf, "FREQUENT_TERMS", 10)
    assert found(reviews, 50) == expected(texts, 50)


def test_no_texts(spark, reviews):
    assert found(reviews.limit(0), 5) == [] and found(spark.createDataFrame([(None,), ("",)], "review_text string"), 5) == []


def test_chunks_and_held_terms_change_nothing(texts, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"body": pa.array(texts)})

    def counted():
        total = collections.Counter()
        for out in terms.frequency_counter(STOPS, True)(iter([batch])):
            for h, df, n in zip(*(c.to_pylist() for c in out.columns)):
                total[h] += df * 1000 + n
        return total
    whole = counted()
    monkeypatch.setattr(terms, "CHUNK_BYTES", 50)
    monkeypatch.setattr(terms, "HELD_TERMS", 20)
    assert counted() == whole


def test_every_sign_is_cleaned_as_in_the_column_function(spark):
    """Each sign alone, between letters, for all of Unicode."""
    from pyspark.sql import functions as F

    from streetlens.functions.text import clean_text

    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}B " for c in signs[i:i + 997]) for i in range(0, len(signs), 997)] + [None, "", "  ", "É\u3000x\u212a\u0130"]
    want = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", clean_text(F.col("t")).alias("c")).orderBy("i").collect()]
    array = pa.concat_arrays([pa.array(["skipped"]), pa.array(rows)])[1:]
    assert [" ".join(t.split(" ")).split() for t in terms.cleaned(array).to_pylist()] == [t.split() for t in want]


def test_bit_map(spark, reviews):
    values = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 500)
    bits = tfidf.Corpus(reviews, "review_text", STOPS).bit_map(spark.createDataFrame([(int(v),) for v in values], "h bigint"), 500).value
    assert terms.in_bits(bits, values).all()
    assert terms.in_bits(bits, np.random.default_rng(1).integers(-2**63, 2**63 - 1, 10_000)).mean() < 0.1


@pytest.mark.parametrize("with_totals", [False, True])
def test_packed_frequencies_equal_the_counted(texts, with_totals, monkeypatch):
    """Terms travel as one row a part; parts that go over several batches are added up whole."""
    for name, value in (("CHUNK_BYTES", 200), ("HELD_TERMS", 50), ("PART_BITS", 3)):
        monkeypatch.setattr(terms, name, value)
    tasks = [pa.RecordBatch.from_pydict({"body": pa.array(some, pa.string())}) for some in (texts[:40], texts[40:], [None, ""])]
    want, packed = collections.defaultdict(lambda: [0, 0]), []
    for task in tasks:
        for out in terms.frequency_counter(STOPS, True)(iter([task])):
            for h, df, n in zip(*(c.to_pylist() for c in out.columns)):
                want[h] = [want[h][0] + df, want[h][1] + n]
        found = list(terms.frequency_packer(STOPS, with_totals)(iter([task])))
        assert all(out.num_rows <= 8 for out in found)
        packed += found
    rows = pa.Table.from_batches(packed).sort_by("part").combine_chunks()
    assert 8 < rows.num_rows < len(want)
    for size in (1, 5, 1000):
        got = [row for out in terms.frequency_merger(2)(iter(rows.to_batches(size))) for row in zip(*(c.to_pylist() for c in out.columns))]
        assert sorted(got) == sorted((h, *v[:1 + with_totals]) for h, v in want.items() if v[0] >= 2)
    assert list(terms.frequency_merger(2)(iter([]))) == []


def test_a_task_that_has_named_all_terms_reads_no_more(monkeypatch):
    class Sent:
        def __init__(self, value):
            self.value = value

    texts = ["soup bread", "soup salt", "fish soup"] + ["other words", "soup bread fish"] * 20
    h = {}
    for out in terms.namer(STOPS, Sent(np.full(4096, 255, np.uint8)))(iter([pa.RecordBatch.from_pydict({"body": pa.array(texts)})])):
        h.update(zip(out.column("term").to_pylist(), out.column("h").to_pylist()))
    read = []
    monkeypatch.setattr(terms, "CHUNK_BYTES", 1)
    monkeypatch.setattr(terms, "terms_of", lambda body, stops, plain=terms.terms_of: read.append(len(body)) or plain(body, stops))
    wanted = Sent(np.sort([h["soup salt"], h["fish"], h["soup"]]))
    got = [row for out in terms.namer(STOPS, Sent(np.full(4096, 255, np.uint8)), wanted)(iter([pa.RecordBatch.from_pydict({"body": pa.array(texts)})]))
           for row in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(got) == sorted((h[t], t) for t in ("fish", "soup", "soup salt")) and sum(read) == 3


def test_hashes_are_found_in_any_order():
    rng = np.random.default_rng(3)
    table, sought = np.unique(rng.integers(-50, 50, 40)), rng.integers(-60, 60, 500)
    known, at = terms.find(table, sought)
    assert (known == np.isin(sought, table)).all() and (table[at] == sought[known]).all()
    known, at = terms.find(table[:0], sought)
    assert not known.any() and not len(at)
