"""Competitors by pattern and counts of many keywords: equal to testing everything on everything."""

import random
import re

import pytest

from streetlens.operators import joins


@pytest.fixture(scope="module")
def businesses(spark):
    rng = random.Random(4)
    kinds, cities = ["Restaurant", "Bar", "Juice Bar", "Café (new)", "a+b", None], ["Paris", "St. Paul", "Saint Paul", "x\ny", None]
    rows = [(f"b{i:03d}", f"name {i % 37}" if i % 11 else None, rng.choice([None, 1.0, 4.5, 5.0]), i, i % 4, rng.choice(kinds), rng.choice(cities)) for i in range(150)]
    return spark.createDataFrame(rows, "source_id string, name string, rating double, review_count int, price_level int, category string, city string"), rows


@pytest.mark.parametrize("block", [1024, 2])
def test_competitors_by_pattern(spark, businesses, block, monkeypatch):
    monkeypatch.setattr(joins, "VALUE_BLOCK", block)
    df, rows = businesses
    requests = [(i, f"name {i}", c, p) for i, (c, p) in enumerate(
        [("^rest|bar$", "paul"), ("bar", "^saint"), (".", "."), ("", ""), ("caf.", "PARIS"), (None, "."), ("nothing", "."), (r"\(new\)", "."), (r"a\+b", "x")] * 2)]
    asked = spark.createDataFrame(requests, "request_id int, name string, category_pattern string, city_pattern string")
    got = {r.request_id: [c.source_id for c in r.competitors] for r in joins.competitors_by_pattern(asked, df, 7).collect()}

    def fits(pattern, value):
        return pattern is not None and value is not None and re.search(pattern, value, re.I)
    for i, name, category, city in requests:
        want = sorted((r for r in rows if fits(category, r[5]) and fits(city, r[6]) and (r[1] or "") != name), key=lambda r: (-(r[2] or 0), r[0]))
        assert got[i] == [r[0] for r in want[:7]]
    assert len(got) == len(requests)


def test_no_pair_of_businesses_is_formed(spark, businesses):
    df, _ = businesses
    asked = df.selectExpr("source_id AS request_id", "name", "category AS category_pattern", "city AS city_pattern").filter("category <> 'a+b' and category not like '%(%'")
    plan = joins.competitors_by_pattern(asked, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("listed, sent", [(256, 1), (0, 250_000), (0, 100)])
def test_keyword_counts(spark, listed, sent, monkeypatch):
    monkeypatch.setattr(joins, "LISTED_KEYWORDS", listed)
    monkeypatch.setattr(joins, "SENT_KEYWORDS", sent)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcÉ𝔸 \n") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "a" * 20_000]
    words = ["", "a", "ab", "abc", "bca", "cé", "𝔸", "a𝔸b", "zzz", "abca", "abcab", "aaaaa", "aaaaaa", "a b c", "c\na", "ÉÉ"]
    words += list({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(300)})
    reviews = spark.createDataFrame([(t,) for t in texts], "review_text string").repartition(3)
    keywords = spark.createDataFrame([(w, i) for i, w in enumerate(words + ["abc", None])], "text string, no int")
    got = {r.no: (r.text, r["count"]) for r in joins.keyword_review_counts(keywords, reviews).collect()}
    lowered = [t.lower() for t in texts if t is not None]
    assert got == {i: (w, 0 if w is None else sum(w in t for t in lowered)) for i, w in enumerate(words + ["abc", None])}


def test_keyword_counts_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(joins, "LISTED_KEYWORDS", 0)
    none = spark.createDataFrame([], "text string")
    texts = spark.createDataFrame([("some text",)], "review_text string")
    assert joins.keyword_review_counts(none, texts).collect() == []
    assert [tuple(r) for r in joins.keyword_review_counts(spark.createDataFrame([("some",)], "text string"), texts.limit(0)).collect()] == [("some", 0)]


def test_all_keywords_are_looked_for_in_one_reading(spark, monkeypatch):
    # many keywords built of the same syllables, within each other and as long as a whole text
    syllables = ["ka", "lo", "mi", "é", "ru", "ß"]
    rng = random.Random(8)
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(1, 20))) for _ in range(700)})
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(80)] + [words[3], words[3].upper(), "", None]
    reviews = spark.createDataFrame([(t,) for t in texts], "review_text string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in words], "text string")
    asked = []
    counter = joins.piece_counter
    monkeypatch.setattr(joins, "piece_counter", lambda sizes, *sent: asked.append(sizes) or counter(sizes, *sent))
    got = {r.text: r["count"] for r in joins.keyword_review_counts(keywords, reviews).collect()}
    lowered = [t.lower() for t in texts if t is not None]
    assert got == {w: sum(w in t for t in lowered) for w in words}
    assert len(asked) == 1


def test_few_keywords_are_searched_on_batches(spark):
    """Anywhere in the lower-cased text, also across words and in other scripts; null texts count nowhere."""
    import pyarrow as pa

    from streetlens.tasks import substrings

    texts = ["Great SOUP", "soupsoup", None, "", "thé noir", "at so", "á"]
    batch = pa.RecordBatch.from_pydict({"body": pa.array([t if t is None else t.lower() for t in texts])})
    words = ["soup", "t so", "é", "", "none", "a"]
    (out,) = substrings.listed_counter([w.encode() for w in words])(iter([batch, batch]))
    want = {w: sum(w in t.lower() for t in texts if t is not None) for w in words}
    assert dict(zip(out.column("text").to_pylist(), out.column("n").to_pylist())) == {w.encode(): 2 * n for w, n in want.items()}
    keywords = spark.createDataFrame([(w,) for w in [*words, "soup", None]], "text string")
    got = joins.keyword_review_counts(keywords, spark.createDataFrame([(t,) for t in texts], "review_text string")).collect()
    assert sorted((r.text or "-", r["count"]) for r in got) == sorted([*((w or "-", n) for w, n in want.items()), ("soup", want["soup"]), ("-", 0)])
