import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from streetlens.functions import scalars, sentiment, text
from streetlens.operators import aggregates, enrich, tfidf

STOPS = ["the", "a", "of"]
TEXTS = [
    "The  Great\tpizza, the great CRUST! pizza of pizza",
    "don't   re-heat café crème pizza\n\nline two",
    "!!! ??? 123", "", None, "a", "Crust crust crust\x1cpizza", "great pizza great pizza a b",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "review_id int, review_text string")


def py_clean(s):
    kept = "".join(c for c in (s or "").lower() if c.isspace() or "a" <= c <= "z")
    return " ".join(kept.split())


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_clean(frame):
    got = by_id(frame.select("review_id", text.clean_text(F.col("review_text"))))
    assert got == {i: py_clean(t) for i, t in enumerate(TEXTS)}


def test_keywords_and_phrases(frame):
    words = {i: py_clean(t).split() for i, t in enumerate(TEXTS)}
    kw = by_id(frame.select("review_id", text.keywords(F.col("review_text"), 3, STOPS)))
    assert kw == {i: [w for w, _ in Counter(w for w in ws if w not in STOPS and len(w) > 2).most_common(3)] for i, ws in words.items()}
    ph = by_id(frame.select("review_id", text.phrases(F.col("review_text"), 2, STOPS)))
    pairs = {i: [f"{a} {b}" for a, b in zip(ws, ws[1:]) if a not in STOPS and b not in STOPS and len(a) + len(b) > 4] for i, ws in words.items()}
    assert ph == {i: [p for p, _ in Counter(ps).most_common(2)] for i, ps in pairs.items()}


def test_counts_and_simple_keywords(frame):
    got = by_id(frame.select("review_id", text.word_count(F.col("review_text"))).filter("review_id not in (3, 4)"))
    assert got == {i: len(t.split()) for i, t in enumerate(TEXTS) if t}
    one = frame.sparkSession.createDataFrame([("Tables, tables été_abc caféxyz were WERE with9 ouvert",)], "t string")
    assert one.select(text.simple_keywords(F.col("t"))).first()[0] == ["tables", "ouvert"]


def brute_tfidf(texts, stops, max_terms, k):
    docs = []
    for t in texts:
        ws = [w for w in py_clean(t).split() if len(w) > 1 and w not in stops]
        docs.append(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]))
    n, df, total = len(docs), Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        total.update(d)
    kept = sorted((t for t in df if 2 <= df[t] <= 0.8 * n), key=lambda t: (-total[t], t))[:max_terms]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    scores = defaultdict(float)
    for d in docs:
        w = {t: d[t] * idf[t] for t in d if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            scores[t] += v / norm / n
    return sorted(((t, round(s, 9)) for t, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_tfidf_against_brute_force(spark):
    base = "great pizza and warm crust|cold pizza but great crust|service was slow|slow service and warm bread|great bread|???".split("|")
    data = [(i, t) for i, t in enumerate(base * 2)] + [(99, ""), (100, None)]
    df = spark.createDataFrame(data, "review_id int, review_text string").repartition(3)
    got = [(r.text, round(r.weight, 9)) for r in tfidf.tfidf_keywords(df, 8, stop_words=["and", "was"], max_terms=7).collect()]
    assert got == brute_tfidf([t for _, t in data if t], {"and", "was"}, 7, 8)


def test_tfidf_keeps_terms_behind_the_500_most_frequent(spark):
    def word(i):
        return f"{chr(97 + i // 26)}{chr(97 + i % 26)}"
    # 600 frequent words, then one text of two words that are the rarest of all
    texts = [" ".join([word(i)] * 3) for i in range(600) for _ in range(2)] + ["zzrare zzword"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, review_text string").repartition(3)
    got = [(r.text, round(r.weight, 9)) for r in tfidf.tfidf_keywords(df, 2000, stop_words=[]).collect()]
    assert got == brute_tfidf(texts, set(), None, 2000)
    assert {"zzrare", "zzword", "zzrare zzword"} <= {t for t, _ in got}


def test_tfidf_without_surviving_terms_is_empty(spark):
    df = spark.createDataFrame([(1, "one text only")], "review_id int, review_text string")
    assert tfidf.keyword_cloud(df, 5, stop_words=STOPS).count() == 0


def test_rating_sentiment(spark):
    data = [(5, "great great awful"), (1, "bad food, the worst, terrible, hate"), (3, "badge of honour"), (None, "x"), (4, None), (2, ""), (5, "love best perfect awesome amazing")]
    df = spark.createDataFrame(data, "rating int, t string")
    got = [(round(r.s.score, 6), r.s.label, r.s.confidence, r.s.method) for r in df.select(sentiment.rating_sentiment(F.col("rating"), F.col("t")).alias("s")).collect()]
    assert got[0] == (0.8, "positive", 0.9, "rating_plus_keywords")
    assert got[1][:2] == (-1.0, "negative")
    # "bad" counts inside "badge"; exactly -0.1 is not below the strict threshold
    assert got[2][:2] == (-0.1, "neutral")
    assert got[3][0] == -0.8
    assert got[4] == (0.5, "positive", 0.6, "rating_only")
    assert got[5] == (-0.25, "negative", 0.6, "rating_only")
    assert got[6][0] == 1.0


def test_labels_at_the_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.1,), (-0.1,), (0.0,), (None,)], "s double")
    got = [tuple(r) for r in df.select(sentiment.label(F.col("s")), sentiment.label(F.col("s"), 0.1, False)).collect()]
    assert got == [("positive", "neutral"), ("negative", "neutral"), ("positive", "neutral"), ("negative", "neutral"), ("neutral", "neutral"), (None, None)]


def test_enrichment_is_idempotent_and_leaves_empty_texts_null(frame):
    lexicon = {"great": 2.0, "pizza": -0.5}
    once = enrich.enrich_reviews(frame, lexicon, stop_words=STOPS)
    twice = enrich.enrich_reviews(once, lexicon, stop_words=STOPS)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    empty = once.filter("review_id in (3, 4)").collect()
    assert all(r[c] is None for r in empty for c in enrich.ENRICHED)
    total = 2.0 * 2 - 0.5 * 3
    assert by_id(once.select("review_id", "sentiment_score"))[0] == pytest.approx(total / math.sqrt(total * total + 15))


def test_user_scorer(frame):
    import pandas as pd

    @F.pandas_udf("double")
    def scorer(s: pd.Series) -> pd.Series:
        return s.str.len() / 100.0

    got = enrich.enrich_reviews(frame, score_fn=scorer, stop_words=STOPS)
    assert by_id(got.select("review_id", "sentiment_score"))[5] == 0.01


def test_scalar_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalars.segment(F.lit(None).cast("double"), F.lit(99))) == "New Entries"
    assert value(scalars.segment(F.lit(4.5), F.lit(50))) == "Market Leaders"
    assert value(scalars.point(F.lit(0.0), F.lit(5.0))) is None
    assert tuple(value(scalars.city_region(F.lit("Paris"), F.lit("1 Rue, Paris, IDF, France")))) == ("Paris", "IDF")
    assert tuple(value(scalars.city_state(F.lit("")))) == ("Unknown City", "Unknown State")
    assert value(scalars.parse_date(F.lit("13/45/2020"))) is None
    assert value(scalars.parse_date(F.lit("soon"))) is None
    assert [value(scalars.hour_label(F.lit(h))) for h in (0, 11, 12, 13)] == ["12 AM", "11 AM", "12 PM", "1 PM"]
    assert value(scalars.unescape(F.lit("a &amp;lt; b"))) == "a &lt; b"
    assert value(scalars.period_label(F.lit("2024-03-10").cast("timestamp"), "week")) == "2024-03-04/2024-03-10"


def test_label_counts_sum_to_the_total(spark):
    df = spark.createDataFrame([("b", "positive"), ("b", None), ("b", "negative"), ("b", "odd")], "business_id string, sentiment_label string")
    row = aggregates.label_distribution(df).first()
    assert (row.positive, row.neutral, row.negative) == (1, 1, 1)


@pytest.mark.parametrize("text", [
    "caf&eacute; &#233;&#xE9;&#x1F600; &#128512;", "&amp;lt; &#38;lt; &&#35;38; &amp;#38;", "&unknown; &#0; &#xD800; &#9999999; & ; &;", "no reference", "",
    "&lt;b&gt;&quot;x&quot;&#39;&nbsp;&copy;&middot;", "&euro;", "a&amp;", "&Alpha;&alpha;&sup2;"])
def test_character_references(spark, text):
    import html
    import re

    kept = {"&unknown;", "&#0;", "&#xD800;", "&#9999999;"}
    want = re.sub("&[#A-Za-z0-9]+;", lambda m: m[0] if m[0] in kept else html.unescape(m[0]), text)
    # a column, not a literal, so that the expression is not folded away
    got = spark.createDataFrame([(text,)], "t string").select(scalars.unescape(F.col("t")).alias("v")).first().v
    assert got == want


@pytest.mark.parametrize("mode, most", [("compound", 3), ("mean", 100)])
def test_enrichment_counts_words_once_and_as_the_column_functions(spark, mode, most):
    rng = random.Random(5)
    words = ["the", "pizza", "Great", "bad", "ab", "abc", "x1y", "don't", "\u0130n", "\u212aeg", "caf\u00e9", "\u2003", "\u00a0", "\n\t", "...", "5"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", " ", None, "...", "a\x1cb abcd efgh", "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "no int, review_text string").repartition(3)
    lexicon = {"great": 1.0, "bad": -1.5, "pizza": 0.5}
    body = F.col("review_text")
    plain = df.select(
        "no", sentiment.lexicon_score(body, lexicon, mode).alias("score"), text.keywords(body, most, STOPS).alias("keywords"),
        text.phrases(body, most, STOPS).alias("phrases"), (F.length(body) > 0).alias("full"))
    want = {r.no: (round(r.score, 9), r.keywords, r.phrases) if r.full else (None, None, None) for r in plain.collect()}
    found = enrich.enrich_reviews(df, lexicon, stop_words=STOPS, mode=mode, max_keywords=most, max_phrases=most)
    got = {r.no: (r.sentiment_score if r.sentiment_score is None else round(r.sentiment_score, 9), r.keywords, r.phrases) for r in found.collect()}
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "sort_array" not in plan
