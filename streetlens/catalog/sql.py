"""SQL texts of the views. The column lists run unchanged on both engines."""

from __future__ import annotations

from streetlens.constants import NEGATIVE_WORDS, POSITIVE_WORDS, SHORT_STOP_WORDS

BUSINESS_COLUMNS = [
    "concat('biz_', CAST(s_suppkey AS VARCHAR(20))) AS source_id",
    "s_name AS name",
    "concat(CAST(100 + s_suppkey % 900 AS VARCHAR(20)), ' Main St, ', n_name) AS address",
    "n_name AS city",
    "r_name AS state",
    "CASE s_suppkey % 6 WHEN 0 THEN 'Restaurant' WHEN 1 THEN 'Cafe' WHEN 2 THEN 'Retail' "
    "WHEN 3 THEN 'Service' WHEN 4 THEN 'Bar' ELSE 'Fitness' END AS category",
    "CASE WHEN s_suppkey % 29 = 28 THEN NULL "
    "ELSE CAST(10 + (s_suppkey * 7 + s_nationkey * 3) % 41 AS DOUBLE) / 10 END AS rating",
    "CAST((s_suppkey * 37 + s_nationkey * 11) % 240 AS INT) AS review_count",
    "CASE s_suppkey % 3 WHEN 0 THEN 'google_places' WHEN 1 THEN 'yelp' ELSE 'city_search' END AS source",
    "CAST(25 + (s_suppkey * 13) % 2400 / 100.0 AS DOUBLE) AS latitude",
    "CAST(-120 + (s_suppkey * 17) % 5000 / 100.0 AS DOUBLE) AS longitude",
    "CAST(s_suppkey % 5 AS INT) AS price_level",
]

REVIEW_COLUMNS = [
    "concat(CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS source_review_id",
    "concat('biz_', CAST(l_suppkey AS VARCHAR(20))) AS business_id",
    "l_partkey AS seq",
    "CAST(1 + CAST(l_quantity AS INT) % 5 AS INT) AS rating",
    "l_discount * 20 - 1 AS sentiment_score",
    "CASE WHEN l_discount * 20 - 1 >= 0.05 THEN 'positive' "
    "WHEN l_discount * 20 - 1 <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label",
    "l_shipdate AS review_date",
    "CASE l_partkey % 3 WHEN 0 THEN 'google_places' WHEN 1 THEN 'yelp' ELSE 'city_search' END AS source",
]

TEXT_COLUMNS = [
    "doc_id AS review_id",
    "concat('biz_', CAST(doc_id % n_suppliers AS VARCHAR(20))) AS business_id",
    "CAST(1 + doc_id % 5 AS INT) AS rating",
    "text AS review_text",
    "lang",
    "DATE '2023-01-01' + CAST(doc_id % 700 AS INT) AS review_date",
]

CLICK_COLUMNS = [
    "event_id AS source_review_id",
    "concat('biz_', CAST(user_id % n_suppliers AS VARCHAR(20))) AS business_id",
    "CAST(ts AS TIMESTAMP) AS review_date",
    "CAST(1 + event_id % 5 AS INT) AS rating",
    "event_type",
    "value / 50.0 - 1 AS sentiment_score",
    "CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment_label",
]


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(lower(review_text), '{w}') AS INT)" for w in words)


STOP_WORDS = "the and of to in is place food".split()
LEXICON = {**{w: 1.0 for w in POSITIVE_WORDS}, **{w: -1.0 for w in NEGATIVE_WORDS}}
# white space that is not the plain space, and letters, for the cleaning rule
_WIDE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NARROW = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}"

RATING_SCORE = f"""greatest(-1.0, least(1.0,
  CASE WHEN rating >= 4 THEN 0.6 + (rating - 4) * 0.2 WHEN rating >= 3 THEN 0.0 ELSE -0.6 + (rating - 1) * 0.2 END
  + (({_hits(POSITIVE_WORDS)}) - ({_hits(NEGATIVE_WORDS)})) * 0.1::DOUBLE))"""


def clean(column: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), '[{_WIDE}]', ' ', 'g'), "
        f"'[^a-z {_NARROW}]', '', 'g'), '[ {_NARROW}]+', ' ', 'g'))"
    )


def _select(columns, source) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


_COUNTED = "(SELECT *, (SELECT count(*) FROM supplier) AS n_suppliers FROM {t}) AS t"

VIEWS = {
    "businesses": (
        (), _select(BUSINESS_COLUMNS, "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")),
    # one business more, of which there is no review
    "more_businesses": (
        ("businesses",),
        "SELECT * FROM businesses UNION ALL SELECT * REPLACE ('biz_new' AS source_id) FROM businesses WHERE source_id = 'biz_5'"),
    "reviews": ((), _select(REVIEW_COLUMNS, "lineitem")),
    "named_reviews": (
        ("businesses", "reviews"),
        "SELECT r.*, b.name AS business_name, b.category AS business_category, b.city AS business_city "
        "FROM reviews r LEFT JOIN businesses b ON r.business_id = b.source_id"),
    "texts": ((), _select(TEXT_COLUMNS, _COUNTED.format(t="documents"))),
    "scored": (
        ("texts",),
        "SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label, "
        "list_filter(words, lambda w, i: list_position(words, w) = i) AS keywords "
        f"FROM (SELECT *, {RATING_SCORE} AS sentiment_score, "
        r"list_filter(regexp_extract_all(lower(review_text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}') "
        f"AND NOT list_contains([{quoted(SHORT_STOP_WORDS)}], w)) AS words FROM texts) AS s"),
    "clicks": ((), _select(CLICK_COLUMNS, _COUNTED.format(t="events"))),
    # words of the cleaned text with their position
    "cleaned": (("texts",), f"SELECT review_id, list_filter(string_split({clean('review_text')}, ' '), lambda w: w <> '') AS words FROM texts"),
    "words": (
        ("cleaned",),
        "SELECT review_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM cleaned"),
}


def with_views(names) -> str:
    """``WITH`` clause of the views and of those they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
