"""Landed HTML pages to business, review, card and link rows.

Fields are found by patterns on the raw markup with built-in functions, one row per page; nothing is
fetched. Each pattern mirrors a selector: an element by attribute or class, then text inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.functions import scalars
from streetlens.functions.arrays import exploded
from streetlens.functions.scalars import unescape


def _first(source: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group; null when there is none or it is empty."""
    return unescape(F.nullif(F.regexp_extract(source, pattern, group), F.lit("")))


def _all(source: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(group)), unescape)


def _block(source: Column, attribute: str) -> Column:
    """Inner markup of the first element that carries an attribute; '' when there is none."""
    return F.regexp_extract(source, rf"(?s)<(\w+)\b[^>]*\b{attribute}[^>]*>(.*?)</\1>", 2)


def _test_id(name: str) -> str:
    return f'data-testid="{name}"'


def _class(name: str) -> str:
    return rf'class="(?:[^"]* )?{name}(?: [^"]*)?"'


def _own_class(name: str) -> str:
    # a word boundary before the literal would be tested at every character; behind it Java looks for the literal first
    return _class(name).replace('class="', r'class="(?<=\bclass=")', 1)


_P, _SPAN, _A = r"<p\b[^>]*>([^<]+)", r"<span\b[^>]*>([^<]+)", r"<a\b[^>]*>([^<]+)"


def _joined(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


def _categories(links: Column) -> dict[str, Column]:
    return {
        "category": F.get(links, F.lit(0)),
        "subcategory": F.when(F.size(links) > 1, F.slice(links, F.lit(2), F.greatest(F.size(links) - 1, F.lit(1)))),
    }


def page_name(html: Column) -> Column:
    """Text of the first main heading."""
    return _first(html, r"<h1\b[^>]*>([^<]+)")


def extract_business_pages(pages: DataFrame, max_images: int | None = None) -> DataFrame:
    """Business pages (``url``, ``html``) to business rows; of the images the first ``max_images`` when given."""
    html = F.col("html")
    links = _all(_block(html, _test_id("business-categories")), _A)
    hours = F.regexp_extract_all(
        _block(html, _test_id("business-hours")),
        F.lit(r"(?s)<tr\b[^>]*>\s*<th\b[^>]*>[^<]+</th>\s*<td\b[^>]*>\s*<p\b[^>]*>[^<]+"), F.lit(0))
    day = lambda row: F.regexp_extract(row, r"<th\b[^>]*>([^<]+)", 1)
    time = lambda row: F.regexp_extract(row, r"<p\b[^>]*>([^<]+)", 1)
    # a day given twice keeps its last line
    last_per_day = F.filter(
        hours, lambda r, i: ~F.exists(F.slice(hours, i + 2, F.size(hours)), lambda later: day(later) == day(r)))
    scripts = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?s)<script\b[^>]*>(.*?)</script>"), F.lit(1)),
        lambda s: F.contains(s, F.lit("mapMarkerProps")) & s.rlike(r'"latitude":-?\d') & s.rlike(r'"longitude":-?\d'))
    script = F.get(scripts, F.lit(0))
    rating = _first(html, rf'(?s){_test_id("rating")}[^>]*>.*?<span\b[^>]*aria-label="([^"]*)"')
    images = _all(html, rf'(?s)\b{_class("photo-box")}[^>]*>\s*<img\b[^>]*src="([^"]*)"')
    reviews = _first(html, r'(?s)<a\b[^>]*href="[^"]*reviews[^"]*"[^>]*>\s*<span\b[^>]*>([^<]+)')
    return pages.select(
        page_name(html).alias("name"), F.lit("yelp").alias("source"),
        scalars.slug(F.col("url")).alias("source_id"),
        scalars.star_rating(rating).alias("rating"), scalars.leading_count(reviews).alias("review_count"),
        _joined(_all(_block(html, _test_id("business-address")), _P)).alias("address"),
        _first(_block(html, _test_id("business-phone")), _P).alias("phone"),
        _first(html, r'<a\b[^>]*href="([^"]*biz_redir[^"]*)"').alias("website"),
        *[c.alias(n) for n, c in _categories(links).items()],
        _first(_block(html, _test_id("business-price")), _SPAN).alias("price_range"),
        F.map_from_entries(F.transform(last_per_day, lambda r: F.struct(unescape(day(r)), unescape(time(r))))).alias("hours"),
        _first(_block(html, _test_id("business-description")), _P).alias("description"),
        (images if max_images is None else F.slice(images, 1, max_images)).alias("images"),
        scalars.coordinate(script, "latitude").alias("latitude"), scalars.coordinate(script, "longitude").alias("longitude"),
    )


def extract_review_pages(pages: DataFrame) -> DataFrame:
    """Review pages (``business_id``, ``business_name``, ``html``) to review rows with text."""
    listing = F.regexp_extract("html", rf'(?s){_test_id("reviews-list")}[^>]*>(.*)', 1)
    # each review block starts at its user-name element
    pieces = F.filter(F.split(listing, rf'(?={_own_class("user-name")})'), lambda b: F.contains(b, F.lit("user-name")))
    # the matches are elements of an array, so that each pattern runs once; a column that is read often would be matched anew
    texts = F.transform(pieces, lambda b: F.struct(
        b.alias("b"), F.regexp_extract(b, rf'(?s){_class("comment")}[^>]*>\s*<p\b[^>]*>([^<]+)', 1).alias("review_text")))
    user = rf'(?s){_class("user-name")}[^>]*>\s*<a\b[^>]*'
    patterns = {
        "reviewer_name": rf"{user}>([^<]+)", "reviewer_id": rf'{user}href="([^"]*)"', "stars": r'(?s)role="img"[^>]*aria-label="([^"]*)"',
        "date": rf'{_own_class("review-date")}[^>]*>([^<]+)', "helpful": rf'{_own_class("helpful-count")}[^>]*>([^<]+)'}
    matches = F.transform(F.filter(texts, lambda t: t["review_text"] != ""), lambda t: F.struct(
        t["review_text"].alias("review_text"), *[F.regexp_extract(t["b"], p, 1).alias(name) for name, p in patterns.items()]))
    fields = F.transform(matches, lambda m: F.struct(
        *[F.when(m[name] != "", unescape(m[name])).alias(name) for name in ("review_text", *patterns)]))
    rows = exploded(pages, fields, "f", "business_id", "business_name").select("business_id", "business_name", "f.*")
    return rows.select(
        "business_id", "business_name", F.lit("yelp").alias("source"), "reviewer_name", "reviewer_id",
        F.regexp_extract("stars", r"(\d+) star", 1).try_cast("int").alias("rating"), "review_text",
        scalars.parse_date(F.col("date")).alias("review_date"), scalars.leading_count(F.col("helpful")).alias("helpful_votes"),
        F.concat_ws("_", "business_id", F.coalesce("reviewer_id", F.lit("None"))).alias("source_review_id"),
    )


def extract_directory_pages(pages: DataFrame) -> DataFrame:
    """Directory pages to business rows with a name; the id keeps the query part of the URL."""
    html = F.col("html")
    links = _all(_block(html, _class("categories")), _A)
    hours = _joined(_all(html, rf'\b{_class("hours-info")}[^>]*>([^<]+)'))
    found = pages.select(
        page_name(html).alias("name"), F.lit("yellowpages").alias("source"),
        scalars.slug(F.col("url"), cut_query=False).alias("source_id"),
        _joined(_all(_block(html, _class("address")), _SPAN)).alias("address"),
        _first(html, rf'\b{_class("phone")}[^>]*>([^<]+)').alias("phone"),
        F.coalesce(
            _first(html, r'<a\b[^>]*title="Website"[^>]*href="([^"]*)"'),
            _first(html, r'<a\b[^>]*href="([^"]*)"[^>]*title="Website"')).alias("website"),
        *[c.alias(n) for n, c in _categories(links).items()],
        F.when(hours.isNotNull(), F.create_map(F.lit("*"), hours)).alias("hours"),
        _first(_block(html, _class("description")), _P).alias("description"),
    )
    return found.filter(F.length("name") > 0)


def extract_search_cards(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Result pages to their cards with a name; of each page the first ``limit`` cards when given."""
    pieces = F.filter(F.split("html", r"(?=<\w+\b[^>]*\bdata-cid=)"), lambda p: p.rlike(r"^<\w+\b[^>]*\bdata-cid="))
    pieces = pieces if limit is None else F.slice(pieces, 1, limit)
    rows = exploded(pages, pieces, "b", "url", position="position")
    b = F.col("b")
    stars = _first(b, r'(?s)role="img"[^>]*aria-label="([^"]*)"')
    found = rows.select(
        "url", "position", _first(b, r"<h3\b[^>]*>([^<]+)").alias("name"), F.lit("google").alias("source"),
        _first(b, r'data-cid="([^"]*)"').alias("source_id"),
        F.when(F.contains(stars, F.lit("star")), F.regexp_extract(stars, r"(\d+\.?\d*)", 1).try_cast("double")).alias("rating"),
        scalars.leading_count(_first(b, r"<span\b[^>]*>([^<]*reviews[^<]*)")).alias("review_count"),
    )
    return found.filter(F.length("name") > 0)


def extract_links(pages: DataFrame, prefix: str = "/biz/", limit: int | None = None) -> DataFrame:
    """Outgoing links of a page that start with the prefix; ``limit`` keeps those among the first
    links that hold it anywhere."""
    links = _all(F.col("html"), r'<a\b[^>]*href="([^"]*)"')
    hits = F.filter(links, lambda x: F.contains(x, F.lit(prefix)))
    kept = hits if limit is None else F.slice(hits, 1, limit)
    return exploded(pages, kept, "link", "url", position="position").filter(F.startswith("link", F.lit(prefix)))


def next_page(pages: DataFrame) -> DataFrame:
    """Link to the next result page, where there is one."""
    html = F.col("html")
    link = F.coalesce(
        _first(html, r'<a\b[^>]*aria-label="Next"[^>]*href="([^"]*)"'), _first(html, r'<a\b[^>]*href="([^"]*)"[^>]*aria-label="Next"'),
        _first(html, rf'<a\b[^>]*{_class("next")}[^>]*href="([^"]*)"'), _first(html, rf'<a\b[^>]*href="([^"]*)"[^>]*{_class("next")}'))
    return pages.select("url", link.alias("next_url")).filter(F.col("next_url").isNotNull())
