from streetlens.sources import pages


def test_review_pages_are_matched_once_a_pattern(spark):
    block = ('<div><span {0}="x user-name y"><a href="/u?a=1&amp;b=2">A &amp;amp; B</a></span><div role="img" aria-label="&#53; star rating"></div>'
             '<p class="review-date">3/4/2024</p><div class="big comment"> <p>{1}</p></div>'
             '<b class="helpful-count">1,2 votes</b></div>')
    html = '<i class="user-name"></i><section data-testid="reviews-list" x>' + "".join([
        block.format("class", "good &lt;3"), block.format("class", ""), block.format("subclass", "of no user"), block.format("class", "last")]) + "</section>"
    df = spark.createDataFrame([("b1", "Shop", html), ("b2", "None", "<p></p>"), ("b3", "Null", None)], "business_id string, business_name string, html string")
    found = pages.extract_review_pages(df)
    rows = sorted(tuple(r) for r in found.selectExpr(
        "review_text", "business_id", "reviewer_name", "reviewer_id", "rating", "cast(review_date as date) || ''", "helpful_votes", "source_review_id").collect())
    # the element that is no user name belongs to the piece before it
    same = ("b1", "A &amp; B", "/u?a=1&b=2", 5, "2024-03-04", 12, "b1_/u?a=1&b=2")
    assert rows == [("good <3", *same), ("last", *same), ("of no user", *same)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for name in ("comment", "helpful-count", "review-date"):
        assert plan.count(f"{name}(?: ") == 1, name
