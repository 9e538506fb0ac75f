import json

from streetlens.sources import places


def response(*texts):
    return json.dumps({"displayName": {"text": "Place"}, "reviews": [{"rating": 4, "text": {"text": t}} for t in texts]})


def test_profiles_read_the_responses_once_for_all_measures(spark):
    rows = [("a", response("pizza pasta wine", "wine pizza", "")), ("a", response("wine")), ("b", response("ok")), ("c", response()), (None, response("none here"))]
    found = places.profiles_from_places(spark.createDataFrame(rows, "place_id string, json string"), top_k=2)
    got = sorted(str([r.place_id, r.reviews_fetched, r.top_keywords and [tuple(k) for k in r.top_keywords]]) for r in found.collect())
    assert got == sorted(map(str, [
        ["a", 4, [(1, "wine", 3), (2, "pizza", 2)]], ["a", 4, [(1, "wine", 3), (2, "pizza", 2)]], ["b", 1, None], ["c", 0, None], [None, 0, None]]))
    # the place itself and all that comes from its reviews
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
