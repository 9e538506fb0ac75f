import random
import re

import pytest

from streetlens.llm import jaccard_join
from streetlens.llm.jaccard_join import Rule, best_boundary, one_of_each_group, rarest_lists, similar_groups


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected(rows, width, share):
    sets = [shingles(r.text, width) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: min((r.doc_id for r, k in zip(rows, group, strict=True) if k == g and r.doc_id is not None), default=None) for g in set(group)}
    return [(r.doc_id, len(s), ids[g]) for r, s, g in zip(rows, sets, group, strict=True)]


@pytest.mark.parametrize(("width", "share", "block"), [(3, 90, 1024), (5, 80, 1024), (1, 50, 1024), (3, 90, 3)])
def test_equals_brute_force(spark, clashing, monkeypatch, width, share, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = clashing.select("doc_id", "text").collect()
    got = similar_groups(clashing, width, share).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows, width, share)))


def test_a_common_passage_makes_no_large_group_of_candidates(spark, monkeypatch):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    rows = []
    for i in range(30):
        own = words(140)
        rows += [(2 * i, f"{own} {passage}"), (2 * i + 1, f"{own} {passage} {words(1)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = []

    def grouped(links, real=jaccard_join.connected_components):
        groups.append(found := real(links))
        return found

    monkeypatch.setattr(jaccard_join, "connected_components", grouped)
    got = similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected(docs.collect(), 5, 80))
    # by the passage alone all sixty were one group, each set of it sent once for every block of the group
    assert [r["count"] for r in groups[0].groupBy("label").count().collect()] == [2] * 30


def test_rarest_lists_hold_one_of_every_pair(spark):
    rng = random.Random(3)
    sets = {i: rng.sample(range(40), rng.randrange(1, 25)) for i in range(60)}
    need = {i: rng.randrange(1, 8) for i in sets}
    rows = [(key, i, i % 2, need[i]) for i, keys in sets.items() for key in keys]
    kept = {}
    for r in rarest_lists(spark.createDataFrame(rows, "key bigint, set_id bigint, kind int, need int")).collect():
        kept.setdefault(r.set_id, set()).add(r.key)
    assert all(kept.get(i, set()) <= set(keys) for i, keys in sets.items()) and sum(map(len, kept.values())) < len(rows)
    for a in sets:
        for b in sets:
            if a < b and a % 2 == b % 2 and len({*sets[a]} & {*sets[b]}) >= max(need[a], need[b]):
                assert kept[a] & kept[b]


def test_one_document_of_each_group_stays(spark, clashing, no_documents):
    kept = one_of_each_group(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    want = expected(clashing.select("doc_id", "text").collect(), 5, 80)
    empty = sum(1 for _, n, _ in want if n == 0)
    groups = {c for _, n, c in want if n}
    assert len(ids) == len(groups) + empty
    assert groups <= set(ids) and 1 not in ids and 0 in ids
    assert one_of_each_group(no_documents).count() == 0 and similar_groups(no_documents).count() == 0


def test_sizes_that_follow_from_the_rule():
    rule = Rule(90, 19)
    for a in range(1, 400):
        assert rule.largest(a) == max(b for b in range(a, 2 * a + 2) if 100 * a >= 90 * b)
        assert rule.smallest(a) == min(b for b in range(1, a + 1) if 100 * b >= 90 * a)
        for b in range(a, rule.largest(a) + 1):
            assert set(rule.classes(a)) & set(rule.classes(b))
            least = next(c for c in range(1, a + 1) if 100 * c >= 90 * (a + b - c))
            assert a + b - 2 * least <= rule.apart(a + b)
            if a <= 19:
                assert least in rule.subset_sizes(a) and least in rule.subset_sizes(b)
            else:
                assert rule.needed(max(set(rule.classes(a)) & set(rule.classes(b)))) > rule.apart(a + b)


def test_boundary_follows_cost():
    assert best_boundary(90, {5: 1000}) >= 5
    assert 9 <= best_boundary(90, {s: 100 for s in range(1, 30)}) < 29
