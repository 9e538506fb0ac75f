import hashlib
import re

import pytest

from streetlens.llm import decontaminate
from streetlens.llm.decontaminate import benchmark_matches, contamination, decontaminated


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def expected(docs, items, window=13, share=20):
    wanted = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            wanted.setdefault(tuple(w[i:i + window]), set()).add(name or "")
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wanted}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[tuple(w[i:i + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    cut = texts[0].split()
    rows = [("b", " ".join(cut[10:40])), ("a", " ".join(cut[20:33]).upper()), ("a", "one two"), ("c", None), (None, "日本語のテキスト"), ("d", ""), ("e", " ".join(cut[20:33])),
            ("f", "never seen words"), ("g", texts[18][:400])]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("searched", [1 << 17, 2])
def test_equals_brute_force(spark, clashing, benchmark, monkeypatch, searched):
    monkeypatch.setattr(decontaminate, "SEARCH_ROWS", searched)
    rows = clashing.select("doc_id", "text").collect()
    report = contamination(clashing, benchmark)
    got = report.select("n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = expected([r.text for r in rows], [tuple(r) for r in benchmark.collect()])
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert any(w[4] for w in want)


def test_clean_documents_stay_as_they_are(spark, clashing, benchmark, no_documents):
    kept = decontaminated(clashing, benchmark)
    assert kept.columns == clashing.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert 0 not in rows and 18 in rows and 7 in rows and rows[18].contaminated == "x"
    assert decontaminated(no_documents, benchmark).count() == 0
    assert decontaminated(clashing, benchmark.limit(0)).count() == clashing.count()


def test_longest_matches_have_their_places(spark, benchmark, texts):
    docs = spark.createDataFrame([(1, "x y " + " ".join(texts[0].split()[5:50]) + " z")], "doc_id int, text string")
    found = {(r.item_id, r.item_start, r.doc_start, r.n_words) for r in benchmark_matches(docs, benchmark).collect()}
    assert found == {("b", 0, 7, 30), ("a", 0, 17, 13), ("e", 0, 17, 13)}


@pytest.mark.parametrize("pairs", [1 << 22, 1])
def test_parts_of_a_benchmark_give_the_report_of_the_whole(spark, clashing, benchmark, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIR_ROWS", pairs)
    # two halves of one passage that overlap, and one id in several parts
    cut = clashing.filter("text IS NOT NULL").first().text.split()
    more = benchmark.union(spark.createDataFrame([(f"h{i}", " ".join(cut[i:i + 16])) for i in range(0, 40, 5)] * 2, benchmark.schema))
    whole = contamination(clashing, more, share=2)
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 1200)
    parts = contamination(clashing, more, share=2)
    assert 2 <= len(decontaminate._parts(more)) <= 16 and parts.columns == whole.columns
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert whole.filter("contaminated").count() and whole.filter("n_hit > 0 AND NOT contaminated").count()
    assert decontaminated(clashing, more, share=2).columns == clashing.columns
    assert benchmark_matches(clashing, more).distinct().count() > 0


def test_an_item_above_the_bound_is_refused(spark, clashing, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 10)
    with pytest.raises(ValueError, match="item"):
        contamination(clashing, benchmark)


def test_a_text_longer_than_a_piece_of_work(spark, texts, benchmark, monkeypatch):
    """One text of 5 MB among short ones, which is a piece of work by itself."""
    long = " ".join(["filler words in between"] * 220_000)
    body = f"{long} {texts[0]} {long[:1000]}"
    docs = spark.createDataFrame([(1, body), (2, texts[0]), (3, None)], "doc_id int, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, benchmark).collect()}
    want = expected([texts[0], None], [tuple(r) for r in benchmark.collect()])
    assert (got[2], got[3]) == tuple(want)
    assert got[1][1:4] == got[2][1:4] and got[1][0] == len(words(body)) and not got[1][4]
