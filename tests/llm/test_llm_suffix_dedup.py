import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetlens.llm import suffix_dedup
from streetlens.llm.suffix_dedup import anchors, deduplicated, merge, range_minimum, without_repeats


def expected(texts, length):
    datas = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [256, 1])
def test_equals_brute_force(spark, clashing, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "BUCKET_WINDOWS", largest)
    rows = clashing.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in without_repeats(clashing, 200).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(expected([r.text for r in rows], 200))


def test_columns_stay_and_signs_are_whole(spark, clashing, no_documents):
    cut = deduplicated(clashing)
    assert cut.columns == clashing.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[0].text == "" and rows[0].n_chars == 0 and rows[0].row == "x"
    assert rows[7].text is None and rows[8].text == ""
    assert rows[13].text == "one two three"
    assert cut.count() == clashing.count()
    assert without_repeats(no_documents).count() == 0 and deduplicated(no_documents).count() == 0


def test_refinement_finds_equal_strings_at_every_offset():
    rng = random.Random(4)
    length = 60
    base = bytes(rng.choice(b"ab") for _ in range(400))
    windows = []
    for _ in range(60):
        copy = bytearray(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = rng.choice(b"abc\x00")
        low, high = rng.randrange(0, 8), rng.randrange(8, 20)
        windows.append((low, high, bytes(copy[200 - high:200 - low + length])))
    low, high, content = (np.array([w[0] for w in windows]), np.array([w[1] for w in windows]), [w[2] for w in windows])
    flags = merge(np.zeros(60, np.int64), low, high, np.ones(60, np.int64), content, length)
    strings = {(i, o): content[i][high[i] - o:high[i] - o + length] for i in range(60) for o in range(low[i], high[i] + 1)}
    counts = Counter((o, s) for (_, o), s in strings.items())
    for (i, o), s in strings.items():
        assert flags[o, i] == (counts[o, s] > 1)
    assert flags.sum() == sum(n for n in counts.values() if n > 1)


def test_range_minimum():
    values = np.array([5, 3, 8, 1, 9, 7, 2, 6])
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    got = range_minimum(values, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [values[a + 1:b + 1].min() for a, b in pairs]


def test_every_start_has_one_window():
    data = np.frombuffer(b"aaaa" * 100 + b"xyz" * 120 + b"short", np.uint8)
    found = anchors(data, np.array([0, 400, 760, 765]), 200)
    starts = np.concatenate([np.arange(a - h, a - lo + 1) for a, h, lo in zip(found["at"], found["high"], found["low"], strict=True)])
    assert sorted(starts.tolist()) == [*range(201), *range(400, 561)]


def test_a_window_cut_into_pieces_is_one_row(spark):
    found = spark.createDataFrame(
        [(1, o, o) for o in (4, 0, 2, 1, 9, 8)] + [(1, 1, 4), (2, 0, 160), (2, 3, 3), (3, 5, 5), (3, 5, 5)], "window long, low int, high int")
    got = {r.window: [tuple(x) for x in r.runs] for r in suffix_dedup.runs_by_window(found).collect()}
    assert got == {1: [(0, 4), (8, 9)], 2: [(0, 160)], 3: [(5, 5)]}


def test_places_meet_their_window_once(spark, monkeypatch):
    # near copies that share most of a long passage: all buckets are cut into single strings
    monkeypatch.setattr(suffix_dedup, "BUCKET_WINDOWS", 1)
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
    rows = [(i, f"{passage[:300 + 5 * i]} own{i} {passage[300 + 5 * i:]}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("key"), "text")
    asked = []
    whole = suffix_dedup.runs_by_window
    monkeypatch.setattr(suffix_dedup, "runs_by_window", lambda found: asked.append(whole(found)) or asked[-1])
    suffix_dedup.repeated_spans(docs, 200).collect()
    assert asked[0].count() == asked[0].select("window").distinct().count() > 0
    got = [tuple(r) for r in without_repeats(docs.withColumnRenamed("key", "doc_id"), 200).orderBy("row.doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == expected([text for _, text in rows], 200)
