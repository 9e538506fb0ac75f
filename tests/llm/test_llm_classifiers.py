import random

import numpy as np
from pyspark.sql import functions as F

from streetlens.llm.language_id import fit, has_letter, identify_language, init, responses, step, tables, trained_network, training_windows
from streetlens.llm.quality import good_documents, score_quality, word_vectors

from tests.llm.conftest import prose


def languages(spark):
    rng = random.Random(1)
    parts = {"xx": "the and ing her tion was".split(), "yy": "sch ein und keit der über".split(), "zz": "que los ción ado ñar más".split()}
    rows = []
    for i in range(240):
        lang = "xyz"[i % 3] * 2
        rows.append((i, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(rng.choice([3, 20, 200]))), lang))
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 !?", "xx"), (903, "thetion anding", None), (0, rows[0][1], "xx"), (904, "keitund " * 20_000, "yy")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"row": F.lit("x"), "score": F.lit(None).cast("string")}).repartition(2)


def test_languages_of_unseen_texts(spark):
    docs = languages(spark)
    got = identify_language(docs, docs.filter("doc_id % 4 <> 2"), docs.columns).collect()
    assert len(got) == docs.count()
    unseen = [r for r in got if r.row.doc_id < 240 and r.row.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == r.row.lang for r in unseen]) > 0.97
    named = {r.row.doc_id: r for r in got}
    assert all((named[i].lang_pred, named[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert named[903].lang_pred == "xx" and named[904].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got)
    nothing = identify_language(docs, docs.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert identify_language(docs.limit(0), docs).count() == 0


def test_tables_equal_convolutions_and_gradients_are_right():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in init(3, 1).items()}
    rows, label = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        logit = responses(rows, tables(net), net)
        return float(np.mean(np.log(np.exp(logit).sum(axis=1)) - logit[np.arange(6), label]))

    grads = step(net, rows, label)
    for name, at in (("filter3", (4, 2)), ("out", (7, 1)), ("bias2", (3,)), ("embedding", (int(rows[0, 5]), 1)), ("out_bias", (2,))):
        keep, h = net[name][at], 1e-5
        net[name][at] = keep + h
        up = loss()
        net[name][at] = keep - h
        down = loss()
        net[name][at] = keep
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-4


def test_training_is_the_same_every_time():
    texts, label = [prose(i, 30) for i in range(20)], np.arange(20) % 2
    a, b = fit(texts, label, 2, epochs=1), fit(texts, label, 2, epochs=1)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def qualities(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        text = prose(i, rng.choice([8, 40, 200]))
        bad = i % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "*** "), " | ".join(text.split()), " ".join([text.split()[0]] * 30)][i // 4 % 4]
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, "x"))
    rows += [(900, None), (901, ""), (902, prose(5, 20_000)), (None, prose(6, 30)), (2, rows[2][1])]
    labels += [(900, 1, "x"), (5000, 0, "x"), (None, 1, "x"), (1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"row": F.lit("x"), "predicted": F.lit("x"), "label": F.lit("x")}).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, row string")


def test_quality_of_unseen_texts(spark):
    docs, labels = qualities(spark)
    got = score_quality(docs, labels.filter("doc_id % 5 <> 0"), docs.columns).collect()
    assert len(got) == docs.count()
    unseen = [r for r in got if r.row.doc_id is not None and r.row.doc_id < 300 and r.row.doc_id % 5 == 0]
    assert np.mean([r.predicted == (r.row.doc_id % 4 != 0) for r in unseen]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {902}
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_word_vectors_cover_all_texts_whatever_the_partitions(spark):
    docs, _ = qualities(spark)
    assert np.array_equal(word_vectors(docs), word_vectors(docs.repartition(7)))


def test_training_windows_come_from_the_whole_text(spark):
    head = "12345 67 89, " * 400
    rows = [(i, head + word * 300, word[:2]) for i, word in enumerate(["theing ", "schkeit "] * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert all(b"e" in part or b"c" in part for _, text, _ in rows for part in training_windows(text.encode()))
    net, names = trained_network(docs)
    assert names == ["sc", "th"]
    got = identify_language(spark.createDataFrame([(1, "theing theing"), (2, "schkeit schkeit")], "doc_id bigint, text string"), docs)
    assert {r.row.doc_id: r.lang_pred for r in got.collect()} == {1: "th", 2: "sc"}


def test_repeated_documents_do_not_crowd_out_a_label(spark):
    rng = random.Random(9)
    texts = [(i, prose(i, 40) if i % 2 else " ".join(rng.choice(["!!", "##", "A1"]) for _ in range(40))) for i in range(60)]
    # each bad document is there 30 times: 900 rows, the bound is 4 * 60
    docs = spark.createDataFrame([r for r in texts for _ in range(1 if r[0] % 2 else 30)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, quality int")
    got = {r.row.doc_id: r.predicted for r in score_quality(docs, labels, rows=60).collect()}
    assert np.mean([got[i] == i % 2 for i, _ in texts]) > 0.9


def test_numbers_are_no_letters():
    assert not any(map(has_letter, (None, "", "²½ Ⅷ 123", "_ 7", "€ 5")))
    assert all(map(has_letter, ("² a", "日", "ß", "º 1 é")))
