import corpus_pipeline
from pyspark.sql import functions as F

from streetlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_the_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        seen.append((name, rows.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
            docs = rows.cache()
    counts = [n for _, n in seen]
    assert 150 < counts[-1] < 200 and counts == sorted(counts, reverse=True) and counts[0] > counts[1]


def test_run_gives_the_ids_of_all_that_is_kept(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"]
    assert rows.filter(~F.col("round_trip") | (F.size("ids") != F.col("n_pieces"))).count() == 0
    assert rows.select("doc_id").distinct().count() == rows.count()


def test_stages_take_dotted_names_nulls_repeats_and_no_rows(spark):
    few = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30)
    odd = spark.createDataFrame(
        [(None, "no id here", "en", None, None), (5001, None, None, None, None), (5002, "", "fr", "s", 0), (5002, "", "fr", "s", 0)], few.schema)
    docs = few.union(odd).union(odd).selectExpr("*", "1 AS `meta.x`", "'y' AS `a``b`")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns, name
            assert rows.filter("`meta.x` = 1 AND `a``b` = 'y'").count() == rows.count() > 0, name
        else:
            assert rows.count() == docs.count()
