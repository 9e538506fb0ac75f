"""Writers: whole-table replacement, JSON export, and a table that takes the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, StructType, TimestampNTZType, TimestampType


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite a table and return it as read back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def with_iso_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO-8601 text, also inside structs and arrays."""
    def convert(value: Column, kind) -> Column:
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return F.date_format(value, _ISO)
        if isinstance(kind, DateType):
            return F.date_format(value, "yyyy-MM-dd")
        if isinstance(kind, StructType):
            inner = F.struct(*[convert(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), inner)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda v: convert(v, kind.elementType))
        return value

    return df.select(*[convert(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def export_json(tables: dict[str, DataFrame], path: str, created_at: Column | None = None) -> dict[str, str]:
    """One JSON-lines folder per table, dates as ISO text; ``created_at`` is added to every row when given."""
    paths = {}
    for name, df in tables.items():
        rows = with_iso_dates(df if created_at is None else df.withColumn("created_at", created_at))
        paths[name] = f"{path}/{name}"
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(paths[name])
    return paths


# -- a table that grows by the batches of a stream --------------------------------------------------
#
# ``path/batch=N`` holds what batch N contributes, ``path/fold/upto=N`` all batches up to N folded into one. A reader
# takes the newest complete fold and the batches behind it, so a fold that was cut off, batches it has not
# removed yet, and the replay of a batch it already holds change nothing.

def write_delta(batch: DataFrame, path: str, number: int) -> None:
    """Add what batch ``number`` contributes. Writing the batch again replaces its own rows and no others,
    so a replay after a failure is harmless, and the work follows the batch, not the table."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_deltas(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All contributions so far; empty when there was no batch yet."""
    folded, batches = _parts(spark, path)
    return _read(spark, path, schema, folded, [b for b in batches if b > folded])


def fold_deltas(spark: SparkSession, path: str, schema: StructType, fold: Callable[[DataFrame], DataFrame], pending: int = 1) -> bool:
    """Fold the newest batches into one table, once more than ``pending`` of them wait; tells whether it did.

    ``fold`` takes contributions and returns fewer rows of the same columns that stand for them. The fold is written
    first and named by its last batch; then what the fold *before* it had replaced is removed. What this one replaces
    stays until the next, so that frames read from it can still be computed.
    """
    folded, batches = _parts(spark, path)
    waiting = [b for b in batches if b > folded]
    if len(waiting) <= pending:
        return False
    rows = fold(_read(spark, path, schema, folded, waiting)).select(*schema.fieldNames())
    rows.write.mode("overwrite").parquet(f"{path}/fold/upto={waiting[-1]}")
    remove_folded(spark, path, folded)
    return True


def remove_folded(spark: SparkSession, path: str, folded: int) -> None:
    """Remove the batches that the fold up to ``folded`` holds, and the folds before it."""
    _, batches = _parts(spark, path)
    for number in [b for b in batches if b <= folded]:
        _delete(spark, f"{path}/batch={number}")
    for number in [f for f in _numbers(spark, f"{path}/fold", "upto") if f < folded]:
        _delete(spark, f"{path}/fold/upto={number}")


def _read(spark: SparkSession, path: str, schema: StructType, folded: int, batches: list[int]) -> DataFrame:
    paths = [f"{path}/batch={b}" for b in batches] + ([f"{path}/fold/upto={folded}"] if folded >= 0 else [])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """Number of the newest complete fold (-1 without one), and the complete batches in order."""
    folds = _numbers(spark, f"{path}/fold", "upto")
    return max(folds, default=-1), _numbers(spark, path, "batch")


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete tables ``name=N`` below a path."""
    hadoop, files = _file_system(spark, path)
    if not files.exists(hadoop):
        return []
    found = [str(s.getPath().toString()) for s in files.listStatus(hadoop)]
    numbered = [p for p in found if p.rsplit("/", 1)[1].startswith(f"{name}=")]
    return sorted(int(p.rsplit("=", 1)[1]) for p in numbered if files.exists(_file_system(spark, f"{p}/_SUCCESS")[0]))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
