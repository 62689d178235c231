"""Reading and writing tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from anchorline.functions.times import parse_time
from anchorline.sources.schemas import SCORES

INDEX_COLUMN = re.compile(r"(Unnamed.*|_c\d+)?")


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, form: str = "parquet") -> DataFrame:
    """A stored table; only the columns named are read."""
    df = spark.read.format(form).load(path)
    return df.select(*columns) if columns else df


def scan_database(
    spark: SparkSession, url: str, table: str, split_on: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read by ranges of a numeric column; credentials come in as options."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=parts,
            **options,
        )
        .load()
    )


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header, its unnamed index columns dropped, and types by column name where given."""
    raw = spark.read.csv(path, header=True)
    kept = raw.select(*[F.col(f"`{c}`") for c in raw.columns if not INDEX_COLUMN.fullmatch(c)])
    if schema is None:
        return kept
    typed = {f.name: f.dataType for f in schema}
    return kept.select(
        *[
            (parse_time(c) if isinstance(typed[c], T.TimestampNTZType) else F.col(c).cast(typed[c])).alias(c)
            if c in typed
            else F.col(c)
            for c in kept.columns
        ]
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the table and read it back. With partitions only those present in ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    like(df, schema).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)


STORING = Lock()  # runs that are submitted side by side store one after the other


def store_scores(scores: DataFrame, path: str) -> DataFrame:
    """Tidy scores by run and target; storing a run again replaces it."""
    parts = ["run_id", "target_start", "target_end"]
    with STORING:
        write_table(like(scores, SCORES), path, parts)
    return load_scores(scores.sparkSession, path)


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(path)


def _folder(spark: SparkSession, path: str):
    """File system and path object of a folder, wherever Spark keeps it."""
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()), java


def stored_runs(spark: SparkSession, path: str) -> set[tuple[str, int, int]]:
    """(run, target start, target end) whose scores are stored: the ledger of a sweep. Empty before the first run."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return set()
    rows = load_scores(spark, path).select("run_id", "target_start", "target_end").distinct().collect()
    return {tuple(r) for r in rows}


CHOICES = "name string, choice string"


def store_choice(spark: SparkSession, path: str, name: str, choice: object) -> None:
    """A selection or settings found by a run, as JSON; the one stored last holds."""
    row = spark.createDataFrame([(name, json.dumps(choice))], CHOICES)
    row.coalesce(1).withColumn("stored", F.current_timestamp()).write.mode("append").parquet(path)


def load_choices(spark: SparkSession, path: str) -> dict[str, object]:
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return {}
    last = spark.read.parquet(path).groupBy("name").agg(F.max_by("choice", "stored").alias("choice"))
    return {r["name"]: json.loads(r["choice"]) for r in last.collect()}
