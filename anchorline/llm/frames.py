"""Small DataFrame helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NULL_ID = 2**63 - 1  # stands for a null id: sorts last, and is never smaller than another id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one map-side combined sum, from which numbers of partitions are derived."""
    return docs.agg(F.coalesce(F.sum(text_bytes(text)), F.lit(0))).first()[0]


def crc_held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts(total: int, each: int, least: int = 1) -> int:
    """Number of pieces of about ``each`` that hold ``total``."""
    return max(least, -(-int(total) // int(each)))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 1000


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with at most BATCH_ROWS rows a batch, as texts are long: the session's limit is lowered to it.

    A batch stands in the memory of the executor's JVM and of the Python worker at once.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
