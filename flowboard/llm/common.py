"""What several operators share: document keys, order without one task, scratch tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowboard.session import cut, new_path

__all__ = ["cut", "new_path", "on_workers", "drop", "hash_pair", "documents", "order_bounds", "chunk_of", "offsets"]

#: Rows of one ordered chunk; a chunk is sorted in one task.
CHUNK_ROWS = 4096
_FAN = 256


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines with the same folders import this package; elsewhere ship it with `--py-files`."""
    import flowboard

    root, env = os.path.dirname(os.path.dirname(os.path.abspath(flowboard.__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table written by `cut` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def hash_pair(col: Column) -> tuple[Column, Column]:
    """128 bits of hash as two bigints: at 10^12 values one alone would collide."""
    return F.xxhash64(col), F.xxhash64(F.lit("second"), col)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named further columns, nothing else."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def order_bounds(ids: DataFrame, col: str = "doc_id", chunk_rows: int = CHUNK_ROWS) -> list[int]:
    """Values of `col` that cut its sorted order into chunks of about `chunk_rows` rows.

    One pass over that column; the driver gets one number a chunk. Nulls belong to the first chunk.
    """
    chunks = -(-ids.count() // chunk_rows)
    if chunks < 2:
        return []
    cuts = [i / chunks for i in range(1, chunks)]
    found = ids.agg(F.percentile_approx(col, cuts, 20 * chunks + 1000)).first()[0]
    return sorted(set(found or []))


def chunk_of(col: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or below the value: a two-level search over constant arrays."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i:i + _FAN] for i in range(0, len(bounds), _FAN)]
    heads = F.lit([g[0] for g in groups]).cast("array<bigint>")
    tables = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b <= col))
    fine = F.size(F.filter(F.element_at(tables, coarse), lambda b: b <= col))
    return F.when(col.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * _FAN + fine).cast("int")


def offsets(counts: DataFrame, keys: list[str], chunk: str, n: str) -> DataFrame:
    """Rows before each chunk, per key: a running sum over one small row a chunk."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint"))
