"""Session helpers: time zone, checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on. Epoch arithmetic and timestamps are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary folder serves a session whose tasks run in the driver's own
    process (tests); on a cluster no machine-local folder would do, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="flowboard-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Materialise as a table in the shared folder: short lineage, survives lost executors.

    Columnar files, so each later branch reads only the columns it needs, in a folder per value of `by`.
    Shuffle files go as soon as the table is written, not when the driver next collects garbage.
    """
    path, conf = new_path(df.sparkSession, "cut"), df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP_CONF) if before is None else conf.set(CLEANUP_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store, sorted; none where it does not exist."""
    hadoop, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file: there from one moment to the next, never in part."""
    hadoop, fs = _fs(spark, path)
    fs.create(hadoop, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file with all it holds."""
    hadoop, fs = _fs(spark, path)
    fs.delete(hadoop, True)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the tables made by `cut` that `df` reads, once nothing else does; with `part` (`column=value`) one folder of each."""
    for path in {re.sub(r"(/cut-[0-9a-f]{32})/.*", r"\1", f) for f in df.inputFiles()}:
        remove(df.sparkSession, f"{path}/{part}".rstrip("/"))
