"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task holds of a table it writes.
BLOCK_BYTES = 16 << 20
#: Bytes that a task and its Python worker pass each other at once.
BATCH_BYTES = 4 << 20
_SETTINGS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="siftgauge-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/siftgauge/{kind}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings for the statements inside, by the last part of their names."""
    names = {k: next(n for n in _SETTINGS if n.endswith(k)) for k in values}
    was = {n: spark.conf.get(n) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, str(values[k]).lower())
    try:
        yield
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Statements inside pass texts to Python by BATCH_BYTES; `Tables.write` does so by itself."""
    return _set(spark, maxBytesPerBatch=BATCH_BYTES)


class Tables:
    """Tables of one run, each written once as Parquet; what is lost with an executor is read again from there.

    `drop` deletes tables whose readers have all been written themselves; what the result still reads stays in the
    shared folder, which the cluster clears.
    """

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self.spark, self.folder, self.made = spark, new_folder(spark, kind), 0

    def write(self, df: DataFrame, rows_at_once: int | None = None) -> DataFrame:
        """`rows_at_once`: how many rows a task holds of what `df` reads, where rows are large."""
        self.made += 1
        path = f"{self.folder}/{self.made:04d}"
        held = {} if rows_at_once is None else {"columnarReaderBatchSize": rows_at_once, "maxRecordsPerBatch": rows_at_once}
        # Shuffle files of the statement go when it has ended.
        with _set(self.spark, **{"fileCleanup.enabled": True}, maxBytesPerBatch=BATCH_BYTES, **held):
            df.write.option("parquet.block.size", BLOCK_BYTES).option("parquet.page.size.row.check.min", 16).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siftgauge_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._siftgauge_path)
            path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read from there."""
    return Tables(df.sparkSession, "cut").write(df)
