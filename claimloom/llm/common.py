"""Shared plumbing of the corpus operators: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()

#: Rows and bytes of an Arrow batch handed to Python, at most (a single longer row excepted).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of plans made from now on. All operators ask for the same bounds, so plans don't race on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else a private one (local master only, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the application's scratch is removed when Python exits."""
    root = f"{shared_dir(spark)}/claimloom-{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; scratch is then left to the cluster's own cleaning
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that staged() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of one batch; small batches, so that memory stays bounded."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    col = batch.column(column)
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def extended(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in extra])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, never reach an operator's joins."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but `own` under a number (no name of an operator's can clash), and what gives the columns back."""
    names = {c: c if c in own else f"c{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def input_bytes(df: DataFrame) -> int:
    """Size of df's (doc_id, text …) rows: Catalyst's estimate, or, where it has none, twice the texts' bytes as counted.

    Widths and bucket counts follow from it, never results.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return 2 * int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
