"""Helpers shared by the text operators: shared storage, Arrow batches, text views."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch; texts may be long, and a worker holds a batch at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: A key with more than one in so many rows is dealt to several tasks; so there are fewer such keys than this.
HOT_SHARE = 256

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, on a local master (tests on one machine), is a temporary one made and set.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tiergrid-")
            sc.setCheckpointDir(base)
        _folders[app] = f"{base.rstrip('/')}/tiergrid-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete the application's tables when the driver's Python ends, if its JVM still runs."""
    if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001  the JVM went first; the folder is the cluster's to clear
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and the
    rows outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once what was made of them is itself written."""
    for table in tables:
        _delete(table.sparkSession, table.shared_path)


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", weigh: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, which holds a key once at most, on one column.

    Keys with more than one in HOT_SHARE rows of ``big`` (or of ``weigh``, a cheaper table with the same keys) are dealt
    to as many tasks as they have such shares, and their rows of ``small`` go to each of these; so no key, whatever its rows, makes
    a task longer than others.  Rows are dealt by their own hash, so a task that runs again deals them alike.  The hot keys, fewer than HOT_SHARE, and their counts come to the driver.
    """
    counts = (big if weigh is None else weigh).groupBy(key).count()
    totals = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    share = (totals["rows"] or 0) / HOT_SHARE
    if not totals["rows"] or totals["most"] <= max(share, 1):
        return big.join(small, key, how)
    hot = [(r[key], max(2, math.ceil(r["count"] / share))) for r in counts.where(F.col("count") > max(share, 1)).collect() if r[key] is not None]
    if not hot:
        return big.join(small, key, how)
    parts = big.sparkSession.createDataFrame(hot, f"{key} {big.schema[key].dataType.simpleString()}, spread_n int")
    left = big.join(F.broadcast(parts), key, "left").withColumn("spread_at", F.when(F.col("spread_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("spread_n")).cast("int"))).drop("spread_n")
    right = small.join(F.broadcast(parts), key, "left").withColumn("spread_at", F.explode(F.sequence(F.lit(0), F.coalesce("spread_n", F.lit(1)) - 1))).drop("spread_n")
    return left.join(right, [key, "spread_at"], how).drop("spread_at")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in rows and bytes, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(key).removesuffix("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def give_back() -> None:
    """Return the memory that a worker has freed to the system; workers wait for their next task, and several share an executor's."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives memory back when its partition ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def fields(df: DataFrame, names: list[str] | tuple[str, ...]) -> str:
    """These columns of ``df`` as the part of a schema that follows others."""
    return "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in names)


def pack(arrays: list[np.ndarray]) -> pa.Array:
    """Numpy arrays as one binary column."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())
