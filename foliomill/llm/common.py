"""Shared plumbing: tables, scratch space that every executor can read, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python kernel holds at once; keeps a worker small whatever the batch size is.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        return


class Scratch:
    """Tables of one run in the shared folder: a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        # shuffle files behind a written table are not read again; Spark deletes them once the driver has let go of the plan
        del df
        release()
        self.spark.sparkContext._jvm.System.gc()
        return back

    def split(self, df: DataFrame, column: str, values: list[int]) -> dict[int, DataFrame]:
        """Writes ``df`` once, a table for each of the ``values`` of a column, which goes."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        out = {}
        for v in values:
            out[v] = self.spark.read.schema(df.drop(column).schema)
            at = f"{path}/{column}={v}"
            # a table without rows has no folder
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            exists = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
            out[v] = out[v].parquet(at) if exists else self.spark.createDataFrame([], df.drop(column).schema)
            out[v]._scratch_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)

    def only(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and deletes all earlier tables, which nothing may read any more."""
        earlier = [f"{self.root}/{k}" for k in range(1, self.n + 1)]
        back = self.keep(df)
        for path in earlier:
            _delete(self.spark, path)
        return back


def crc_mod(col: str | Column, m: int) -> Column:
    """``crc32`` of the value as text, modulo ``m``; null ids count as remainder of the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def release() -> None:
    """Hands memory that a task has freed back to the system: workers are reused, and some wait idle."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a kernel built once per task; batches are cut so that little text is held at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch):
                out = kernel(part)
                if out is None:
                    continue
                yield from out if isinstance(out, list) else [out]
        del kernel
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``most`` bytes of ``codes`` or else ``text`` each (one row at least)."""
    column = next((c for c in ("codes", "text") if c in batch.schema.names), None)
    if column is None or batch.num_rows < 2:
        yield batch
        return
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
    lengths = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def record(batch: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := batch[k], pa.Array) else pa.array(x, t) for k, t in types.items()], names=list(types))


MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
