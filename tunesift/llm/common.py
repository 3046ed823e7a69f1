"""Helpers shared by the operators: shared-folder tables, global ranks, text views.

``cloudpickle`` ships functions of this subpackage by value, so executors need
no installed copy of the library.
"""

from __future__ import annotations

import sys
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesift.session import scratch_path


def ship(*modules: str) -> None:
    """Pickle these modules by value."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])


ship(__name__)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")


#: Rows and bytes that pass between the JVM and a Python worker at once, so whole
#: long texts need bounded memory on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


@contextmanager
def small_batches(spark: SparkSession):
    """The session's batch bounds, lowered to ``BATCH`` while the jobs inside run."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, most in BATCH.items():
            own = str(before[k] or "0")
            spark.conf.set(k, str(min(int(own), most) if own.isdigit() and int(own) > 0 else most))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and reread it: this cuts
    the lineage, and a lost executor costs a reread instead of a recomputation."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _partition_starts(ranked: DataFrame, agg) -> DataFrame:
    """One row per partition (a number the session sets, not the data): its start."""
    per = sorted((r[0], r[1]) for r in ranked.groupBy("_pid").agg(agg).collect())
    rows, at = [], 0
    for pid, n in per:
        rows.append((pid, at))
        at += n
    return ranked.sparkSession.createDataFrame(rows, "_pid int, _start long")


def global_rank(df: DataFrame, order: list, name: str, col: str = "rank") -> DataFrame:
    """Gapless rank from 0 over all rows in the given order (ties in any order).

    Range partitions sorted in place, stored once with each row's place in its
    partition; a rank is that place plus the rows of the partitions before.
    No task sees more than one range, however many rows share a key, as long
    as the order has a distinguishing last column.
    """
    n = n_partitions(df.sparkSession)
    ranked = stored(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    starts = _partition_starts(ranked, F.count(F.lit(1)))
    return (ranked.join(F.broadcast(starts), "_pid").withColumn(col, F.col("_start") + F.col("_pos"))
            .drop("_pid", "_pos", "_start"))


def running_total(df: DataFrame, order: list, value: str, name: str, col: str = "before") -> DataFrame:
    """Exclusive running sum of ``value`` over all rows in the given order.

    As ``global_rank``: sums inside a sorted range partition, stored, plus the
    totals of the partitions before.
    """
    n = n_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = ranged.withColumn("_local", F.lit(0).cast("long")).withColumn("_pid", F.lit(0)).schema

    def sums(batches):
        from pyspark import TaskContext
        pid, at = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            end = at + np.cumsum(v)
            out = [*b.columns, pa.array(end - v), pa.array(np.full(len(v), pid, np.int32))]
            at = int(end[-1]) if len(end) else at
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "_local", "_pid"])

    part = stored(ranged.mapInArrow(sums, schema), name)
    starts = _partition_starts(part, F.sum(value))
    return (part.join(F.broadcast(starts), "_pid").withColumn(col, F.col("_start") + F.col("_local"))
            .drop("_pid", "_local", "_start"))


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        width = np.int64
    else:
        width = np.int32
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("" if "string" in str(arr.type) else b"")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, width)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(arr: pa.Array, max_bytes: int = 4 << 20):
    """(start, length) runs of an array holding about ``max_bytes`` of text each, one row at least."""
    if not len(arr):
        return
    _, off = utf8_view(arr)
    start = 0
    while start < len(arr):
        end = int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), len(arr))
        yield start, end - start
        start = end


def whole_groups(batches, n_keys: int):
    """Batches of sorted rows, joined so that none ends inside a run of equal keys (the first ``n_keys`` columns)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        starts = group_starts(t, n_keys)
        held = t.slice(starts[-1])
        if starts[-1]:
            yield t.slice(0, starts[-1]).combine_chunks().to_batches()[0]
    if held is not None:
        yield held.combine_chunks().to_batches()[0]


def group_starts(t, n_keys: int) -> np.ndarray:
    """Where each run of equal keys begins in a batch or table of sorted rows (keys are numbers)."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in range(n_keys):
        c = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def kept_by_worker(key, make):
    """``make()``, or what an earlier task of this worker process made under the same key
    (of each key's first part, only the latest is kept)."""
    state = sys.modules.setdefault("tunesift_worker_state", types.ModuleType("tunesift_worker_state"))
    if state.__dict__.get(key[0], (None,))[0] != key:
        state.__dict__[key[0]] = (key, make())
    return state.__dict__[key[0]][1]


def release() -> None:
    """Give memory that a step has freed back to the system: workers live on, and the next step's come on top."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gathered(batches, column: int, max_bytes: int):
    """Batches joined until their text column holds about ``max_bytes``."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(utf8_view(b.column(column))[1][-1])
        if size >= max_bytes:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            yield whole
            del whole
            release()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    del held
    release()


#: ASCII white space: the six bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_counts(arr: pa.Array) -> np.ndarray:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of each text (null: 0)."""
    raw, off = utf8_view(arr)
    if not len(raw):
        return np.zeros(len(arr), np.int64)
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begins[edge] = word[edge]  # a text's first byte starts a word whatever precedes it
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
