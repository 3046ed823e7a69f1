"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2^bits`` buckets by quantiles (of strings by
the counts of their values), a row's buckets become one curve index, and the
rows in curve order are cut into shards of equal row count and, inside a shard,
into runs of about ``run_bytes`` of text that are one file each.  Neighbours on
the curve are neighbours in every dimension, so each file spans a small box
and Parquet min/max statistics prune files on any of the dimensions.

A first pass ranks slim keys (curve index, id, a hash of the text, its bytes)
and cuts them; the whole rows are shuffled once, each run to a partition of its
own, and sorted there.  Rows whose key is the same on both sides of a cut are
ranked among themselves first, so however many rows share a key, none of its
runs grows.  Law ``rows``: shard counts differ by one at most.

Defined results: a null dimension value has bucket 0; a null text has no bytes
and checksum 0; a null id sorts first within its curve index; rows that repeat
index and id are neighbours in the order of their text's hash, and repeated rows
in any order; an empty table gives empty shards.  Ids that aren't whole numbers
are ordered as strings.  All columns of the input keep their names and values;
those that sharding adds (``Shards.names``) get an underscore in front where
the input has such a name.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.llm.common import global_rank, n_partitions, running_total, shared_path, ship, small_batches, stored

ship(__name__)

BITS = 6
#: Bytes of text of a run (one file of a shard), about; a shard has one run at least.
RUN_BYTES = 16 << 20


def hilbert_index(buckets: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of rows of bucket numbers (n, dims): the transpose form of the
    Hilbert transform, one bit plane after another, interleaved at the end."""
    x = buckets.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations, from the highest plane down
        low = q - 1
        for i in range(dims):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[:, i] >> plane & 1)
    return index


def _string_bounds(df: DataFrame, dim: str, bits: int) -> list[str]:
    """The inner bucket bounds of a string column: the values at its quantiles, from the running counts of its values."""
    counts = df.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = running_total(counts, ["value"], "n", "shard-values")
    n = total.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    # a value is the bound of every step that its rows cover: at most 2^bits - 1 rows come back
    step = F.expr(f"filter(sequence(1, {(1 << bits) - 1}), k -> k * {n} > before * {1 << bits} and k * {n} <= (before + n) * {1 << bits})")
    return [r.value for r in total.withColumn("k", F.explode(step)).orderBy("k").select("value").collect()] if n else []


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> tuple[list[Column], list[list]]:
    """The dimensions, numbers as doubles and others as strings, and their 2^bits - 1 inner bucket bounds.

    Bounds repeat where one value fills several buckets, so frequent values
    spread the others over the whole range of every dimension.
    """
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    texts = {d for d in dims if not isinstance(df.schema[d].dataType, T.NumericType)}
    cols = [F.col(d).cast("string" if d in texts else "double") for d in dims]
    numbers = [i for i, d in enumerate(dims) if d not in texts]
    row = df.agg(*[F.percentile_approx(cols[i], steps, 100 << bits) for i in numbers]).first() if numbers else []
    bounds = {i: list(q or []) for i, q in zip(numbers, row)}
    return cols, [bounds[i] if i in bounds else _string_bounds(df.select(cols[i].alias(d)), d, bits) for i, d in enumerate(dims)]


def curve_index(df: DataFrame, dims: list[str], bits: int = BITS) -> Column:
    ordinals, bounds = quantised(df, dims, bits)

    @F.pandas_udf(T.LongType())
    def index(*cols: pd.Series) -> pd.Series:
        buckets = []
        for c, b in zip(cols, bounds):
            there = c.notna().to_numpy()
            own = np.zeros(len(c), np.int64)
            values = c.to_numpy()[there]
            own[there] = np.searchsorted(np.array(b, values.dtype), values, "left") if len(b) else 0
            buckets.append(own)
        return pd.Series(hilbert_index(np.stack(buckets, axis=1), bits))

    return index(*ordinals)


@dataclass(frozen=True)
class Shards:
    path: str
    rows: DataFrame  # as read back: all columns of the input, and those of ``names``
    n_rows: int
    names: dict[str, str]  # what the columns curve, run, slot and shard are called


KEY = ["curve", "has_id", "id", "mark"]


def _keys(curve: Column, id_: Column, whole: bool, text: Column) -> list[Column]:
    """What rows are ordered by: curve index, id (nulls first), a hash of the text."""
    return [curve.alias("curve"), id_.isNotNull().alias("has_id"),
            F.coalesce(id_, F.lit(0).cast("long") if whole else F.lit("")).alias("id"), F.xxhash64(text).alias("mark")]


def _ranked(keys: DataFrame, order: list[str]) -> DataFrame:
    """The rows of keys and ``size`` with their gapless ``rank`` and the bytes ``before`` them, both over all rows in order."""
    ranged = keys.repartitionByRange(n_partitions(keys.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in ("pos", "local")), T.StructField("pid", T.IntegerType())])

    def sums(batches):
        from pyspark import TaskContext
        pid, rows, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            end = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows + np.arange(len(size))), pa.array(end - size),
                                              pa.array(np.full(len(size), pid, np.int32))], names=schema.names)
            rows, at = rows + len(size), int(end[-1]) if len(size) else at

    part = stored(ranged.mapInArrow(sums, schema), "shard-keys")
    starts, rows, at = [], 0, 0
    for pid, n, size in sorted(part.groupBy("pid").agg(F.count(F.lit(1)), F.sum("size")).collect()):  # one row a partition
        starts.append((pid, rows, at))
        rows, at = rows + n, at + size
    starts = keys.sparkSession.createDataFrame(starts, "pid int, first_rank long, first_byte long")
    return part.join(F.broadcast(starts), "pid").select(*keys.columns, (F.col("first_rank") + F.col("pos")).alias("rank"),
                                                        (F.col("first_byte") + F.col("local")).alias("before"))


def shard(df: DataFrame, path: str, n_shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text",
          bits: int = BITS, run_bytes: int = RUN_BYTES) -> Shards:
    """Write ``df`` as ``n_shards`` shards under ``path`` (folders by shard, a sorted file per run) and read them back."""
    spark = df.sparkSession
    given, names = {c.lower() for c in df.columns}, {}
    for c in ("curve", "run", "slot", "shard"):
        names[c] = c
        while names[c] in given:
            names[c] = "_" + names[c]
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    id_, text = F.col(id_col).cast("long" if whole else "string"), F.col(text_col)
    with small_batches(spark):
        key = _keys(curve_index(df, dims, bits), id_, whole, text)
        slim = df.select(*key, (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 8).cast("long").alias("size"))
        ranked = _ranked(slim, KEY)
        n = ranked.count()
        # shard k has the ranks r with floor(r * n_shards / n) = k; inside it a run ends after each run_bytes
        cell = (F.floor(F.col("rank") * n_shards / max(n, 1)).cast("int").alias("shard"), F.floor(F.col("before") / run_bytes).alias("cell"))
        ends = F.struct(*KEY)
        # one row a run: its first and last key
        runs = ranked.groupBy(*cell).agg(F.min("rank").alias("start"), F.min(ends).alias("low"), F.max(ends).alias("high")).orderBy("start").collect()
        starts = [r.start for r in runs]
        lows = [tuple(r.low) for r in runs]
        split = {tuple(b.low) for a, b in zip(runs, runs[1:]) if a.high == b.low}
        placed = _rows_with_run(df, key, lows, starts, split, ranked)
        first = [-(-r.shard * n // n_shards) for r in runs]
        table = spark.createDataFrame([(k, r.shard, r.start - f) for k, (r, f) in enumerate(zip(runs, first))], "run int, shard int, at long")
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        out = placed.repartitionById(max(len(runs), 1), F.col("run")).sortWithinPartitions(*KEY, "among").withColumn("pos", inside) \
            .join(F.broadcast(table), "run").select("row.*", F.col("curve").alias(names["curve"]), F.col("run").alias(names["run"]),
                                                    (F.col("at") + F.col("pos")).alias(names["slot"]), F.col("shard").alias(names["shard"]))
        out.write.partitionBy(names["shard"]).parquet(path)
    return Shards(path, spark.read.schema(out.schema).parquet(path), n, names)


def _rows_with_run(df: DataFrame, key: list[Column], lows: list[tuple], starts: list[int], split: set[tuple], ranked: DataFrame) -> DataFrame:
    """(row, the key, among, run) of every row: the last run that begins at or before its key; rows
    of a key on which a run ends and the next begins go by their place among themselves (``among``)."""
    spark = df.sparkSession

    @F.pandas_udf("int")
    def run_of(curve: pd.Series, has: pd.Series, id_: pd.Series, mark: pd.Series) -> pd.Series:
        keys = zip(curve.tolist(), has.tolist(), id_.tolist(), mark.tolist())
        return pd.Series([-1 if k in split else bisect_right(lows, k) - 1 for k in keys], dtype="int32")

    keyed = df.select(F.struct("*").alias("row"), *key).withColumn("run", run_of(*KEY))
    if not split:
        return keyed.withColumn("among", F.lit(0).cast("long"))
    one = keyed.schema["id"].dataType.simpleString()
    # at most one such key a run
    shared = spark.createDataFrame(sorted(split), f"curve long, has_id boolean, id {one}, mark long")
    least = ranked.join(F.broadcast(shared), KEY).groupBy(*KEY).agg(F.min("rank").alias("least"))
    hot = global_rank(keyed.filter("run < 0").drop("run").withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), [*KEY, "spread"], "shard-hot")
    own = hot.groupBy(*KEY).agg(F.min("rank").alias("own"))
    hot = hot.join(F.broadcast(own), KEY).join(F.broadcast(least), KEY).withColumn("among", F.col("rank") - F.col("own"))

    @F.pandas_udf("int")
    def run_at(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.asarray(starts, np.int64), rank.to_numpy(), "right") - 1).astype("int32")

    hot = hot.select("row", *KEY, run_at(F.col("least") + F.col("among")).alias("run"), "among")
    return keyed.filter("run >= 0").withColumn("among", F.lit(0).cast("long")).unionByName(hot)


def op2_shard_hilbert(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = shard(docs, shared_path(spark, "shards"), 24, ["lang", "source", "n_chars"])
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return out.rows.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                           F.lit("rows").alias("law"), F.col(out.names["shard"]).alias("shard"), F.col(out.names["slot"]).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
