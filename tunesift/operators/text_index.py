"""C3-C5, C7 through an index: trigram postings stored with the catalogue.

Rows are numbered in the order of their id and stored in blocks of
``BLOCK_ROWS`` (a partition folder each).  For every searched field the
postings say, per trigram and run of a block's rows, which rows' lower-cased
text has it (or which lack it, if those are fewer), kept by trigram in the order
of (field, trigram), so a search reads the few lists of its query's trigrams.
A task makes the lists of the rows that it reads: rows aren't exchanged by
trigram, finished lists are.  Rows that are in all lists are candidates; only the blocks
that hold candidates are read, and ``contains`` settles each.  A query of fewer
than three letters has no trigram and scans the table.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.operators.similarity import small_side

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

BLOCK_ROWS = 65_536
#: Rows and bytes of text that a task makes lists of at a time (places in a run are 16 bits).
RUN_ROWS, RUN_BYTES = 65_536, 16 << 20
POSTINGS = "field string, gram string, block int, first long, n int, lacks boolean, places binary"


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    schema: T.StructType         # the table's columns
    path: str                    # rows (block, row, the table's columns) and postings (``POSTINGS``)
    fields: dict[str, Column]    # what is searched, over the table's columns

    @property
    def rows(self) -> DataFrame:
        numbers = [T.StructField("row", T.LongType()), T.StructField("block", T.IntegerType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *numbers])).parquet(f"{self.path}/rows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")


def _lists(texts: pa.Array) -> tuple[list[str], list[bool], list[bytes]]:
    """The texts' trigrams, each with the places of the texts that have it, or of those that lack it."""
    n = len(texts)
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return [], [], []
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(n), size)
    inside = place[2:] == place[:-2]
    coded = pa.array((code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:])[inside]).dictionary_encode()
    grams, of, place = coded.dictionary.to_numpy(), coded.indices.to_numpy(), place[2:][inside].astype(np.uint16)
    order = np.argsort(of.astype(np.uint16) if len(grams) <= 1 << 16 else of, kind="stable")  # 16 bits are sorted by digits
    of, places = of[order], place[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (places[1:] != places[:-1])  # a text has a trigram once
    of, places = of[new], places[new]
    starts = np.searchsorted(of, np.arange(len(grams) + 1))
    names, lacks, out = [], [], []
    for g, a, b in zip(grams.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        names.append(chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF))
        lacks.append(b - a > n // 2)
        own = places[a:b]
        if lacks[-1]:
            rest = np.ones(n, bool)
            rest[own] = False
            own = np.flatnonzero(rest).astype(np.uint16)
        out.append(own.tobytes())
    return names, lacks, out


def _post(fields: list[str]):
    """``POSTINGS`` of batches (block, row, a lower-cased text per field): runs of one block's successive rows."""
    names = [c.split()[0] for c in POSTINGS.split(", ")]

    def made(held):
        t = pa.Table.from_batches(held)
        block, first = t.column(0)[0].as_py(), t.column(1)[0].as_py()
        for name, texts in zip(fields, t.columns[2:]):
            grams, lacks, places = _lists(texts.combine_chunks())
            k = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(grams, pa.string()), pa.array([block] * k, pa.int32()), pa.array([first] * k, pa.int64()),
                                              pa.array([t.num_rows] * k, pa.int32()), pa.array(lacks, pa.bool_()), pa.array(places, pa.binary())], names=names)

    def run(batches):
        held, rows, size, end = [], 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            block, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (row[1:] != row[:-1] + 1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                while a < z:
                    if held and ((block[a], row[a]) != end or rows >= RUN_ROWS or size >= RUN_BYTES):
                        yield from made(held)
                        held, rows, size = [], 0, 0
                    part = b.slice(a, min(z - a, RUN_ROWS - rows))
                    held.append(part)
                    rows, size, a = rows + part.num_rows, size + part.nbytes, a + part.num_rows
                    end = (block[a - 1], row[a - 1] + 1)
        if held:
            yield from made(held)
    return run


def build(df: DataFrame, fields: dict[str, Column], path: str, order: str = "track_id", block_rows: int = BLOCK_ROWS) -> TextIndex:
    """Index ``df`` under ``path``; ``order`` is a unique column."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.repartitionByRange(n, order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_pid"), place.alias("_pos")) \
        .write.mode("overwrite").parquet(f"{path}/sorted")
    kept = spark.read.parquet(f"{path}/sorted")
    starts, at = [], 0
    for pid, count in sorted(tuple(r) for r in kept.groupBy("_pid").count().collect()):  # one row a partition
        starts.append((pid, at))
        at += count
    starts = spark.createDataFrame(starts, "_pid int, _start long")
    row = F.col("_start") + F.col("_pos")
    numbered = kept.join(F.broadcast(starts), "_pid").withColumns({"row": row, "block": F.floor(row / block_rows).cast("int")}).drop("_pid", "_pos", "_start")
    numbered.write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    index = TextIndex(spark, df.schema, path, fields)
    texts = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_t{i}") for i, c in enumerate(fields.values())]
    # a list holds at most a run's rows
    index.rows.select("block", "row", *texts).mapInArrow(_post(list(fields)), POSTINGS) \
        .repartition(n, "field", "gram").sortWithinPartitions("field", "gram", "first").write.mode("overwrite").parquet(f"{path}/postings")
    return index


def _literal(query: str | None) -> str:
    return (query or "").strip().lower()


def candidates(index: TextIndex, field: str, literal: str) -> DataFrame:
    """(block, row) of rows whose field has all of the literal's trigrams."""
    grams = sorted({literal[i:i + 3] for i in range(len(literal) - 2)})
    lists = index.postings.filter((F.col("field") == field) & F.col("gram").isin(grams)).groupBy("block", "first", "n").agg(
        F.collect_list("lacks").alias("lacks"), F.collect_list("places").alias("places"))

    def both(batches):
        for b in batches:
            for block, first, n, lacks, places in zip(*(c.to_pylist() for c in b.columns)):
                on = np.ones(n, bool)
                for less, own in zip(lacks, places):
                    has = np.full(n, less)
                    has[np.frombuffer(own, np.uint16)] = not less
                    on &= has
                row = first + np.flatnonzero(on)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block), pa.int32()), pa.array(row, pa.int64())], names=["block", "row"])

    return lists.filter(F.size("places") == len(grams)).select("block", "first", "n", "lacks", "places").mapInArrow(both, "block int, row long")


def contains_any(index: TextIndex, wanted: list[tuple[str, str]]) -> DataFrame:
    """The table's rows in which any of the (field, literal) pairs is contained, case apart; a blank literal is in every row."""
    pairs = [(f, _literal(q)) for f, q in wanted]
    fits = reduce(lambda a, b: a | b, [F.lower(F.coalesce(index.fields[f], F.lit(""))).contains(F.lit(q)) for f, q in pairs])
    if any(len(q) < 3 for _, q in pairs):
        return index.rows.filter(fits).drop("block", "row")
    found = reduce(DataFrame.unionAll, [candidates(index, f, q) for f, q in pairs]).distinct()
    found, hint = small_side(found)
    blocks = [r[0] for r in found.select("block").distinct().collect()]  # at most one a folder
    return index.rows.filter(F.col("block").isin(blocks)).join(hint(found), ["block", "row"]).filter(fits).drop("block", "row")
