"""An inverted-file index over dense vectors.

Fitting takes a bounded sample (``fit_rows``): a spherical coarse quantiser of
about sqrt(items) cells, a range for every dimension of what a vector differs
from its cell's centre, and the number of cells a seed has to probe for
``target`` of its nearest items (measured in the sample, so vectors that form no
groups are probed widely and grouped ones narrowly).  Every item is indexed: its
cell, and a byte a dimension.  Lists are stored by range of (cell, block);
a cell of any size is several blocks of about ``BLOCK`` items.

A search deals each cell's seeds into chunks and meets chunk and block as one
row, scored as one matrix product over the decoded codes; the ``refine`` best of
a seed are then compared exactly.  A seed probes on until its cells hold enough
items, so every seed gets ``k`` rows, or all items there are.

Vectors that are null, of zero length, or hold a null or a value that isn't
finite are no items and no seeds; nor are those with fewer components than the
longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tunesift.operators.similarity import rounded, small_side, unit_vectors

FIT_ROWS = 65_536
MOST_CELLS = 4_096
BLOCK = 1_024   # items of a list row
CHUNK = 256     # seeds of a probe row
REFINE = 24     # items compared exactly per seed
LEVELS = 255


@dataclass(frozen=True)
class IvfIndex:
    path: str              # stored lists (cell, block, ids, codes) and items (id, vec)
    centres: np.ndarray    # cells x dims
    low: np.ndarray        # least coded difference of each dimension
    step: np.ndarray
    sizes: np.ndarray      # items of each cell
    n_probe: int


@dataclass(frozen=True)
class IvfSearch:
    neighbours: DataFrame  # (seed_id, id, score, rank)
    probes: DataFrame      # (seed_id, vec, cells, probed): the cells and how many items they hold
    candidates: DataFrame  # (seed_id, id): the pairs compared exactly


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def spherical_kmeans(v: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of unit rows; a centre that loses its rows takes the row farthest from its own."""
    centres = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)]
    for _ in range(rounds):
        sims = v @ centres.T
        own = sims.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = v[np.argsort(sims.max(1))[:len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def probes_for(v: np.ndarray, centres: np.ndarray, k: int, target: float, seed: int, queries: int = 256) -> int:
    """The least number of nearest cells that hold ``target`` of the sample's own ``k`` nearest, on average over some of its rows."""
    picked = np.random.default_rng(seed + 1).choice(len(v), min(queries, len(v)), replace=False)
    sims = v[picked] @ v.T
    sims[np.arange(len(picked)), picked] = -np.inf
    near = np.argsort(-sims, axis=1, kind="stable")[:, :min(k, len(v) - 1)]
    own = (v @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(v[picked] @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell among a query's
    need = np.take_along_axis(place, own[near], axis=1)
    found = np.cumsum(np.bincount(need.ravel(), minlength=len(centres))) / max(need.size, 1)
    return int(np.searchsorted(found, target) + 1) if need.size else 1


def encode(v: np.ndarray, cell: np.ndarray, centres: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A byte a dimension of each row's difference from its centre."""
    return np.clip(np.rint((v - centres[cell] - low) / step), 0, LEVELS).astype(np.uint8)


def decode(codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return codes * step + low


def build(items: DataFrame, path: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.97,
          fit_rows: int = FIT_ROWS, most_cells: int = MOST_CELLS, block: int = BLOCK, seed: int = 42) -> IvfIndex:
    """Index all items under ``path``."""
    spark = items.sparkSession
    unit = unit_vectors(items, vec_col, id_col).withColumnRenamed(id_col, "id")
    n, dims = unit.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    unit.filter(F.size("vec") == F.lit(dims or 0)).write.mode("overwrite").parquet(f"{path}/items")
    unit = spark.read.parquet(f"{path}/items")
    share = min(1.0, fit_rows / max(n, 1))
    sample = unit.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).limit(fit_rows).toArrow()
    v = _matrix(sample.sort_by("id").column("vec").combine_chunks())
    if not len(v):
        centres, low, step, n_probe = np.zeros((1, dims or 1)), np.zeros(dims or 1), np.ones(dims or 1), 1
    else:
        centres = spherical_kmeans(v, max(1, min(most_cells, int(n ** 0.5), len(v) // 4)), seed)
        rest = v - centres[(v @ centres.T).argmax(1)]
        low, high = rest.min(axis=0), rest.max(axis=0)
        step = np.maximum(high - low, 1e-9) / LEVELS
        n_probe = probes_for(v, centres, k, target, seed)
    fitted = spark.sparkContext.broadcast((centres, low, step))

    def assign(batches):
        centres, low, step = fitted.value
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                cell = (v @ centres.T).argmax(1)
                codes = encode(v, cell, centres, low, step)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())],
                                                 names=["cell", "id", "code"])

    unit.select("id", "vec").mapInArrow(assign, "cell int, id string, code binary").write.mode("overwrite").parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    counts = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most most_cells rows
    sizes = np.zeros(len(centres), np.int64)
    for r in counts.collect():
        sizes[r.cell] = r.n
    blocks = counts.select("cell", F.ceil(F.col("n") / block).alias("blocks"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assigned.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .repartitionByRange(parts, "cell", "block").groupBy("cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes")) \
        .write.mode("overwrite").parquet(f"{path}/lists")
    return IvfIndex(path, centres, low, step, sizes, n_probe)


def search(index: IvfIndex, seeds: DataFrame, work: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           refine: int = REFINE, chunk: int = CHUNK, exclude_self: bool = True) -> IvfSearch:
    """The ``k`` nearest items of each seed (one row per seed id counts); stages are written under ``work``."""
    spark = seeds.sparkSession
    refine = max(refine, k)
    fitted = spark.sparkContext.broadcast((index.centres, index.low, index.step, index.sizes, index.n_probe))
    asked = unit_vectors(seeds, vec_col, id_col).withColumnRenamed(id_col, "seed_id").filter(F.size("vec") == index.centres.shape[1]).dropDuplicates(["seed_id"])

    def probe(batches):
        centres, _, _, sizes, n_probe = fitted.value
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-(_matrix(b.column(1)) @ centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            # on to as many cells as hold what is refined, and the seed itself
            n = np.minimum(np.maximum(n_probe, (held < refine + 1).sum(1) + 1), len(centres))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[:m].tolist() for o, m in zip(order, n)], pa.list_(pa.int32())),
                                              pa.array(held[np.arange(len(n)), n - 1])], names=["seed_id", "vec", "cells", "probed"])

    asked.select("seed_id", "vec").mapInArrow(probe, "seed_id string, vec array<double>, cells array<int>, probed long") \
        .write.mode("overwrite").parquet(f"{work}/probes")
    probes = spark.read.parquet(f"{work}/probes")
    each = probes.select(F.explode("cells").alias("cell"), "seed_id", "vec")
    chunks = each.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))  # one row a cell at most
    asking = each.join(F.broadcast(chunks), "cell").groupBy("cell", F.pmod(F.xxhash64("seed_id"), F.col("chunks")).alias("chunk")) \
        .agg(F.collect_list("seed_id").alias("seeds"), F.collect_list("vec").alias("vecs"))
    lists = spark.read.parquet(f"{index.path}/lists")
    met = lists.join(asking, "cell").select("cell", "ids", "codes", "seeds", "vecs")

    def score(batches):
        centres, low, step, _, _ = fitted.value
        for b in batches:
            for i in range(b.num_rows):
                cell, ids, codes, names, vecs = (b.column(c)[i] for c in range(5))
                ids, names = ids.values, names.values
                codes = np.frombuffer(b"".join(codes.values.to_pylist()), np.uint8).reshape(len(ids), -1)
                q = _matrix(vecs.values)
                sims = (q @ (centres[cell.as_py()] + decode(codes, low, step)).T).astype(np.float32)
                if exclude_self:
                    own = pc.index_in(names, value_set=ids).to_numpy(zero_copy_only=False)
                    mine = np.flatnonzero(~np.isnan(own.astype(float)))
                    sims[mine, own[mine].astype(int)] = -np.inf
                best = np.argpartition(-sims, refine - 1, axis=1)[:, :refine] if len(ids) > refine else np.tile(np.arange(len(ids)), (len(names), 1))
                row = np.repeat(np.arange(len(names)), best.shape[1])
                there = np.isfinite(sims[row, best.ravel()])
                row, at = row[there], best.ravel()[there]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(at)), pa.array(sims[row, at].astype(np.float64))],
                                                 names=["seed_id", "id", "about"])

    near = W.partitionBy("seed_id").orderBy(F.desc("about"), "id")
    met.mapInArrow(score, "seed_id string, id string, about double").withColumn("r", F.row_number().over(near)).filter(F.col("r") <= refine) \
        .select("seed_id", "id").write.mode("overwrite").parquet(f"{work}/candidates")
    candidates, hint = small_side(spark.read.parquet(f"{work}/candidates"))
    pairs = spark.read.parquet(f"{index.path}/items").join(hint(candidates), "id").join(
        probes.select("seed_id", F.col("vec").alias("q")), "seed_id")
    dot = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranked = W.partitionBy("seed_id").orderBy(rounded("score").desc(), F.col("id"))
    found = pairs.select("seed_id", "id", dot.alias("score")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= int(k))
    return IvfSearch(found.withColumnRenamed("id", id_col), probes, candidates)
