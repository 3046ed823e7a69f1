"""E2 with score bounds: items in impact-ordered blocks with block maxima.

Index rows are ordered by artist, then by their numbers and genre, so items
that score alike for most queries lie side by side, and cut into blocks.  A
block row holds its items and what bounds their scores: for every key but those
of low impact (titles) the greatest and least value that any item has (zero
where one lacks the key), and the greatest norms of the items' genre part, of
their title part, and of all but the artist.  A seed's score is nowhere above
the products with the artist keys' maxima plus the lesser of two bounds on the
rest: the products with the other maxima, where the genres' may give way to the
product of norms (Cauchy-Schwarz), as the titles' always do; or the product of
the norms of all but the artist.

A first pass opens only each seed's most promising block of every batch; the
k-th best score of what it finds is the seed's threshold.  The second pass opens
a block for a seed only if its bound, rounded as scores are, reaches that
threshold, or the k-th best score that the task has met since.  The result is
that of scoring everything: a skipped item is below ``k`` others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tunesift.operators.similarity import GROUP_NNZ, GROUP_SEEDS, _best, _block_top, _round_int, _seed_tables, rounded, seed_groups

BLOCK_ITEMS = 128
#: Key prefixes: the leading part, the part with either bound, the part bounded by its norm alone, and the numbers.
LEAD, EITHER, SLIGHT, NUMBERS = "a:", "g:", "t:", "n:"

BLOCKS = "ids array<string>, sizes array<int>, keys array<string>, vals array<double>, top array<string>, high array<double>, low array<double>, norms array<double>"


def _on(keys: pa.Array, prefix: str) -> np.ndarray:
    return pc.starts_with(keys, prefix).to_numpy(zero_copy_only=False)


def _parts(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys are of the parts whose norms bound scores: genre, title, all but the artist."""
    return _on(keys, EITHER), _on(keys, SLIGHT), ~_on(keys, LEAD)


def _block(t: pa.Table) -> list:
    """One row of ``BLOCKS`` of some items (id, keys, vals)."""
    ids, lists = t.column(0).combine_chunks(), t.column(1).combine_chunks()
    keys, vals = pc.list_flatten(lists), pc.list_flatten(t.column(2).combine_chunks()).to_numpy(zero_copy_only=False)
    item = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    norms = [float(np.sqrt(np.bincount(item[on], weights=vals[on] ** 2, minlength=len(ids))).max(initial=0.0)) for on in _parts(keys)]
    slight = _on(keys, SLIGHT)
    strong = keys.filter(pa.array(~slight)).dictionary_encode()
    code, v = strong.indices.to_numpy(zero_copy_only=False), vals[~slight]
    n = len(strong.dictionary)
    high, low = np.full(n, -np.inf), np.full(n, np.inf)
    np.maximum.at(high, code, v)
    np.minimum.at(low, code, v)
    some = np.bincount(code, minlength=n) < len(ids)
    high[some], low[some] = np.maximum(high[some], 0.0), np.minimum(low[some], 0.0)
    return [ids, pc.list_value_length(lists), keys, pa.array(vals), strong.dictionary, pa.array(high), pa.array(low), pa.array(norms)]


def block_index(rows: DataFrame, id_col: str = "track_id", items: int = BLOCK_ITEMS) -> DataFrame:
    """``BLOCKS`` of an ``index_rows`` frame: one exchange, by range of its keys of high impact."""
    def of(prefix):
        return F.array_join(F.array_sort(F.filter("keys", lambda k: k.startswith(prefix))), " ")
    entries = F.filter(F.arrays_zip("keys", "vals"), lambda e: e["keys"].startswith(NUMBERS))
    # numbers in steps, so that those alike stay together and genres order them further
    numbers = F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["keys"], F.round(e["vals"] * 5).cast("string")))), " ")
    entries = rows.select(F.col(id_col).cast("string").alias("id"), "keys", "vals")
    return in_order(entries, [of(LEAD), numbers, of(EITHER), F.col("id")]).mapInArrow(cut(items), BLOCKS)


#: Rows that a task sorts at once, about.
SORT_ROWS = 200_000


def in_order(rows: DataFrame, by: list[Column]) -> DataFrame:
    """The rows in partitions by range of some columns, and in their order there; more partitions where rows are many."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS))
    names = [f"_by_{i}" for i in range(len(by))]
    return rows.select("*", *[c.alias(k) for c, k in zip(by, names)]).repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)


def cut(items: int):
    """Batches of ordered items (id, keys, vals) to rows of ``BLOCKS``."""
    def run(batches):
        held = None
        texts, doubles = pa.list_(pa.string()), pa.list_(pa.float64())
        schema = pa.schema(list(zip([c.split()[0] for c in BLOCKS.split(", ")], [texts, pa.list_(pa.int32()), texts, doubles, texts, doubles, doubles, doubles])))

        def row(t):
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in _block(t)]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= items:
                yield row(held.slice(0, items))
                held = held.slice(items)
        if held is not None and held.num_rows:
            yield row(held)
    return run


def _products(names: pa.Array, owner: np.ndarray, n: int, values: np.ndarray, tables, seeds: np.ndarray | None = None) -> np.ndarray:
    """(n x seeds) sums of the products of some keys' values, per owner, with the seeds' values of those keys."""
    dense_all, dense, key_index, ptr, post_seed, post_w = tables
    S = dense.shape[1] if seeds is None else len(seeds)
    out = np.zeros((n, S))
    at = pc.fill_null(pc.index_in(names, value_set=dense_all), -1).to_numpy(zero_copy_only=False)
    on = at >= 0
    if on.any():
        x = np.zeros((n, len(dense_all)))
        x[owner[on], at[on]] = values[on]
        out += x @ (dense if seeds is None else dense[:, seeds])
    at = pc.fill_null(pc.index_in(names, value_set=key_index), -1).to_numpy(zero_copy_only=False)
    on = at >= 0
    if on.any():
        own, key, v = owner[on], at[on].astype(np.int64), values[on]
        count = ptr[key + 1] - ptr[key]
        place = np.repeat(ptr[key] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        own, column, product = np.repeat(own, count), post_seed[place], np.repeat(v, count) * post_w[place]
        if seeds is not None:
            asked = np.full(dense.shape[1], -1)
            asked[seeds] = np.arange(S)
            column = asked[column]
            own, column, product = own[column >= 0], column[column >= 0], product[column >= 0]
        out += np.bincount(own * S + column, weights=product, minlength=n * S).reshape(n, S)
    return out


def _kernel(bc, id_col: str, kk: int, tally, thresholds=None):
    """The top kk per seed of a task's blocks; without thresholds, of each batch's most promising blocks alone."""
    def kernel(batches):
        seed_ids, (dense_names, dense), key_names, ptr, post_seed, post_w, seed_norms = bc.value
        S = len(seed_ids)
        dense_all, key_index = pa.array(list(dense_names), pa.string()), pa.array(list(key_names), pa.string())
        tables = (dense_all, dense, key_index, ptr, post_seed, post_w)
        above = (dense_all, np.maximum(dense, 0.0), key_index, ptr, post_seed, np.maximum(post_w, 0.0))
        below = (dense_all, np.minimum(dense, 0.0), key_index, ptr, post_seed, np.minimum(post_w, 0.0))
        best = np.full((S, kk), np.iinfo(np.int64).min)  # the rounded scores that a new item has to reach
        least = best.min(axis=1) if thresholds is None else thresholds.value.copy()
        held, n_held = [], 0

        def opened(b, i, seeds):
            """Score block row i for some seeds and keep what is among their best."""
            nonlocal held, n_held
            tally.add(len(seeds))
            ids, sizes, keys, vals = (b.column(c)[i].values for c in range(4))
            owner = np.repeat(np.arange(len(ids)), sizes.to_numpy())
            order = pc.sort_indices(ids)
            scores = _products(keys, owner, len(ids), vals.to_numpy(), tables, seeds)[order.to_numpy()]
            t = _block_top(scores, ids.take(order), kk)
            t = t.set_column(0, "s", pa.array(seeds[t.column("s").to_numpy()]))
            t = t.filter(pa.array(t.column("r").to_numpy() >= least[t.column("s").to_numpy()]))
            held.append(t)
            n_held += t.num_rows
            r = _round_int(scores)
            both = np.concatenate([best[seeds], (r if len(r) <= kk else np.partition(r, len(r) - kk, axis=0)[-kk:]).T], axis=1)
            best[seeds] = np.partition(both, both.shape[1] - kk, axis=1)[:, -kk:]
            least[seeds] = np.maximum(least[seeds], best[seeds].min(axis=1))
            if n_held > 2 * kk * S:
                held = [_best(held, kk)]
                n_held = held[0].num_rows

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            top = b.column(4)
            names, owner = pc.list_flatten(top), pc.list_parent_indices(top).to_numpy(zero_copy_only=False)
            high, low = (pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False) for c in (5, 6))
            lead, either = _on(names, LEAD), _on(names, EITHER)

            def most(on):
                some = names.filter(pa.array(on))
                return _products(some, owner[on], n, high[on], above) + _products(some, owner[on], n, low[on], below)
            # (block x seed) products of the parts' norms
            genre, title, others = (x[:, None] * y[None, :] for x, y in zip(pc.list_flatten(b.column(7)).to_numpy(zero_copy_only=False).reshape(n, 3).T, seed_norms))
            bound = most(lead) + np.minimum(np.minimum(most(either), genre) + most(~lead & ~either) + title, others)
            bound = _round_int(bound + 1e-9)
            first = bound.argmax(axis=0)
            if thresholds is None:
                for i in np.unique(first).tolist():
                    seeds = np.flatnonzero(first == i)
                    seeds = seeds[bound[i, seeds] > least[seeds]]
                    if len(seeds):
                        opened(b, i, seeds)
                continue
            for i in np.argsort(-bound.max(axis=1), kind="stable").tolist():
                seeds = np.flatnonzero(bound[i] >= least)
                if len(seeds):
                    opened(b, i, seeds)
        if held:
            t = _best(held, kk)
            yield pa.RecordBatch.from_arrays([pa.array(seed_ids[t.column("s").to_numpy()], type=pa.string()),
                                              t.column("id").combine_chunks().cast(pa.string()), t.column("score").combine_chunks()],
                                             names=["seed_id", id_col, "score"])
    return kernel


def _thresholds(found: DataFrame, seed_ids: np.ndarray, kk: int) -> np.ndarray:
    """The kk-th best rounded score that each seed of a group has so far (one row a seed comes back)."""
    w = W.partitionBy("seed_id").orderBy(rounded("score").desc())
    last = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") == kk).select("seed_id", "score")
    out, place = np.full(len(seed_ids), np.iinfo(np.int64).min), {s: i for i, s in enumerate(seed_ids)}
    for r in last.collect():
        out[place[r.seed_id]] = _round_int(np.array(r.score))
    return out


def knn_blocks(spark: SparkSession, blocks: DataFrame, seed_index: DataFrame, k: int, id_col: str = "track_id", exclude_self: bool = True,
               dense_keys: tuple[str, ...] = ("n:year", "n:explicit"), per_group: tuple[int, int] = (GROUP_SEEDS, GROUP_NNZ), tally=None) -> DataFrame:
    """E2 over ``BLOCKS``: (seed_id, id, score, rank) of the k nearest items per seed, as ``knn_batch``
    gives them over index rows.  ``tally`` (an accumulator) counts (block, seed) pairs that were opened."""
    kk = int(k) + (1 if exclude_self else 0)
    tally = tally if tally is not None else spark.sparkContext.accumulator(0)
    schema = f"seed_id string, {id_col} string, score double"
    cand = None
    for rows in seed_groups(seed_index.select(id_col, "keys", "vals"), id_col, F.size("keys"), per_group):
        tables = _seed_tables(rows, dense_keys)
        norms = np.array([[np.sqrt(np.square(np.array(r[2], float)[on]).sum()) for on in _parts(pa.array(r[1], pa.string()))] for r in rows]).T
        bc = spark.sparkContext.broadcast((*tables, norms))
        first = blocks.mapInArrow(_kernel(bc, id_col, kk, tally), schema)
        reached = spark.sparkContext.broadcast(_thresholds(first, tables[0], kk))
        one = blocks.mapInArrow(_kernel(bc, id_col, kk, tally, reached), schema)
        cand = one if cand is None else cand.unionByName(one)
    if cand is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if exclude_self:
        cand = cand.filter(F.col("seed_id") != F.col(id_col))
    w = W.partitionBy("seed_id").orderBy(rounded("score").desc(), F.col(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(k))
