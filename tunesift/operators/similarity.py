"""Similarity and recommendation.

Two exact strategies, one ranking rule (rounded score desc, then id asc, Q21):

* one query (E1/E9): the query's few keys travel as one broadcast row and each
  index row (one per item, key and value arrays) is scored in place, so
  nothing is shuffled before the ``TakeOrderedAndProject`` of the top k.
* many queries (E2/E10): the seeds are dealt by an id hash into groups whose
  vectors have a bounded number of non-zeros; each group is broadcast and one
  pass over the index scores it (Arrow + NumPy), each task keeping only the
  best ``k`` per seed found so far.  All seed x item products are computed
  (exact cosine top-k needs them: the dense numerics touch every item) but
  none is materialised as a row, written to a shuffle or sorted; the shuffle
  carries ``seeds x k`` rows per task.  A small seed set is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.functions import text
from tunesift.session import ensure_checkpoint_dir

GROUP_NNZ = 2_000_000       # non-zeros of a broadcast seed group, about (groups are dealt by hash)
GROUP_SEEDS = 20_000        # seeds of a group, about
BROADCAST_ROWS = 1_000_000  # candidate rows that may be broadcast; larger sets are joined by shuffle
ROUND_SCALE = 10_000        # scores ranked at 4 decimals (E4)


def rounded(c):
    return F.round(c, 4)


# ---------------------------------------------------------------------------
# index layout
# ---------------------------------------------------------------------------

def index_rows(long_df: DataFrame, id_col: str = "track_id") -> DataFrame:
    """Long (id, key, value) -> one row per item with parallel key/value arrays.

    Taken of the long table as the per-id normalisation leaves it (clustered by
    id) this adds no exchange; of a stored long table it is one."""
    return long_df.groupBy(id_col).agg(
        F.collect_list("key").alias("keys"), F.collect_list("value").alias("vals"))


# ---------------------------------------------------------------------------
# One query, scored row by row
# ---------------------------------------------------------------------------

def knn_cosine(index: DataFrame, query_long: DataFrame, k: int | None, id_col: str = "track_id",
               exclude: DataFrame | None = None) -> DataFrame:
    """(id, score) of the ``k`` nearest items to one query vector.

    ``index`` is an ``index_rows`` frame and ``query_long`` is (key, value) of
    one normalised query (tens of keys), packed into one row; ``exclude`` (a
    one-row id frame) drops the query item itself (E3)."""
    q = query_long.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_q"))
    zero = F.lit(0.0)
    # try_element_at: a key that the query lacks counts as zero
    parts = F.zip_with("keys", "vals", lambda key, v: v * F.coalesce(F.try_element_at(F.col("_q"), key), zero))
    s = index.crossJoin(F.broadcast(q)).select(id_col, F.aggregate(parts, zero, lambda a, x: a + x).alias("score"))
    if exclude is not None:
        s = s.join(F.broadcast(exclude.select(id_col).limit(1)), id_col, "left_anti")
    s = s.orderBy(rounded("score").desc(), F.col(id_col))
    return s.limit(int(k)) if k else s


# ---------------------------------------------------------------------------
# Many queries, broadcast seed groups + per-task top-k kernel
# ---------------------------------------------------------------------------

def seed_groups(seeds: DataFrame, id_col: str, size: F.Column, per_group: tuple[int, int]):
    """Yield the rows of ``seeds`` (one per id) as lists of about ``per_group``
    (rows, total ``size``) at most: groups are residues of an id hash, as many
    as the totals need, so a group's share of either bound varies only by chance."""
    once = seeds.dropDuplicates([id_col])
    n, total = once.agg(F.count(F.lit(1)), F.sum(size)).first()
    groups = max(1, -(-n // per_group[0]), -(-int(total or 0) // per_group[1]))
    for g in range(groups):
        rows = once.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(groups)) == g).collect()
        if rows:
            yield rows


def small_side(df: DataFrame, most: int = BROADCAST_ROWS):
    """(frame, hint): the frame checkpointed in the shared folder, and a hint
    for it and what a join on a unique key leaves of it: ``F.broadcast`` if it
    was counted to have ``most`` rows at most, else none."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    return kept, F.broadcast if kept.count() <= most else (lambda x: x)


def _seed_tables(rows, dense_keys, hot_share: int = 16):
    """Split seeds into a dense block and a sparse key -> postings table.

    The dense block holds the always-dense keys (numerics) and every key that
    at least ``max(8, S / hot_share)`` seeds share (a hot genre or artist
    token): those are one BLAS product per block of items instead of one
    pair per (item, seed)."""
    S = len(rows)
    seed_ids = np.array([str(r[0]) for r in rows], dtype=object)
    freq: dict[str, int] = {}
    for r in rows:
        for key in r[1]:
            freq[key] = freq.get(key, 0) + 1
    hot_min = max(8, S // hot_share)
    dense_all = list(dense_keys) + sorted(k for k, c in freq.items() if c >= hot_min and k not in set(dense_keys))
    dpos = {k: i for i, k in enumerate(dense_all)}
    dense = np.zeros((len(dense_all), S))
    key_ids: dict[str, int] = {}
    ks, ss, ws = [], [], []
    for j, r in enumerate(rows):
        for key, val in zip(r[1], r[2]):
            if key in dpos:
                dense[dpos[key], j] += val
            else:
                kid = key_ids.setdefault(key, len(key_ids))
                ks.append(kid), ss.append(j), ws.append(val)
    ks, ss, ws = np.array(ks, dtype=np.int64), np.array(ss, dtype=np.int64), np.array(ws)
    order = np.argsort(ks, kind="stable")
    ks, ss, ws = ks[order], ss[order], ws[order]
    ptr = np.zeros(len(key_ids) + 1, dtype=np.int64)
    np.add.at(ptr, ks + 1, 1)
    ptr = np.cumsum(ptr)
    key_index = list(key_ids.keys())  # position == key id
    return seed_ids, (dense_all, dense), key_index, ptr, ss, ws


def _round_int(s: np.ndarray) -> np.ndarray:
    """Half-away-from-zero rounding to 4 decimals as integers (SQL ``round``)."""
    return (np.sign(s) * np.floor(np.abs(s) * ROUND_SCALE + 0.5)).astype(np.int64)


def _block_top(scores: np.ndarray, ids, kk: int):
    """The top kk per seed of a block's scores (items x seeds), its ids in ascending order: (rounded
    score, id order) as one int64 a pair."""
    import pyarrow as pa
    n, S = scores.shape
    r = _round_int(scores)
    comp = r * (1 << 32) + ((1 << 32) - 1 - np.arange(n))[:, None]
    take = min(kk, n)
    top = np.argpartition(-comp, take - 1, axis=0)[:take] if n > take else np.tile(np.arange(n)[:, None], (1, S))
    cols, rows = np.tile(np.arange(S), take), top.reshape(-1)
    return pa.table({"s": cols, "r": r[rows, cols], "id": ids.take(pa.array(rows)), "score": scores[rows, cols]})


def _best(parts: list, kk: int):
    """The top kk per seed of candidate tables."""
    import pyarrow as pa
    t = pa.concat_tables(parts).combine_chunks()
    t = t.sort_by([("s", "ascending"), ("r", "descending"), ("id", "ascending")])
    sv = t.column("s").to_numpy()
    starts = np.r_[0, np.flatnonzero(np.diff(sv)) + 1]
    rank = np.arange(len(sv)) - np.repeat(starts, np.diff(np.r_[starts, len(sv)]))
    return t.take(pa.array(np.flatnonzero(rank < kk)))


def _make_kernel(bc, id_col: str, kk: int, dense_keys: tuple[str, ...], block_cells: int = 4_000_000):
    """Per-task exact top-kk per seed over Arrow record batches.

    Keys are matched with ``pyarrow.compute.index_in`` (vectorised hashing,
    no Python object per non-zero); each batch is sorted by id so the
    (rounded score desc, id asc) order is a single int64 key within a block.
    The best of the blocks so far are merged with an Arrow sort whenever as
    many again have come in, so a task holds at most twice kk per seed."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def kernel(batches):
        seed_ids, (dense_all, dense), key_index, ptr, post_seed, post_w = bc.value
        S = len(seed_ids)
        seed_keys = pa.array(list(key_index), type=pa.string())
        dense_set = pa.array(list(dense_all), type=pa.string())
        held, n_held = [], 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            rb = rb.take(pc.sort_indices(rb.column(id_col)))
            step = max(64, block_cells // max(S, 1))
            for lo in range(0, rb.num_rows, step):
                part = rb.slice(lo, step)
                n = part.num_rows
                keys, vals = part.column("keys"), part.column("vals")
                flat_k = pc.list_flatten(keys)
                flat_v = pc.list_flatten(vals).to_numpy(zero_copy_only=False).astype(float)
                item = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
                scores = np.zeros((n, S))
                if len(dense_all):
                    di = pc.fill_null(pc.index_in(flat_k, value_set=dense_set), -1).to_numpy(zero_copy_only=False)
                    m = di >= 0
                    xd = np.zeros((n, len(dense_all)))
                    xd[item[m], di[m]] = flat_v[m]
                    scores += xd @ dense
                if len(key_index):
                    kid = pc.fill_null(pc.index_in(flat_k, value_set=seed_keys), -1).to_numpy(zero_copy_only=False)
                    m = kid >= 0
                    if m.any():
                        it, kd, vv = item[m], kid[m].astype(np.int64), flat_v[m]
                        cnt = ptr[kd + 1] - ptr[kd]
                        tot = int(cnt.sum())
                        if tot:
                            starts = np.repeat(ptr[kd] - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt)
                            pidx = starts + np.arange(tot)
                            flat = np.repeat(it, cnt) * S + post_seed[pidx]
                            scores += np.bincount(flat, weights=np.repeat(vv, cnt) * post_w[pidx],
                                                  minlength=n * S).reshape(n, S)
                held.append(_block_top(scores, part.column(id_col), kk))
                n_held += held[-1].num_rows
                if n_held > 2 * kk * S:
                    held = [_best(held, kk)]
                    n_held = held[0].num_rows
        if not held:
            return
        t = _best(held, kk)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seed_ids[t.column("s").to_numpy()], type=pa.string()),
             t.column("id").combine_chunks().cast(pa.string()), t.column("score").combine_chunks()],
            names=["seed_id", id_col, "score"])
    return kernel


def knn_batch(spark: SparkSession, index: DataFrame, seed_index: DataFrame, k: int, id_col: str = "track_id",
              exclude_self: bool = True, dense_keys: tuple[str, ...] = ("n:year", "n:explicit"),
              per_group: tuple[int, int] = (GROUP_SEEDS, GROUP_NNZ)) -> DataFrame:
    """(seed_id, id, score, rank) of the k nearest items per seed.

    ``index``/``seed_index`` are ``index_rows`` frames (seeds are index rows
    or vectorised query rows; one row per seed id counts).  ``exclude_self``
    drops the seed item (E3): the kernel keeps k+1 so the result stays exact
    after the drop.  One pass over the index per seed group."""
    kk = int(k) + (1 if exclude_self else 0)
    schema = T.StructType([T.StructField("seed_id", T.StringType()), T.StructField(id_col, T.StringType()),
                           T.StructField("score", T.DoubleType())])
    items = index.select(F.col(id_col).cast("string").alias(id_col), "keys", "vals")
    cand = None
    for rows in seed_groups(seed_index.select(id_col, "keys", "vals"), id_col, F.size("keys"), per_group):
        bc = spark.sparkContext.broadcast(_seed_tables(rows, dense_keys))
        one = items.mapInArrow(_make_kernel(bc, id_col, kk, dense_keys), schema)
        cand = one if cand is None else cand.unionByName(one)
    if cand is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if exclude_self:
        cand = cand.filter(F.col("seed_id") != F.col(id_col))
    w = W.partitionBy("seed_id").orderBy(rounded("score").desc(), F.col(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(k))


def unit_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id as text, vec): vectors of length one as arrays of doubles; null and zero vectors, and those
    with a null or a value that isn't finite, are left out."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))  # null where a component is
    return df.select(F.col(id_col).cast("string").alias(id_col), v.alias("vec"), norm.alias("_norm")) \
        .filter((F.col("_norm") > 0) & (F.col("_norm") < F.lit(float("inf")))) \
        .select(id_col, F.transform("vec", lambda x: x / F.col("_norm")).alias("vec"))


def _dense_kernel(bc, id_col: str, kk: int, block_cells: int = 4_000_000):
    """Per-task exact top-kk per seed over batches of (id, unit vector): one matrix product a block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def kernel(batches):
        seed_ids, matrix = bc.value
        held, n_held = [], 0
        for rb in batches:
            rb = rb.take(pc.sort_indices(rb.column(0)))
            step = max(64, block_cells // max(len(seed_ids), 1))
            for lo in range(0, rb.num_rows, step):
                part = rb.slice(lo, step)
                items = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                held.append(_block_top(items @ matrix, part.column(0), kk))
                n_held += held[-1].num_rows
                if n_held > 2 * kk * len(seed_ids):
                    held = [_best(held, kk)]
                    n_held = held[0].num_rows
        if held:
            t = _best(held, kk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed_ids[t.column("s").to_numpy()], type=pa.string()), t.column("id").combine_chunks(), t.column("score").combine_chunks()],
                names=["seed_id", id_col, "score"])
    return kernel


def knn_dense(spark: SparkSession, items: DataFrame, seeds: DataFrame, k: int, id_col: str = "vec_id",
              vec_col: str = "embedding", exclude_self: bool = True, per_group: tuple[int, int] = (GROUP_SEEDS, GROUP_NNZ)) -> DataFrame:
    """Exact cosine kNN on dense array vectors: seeds in broadcast groups of bounded size, each
    a matrix that every task multiplies its items with.  Vectors with fewer components than the
    longest, and those without a direction (``unit_vectors``), are left out."""
    kk = int(k) + (1 if exclude_self else 0)
    every = unit_vectors(items, vec_col, id_col)
    dims = every.agg(F.max(F.size("vec"))).first()[0] or 0
    every = every.filter(F.size("vec") == dims)
    schema = f"seed_id string, {id_col} string, score double"
    cand = None
    asked = unit_vectors(seeds, vec_col, id_col).filter(F.size("vec") == dims)
    for rows in seed_groups(asked, id_col, F.size("vec"), per_group):
        bc = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows]).T))
        one = every.mapInArrow(_dense_kernel(bc, id_col, kk), schema)
        cand = one if cand is None else cand.unionByName(one)
    if cand is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if exclude_self:
        cand = cand.filter(F.col("seed_id") != F.col(id_col))
    w = W.partitionBy("seed_id").orderBy(rounded("score").desc(), F.col(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(k))


# ---------------------------------------------------------------------------
# Recommendation post-processing
# ---------------------------------------------------------------------------

def restrict_to_view(cands: DataFrame, view: DataFrame | None, id_col: str = "track_id", hint=None) -> DataFrame:
    """E5: keep candidates inside the filtered view (semi join).

    With the ``hint`` of a ``small_side`` the view is streamed; view ids are
    unique, so the inner join equals the semi join without shuffling the
    catalogue."""
    if view is None:
        return cands
    if hint is not None:
        return view.select(id_col).join(hint(cands), id_col)
    return cands.join(view.select(id_col), id_col, "left_semi")


def diversify_by_artist(recs: DataFrame, top_k: int, group: str = "seed_id", artist_col: str = "artist_name",
                        score_col: str = "score", id_col: str = "track_id") -> DataFrame:
    """Best row per (group, stripped lower artist), blank artists dropped,
    then the top ``top_k`` per group."""
    key = text.artist_key_strip_lower(artist_col)
    order = [rounded(F.col(score_col)).desc(), F.col(id_col)]
    w1 = W.partitionBy(group, "_akey").orderBy(*order)
    w2 = W.partitionBy(group).orderBy(*order)
    # one exchange by group serves both windows (a group holds k + overfetch rows)
    return (recs.withColumn("_akey", key).filter(F.col("_akey") != "").repartition(group)
                .withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") == 1)
                .withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= int(top_k))
                .drop("_akey", "_r1"))


def top_k_per_group(recs: DataFrame, top_k: int, group: str = "seed_id", score_col: str = "score",
                    id_col: str = "track_id") -> DataFrame:
    """First K by rounded score then id."""
    w = W.partitionBy(group).orderBy(rounded(F.col(score_col)).desc(), F.col(id_col))
    return recs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(top_k))


def finish_recommendations(cands: DataFrame, meta: DataFrame, view: DataFrame | None, top_k: int,
                           threshold: float, one_per_artist: bool, group: str = "seed_id") -> DataFrame:
    """E3 -> E5 -> E6 -> E4 -> E7/E8 -> B18 on (group, track_id, score) candidates
    (the over-fetched nearest items, self included, as the reference fetches them)."""
    c, hint = small_side(cands.filter(F.col(group) != F.col("track_id")).filter(F.col("score") >= F.lit(float(threshold))))
    c = restrict_to_view(c, view, hint=hint)
    c = meta.select("track_id", "track_name", "artist_name", "artist_genres", "release_year", "explicit").join(hint(c), "track_id")
    c = diversify_by_artist(c, top_k, group) if one_per_artist else top_k_per_group(c, top_k, group)
    return c.select(group, "rank", rounded("score").alias("score"), "track_name", "artist_name", "artist_genres",
                    "release_year", "explicit", "track_id", text.track_url().alias("url"))
