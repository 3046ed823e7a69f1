"""Descriptive analytics.

Every profile is an aggregation that combines map-side (partial aggregates),
so the shuffle carries one row per group and partition, never the raw rows.
Windows run only on results that are already aggregates (years, clusters).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tunesift.functions import text


def duration_min(c="duration_ms"):
    """Minutes from milliseconds."""
    return F.col(c) / F.lit(60000.0)


def genre_tokens(df: DataFrame, col: str = "artist_genres", keep: tuple[str, ...] = ()) -> DataFrame:
    """B11 exploded: one row per genre token (bag semantics)."""
    return df.select(*keep, F.explode(text.split_genres(col)).alias("genre"))


def top_counts(df: DataFrame, key: str, n: int | None, name: str | None = None) -> DataFrame:
    """``value_counts().head(n)`` with a unique tie-break (count desc, key asc)."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    if name:
        out = out.withColumnRenamed(key, name)
        key = name
    out = out.orderBy(F.col("count").desc(), F.col(key).asc())
    return out.limit(int(n)) if n else out


def kpis(meta: DataFrame) -> DataFrame:
    """H1: songs, artists, year span over years > 0, explicit %, distinct genre tokens."""
    base = meta.agg(
        F.count(F.lit(1)).alias("songs"),
        F.count_distinct("artist_name").alias("artists"),
        F.min(F.when(F.col("release_year") > 0, F.col("release_year"))).alias("min_year"),
        F.max(F.when(F.col("release_year") > 0, F.col("release_year"))).alias("max_year"),
        F.round(F.avg((F.col("explicit") == 1).cast("double")) * 100.0, 4).alias("explicit_pct"))
    g = genre_tokens(meta).agg(F.count_distinct("genre").alias("genre_tokens"))
    return base.crossJoin(g)  # two one-row aggregates


def genre_counts(meta: DataFrame, top_n: int | None = 30) -> DataFrame:
    """H2: top-N genre tokens."""
    return top_counts(genre_tokens(meta), "genre", top_n)


def genre_vocab(meta: DataFrame, top_k: int = 200) -> DataFrame:
    """H3: the top-200 token names (the multiselect options)."""
    return genre_counts(meta, top_k).select("genre")


def year_counts(meta: DataFrame, col: str = "release_year") -> DataFrame:
    """H4: rows per known year (> 0), ascending."""
    return (meta.filter(F.col(col) > 0).groupBy(F.col(col).alias("year"))
                .agg(F.count(F.lit(1)).alias("count")).orderBy("year"))


def year_counts_smoothed(meta: DataFrame, col: str = "release_year") -> DataFrame:
    """H5: centred 3-row rolling mean (partial at the edges), by row not by year
    gap; only when there are at least three years.  The window runs on the
    per-year aggregate (about a hundred rows), not on the catalogue."""
    yc = year_counts(meta, col)
    w = W.orderBy("year")
    sm = yc.withColumn("smooth", F.avg("count").over(w.rowsBetween(-1, 1)))
    n = sm.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    return n.filter(F.col("_n") >= 3).drop("_n")


def artist_counts(meta: DataFrame, top_n: int = 20) -> DataFrame:
    """H6: top-N raw artist names."""
    return top_counts(meta, "artist_name", top_n, "artist")


def dominant_artists(meta: DataFrame, top_n: int = 20) -> DataFrame:
    """H7: top-20 stripped artist names, blank counted as one artist."""
    return top_counts(meta.select(text.artist_key_strip("artist_name").alias("artist")), "artist", top_n)


def quality_table(raw: DataFrame) -> DataFrame:
    """H8: % null and % empty string per column, one pass (Q16: run on the raw table)."""
    aggs = []
    for f in raw.schema.fields:
        aggs.append(F.round(F.avg(F.col(f.name).isNull().cast("double")) * 100.0, 2).alias(f"{f.name}__m"))
        if isinstance(f.dataType, StringType):
            aggs.append(F.round(F.avg(F.coalesce((F.col(f.name) == "").cast("double"), F.lit(0.0))) * 100.0, 2)
                        .alias(f"{f.name}__e"))
        else:
            aggs.append(F.lit(0.0).alias(f"{f.name}__e"))
    wide = raw.agg(*aggs)
    stack = ", ".join(f"'{f.name}', `{f.name}__m`, `{f.name}__e`" for f in raw.schema.fields)
    return wide.selectExpr(f"stack({len(raw.columns)}, {stack}) AS (column, missing_pct, empty_string_pct)")


def duplicate_count(raw: DataFrame, key: str = "track_id") -> DataFrame:
    """H9: rows minus distinct keys."""
    return raw.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicates"))


def explicit_split(meta: DataFrame, col: str = "explicit") -> DataFrame:
    """Clean/Explicit counts; other values are dropped."""
    lab = F.when(F.col(col) == 0, F.lit("Clean")).when(F.col(col) == 1, F.lit("Explicit"))
    return (meta.select(lab.alias("label")).filter(F.col("label").isNotNull())
                .groupBy("label").agg(F.count(F.lit(1)).alias("count")))


def missing_counts(raw: DataFrame, top_n: int = 10) -> DataFrame:
    """Nulls per column, descending, top 10 (column name breaks ties)."""
    wide = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in raw.columns])
    long = wide.unpivot([], raw.columns, "column", "missing")
    return long.orderBy(F.col("missing").desc(), F.col("column")).limit(int(top_n))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max.

    ``exact`` finds the quartiles of all columns together with
    ``exact_quantiles`` (bounded histogram passes, no value map merged in one
    task); ``exact=False`` uses the ``percentile_approx`` sketch in the same
    single aggregate."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    probs = (0.25, 0.5, 0.75)
    found = exact_quantiles(df, cols, probs) if exact else {}
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        q = ([F.lit(v).cast("double") for v in found[c]] if exact
             else [F.percentile_approx(x, p, 10000) for p in probs])
        parts.append(df.agg(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.round(F.avg(x), 4).alias("mean"),
            F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("min"),
            F.round(q[0], 4).alias("q25"), F.round(q[1], 4).alias("q50"), F.round(q[2], 4).alias("q75"),
            F.max(x).alias("max")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns and column names."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(df.columns)).alias("column_names"))


def explicit_share_by_year(meta: DataFrame) -> DataFrame:
    """Mean explicit per year, year 0 included."""
    return meta.groupBy(F.col("release_year").alias("year")).agg(
        F.round(F.avg((F.col("explicit") == 1).cast("double")), 6).alias("explicit_share"))


def data_check(lab: DataFrame) -> DataFrame:
    """Rows, distinct artists, distinct titles, rows with genres (Q17)."""
    return lab.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("artist_name").alias("artists"),
                   F.count_distinct("track_name").alias("tracks"),
                   F.count_if(F.length("artist_genres") > 0).alias("rows_with_genres"))


def main_genre_top(df: DataFrame, top_n: int = 15) -> DataFrame:
    """Top-15 of the naive main genre."""
    return top_counts(df.select(text.main_genre_naive("artist_genres").alias("main_genre")), "main_genre", top_n)


def equal_width_histogram(df: DataFrame, x, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max, last edge inclusive.

    The bounds are a one-row aggregate broadcast to the rows; the counts are
    then one more partial aggregation (``bins`` groups)."""
    xv = x if not isinstance(x, str) else F.col(x)
    vals = df.select(xv.cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    b = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo"))
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    j = vals.crossJoin(F.broadcast(b)).select(idx.alias("bin"), "_lo", "_hi")
    return (j.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .select("bin",
                     F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins, 6).alias("lo"),
                     F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / bins, 6).alias("hi"),
                     "count"))


def duration_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """30 equal bins of duration in minutes."""
    return equal_width_histogram(df, duration_min("duration_ms"), bins)


#: Bins of the binned kernel density, and the moments kept of each.
KDE_BINS, KDE_MOMENTS = 4096, 4


def duration_kde(df: DataFrame, gridsize: int = 200, cut: float = 3.0, bins: int = KDE_BINS) -> DataFrame:
    """Gaussian kernel density of duration (minutes), Scott's bandwidth
    ``std * n^(-1/5)`` on a grid of ``gridsize`` points from min - cut*bw to
    max + cut*bw.

    Rows are binned between the least and greatest value, each bin keeping its
    count and the first moments about its centre (a partial aggregate of at most
    ``bins`` rows).  One kernel product of bins and grid follows, with the kernel
    expanded about each centre (Hermite polynomials), so the result is that of
    the rows themselves to about (bin width / 2 bandwidth)^4 / 24.  Without rows
    there is no grid; without a bandwidth the grid has no values."""
    vals = df.select(duration_min("duration_ms").alias("_x")).filter(F.col("_x").isNotNull())
    st = vals.agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")) \
             .withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).filter("_n > 0")
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = vals.crossJoin(F.broadcast(st)).withColumn(
        "_b", F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0))
    off = F.col("_x") - (F.col("_lo") + (F.col("_b") + 0.5) * width)
    moments = [F.sum(F.pow(off, m)).alias(f"_m{m}") for m in range(KDE_MOMENTS)]
    binned = placed.groupBy("_b", "_n", "_lo", "_hi", "_bw").agg(*moments)

    def product(batches):
        parts = [b.to_pandas() for b in batches if b.num_rows]
        if not parts:
            return
        t = pd.concat(parts)
        n, lo, hi, bw = (t[c].iloc[0] for c in ("_n", "_lo", "_hi", "_bw"))
        i = np.arange(gridsize)
        x = density = np.full(gridsize, None)
        if bw is not None and bw > 0:
            x = lo - cut * bw + i * ((hi - lo) + 2 * cut * bw) / (gridsize - 1)
            centre = lo + (t["_b"].to_numpy() + 0.5) * (hi - lo) / bins
            u = (x[:, None] - centre[None, :]) / bw
            terms, power = 1.0, 1.0
            total = np.zeros(u.shape)
            for m, poly in enumerate((1.0, u, u * u - 1, u ** 3 - 3 * u)):
                terms = terms * max(m, 1)
                total += poly * (t[f"_m{m}"].to_numpy() / power / terms)[None, :]
                power *= bw
            density = (np.exp(-0.5 * u * u) * total).sum(axis=1) / (n * bw * math.sqrt(2 * math.pi))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(x, pa.float64()), pa.array(density, pa.float64())], names=["i", "x", "density"])

    # at most ``bins`` rows, whatever the table
    return binned.coalesce(1).mapInArrow(product, "i int, x double, density double") \
        .select("i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def unpivot_long(df: DataFrame, ids: list[str], values: list[str], var: str = "series",
                 val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(ids, values, var, val)


# ---------------------------------------------------------------------------
# cluster profiles
# ---------------------------------------------------------------------------

def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, share and the expected mean size per cluster (k-row result)."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    tot = W.partitionBy(F.lit(1))  # over the k cluster rows only
    return g.select(cluster, "size", (F.col("size") / F.sum("size").over(tot)).alias("share"),
                    (F.sum("size").over(tot) / F.count(F.lit(1)).over(tot)).alias("expected_size"))


def cluster_profile(meta: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, explicit share, median year (year 0 included, null ignored,
    truncated to int)."""
    return meta.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg((F.col("explicit") == 1).cast("double")).alias("explicit_share"),
        F.median("release_year").cast("int").alias("year_median"))


def cluster_top_genres(meta: DataFrame, n: int = 12, cluster: str = "cluster") -> DataFrame:
    """Top tokens per cluster (count desc, token asc), ``row_number <= n``
    planned with a partial window group limit."""
    c = genre_tokens(meta, keep=(cluster,)).groupBy(cluster, "genre").agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy(cluster).orderBy(F.col("count").desc(), F.col("genre"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(n))


def cluster_top_artists(meta: DataFrame, n: int = 10, cluster: str = "cluster") -> DataFrame:
    """Top raw artist names per cluster."""
    c = meta.groupBy(cluster, F.col("artist_name").alias("artist")).agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy(cluster).orderBy(F.col("count").desc(), F.col("artist"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(n))


def cluster_year_histogram(meta: DataFrame, bins: int = 30, cluster: str = "cluster",
                           col: str = "release_year") -> DataFrame:
    """Equal-width year bins inside each cluster (bounds per cluster)."""
    v = meta.select(cluster, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    b = v.groupBy(cluster).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return (v.join(F.broadcast(b), cluster).select(cluster, idx.alias("bin"))
             .groupBy(cluster, "bin").agg(F.count(F.lit(1)).alias("count")))


DIVERSITY_KS = (5, 10, 15, 20, 25, 30, 40, 50)


def diversity_curve(neigh: DataFrame, ks=DIVERSITY_KS) -> DataFrame:
    """For each K, distinct artists among the first K neighbours without
    and with one-per-artist (at least 1), long form.

    ``neigh`` is (rank, artist_name) of one query's neighbours.  Without
    diversity: keys (lower) whose first rank is <= K.  With: the greedy pick
    takes one row per stripped-lower key, so it yields min(K, #keys)."""
    lk = F.lower(text.null_to_empty("artist_name"))
    sk = text.artist_key_strip_lower("artist_name")
    first = neigh.groupBy(lk.alias("_k")).agg(F.min("rank").alias("_r"))
    nodiv = first.agg(*[F.count_if(F.col("_r") <= k).alias(f"n{k}") for k in ks])
    ndist = neigh.agg(F.count_distinct(sk).alias("_m"))
    wide = nodiv.crossJoin(ndist)
    rows = None
    for k in ks:
        r = wide.select(F.lit(k).alias("K"), F.greatest(F.col(f"n{k}"), F.lit(1)).alias("unique_artists_no_div"),
                        F.greatest(F.least(F.lit(k), F.col("_m")), F.lit(1)).alias("unique_artists_div"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.unpivot(["K"], ["unique_artists_no_div", "unique_artists_div"], "var", "unique_artists")


def cluster_compactness(points: DataFrame, cluster: str = "cluster", coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Per cluster, mean distance of its points to its own centroid (null
    below two points) and to the centroid of all other points (null if none),
    over the given coordinate columns.  Computed on all rows: centroids are
    sums, the 'others' centroid is total minus own, and the distances are one
    more aggregate - linear, so no sampling is needed."""
    n = len(coords)
    per = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(coords)])
    tot = per.agg(F.sum("n").alias("tn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(n)])
    others = F.col("tn") - F.col("n")
    centres = per.crossJoin(F.broadcast(tot)).select(
        cluster, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"c{i}") for i in range(n)],
        *[F.when(others > 0, (F.col(f"t{i}") - F.col(f"s{i}")) / others).alias(f"o{i}") for i in range(n)])
    far = lambda p: F.sqrt(sum((F.pow(F.col(c) - F.col(f"{p}{i}"), 2) for i, c in enumerate(coords)), F.lit(0.0)))
    j = points.join(centres, cluster)
    return j.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(far("c")).alias("_i"), F.avg(far("o")).alias("_o")).select(
        cluster, "n", F.when(F.col("n") >= 2, F.col("_i")).alias("intra"), F.col("_o").alias("extra"))


# ---------------------------------------------------------------------------
# exact quantiles without a global value map
# ---------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, cols: list[str], probs, buckets: int = 4096) -> dict[str, list]:
    """Exact quantiles of numeric columns with linear interpolation between
    order statistics (the definition of ``percentile`` / ``quantile_cont``).

    Every wanted order statistic narrows a range: one job per pass counts, for
    all of them together, the values of the range in at most ``buckets``
    equal parts with each part's least and greatest value; the part that
    holds the rank is the next range, until its ends are equal.  A pass takes
    log2(``buckets``) bits off a range, and a range's ends never share a part,
    so the passes end.  Only the counts reach the driver.  An empty column
    has ``None`` for each quantile."""
    x = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    st = x.agg(*[f(f"_x{i}") for i in range(len(cols)) for f in (F.count, F.min, F.max)]).first()
    ends = [st[3 * i:3 * i + 3] for i in range(len(cols))]
    value: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}  # (column, rank) -> least, greatest, values below
    for i, (n, lo, hi) in enumerate(ends):
        for p in probs if n else ():
            at = (n - 1) * float(p)
            for k in {int(at), min(int(at) + 1, n - 1)}:
                open_[i, k] = (float(lo), float(hi), 0)
    while True:
        value.update({key: lo for key, (lo, hi, _) in open_.items() if lo == hi})
        open_ = {key: r for key, r in open_.items() if r[0] != r[1]}
        if not open_:
            break
        ranges = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in open_.items()})
        parts = []
        for t, (i, lo, hi) in enumerate(ranges):
            c = F.col(f"_x{i}")
            # the share is taken of half the values, so that the widest ranges don't overflow
            part = F.floor((c / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)
            parts.append(F.when(c.between(lo, hi), F.struct(F.lit(t).alias("t"), F.least(part, F.lit(buckets - 1)).alias("b"), c.alias("x"))))
        inside = x.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")
        counts: dict[int, list] = {}
        for r in inside.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            counts.setdefault(r["t"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
        at = {r: t for t, r in enumerate(ranges)}
        for (i, k), (lo, hi, below) in open_.items():
            for _, n, least, greatest in sorted(counts[at[i, lo, hi]]):
                if below + n > k:
                    open_[i, k] = (least, greatest, below)
                    break
                below += n
    out: dict[str, list] = {}
    for i, (c, (n, _, _)) in enumerate(zip(cols, ends)):
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            at = (n - 1) * float(p)
            a, b = value[i, int(at)], value[i, min(int(at) + 1, n - 1)]
            out[c].append(a + (b - a) * (at - int(at)))
    return out
