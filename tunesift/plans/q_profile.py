"""Descriptive analytics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunesift.operators import clean
from tunesift.operators import profile as P
from tunesift.operators import sketches as SK
from tunesift.plans.artifacts import stored_meta
from tunesift.plans.q_ingest import parts
from tunesift.plans.registry import register
from tunesift.plans.sqlfrag import CATALOG, CATALOG_RAW, GENRE_TOKENS, META, with_
from tunesift.session import scratch_path
from tunesift.sources import fixtures as fx

_TOP = """ SELECT {k} AS {name}, count(*) AS count FROM {src} GROUP BY {k} ORDER BY count DESC, {name} LIMIT {n}"""


@register("h1_kpis", with_(META) + GENRE_TOKENS + """
 SELECT * FROM (SELECT count(*) AS songs, count(DISTINCT artist_name) AS artists,
   min(CASE WHEN release_year > 0 THEN release_year END) AS min_year,
   max(CASE WHEN release_year > 0 THEN release_year END) AS max_year,
   round(avg(CAST(explicit = 1 AS DOUBLE)) * 100.0, 4) AS explicit_pct FROM meta) a,
  (SELECT count(DISTINCT genre) AS genre_tokens FROM genre_tok) b""")
def h1_kpis(spark, sf):
    return P.kpis(stored_meta(spark, sf))


@register("h2_genre_counts", with_(META) + GENRE_TOKENS + _TOP.format(k="genre", name="genre", src="genre_tok", n=30))
def h2_genre_counts(spark, sf):
    return P.genre_counts(stored_meta(spark, sf), 30)


@register("h3_genre_vocab", with_(META) + GENRE_TOKENS + """
 SELECT genre FROM (""" + _TOP.format(k="genre", name="genre", src="genre_tok", n=200) + ")")
def h3_genre_vocab(spark, sf):
    return P.genre_vocab(stored_meta(spark, sf), 200)


@register("h4_year_counts", with_(META) + """
 SELECT release_year AS year, count(*) AS count FROM meta WHERE release_year > 0 GROUP BY release_year""")
def h4_year_counts(spark, sf):
    return P.year_counts(stored_meta(spark, sf))


@register("h5_year_counts_smoothed", with_(META) + """,
 yc AS (SELECT release_year AS year, count(*) AS count FROM meta WHERE release_year > 0 GROUP BY release_year)
 SELECT year, count, avg(count) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth
 FROM yc WHERE (SELECT count(*) FROM yc) >= 3""")
def h5_year_counts_smoothed(spark, sf):
    return P.year_counts_smoothed(stored_meta(spark, sf))


@register("h6_artist_counts", with_(META) + _TOP.format(k="artist_name", name="artist", src="meta", n=20))
def h6_artist_counts(spark, sf):
    return P.artist_counts(stored_meta(spark, sf), 20)


@register("h7_dominant_artists", with_(META) + _TOP.format(
    k="regexp_replace(artist_name, '^\\s+|\\s+$', '', 'g')", name="artist", src="meta", n=20))
def h7_dominant_artists(spark, sf):
    return P.dominant_artists(stored_meta(spark, sf), 20)


_RAW_COLS = ["track_id", "track_name", "artist_name", "artist_genres", "release_date", "explicit", "popularity",
             "duration_ms"]
_TEXT = {"track_id", "track_name", "artist_name", "artist_genres", "release_date"}


def _quality_sql():
    parts = []
    for c in _RAW_COLS:
        e = f"round(avg(coalesce(CAST({c} = '' AS DOUBLE), 0.0)) * 100.0, 2)" if c in _TEXT else "0.0"
        parts.append(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)) * 100.0, 2) AS missing_pct, "
                     f"{e} AS empty_string_pct FROM catalog_raw")
    return with_(CATALOG_RAW) + " " + " UNION ALL ".join(parts)


@register("h8_quality_table", _quality_sql())
def h8_quality_table(spark, sf):
    return P.quality_table(fx.catalog_raw(spark, sf))


@register("h9_duplicate_count", with_(CATALOG_RAW) + " SELECT count(*) - count(DISTINCT track_id) AS duplicates FROM catalog_raw")
def h9_duplicate_count(spark, sf):
    return P.duplicate_count(fx.catalog_raw(spark, sf))


@register("h10_explicit_split", with_(META) + """
 SELECT CASE explicit WHEN 0 THEN 'Clean' WHEN 1 THEN 'Explicit' END AS label, count(*) AS count
 FROM meta WHERE explicit IN (0, 1) GROUP BY 1""")
def h10_explicit_split(spark, sf):
    return P.explicit_split(stored_meta(spark, sf))


def _missing_sql():
    parts = [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM catalog_raw"
             for c in _RAW_COLS]
    return with_(CATALOG_RAW) + " SELECT * FROM (" + " UNION ALL ".join(parts) + ") ORDER BY missing DESC, \"column\" LIMIT 10"


@register("h11_missing_counts", _missing_sql())
def h11_missing_counts(spark, sf):
    return P.missing_counts(fx.catalog_raw(spark, sf), 10)


_NUM = ["explicit", "popularity", "duration_ms"]


def _describe_sql():
    parts = []
    for c in _NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, "
            f"min({x}) AS min, round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS q50, "
            f"round(quantile_cont({x}, 0.75), 4) AS q75, max({x}) AS max FROM catalog")
    return with_(CATALOG) + " " + " UNION ALL ".join(parts)


@register("h12_describe_numeric", _describe_sql())
def h12_describe_numeric(spark, sf):
    return P.describe_numeric(stored_meta(spark, sf), _NUM)


@register("h13_table_overview", with_(CATALOG) + """
 SELECT count(*) AS rows, 8 AS columns,
  'track_id,track_name,artist_name,artist_genres,release_date,explicit,popularity,duration_ms' AS column_names FROM catalog""")
def h13_table_overview(spark, sf):
    return P.table_overview(fx.catalog(spark, sf)).withColumn("columns", F.col("columns").cast("int"))


@register("h14_explicit_share_by_year", with_(META) + """
 SELECT release_year AS year, round(avg(CAST(explicit = 1 AS DOUBLE)), 6) AS explicit_share FROM meta GROUP BY release_year""")
def h14_explicit_share_by_year(spark, sf):
    return P.explicit_share_by_year(stored_meta(spark, sf))


@register("h15_data_check", with_(META) + """
 SELECT count(*) AS rows, count(DISTINCT artist_name) AS artists, count(DISTINCT track_name) AS tracks,
  count(*) FILTER (WHERE length(artist_genres) > 0) AS rows_with_genres FROM meta""")
def h15_data_check(spark, sf):
    return P.data_check(stored_meta(spark, sf))


@register("h23_main_genre_top", with_(CATALOG) + _TOP.format(
    k="split_part(coalesce(artist_genres, ''), ',', 1)", name="main_genre", src="catalog", n=15))
def h23_main_genre_top(spark, sf):
    return P.main_genre_top(fx.catalog(spark, sf), 15)


@register("h24_duration_histogram", with_(CATALOG) + """,
 v AS (SELECT duration_ms / 60000.0 AS x FROM catalog WHERE duration_ms IS NOT NULL),
 b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
 k AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 30), 29) END AS INT) AS bin, lo, hi FROM v, b)
 SELECT bin, round(lo + (hi - lo) * bin / 30, 6) AS lo, round(lo + (hi - lo) * (bin + 1) / 30, 6) AS hi, count(*) AS count
 FROM k GROUP BY bin, k.lo, k.hi""")
def h24_duration_histogram(spark, sf):
    return P.duration_histogram(fx.catalog(spark, sf), 30)


@register("h25_duration_kde", with_(CATALOG) + """,
 v AS (SELECT duration_ms / 60000.0 AS x FROM catalog WHERE duration_ms IS NOT NULL),
 s AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM v),
 g AS (SELECT i, lo - 3.0 * bw + i * ((hi - lo) + 6.0 * bw) / 199 AS gx, n, bw FROM s, range(200) r(i))
 SELECT CAST(i AS INT) AS i, round(gx, 6) AS x, round(sum(exp(-0.5 * pow((gx - x) / bw, 2))) / (n * bw * sqrt(2 * pi())), 8) AS density
 FROM g, v GROUP BY i, gx, n, bw""")
def h25_duration_kde(spark, sf):
    return P.duration_kde(fx.catalog(spark, sf), 200).withColumn("i", F.col("i").cast("int"))


@register("h26_unpivot_long", with_(META) + """,
 yc AS (SELECT release_year AS year, count(*) AS count FROM meta WHERE release_year > 0 GROUP BY release_year),
 sm AS (SELECT year, CAST(count AS DOUBLE) AS count,
        avg(count) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM yc)
 UNPIVOT sm ON count, smooth INTO NAME series VALUE value""")
def h26_unpivot_long(spark, sf):
    sm = P.year_counts_smoothed(stored_meta(spark, sf)).withColumn("count", F.col("count").cast("double"))
    return P.unpivot_long(sm, ["year"], ["count", "smooth"])


RAW_META = with_(CATALOG_RAW) + """,
meta AS (
 SELECT track_id, coalesce(artist_name, '') AS artist_name, coalesce(artist_genres, '') AS artist_genres,
  coalesce(TRY_CAST(regexp_extract(release_date, '^(\\d{4})', 1) AS INT), 0) AS release_year FROM catalog_raw)"""
#: What the estimates of distinct values may be off by: four standard errors.
SKETCH_ERROR = 4 * 1.04 / 2 ** (SK.PRECISION / 2)


@register("h1_h9_part_sketches", RAW_META + GENRE_TOKENS + """,
 k AS (SELECT count(*) AS rows, count(DISTINCT track_id) AS songs, count(DISTINCT artist_name) AS artists,
   min(CASE WHEN release_year > 0 THEN release_year END) AS min_year, max(CASE WHEN release_year > 0 THEN release_year END) AS max_year FROM meta)
 SELECT metric, value, true AS close FROM (SELECT rows, rows - songs AS duplicates, songs, artists,
   (SELECT count(DISTINCT genre) FROM genre_tok) AS genre_tokens, CAST(min_year AS BIGINT) AS min_year, CAST(max_year AS BIGINT) AS max_year FROM k)
 UNPIVOT (value FOR metric IN (rows, duplicates, songs, artists, genre_tokens, min_year, max_year))""")
def h1_h9_part_sketches(spark, sf):
    """H1, H9 and H15 over all raw parts from the state stored beside each: the
    exact values, and whether the merged sketches come within their error."""
    path = scratch_path(spark, f"part_sketches/{uuid.uuid4().hex[:12]}")
    made = clean.prepare_meta(parts(spark, sf).drop("release_year")).select("track_id", "artist_name", "artist_genres", "release_year", "part")
    # the part files: made once, so that the joins behind them (and what those broadcast) aren't run again for every part and total
    made.write.partitionBy("part").parquet(f"{path}_files")
    ready = spark.read.schema(made.schema).parquet(f"{path}_files")
    for (number,) in sorted(tuple(r) for r in ready.select("part").distinct().collect()):  # one a part file
        SK.store_part(ready.filter(F.col("part") == number), str(number), path)
    exact = ready.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("track_id").alias("songs"), F.count_distinct("artist_name").alias("artists"),
                      *[f(F.when(F.col("release_year") > 0, F.col("release_year"))).alias(n) for f, n in ((F.min, "min_year"), (F.max, "max_year"))])
    genres = P.genre_tokens(ready).agg(F.count_distinct("genre").alias("genre_tokens"))
    names = ["rows", "duplicates", "songs", "artists", "genre_tokens", "min_year", "max_year"]
    exact = exact.crossJoin(genres).withColumn("duplicates", F.col("rows") - F.col("songs"))  # one row each
    both = exact.select(*[F.col(c).cast("long").alias(c) for c in names]).unpivot([], names, "metric", "value").join(
        SK.merged(spark, path).select(*[F.col(c).cast("long").alias(c) for c in names]).unpivot([], names, "metric", "about"), "metric")
    # duplicates are rows less songs, and share the songs' error
    base = F.when(F.col("metric") == "duplicates", F.max("value").over(Window.partitionBy(F.lit(1)))).otherwise(F.col("value"))
    slack = F.when(F.col("metric").isin("rows", "min_year", "max_year"), 0.0).otherwise(SKETCH_ERROR * base)
    return both.select("metric", "value", (F.abs(F.col("about") - F.col("value")) <= slack).alias("close"))
