"""Catalogue queries: fixtures, repair and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunesift.functions import coerce, text
from tunesift.operators import clean
from tunesift.plans.registry import register
from tunesift.plans.sqlfrag import CATALOG, CATALOG_RAW, GENRE_TOKENS, META, with_
from tunesift.sources import fixtures as fx


@register("b9_dedupe_keep_first", with_(CATALOG) + " SELECT * FROM catalog")
def b9_dedupe_keep_first(spark, sf):
    return fx.catalog(spark, sf)


@register("b1_ensure_columns", with_(CATALOG_RAW) + """
 SELECT regexp_replace(regexp_replace(lower(concat(coalesce(track_name, ''), ' :: ', coalesce(artist_name, ''))),
          '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS track_id,
   track_name, artist_name, '' AS artist_genres, 0 AS release_year, 0 AS explicit
 FROM catalog_raw""")
def b1_ensure_columns(spark, sf):
    raw = fx.catalog_raw(spark, sf).select("track_name", "artist_name")
    return clean.ensure_columns(raw).select(
        "track_id", "track_name", "artist_name", "artist_genres",
        F.col("release_year").cast("int").alias("release_year"), F.col("explicit").cast("int").alias("explicit"))


@register("b2_synth_track_id", with_(CATALOG) + """
 SELECT track_id, regexp_replace(regexp_replace(lower(concat(coalesce(track_name, ''), ' :: ', coalesce(artist_name, ''))),
          '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS synth_id FROM catalog""")
def b2_synth_track_id(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.synth_track_id().alias("synth_id"))


@register("b3_norm_text", with_(CATALOG) + """
 SELECT track_id, regexp_replace(regexp_replace(lower(artist_name), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS norm_artist
 FROM catalog""")
def b3_norm_text(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.norm_text("artist_name").alias("norm_artist"))


@register("b4_null_to_empty", with_(CATALOG) + """
 SELECT track_id, coalesce(track_name, '') AS track_name, coalesce(artist_name, '') AS artist_name,
   coalesce(artist_genres, '') AS artist_genres FROM catalog""")
def b4_null_to_empty(spark, sf):
    c = fx.catalog(spark, sf)
    return c.select("track_id", *[text.null_to_empty(x).alias(x) for x in clean.TEXT_COLS])


@register("b5_coerce_int_zero", with_(CATALOG) + """
 SELECT track_id, coalesce(CAST(trunc(TRY_CAST(release_date AS DOUBLE)) AS INT), 0) AS year_num,
   coalesce(CAST(trunc(TRY_CAST(CAST(popularity AS VARCHAR) AS DOUBLE)) AS INT), 0) AS popularity
 FROM catalog""")
def b5_coerce_int_zero(spark, sf):
    c = fx.catalog(spark, sf)
    return c.select("track_id", coerce.coerce_int_zero("release_date").alias("year_num"),
                    coerce.coerce_int_zero("popularity").alias("popularity"))


@register("b6_year_prefix", with_(CATALOG) + """
 SELECT track_id, TRY_CAST(nullif(regexp_extract(release_date, '^(\\d{4})', 1), '') AS INT) AS release_year
 FROM catalog""")
def b6_year_prefix(spark, sf):
    return fx.catalog(spark, sf).select("track_id", coerce.year_prefix("release_date").alias("release_year"))


@register("a12_year_from_date_prefix", with_(CATALOG) + """
 SELECT track_id, substr(release_date, 1, 4) AS release_year FROM catalog""")
def a12_year_from_date_prefix(spark, sf):
    return fx.catalog(spark, sf).select("track_id", coerce.year_from_date_prefix("release_date").alias("release_year"))


# explicit as text in three spellings: '1', '0' and the boolean word 'True'
_EXPLICIT_TEXT_SQL = "CASE WHEN popularity % 7 = 0 THEN 'True' WHEN explicit = 1 THEN '1' ELSE '0' END"


@register("b7_explicit_flag", with_(CATALOG) + f"""
 SELECT track_id, coalesce(CAST(trunc(TRY_CAST({_EXPLICIT_TEXT_SQL} AS DOUBLE)) AS INT), 0) AS explicit_num,
   CAST(explicit = 1 AS INT) AS explicit_bool_num
 FROM catalog""")
def b7_explicit_flag(spark, sf):
    from pyspark.sql.types import BooleanType
    c = fx.catalog(spark, sf)
    as_text = (F.when(F.col("popularity") % 7 == 0, F.lit("True"))
                .when(F.col("explicit") == 1, F.lit("1")).otherwise(F.lit("0")))
    as_bool = F.col("explicit") == 1
    return c.select("track_id", coerce.explicit_flag(as_text).alias("explicit_num"),
                    coerce.explicit_flag(as_bool, BooleanType()).alias("explicit_bool_num"))


@register("b8_impute_year_median", with_(CATALOG) + """,
 y AS (SELECT track_id, CAST(TRY_CAST(nullif(regexp_extract(release_date, '^(\\d{4})', 1), '') AS INT) AS DOUBLE) AS yr FROM catalog)
 SELECT track_id, coalesce(yr, (SELECT median(yr) FROM y)) AS release_year FROM y""")
def b8_impute_year_median(spark, sf):
    y = fx.catalog(spark, sf).select("track_id", coerce.year_prefix("release_date").alias("release_year"))
    return clean.impute_median(y, "release_year")


@register("b10_display_label", with_(CATALOG) + """
 SELECT track_id, concat(coalesce(track_name, ''), ' — ', coalesce(artist_name, '')) AS display FROM catalog""")
def b10_display_label(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.display_label().alias("display"))


@register("b11_split_genres", with_(META) + GENRE_TOKENS + """
 SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY pos) AS INT) AS pos, genre FROM genre_tok""")
def b11_split_genres(spark, sf):
    m = fx.meta(spark, sf)
    return m.select("track_id", F.posexplode(text.split_genres("artist_genres")).alias("p", "genre")).select(
        "track_id", (F.col("p") + 1).cast("int").alias("pos"), "genre")


@register("b12_genre_set", with_(META) + GENRE_TOKENS + """,
 firsts AS (SELECT track_id, genre, min(pos) AS p FROM genre_tok GROUP BY track_id, genre)
 SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY p) AS INT) AS pos, genre FROM firsts""")
def b12_genre_set(spark, sf):
    m = fx.meta(spark, sf)
    return m.select("track_id", F.posexplode(text.genre_set("artist_genres")).alias("p", "genre")).select(
        "track_id", (F.col("p") + 1).cast("int").alias("pos"), "genre")


PRIMARY_SQL = """CASE WHEN regexp_replace(coalesce(artist_genres, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'unknown'
   WHEN regexp_replace(split_part(regexp_replace(lower(artist_genres), '[;|]', ',', 'g'), ',', 1), '^\\s+|\\s+$', '', 'g') = '' THEN 'unknown'
   ELSE regexp_replace(split_part(regexp_replace(lower(artist_genres), '[;|]', ',', 'g'), ',', 1), '^\\s+|\\s+$', '', 'g') END"""


@register("b13_primary_genre", with_(CATALOG) + f" SELECT track_id, {PRIMARY_SQL} AS primary_genre FROM catalog")
def b13_primary_genre(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.primary_genre("artist_genres").alias("primary_genre"))


@register("b14_bundle_rare", with_(CATALOG) + f""",
 y AS (SELECT track_id, {PRIMARY_SQL} AS label FROM catalog),
 n AS (SELECT label, count(*) AS c FROM y GROUP BY label)
 SELECT track_id, CASE WHEN c < 20 THEN 'other' ELSE y.label END AS label FROM y JOIN n USING (label)""")
def b14_bundle_rare(spark, sf):
    y = fx.catalog(spark, sf).select("track_id", text.primary_genre("artist_genres").alias("label"))
    return clean.bundle_rare(y, "label", 20).select("track_id", "label")


@register("b15_main_genre_naive", with_(CATALOG) + """
 SELECT track_id, split_part(coalesce(artist_genres, ''), ',', 1) AS main_genre FROM catalog""")
def b15_main_genre_naive(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.main_genre_naive("artist_genres").alias("main_genre"))


@register("b16_duration_min", with_(CATALOG) + """
 SELECT track_id, round(duration_ms / 60000.0, 6) AS duration_min FROM catalog""")
def b16_duration_min(spark, sf):
    from tunesift.operators.profile import duration_min
    return fx.catalog(spark, sf).select("track_id", F.round(duration_min("duration_ms"), 6).alias("duration_min"))


@register("b17_artist_key", with_(CATALOG) + """
 SELECT track_id, lower(regexp_replace(coalesce(artist_name, ''), '^\\s+|\\s+$', '', 'g')) AS key_strip_lower,
   lower(coalesce(artist_name, '')) AS key_lower,
   regexp_replace(coalesce(artist_name, ''), '^\\s+|\\s+$', '', 'g') AS key_strip FROM catalog""")
def b17_artist_key(spark, sf):
    return fx.catalog(spark, sf).select(
        "track_id", text.artist_key_strip_lower("artist_name").alias("key_strip_lower"),
        text.artist_key_lower("artist_name").alias("key_lower"), text.artist_key_strip("artist_name").alias("key_strip"))


@register("b18_track_url", with_(CATALOG) + """
 SELECT track_id, concat('https://example.org/track/', track_id) AS url FROM catalog""")
def b18_track_url(spark, sf):
    return fx.catalog(spark, sf).select("track_id", text.track_url().alias("url"))


@register("b19_year_bounds", with_(META) + """
 SELECT CAST(coalesce(min(nullif(release_year, 0)), 1900) AS INT) AS min_year,
   CAST(CASE WHEN coalesce(max(release_year), 0) > 0 THEN max(release_year) ELSE 2030 END AS INT) AS max_year FROM meta""")
def b19_year_bounds(spark, sf):
    return clean.year_bounds(fx.meta(spark, sf))


@register("meta_prepare", with_(META) + """
 SELECT track_id, track_name, artist_name, artist_genres, release_year, explicit FROM meta""")
def meta_prepare(spark, sf):
    return fx.meta(spark, sf).select(*clean.REQUIRED_META)
