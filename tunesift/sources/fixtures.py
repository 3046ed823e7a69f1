"""Catalogue views derived from the given TPC-H-style tables.

The reference ships no data; these views give every operator real input whose
size grows with the scale factor: one catalogue row per order line, with the
nulls, delimiters, mixed case and date formats the cleaning operators handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesift.operators.clean import dedupe_keep_first, prepare_meta
from tunesift.sources.tables import table

# order of the keep-first rule (B9); nulls sort first
DEDUPE_ORDER = ["release_date", "track_name", "artist_name", "artist_genres", "explicit",
                "popularity", "duration_ms"]


def _track_id(orderkey="l_orderkey", linenumber="l_linenumber"):
    return F.concat(F.col(orderkey).cast("string"), F.lit("-"), F.col(linenumber).cast("string"))


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalogue: one row per order line (keys repeat on purpose)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(supp, li.l_suppkey == supp.s_suppkey))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    ship = F.col("l_shipdate").cast("string")
    return j.select(
        _track_id().alias("track_id"),
        F.when(pk % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("track_name"),
        F.when(sk % 41 == 0, F.lit(None).cast("string"))
         .when(ln % 5 == 0, F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")))
         .otherwise(F.col("s_name")).alias("artist_name"),
        F.when(pk % 31 == 0, F.lit(None).cast("string"))
         .when(pk % 4 == 0, F.concat("p_type", F.lit(", "), "p_brand"))
         .when(pk % 4 == 1, F.concat("p_type", F.lit(";"), "p_brand"))
         .when(pk % 4 == 2, F.concat(F.lower("p_type"), F.lit(" | "), "p_name", F.lit(", "), "p_brand"))
         .otherwise(F.col("p_type")).alias("artist_genres"),
        F.when(pk % 53 == 0, F.lit(None).cast("string"))
         .when(pk % 3 == 0, F.substring(ship, 1, 4))
         .otherwise(F.substring(ship, 1, 10)).alias("release_date"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("explicit"),
        F.col("l_quantity").cast("int").alias("popularity"),
        F.floor("l_extendedprice").cast("bigint").alias("duration_ms"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated catalogue: one row per ``track_id``."""
    return dedupe_keep_first(catalog_raw(spark, sf_dir), "track_id", DEDUPE_ORDER)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired recommender table: track_id, track_name, artist_name,
    artist_genres, release_year, explicit (+ popularity, duration_ms, release_date)."""
    return prepare_meta(catalog(spark, sf_dir).drop("release_year")).select(
        "track_id", "track_name", "artist_name", "artist_genres", "release_year", "explicit",
        "release_date", "popularity", "duration_ms")


# ---- ingest views (A3-A11) --------------------------------------------------

def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artists(artist_id, name, genres array<string>)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
             .select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"),
                     F.split(F.concat("n_name", F.lit(","), "r_name"), ",").alias("genres")))


def track_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_artists(track_id, artist_id): two artists per order line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    a = li.select(_track_id().alias("track_id"), F.col("l_suppkey").alias("artist_id"))
    b = li.select(_track_id().alias("track_id"), (F.col("l_partkey") % 7).alias("artist_id"))
    return a.unionByName(b).distinct()


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """albums(album_id, artist_id, release_date)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("album_id"), (F.col("o_custkey") % 10).alias("artist_id"),
                    F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("release_date"))


def album_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """album_tracks(album_id, track_id)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return li.select(F.col("l_orderkey").alias("album_id"), _track_id().alias("track_id")).distinct()


def seed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed_refs(pos, ref): artist URL, bare id, name with a note, playlist URL."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    h = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 22)
    k = F.col("s_suppkey") % 4
    ref = (F.when(k == 0, F.concat(F.lit("https://example.org/artist/"), h))
            .when(k == 1, h)
            .when(k == 2, F.concat(F.lit(" "), F.col("s_name"), F.lit("  # note")))
            .otherwise(F.concat(F.lit("https://example.org/playlist/"), h)))
    return s.select(F.col("s_suppkey").alias("pos"), ref.alias("ref"))


def external_artist_id(col="artist_id"):
    """External 22-character id of an artist in the fixtures."""
    return F.substring(F.md5(F.col(col).cast("string")), 1, 22)
