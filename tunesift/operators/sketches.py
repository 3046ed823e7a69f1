"""H1, H9 and H15 from mergeable sketches: state stored beside each ingested part.

A part is read once, when it arrives: its row count, year span and HyperLogLog
sketches of its ids, artists and genre tokens are one row, written under the
part's name.  Totals merge those rows, so a new part costs its own size and a
repeated part replaces its row.  Counts of distinct values carry the sketch's
error, about 1.04 / sqrt(2^precision) (0.8 % at 14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesift.functions import text

PRECISION = 14
SKETCHED = ("ids", "artists", "genre_tokens")


def part_state(part: DataFrame, precision: int = PRECISION) -> DataFrame:
    """One row of a prepared part (``clean.prepare_meta``): rows, year span and sketches."""
    known = F.when(F.col("release_year") > 0, F.col("release_year"))

    def sketch(c):
        # a sketch leaves out empty texts, which count as values here
        return F.hll_sketch_agg(F.concat(F.lit("="), F.col(c)), precision)

    rows = part.agg(F.count(F.lit(1)).alias("rows"), F.min(known).alias("min_year"), F.max(known).alias("max_year"),
                    sketch("track_id").alias("ids"), sketch("artist_name").alias("artists"))
    genres = part.select(F.explode(text.split_genres("artist_genres")).alias("genre")).agg(sketch("genre").alias("genre_tokens"))
    return rows.crossJoin(genres)  # one row each


def store_part(part: DataFrame, name: str, path: str, precision: int = PRECISION) -> None:
    """Write a part's state; an earlier one of that name is replaced."""
    part_state(part, precision).write.mode("overwrite").parquet(f"{path}/part={name}")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(rows, duplicates, songs, artists, genre_tokens, min_year, max_year) over all stored parts."""
    states = spark.read.parquet(path)
    total = states.agg(F.sum("rows").alias("rows"), F.min("min_year").alias("min_year"), F.max("max_year").alias("max_year"),
                       *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in SKETCHED])
    return total.select("rows", F.greatest(F.col("rows") - F.col("ids"), F.lit(0)).alias("duplicates"), F.col("ids").alias("songs"), "artists", "genre_tokens",
                        "min_year", "max_year")
