"""Cleaning and repair operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.functions import coerce, text

# fixed values: the columns of the recommender's catalogue
REQUIRED_META = ("track_id", "track_name", "artist_name", "artist_genres", "release_year", "explicit")
TEXT_COLS = ("track_name", "artist_name", "artist_genres")


def ensure_columns(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """B1: add missing columns with a default (text '' / numbers 0).

    Q4: an absent ``track_id`` is synthesised from name and artist (B2)."""
    defaults = defaults or {"track_name": "", "artist_name": "", "artist_genres": "",
                            "release_year": 0, "explicit": 0}
    out = df
    if "track_id" not in out.columns:
        tn = F.col("track_name") if "track_name" in out.columns else F.lit("")
        an = F.col("artist_name") if "artist_name" in out.columns else F.lit("")
        out = out.withColumn("track_id", text.synth_track_id(tn, an))
    # Q1: a present release_date is the source of the year (prepare_meta
    # derives it), so it is not masked by a default release_year of 0
    missing = {c: F.lit(v) for c, v in defaults.items()
               if c not in out.columns and not (c == "release_year" and "release_date" in out.columns)}
    return out.withColumns(missing) if missing else out


def dedupe_keep_first(df: DataFrame, key: str = "track_id", order: list[str] | None = None) -> DataFrame:
    """One row per key, the first in ``order`` (ascending, NULLS FIRST).

    Written as ``min(struct(order..., rest...))`` per key rather than a
    ``row_number`` window: the aggregate combines map-side, so a hot key that
    holds a third of the rows is reduced to one row per input partition before
    the shuffle instead of being sorted whole in one task.  Struct ordering
    compares field by field with nulls first, which is the wanted order.
    """
    rest = [c for c in df.columns if c != key and c not in (order or [])]
    fields = list(order or []) + rest
    packed = F.struct(*[F.col(c) for c in fields])
    return (df.groupBy(key).agg(F.min(packed).alias("_first"))
              .select(key, *[F.col("_first").getField(c).alias(c) for c in fields])
              .select(*df.columns))


def prepare_meta(df: DataFrame) -> DataFrame:
    """Recommender meta repair (``ensure_meta``): text null -> '', year and
    explicit through B5 (the year taken from ``release_year`` if present, else
    from the 4-digit prefix of ``release_date``, else 0, see Q1/Q2)."""
    out = ensure_columns(df, {"track_name": "", "artist_name": "", "artist_genres": ""})
    if "release_year" in df.columns:
        year = coerce.coerce_int_zero("release_year")
    elif "release_date" in df.columns:
        year = coerce.release_year_or_zero("release_date")
    else:
        year = F.lit(0)
    explicit = (coerce.explicit_flag("explicit", df.schema["explicit"].dataType)
                if "explicit" in df.columns else F.lit(0))
    return out.withColumns({
        "track_name": text.null_to_empty("track_name"),
        "artist_name": text.null_to_empty("artist_name"),
        "artist_genres": text.null_to_empty("artist_genres"),
        "release_year": year.cast("int"),
        "explicit": explicit.cast("int"),
    })


def impute_median(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Null -> exact median of the column (one-row aggregate, broadcast).

    The median is a single scalar row; the cross join with it is a broadcast
    of one row, not a pairing of data rows.  The exact ``median`` keeps one
    counter per distinct value (partially aggregated per partition), which is
    small for years; use ``percentile_approx`` for high-cardinality columns."""
    med = df.agg(F.median(col).alias("_median"))
    return (df.crossJoin(F.broadcast(med))
              .withColumn(out_col or col, F.coalesce(F.col(col).cast("double"), F.col("_median")))
              .drop("_median"))


def bundle_rare(df: DataFrame, col: str, min_count: int = 20, other: str = "other",
                out_col: str | None = None) -> DataFrame:
    """Classes with fewer than ``min_count`` rows become ``other``.

    Counts are an aggregate (one row per class), joined back on the class;
    the class table is small by construction of a label, but the join is left
    to the planner (broadcast only when statistics prove it small)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return (df.join(counts, on=col, how="left")
              .withColumn(out_col or col, F.when(F.col("_n") < min_count, F.lit(other)).otherwise(F.col(col)))
              .drop("_n"))


def year_bounds(df: DataFrame, col: str = "release_year") -> DataFrame:
    """Slider bounds: min over non-zero years (fallback 1900), max (fallback 2030 if <= 0)."""
    return df.agg(F.min(F.nullif(F.col(col), F.lit(0))).alias("_mn"), F.max(col).alias("_mx")).select(
        F.coalesce(F.col("_mn"), F.lit(1900)).cast("int").alias("min_year"),
        F.when(F.coalesce(F.col("_mx"), F.lit(0)) > 0, F.col("_mx")).otherwise(F.lit(2030)).cast("int").alias("max_year"))
