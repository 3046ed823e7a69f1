"""Hand-computed cases (FIXTURES section 6) for column functions and small operators."""

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tunesift.functions import coerce, text
from tunesift.operators import profile as P
from tunesift.operators import search as S


def col1(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_null_text_is_empty_not_nan(spark):
    assert col1(spark, [None, "a"], text.null_to_empty) == ["", "a"]


def test_genre_bag_delimiters(spark):
    out = col1(spark, ["Pop; Rock | k-pop,, "], text.split_genres)
    assert out == [["pop", "rock", "k-pop"]]
    assert col1(spark, ["Pop; Rock | k-pop,, "], text.primary_genre) == ["pop"]
    assert col1(spark, [None, "  ", ",x"], text.primary_genre) == ["unknown", "unknown", "unknown"]


def test_genre_set_dedupes_in_order(spark):
    assert col1(spark, ["b, a, b"], text.genre_set) == [["b", "a"]]


def test_substring_filter_vs_token_relevance(spark):
    df = spark.createDataFrame([("1", "k-pop"), ("2", "pop")], "track_id string, artist_genres string")
    hits = sorted(r[0] for r in S.filter_genres_any(df, ["pop"]).collect())
    assert hits == ["1", "2"]  # substring: 'pop' hits 'k-pop' (Q9)
    toks = {r[0]: r[1] for r in df.select("track_id", text.genre_set("artist_genres")).collect()}
    assert "pop" not in toks["1"]  # token relevance does not


def test_year_prefix_mixed_dates(spark):
    assert col1(spark, ["2020-01-05", "2019", "2018-03", "x", None], coerce.year_prefix) == [2020, 2019, 2018, None, None]


def test_explicit_flag(spark):
    assert col1(spark, [True, None], lambda c: coerce.explicit_flag(c, BooleanType()), "boolean") == [1, 0]
    assert col1(spark, ["True", "1", None, "0"], coerce.explicit_flag) == [0, 1, 0, 0]


def test_norm_text(spark):
    assert col1(spark, ["  Hello   World\t"], text.norm_text) == ["hello world"]


def test_ngrams(spark):
    out = col1(spark, ["a b c"], lambda c: text.with_ngrams(text.word_tokens(c), 1, 2))
    assert out == [["a", "b", "c", "a b", "b c"]]
    assert col1(spark, [""], lambda c: text.with_ngrams(text.word_tokens(c), 1, 2)) == [[]]


def test_unicode_word_tokens(spark):
    assert col1(spark, ["Ünïcode straße_1 naïve"], text.word_tokens) == [["ünïcode", "straße_1", "naïve"]]


def test_rolling_edges(spark):
    df = spark.createDataFrame([(1999, 1), (2005, 10), (2006, 100), (2007, 1000)], "release_year int, n int")
    meta = df.selectExpr("release_year", "explode(sequence(1, n)) AS k").drop("k")
    out = {r["year"]: r["smooth"] for r in P.year_counts_smoothed(meta).collect()}
    assert out == {1999: 5.5, 2005: 37.0, 2006: 370.0, 2007: 550.0}


def test_tiny_cluster_has_no_intra(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (1, 3.0, 1.0)], "cluster int, x double, y double")
    out = {r["cluster"]: (r["intra"], r["extra"]) for r in P.cluster_compactness(pts).collect()}
    assert out[0][0] is None and abs(out[0][1] - (2 ** 2 + 1) ** 0.5) < 1e-9
    assert abs(out[1][0] - 1.0) < 1e-9


def test_quality_table_counts_empty_strings(spark):
    df = spark.createDataFrame([("a", None), ("", 1), (None, 2)], "s string, n int")
    out = {r["column"]: (r["missing_pct"], r["empty_string_pct"]) for r in P.quality_table(df).collect()}
    assert out["s"] == (33.33, 33.33) and out["n"] == (33.33, 0.0)


def test_exact_quantiles_match_numpy_with_narrowing(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 1000, 3000), np.full(2000, 7), rng.normal(0, 1e6, 1000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = P.exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), ["v", "none"], probs, buckets=8)   # several passes
    assert got["none"] == [None] * len(probs)
    got = got["v"]
    exp = np.quantile(vals, probs)                                     # linear interpolation
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


def test_ensure_columns_keeps_year_from_date(spark):
    from tunesift.operators import clean
    df = spark.createDataFrame([("a", "2001-02-03"), ("b", None)], "track_name string, release_date string")
    out = clean.prepare_meta(clean.ensure_columns(df))
    assert {r["track_name"]: r["release_year"] for r in out.collect()} == {"a": 2001, "b": 0}
