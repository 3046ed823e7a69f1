"""Literal search through trigram postings, and part sketches."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tunesift.operators import sketches as SK
from tunesift.operators import text_index as TI

SCHEMA = "track_id string, track_name string, artist_genres string"


def made(n=400):
    rnd = random.Random(1)
    words = ["red", "RED", "Rödel", "re", "ed", "edre", "blue", "Brand#1", "brand#12", "中文字", "a", ""]
    return [(f"id{i:04d}", None if i % 50 == 0 else " ".join(rnd.choices(words, k=rnd.randint(0, 4))), " | ".join(rnd.choices(words, k=2)) if i % 7 else None) for i in range(n)]


def test_search_equals_a_scan(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = TI.build(df, {"track_name": F.col("track_name"), "artist_genres": F.col("artist_genres")}, str(tmp_path / "i"), block_rows=64)
    assert index.rows.columns == ["track_id", "track_name", "artist_genres", "row", "block"] and index.rows.select("block").distinct().count() == 7
    for q in ("red", " ReD ", "edre", "rödel", "brand#1", "中文字", "d | r", "zzz", "re", "a", "", None, "red red"):
        literal = (q or "").strip().lower()
        want = sorted((r for r in rows if literal in (r[1] or "").lower() or literal in (r[2] or "").lower()), key=str)
        got = TI.contains_any(index, [("track_name", q), ("artist_genres", q)])
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == want, q
    genres = TI.contains_any(index, [("artist_genres", "blue"), ("artist_genres", "brand#12")]).count()
    assert genres == sum("blue" in (r[2] or "").lower() or "brand#12" in (r[2] or "").lower() for r in rows)


def test_a_rare_query_opens_its_blocks_alone(spark, tmp_path):
    rows = [(f"id{i:04d}", "needle in hay" if i == 130 else f"some hay {i}", "") for i in range(640)]
    index = TI.build(spark.createDataFrame(rows, SCHEMA), {"track_name": F.col("track_name")}, str(tmp_path / "i"), block_rows=64)
    hits = TI.contains_any(index, [("track_name", "NEEDLE")])
    leaves = hits._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "FileScan" in leaves.apply(i).toString() or "Scan parquet" in leaves.apply(i).nodeName()]
    assert len(scans) == 1 and scans[0].selectedPartitions().totalNumberOfFiles() <= 2  # a block lies in two sorted files at most
    assert [r.track_id for r in hits.collect()] == ["id0130"]


def test_no_rows(spark, tmp_path):
    index = TI.build(spark.createDataFrame([("x", "red", None)], SCHEMA).filter("track_id = 'y'"), {"track_name": F.col("track_name")}, str(tmp_path / "i"))
    assert index.postings.count() == index.rows.count() == 0
    assert TI.contains_any(index, [("track_name", "red")]).count() == TI.contains_any(index, [("track_name", "r")]).count() == 0


def test_lists_of_a_run_hold_the_rarer_side():
    texts = ["abcabc", "xabc", "", "ab", "中文字中文字", "abcabc", "zabcz"]
    names, lacks, places = TI._lists(pa.array(texts))
    want = {g: {i for i, t in enumerate(texts) if g in t} for t in texts for g in (t[k:k + 3] for k in range(len(t) - 2))}
    assert len(names) == len(set(names)) and set(names) == set(want)
    for g, less, own in zip(names, lacks, places):
        at = np.frombuffer(own, np.uint16).tolist()
        assert at == sorted(set(range(len(texts))) - want[g] if less else want[g]) and len(at) <= len(texts) // 2
    assert dict(zip(names, lacks))["abc"] and TI._lists(pa.array(["", "ab"])) == ([], [], [])


def test_rows_are_not_exchanged_by_trigram(spark, tmp_path, monkeypatch):
    """A posting is one list of a run of rows, whatever cuts the runs; a search over many runs equals a scan."""
    monkeypatch.setattr(TI, "RUN_ROWS", 50)
    rows = [(f"id{i:04d}", f"common words {'needle' if i % 90 == 0 else 'hay'} {i}", "") for i in range(640)]
    index = TI.build(spark.createDataFrame(rows, SCHEMA).repartition(3), {"track_name": F.col("track_name")}, str(tmp_path / "i"), block_rows=256)
    lists = index.postings.filter("gram = 'com'").collect()
    assert sum(r.n for r in lists) == 640 and all(r.lacks and not r.places and r.n <= 50 for r in lists)
    assert len(lists) == index.postings.select("block", "first").distinct().count()
    for q in ("needle", "words hay 1", "common", "needle 63"):
        assert sorted(r.track_id for r in TI.contains_any(index, [("track_name", q)]).collect()) == [r[0] for r in rows if q in r[1]], q


def test_sketches_merge_and_a_part_is_replaced(spark, tmp_path):
    def part(lo, hi):
        return spark.range(lo, hi).select(F.concat(F.lit("t"), "id").alias("track_id"), F.concat(F.lit("a"), F.col("id") % 3000).alias("artist_name"),
                                          F.concat(F.lit("g"), F.col("id") % 70, F.lit(", Rock")).alias("artist_genres"), (F.col("id") % 50 + 1950).cast("int").alias("release_year"))
    path = str(tmp_path / "s")
    for name, (lo, hi) in {"1": (0, 20_000), "2": (10_000, 40_000), "3": (0, 5)}.items():
        SK.store_part(part(lo, hi), name, path)
    SK.store_part(part(0, 20_000), "1", path)  # the same part again
    SK.store_part(part(0, 0), "4", path)
    got = SK.merged(spark, path).first()
    assert got.rows == 50_005 and (got.min_year, got.max_year) == (1950, 1999)
    for name, exact in (("songs", 40_000), ("artists", 3000), ("genre_tokens", 71)):
        assert abs(got[name] - exact) <= 0.033 * exact
    assert abs(got.duplicates - 10_005) <= 0.033 * 40_000


def test_blank_texts_count_as_values(spark, tmp_path):
    part = spark.createDataFrame([("t1", "", "", 0), ("t2", "a", "x", 0), ("t3", None, "x", 1999)], "track_id string, artist_name string, artist_genres string, release_year int")
    SK.store_part(part, "1", str(tmp_path / "s"))
    got = SK.merged(spark, str(tmp_path / "s")).first()
    assert (got.rows, got.duplicates, got.songs, got.artists, got.genre_tokens, got.min_year) == (3, 0, 3, 2, 1, 1999)
