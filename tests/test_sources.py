"""Source edge cases: CSV columns by header name, entity references."""

import uuid

import pytest

from tunesift.operators import ingest as IG
from tunesift.session import ensure_checkpoint_dir, scratch_path
from tunesift.sources import sinks
from tunesift.sources.tables import read_catalog


def test_read_catalog_maps_header_names_and_adds_missing(spark):
    path = scratch_path(spark, f"test_csv/{uuid.uuid4().hex}")
    df = spark.createDataFrame([(" Song ", "x1", "2019", "1")], "track_name string, track_id string, release_date string, explicit string")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = read_catalog(spark, path).first()
    assert out["track_id"] == "x1" and out["track_name"] == " Song " and out["release_date"] == "2019"
    assert out["artist_name"] is None and out["album_name"] is None


def test_read_catalog_reads_files_of_different_headers_by_name(spark):
    path = scratch_path(spark, f"test_csv/{uuid.uuid4().hex}")
    one = spark.createDataFrame([("A", "1", "line one\nline two")], "track_id string, popularity string, track_name string")
    two = spark.createDataFrame([('say "hi", she said', "2001", "C", "1")], "track_name string, release_date string, track_id string, explicit string")
    three = spark.createDataFrame([("D", 'quote " and, comma', " x ")], "track_id string, track_name string, artist_name string")
    for i, df in enumerate((one, two, three)):
        sinks.write_csv(df, f"{path}/{i}")
    got = {r["track_id"]: r for r in read_catalog(spark, f"{path}/*/*.csv").collect()}
    assert sorted(got) == ["A", "C", "D"]
    assert (got["A"]["popularity"], got["A"]["track_name"], got["A"]["release_date"]) == ("1", "line one\nline two", None)
    assert got["C"]["track_name"] == 'say "hi", she said'
    assert (got["C"]["release_date"], got["C"]["explicit"], got["C"]["popularity"]) == ("2001", "1", None)
    assert (got["D"]["track_name"], got["D"]["artist_name"]) == ('quote " and, comma', " x ")


def test_registry_keeps_old_entries_and_raises_on_a_damaged_file(spark):
    path = scratch_path(spark, f"test_registry/{uuid.uuid4().hex}")
    entry = lambda n, p: spark.createDataFrame([(n, p, "t", "{}")], sinks.REGISTRY_SCHEMA)
    assert sinks.registry_upsert(spark, f"{path}/none", entry("a", "p1")).count() == 1
    entry("a", "p1").union(entry("b", "p2")).write.parquet(f"{path}/v1")
    merged = {r["name"]: r["path"] for r in sinks.registry_upsert(spark, f"{path}/v1", entry("a", "p3")).collect()}
    assert merged == {"a": "p3", "b": "p2"}
    spark.range(1).selectExpr("'not parquet' AS value").write.text(f"{path}/bad")
    with pytest.raises(Exception):
        sinks.registry_upsert(spark, f"{path}/bad", entry("c", "p")).collect()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_parse_entity_ref_kinds(spark):
    refs = spark.createDataFrame([
        (1, "https://example.org/artist/" + "A" * 22),
        (2, "b" * 22),
        (3, "https://example.org/playlist/" + "C" * 22 + "?si=1"),
        (4, "Some Name"),
        (5, "ex:artist:" + "D" * 22),          # colon form does not match the URL pattern
    ], "pos int, ref string")
    out = {r["pos"]: (r["kind"], r["ref_id"]) for r in IG.parse_entity_ref(refs).collect()}
    assert out[1] == ("artist", "A" * 22)
    assert out[2] == ("id", "b" * 22)
    assert out[3] == ("playlist", "C" * 22)
    assert out[4] == ("name", None)
    assert out[5] == ("name", None)


def test_strip_note(spark):
    df = spark.createDataFrame([("  Artist Name   # added later ",), ("#hashtag",)], "ref string")
    out = [r[0] for r in df.select(IG.strip_note(df.ref)).collect()]
    assert out == ["Artist Name", "#hashtag"]
