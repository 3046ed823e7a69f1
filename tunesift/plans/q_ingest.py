"""Ingest, source and sink queries (A1-A19 except A12)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tunesift.operators import ingest as IG
from tunesift.plans.registry import register
from tunesift.config import FeatureConfig
from tunesift.plans.sqlfrag import CATALOG, CATALOG_RAW, META, with_
from tunesift.plans.sqlfrag_features import content_ctes
from tunesift.session import scratch_path
from tunesift.sources import fixtures as fx
from tunesift.sources import sinks
from tunesift.sources.tables import read_catalog, read_seed_list, table

_STRIP = "'^\\s+|\\s+$'"
EXT = "substr(md5(CAST({c} AS VARCHAR)), 1, 22)"

ARTISTS_SQL = """ artists AS (SELECT s_suppkey AS artist_id, s_name AS name, string_split(n_name || ',' || r_name, ',') AS genres
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TRACK_ARTISTS_SQL = """ track_artists AS (SELECT DISTINCT track_id, artist_id FROM (
 SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS track_id, l_suppkey AS artist_id FROM lineitem
 UNION ALL SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS track_id, l_partkey % 7 AS artist_id FROM lineitem) u)"""
ALBUMS_SQL = """ albums AS (SELECT o_orderkey AS album_id, o_custkey % 10 AS artist_id, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS release_date FROM orders)"""
ALBUM_TRACKS_SQL = """ album_tracks AS (SELECT DISTINCT l_orderkey AS album_id, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS track_id FROM lineitem)"""
SEED_REFS_SQL = """ seed_refs AS (SELECT s_suppkey AS pos, CASE s_suppkey % 4
 WHEN 0 THEN concat('https://example.org/artist/', substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 22))
 WHEN 1 THEN substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 22)
 WHEN 2 THEN concat(' ', s_name, '  # note')
 ELSE concat('https://example.org/playlist/', substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 22)) END AS ref FROM supplier)"""


def _tag(sf: str) -> str:
    return hashlib.md5(sf.encode()).hexdigest()[:10]


# ---- A1 / A2: sources -----------------------------------------------------------

@register("a1_read_catalog", with_(CATALOG) + """
 SELECT track_id, track_name, artist_name, release_date, CAST(popularity AS VARCHAR) AS popularity,
   CAST(duration_ms AS VARCHAR) AS duration_ms, CAST(explicit AS VARCHAR) AS explicit, artist_genres FROM catalog""")
def a1_read_catalog(spark, sf):
    """Write the catalogue as header CSV (A16) and read it back with the declared schema (A1)."""
    path = scratch_path(spark, f"a1_catalog_csv/{_tag(sf)}")
    c = fx.catalog(spark, sf)
    sinks.write_csv(c.select([F.col(x).cast("string") for x in c.columns]), path)
    return read_catalog(spark, path).select("track_id", "track_name", "artist_name", "release_date", "popularity",
                                            "duration_ms", "explicit", "artist_genres")


@register("a2_read_seed_list", "WITH" + SEED_REFS_SQL + f"""
 SELECT r FROM (SELECT regexp_replace(regexp_replace(regexp_replace(ref, {_STRIP}, '', 'g'), '\\s+#.*$', '', 'g'), {_STRIP}, '', 'g') AS r
 FROM seed_refs) WHERE r <> ''""")
def a2_read_seed_list(spark, sf):
    """Write the seed references as four text files (with blank lines), read them with A2."""
    path = scratch_path(spark, f"a2_seed_lists/{_tag(sf)}")
    refs = fx.seed_refs(spark, sf)
    lines = refs.select((F.col("pos") % 4).alias("part"), "pos", "ref").unionByName(
        refs.select((F.col("pos") % 4).alias("part"), (F.col("pos") + F.lit(0.5)).cast("long").alias("pos"),
                    F.lit("   ").alias("ref")))
    lines.repartition(4, "part").sortWithinPartitions("pos").select("ref").write.mode("overwrite").text(path)
    return read_seed_list(spark, f"{path}/*.txt").select(F.col("ref").alias("r"))


# ---- A3-A5: references -------------------------------------------------------------

@register("a3_parse_entity_ref", "WITH" + SEED_REFS_SQL + f""",
 s AS (SELECT pos, regexp_replace(ref, {_STRIP}, '', 'g') AS s FROM seed_refs)
 SELECT pos, CASE WHEN regexp_extract(s, '{IG.REF_URL}', 1) <> ''
     THEN regexp_extract(s, '{IG.REF_URL}', 1)
   WHEN regexp_full_match(s, '[A-Za-z0-9]{{22}}') THEN 'id' ELSE 'name' END AS kind,
  CASE WHEN regexp_extract(s, '{IG.REF_URL}', 1) <> ''
     THEN regexp_extract(s, '{IG.REF_URL}', 2)
   WHEN regexp_full_match(s, '[A-Za-z0-9]{{22}}') THEN s END AS ref_id FROM s""")
def a3_parse_entity_ref(spark, sf):
    return IG.parse_entity_ref(fx.seed_refs(spark, sf)).select("pos", "kind", "ref_id")


RESOLVED_SQL = f""",
 s AS (SELECT pos, regexp_replace(regexp_replace(regexp_replace(ref, {_STRIP}, '', 'g'), '\\s+#.*$', '', 'g'), {_STRIP}, '', 'g') AS s FROM seed_refs),
 p AS (SELECT pos, s, regexp_extract(s, '{IG.REF_URL}', 1) AS uk,
         regexp_extract(s, '{IG.REF_URL}', 2) AS uid FROM s),
 bn AS (SELECT lower(regexp_replace(name, {_STRIP}, '', 'g')) AS nk, min(artist_id) AS artist_id FROM artists GROUP BY 1),
 r AS (SELECT p.pos, CASE WHEN uk = 'artist' THEN uid WHEN uk <> '' THEN NULL
          WHEN regexp_full_match(s, '[A-Za-z0-9]{{22}}') THEN s
          ELSE {EXT.format(c='bn.artist_id')} END AS artist_ext_id
       FROM p LEFT JOIN bn ON lower(p.s) = bn.nk),
 resolved AS (SELECT artist_ext_id, min(pos) AS pos FROM r WHERE artist_ext_id IS NOT NULL GROUP BY artist_ext_id)"""


@register("a4_resolve_entities", "WITH" + SEED_REFS_SQL + "," + ARTISTS_SQL + RESOLVED_SQL + " SELECT * FROM resolved")
def a4_resolve_entities(spark, sf):
    arts = fx.artists(spark, sf)
    return IG.resolve_entities(fx.seed_refs(spark, sf), arts, fx.external_artist_id())


@register("a5_ordered_distinct", "WITH" + TRACK_ARTISTS_SQL + """
 SELECT artist_id, min(track_id) AS pos FROM track_artists GROUP BY artist_id""")
def a5_ordered_distinct(spark, sf):
    ta = fx.track_artists(spark, sf)
    return IG.ordered_distinct(ta.select("artist_id", F.col("track_id").alias("pos")), "artist_id")


# ---- A6-A11: tracks ---------------------------------------------------------------

TOP_N = 10
MAX_ALBUMS = 10


@register("a6_top_tracks_per_artist", with_(CATALOG) + "," + TRACK_ARTISTS_SQL + f"""
 SELECT * FROM (SELECT ta.artist_id, ta.track_id, c.popularity,
   CAST(row_number() OVER (PARTITION BY ta.artist_id ORDER BY c.popularity DESC NULLS LAST, ta.track_id) AS INT) AS rank
   FROM track_artists ta JOIN catalog c USING (track_id)) WHERE rank <= {TOP_N}""")
def a6_top_tracks_per_artist(spark, sf):
    t = IG.top_tracks_per_artist(fx.track_artists(spark, sf), fx.catalog(spark, sf), TOP_N)
    return t.select("artist_id", "track_id", "popularity", F.col("rank").cast("int"))


@register("a7_latest_albums_per_artist", "WITH" + ALBUMS_SQL + f"""
 SELECT * FROM (SELECT artist_id, album_id, release_date,
   CAST(row_number() OVER (PARTITION BY artist_id ORDER BY coalesce(release_date, '') DESC, album_id) AS INT) AS rank
   FROM (SELECT DISTINCT * FROM albums)) WHERE rank <= {MAX_ALBUMS}""")
def a7_latest_albums_per_artist(spark, sf):
    a = IG.latest_albums_per_artist(fx.albums(spark, sf), MAX_ALBUMS)
    return a.select("artist_id", "album_id", "release_date", F.col("rank").cast("int"))


ALB_SEL_SQL = f""",
 alb AS (SELECT * FROM (SELECT artist_id, album_id, row_number() OVER (PARTITION BY artist_id ORDER BY coalesce(release_date, '') DESC, album_id) AS rank
   FROM (SELECT DISTINCT * FROM albums)) WHERE rank <= {MAX_ALBUMS}),
 atk AS (SELECT artist_id, track_id, min(rank) AS album_rank, arg_min(album_id, rank) AS album_id FROM alb JOIN album_tracks USING (album_id)
   GROUP BY artist_id, track_id)"""


@register("a8_album_tracks", "WITH" + ALBUMS_SQL + "," + ALBUM_TRACKS_SQL + ALB_SEL_SQL + """
 SELECT artist_id, track_id, CAST(album_rank AS INT) AS album_rank, album_id FROM atk""")
def a8_album_tracks(spark, sf):
    alb = IG.latest_albums_per_artist(fx.albums(spark, sf), MAX_ALBUMS)
    out = IG.album_tracks_of(alb, fx.album_tracks(spark, sf))
    return out.select("artist_id", "track_id", F.col("album_rank").cast("int"), "album_id")


def _artist_order(spark, sf):
    arts = fx.artists(spark, sf)
    res = IG.resolve_entities(fx.seed_refs(spark, sf), arts, fx.external_artist_id())
    return res.join(arts.select("artist_id", fx.external_artist_id().alias("artist_ext_id")), "artist_ext_id")


@register("a9_candidate_tracks", with_(CATALOG) + "," + SEED_REFS_SQL + "," + ARTISTS_SQL + "," + TRACK_ARTISTS_SQL +
          "," + ALBUMS_SQL + "," + ALBUM_TRACKS_SQL + RESOLVED_SQL + ALB_SEL_SQL + f""",
 ao AS (SELECT a.artist_id, r.pos FROM resolved r JOIN artists a ON {EXT.format(c='a.artist_id')} = r.artist_ext_id),
 top AS (SELECT * FROM (SELECT ta.artist_id, ta.track_id,
   row_number() OVER (PARTITION BY ta.artist_id ORDER BY c.popularity DESC NULLS LAST, ta.track_id) AS rank
   FROM track_artists ta JOIN catalog c USING (track_id)) WHERE rank <= {TOP_N}),
 parts AS (SELECT artist_id, track_id, 0 AS src, rank AS src_rank FROM top
   UNION ALL SELECT artist_id, track_id, 1, album_rank FROM atk),
 j AS (SELECT track_id, pos AS artist_pos, src, src_rank FROM parts JOIN ao USING (artist_id))
 SELECT track_id, CAST(arg_min(artist_pos, (artist_pos, src, src_rank)) AS BIGINT) AS artist_pos,
   CAST(arg_min(src, (artist_pos, src, src_rank)) AS INT) AS src, CAST(arg_min(src_rank, (artist_pos, src, src_rank)) AS BIGINT) AS src_rank
 FROM j GROUP BY track_id""")
def a9_candidate_tracks(spark, sf):
    order = _artist_order(spark, sf)
    top = IG.top_tracks_per_artist(fx.track_artists(spark, sf), fx.catalog(spark, sf), TOP_N)
    alb = IG.album_tracks_of(IG.latest_albums_per_artist(fx.albums(spark, sf), MAX_ALBUMS), fx.album_tracks(spark, sf))
    out = IG.candidate_tracks(order, top, alb)
    return out.select("track_id", F.col("artist_pos").cast("long"), F.col("src").cast("int"), F.col("src_rank").cast("long"))


def nested_payload(spark, sf):
    """Nested track payload built from the tables: track{id, name, popularity,
    duration_ms, explicit, artists[{id, name}], album{name, release_date}}."""
    raw = fx.catalog_raw(spark, sf)
    arts = fx.artists(spark, sf)
    ta = fx.track_artists(spark, sf).join(arts.select("artist_id", "name"), "artist_id", "left")
    alist = ta.groupBy("track_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("artist_id").alias("id"), "name"))).alias("artists"))
    t = raw.join(alist, "track_id", "left")
    return t.select(F.struct(
        F.col("track_id").alias("id"), F.col("track_name").alias("name"), "popularity", "duration_ms",
        (F.col("explicit") == 1).alias("explicit"), "artists",
        F.struct(F.concat(F.lit("Album "), F.split("track_id", "-").getItem(0)).alias("name"),
                 F.col("release_date")).alias("album")).alias("track"))


@register("a10_flatten_tracks", with_(CATALOG_RAW) + "," + ARTISTS_SQL + "," + TRACK_ARTISTS_SQL + """,
 al AS (SELECT ta.track_id, string_agg(a.name, ', ' ORDER BY ta.artist_id) AS artist_name
        FROM track_artists ta LEFT JOIN artists a USING (artist_id) GROUP BY ta.track_id),
 flat AS (SELECT r.track_id, r.track_name, coalesce(al.artist_name, '') AS artist_name,
   'Album ' || split_part(r.track_id, '-', 1) AS album_name, r.release_date, r.popularity, r.duration_ms, r.explicit = 1 AS explicit
   FROM catalog_raw r LEFT JOIN al USING (track_id))
 SELECT track_id, track_name, artist_name, album_name, release_date, popularity, duration_ms, explicit FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY release_date NULLS FIRST, track_name NULLS FIRST,
    artist_name NULLS FIRST, album_name NULLS FIRST, popularity NULLS FIRST, duration_ms NULLS FIRST, explicit NULLS FIRST) AS rn
  FROM flat) WHERE rn = 1""")
def a10_flatten_tracks(spark, sf):
    return IG.flatten_tracks(nested_payload(spark, sf))


@register("a11_attach_artist_genres", "WITH" + ARTISTS_SQL + "," + TRACK_ARTISTS_SQL + """
 SELECT track_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(genres)))), ', '), '') AS artist_genres
 FROM track_artists LEFT JOIN artists USING (artist_id) GROUP BY track_id""")
def a11_attach_artist_genres(spark, sf):
    return IG.attach_artist_genres(fx.track_artists(spark, sf), fx.artists(spark, sf))


# ---- A13-A15: parts ------------------------------------------------------------------

def parts(spark, sf):
    """catalog_raw split into parts by line number (part 1 is the master)."""
    return fx.catalog_raw(spark, sf).withColumn("part", F.split_part("track_id", F.lit("-"), F.lit(2)).cast("int"))


@register("a13_union_parts", with_(CATALOG_RAW) + """,
 pr AS (SELECT *, CAST(split_part(track_id, '-', 2) AS INT) AS part FROM catalog_raw)
 SELECT track_id, track_name, artist_name, artist_genres, release_date, explicit, popularity,
   CASE WHEN part = 1 THEN duration_ms END AS duration_ms FROM pr""")
def a13_union_parts(spark, sf):
    """The master and all later parts, whose files lack the duration."""
    p = parts(spark, sf)
    return IG.union_parts(p.filter(F.col("part") == 1).drop("part"), p.filter(F.col("part") != 1).drop("part", "duration_ms"))


APPEND_ORDER = ["release_date", "track_name", "artist_name", "artist_genres", "explicit", "popularity", "duration_ms"]
APPEND_SQL = with_(CATALOG_RAW) + """,
 pr AS (SELECT *, CAST(split_part(track_id, '-', 2) AS INT) AS part FROM catalog_raw)
 SELECT track_id, track_name, artist_name, artist_genres, release_date, explicit, popularity, duration_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY part, release_date NULLS FIRST, track_name NULLS FIRST,
    artist_name NULLS FIRST, artist_genres NULLS FIRST, explicit NULLS FIRST, popularity NULLS FIRST, duration_ms NULLS FIRST) AS rn
  FROM pr) WHERE rn = 1"""


@register("a14_append_dedupe", APPEND_SQL)
def a14_append_dedupe(spark, sf):
    """Whatever parts there are, in one pass: the part number is the source rank."""
    return IG.dedupe_sources(parts(spark, sf), "part", "track_id", APPEND_ORDER)


@register("a15_skip_done_parts", """
 SELECT DISTINCT 'artists_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS part FROM lineitem WHERE l_linenumber > 3""")
def a15_skip_done_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("artists_"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("part")
    all_parts = li.select(name).distinct()
    processed = li.filter(F.col("l_linenumber") <= 3).select(name).distinct()
    return IG.skip_done_parts(all_parts, processed)


# ---- A16-A19: sinks ------------------------------------------------------------------

@register("a16_write_csv", with_(CATALOG) + """
 SELECT track_id, track_name, artist_name, artist_genres, release_date, CAST(explicit AS VARCHAR) AS explicit,
   CAST(popularity AS VARCHAR) AS popularity, CAST(duration_ms AS VARCHAR) AS duration_ms FROM catalog""")
def a16_write_csv(spark, sf):
    """The whole catalogue through CSV and back, all columns."""
    path = scratch_path(spark, f"a16_csv/{_tag(sf)}")
    c = fx.catalog(spark, sf)
    c = c.select([F.col(x).cast("string") for x in c.columns])
    sinks.write_csv(c, path)
    return sinks.read_csv(spark, path, c.schema)


@register("a17_write_json_report", with_(CATALOG) + """
 SELECT coalesce(substr(release_date, 1, 4), 'none') AS year, CAST(count(*) AS BIGINT) AS n FROM catalog GROUP BY 1""")
def a17_write_json_report(spark, sf):
    path = scratch_path(spark, f"a17_json/{_tag(sf)}")
    rep = (fx.catalog(spark, sf).groupBy(F.coalesce(F.substring("release_date", 1, 4), F.lit("none")).alias("year"))
           .agg(F.count(F.lit(1)).alias("n")))
    sinks.write_json_report(rep, path)
    return spark.read.schema("year string, n long").json(path)


@register("a18_save_load_model", with_(META) + content_ctes(FeatureConfig()) + """
 SELECT track_id, key, round(value, 6) AS value FROM cv""")
def a18_save_load_model(spark, sf):
    """Fit, save, load and vectorise the catalogue again with the loaded model."""
    from tunesift.operators import features as FE
    path = scratch_path(spark, f"a18_model/{_tag(sf)}")
    meta = fx.meta(spark, sf)
    sinks.save_content_model(FE.fit_content(meta, unique=True), path)
    v = FE.transform_rows(sinks.load_content_model(spark, path), meta, unique=True)
    return v.select("track_id", "key", F.round("value", 6).alias("value"))


@register("a18_save_load_kmeans", with_(META) + " SELECT track_id, true AS same FROM meta")
def a18_save_load_kmeans(spark, sf):
    """The fitted K-Means, saved and loaded, assigns every track as before."""
    from tunesift.operators import sparse_kmeans as KM
    from tunesift.plans.q_models import _fit_kmeans
    _, keys, coded, centres = _fit_kmeans(spark, sf)
    path = scratch_path(spark, f"a18_kmeans/{_tag(sf)}")
    KM.save(spark, centres, keys, path)
    one = KM.assign(coded, centres, keep=("at", "vals")).withColumnRenamed("cluster", "before")
    two = KM.assign(one, KM.load(spark, keys, path), keep=("before",))  # of the same rows, side by side
    return two.filter(F.col("track_id").isNotNull()).select("track_id", (F.col("before") == F.col("cluster")).alias("same"))


@register("a18_save_load_forest", with_(META) + " SELECT track_id, true AS same FROM meta")
def a18_save_load_forest(spark, sf):
    """The fitted artist forest (label index and trees), saved and loaded,
    predicts the same artist and leaves for every track."""
    from tunesift.plans.q_models import _rf_artist
    _, _, raw, rf = _rf_artist(spark, sf)
    path = scratch_path(spark, f"a18_forest/{_tag(sf)}")
    rf.save(path)
    loaded = type(rf).load(spark, path)
    one = rf.transform(raw.select("track_id", "features")).withColumnsRenamed({"_pred": "_pred_before", "leaves": "leaves_before"})
    two = loaded.transform(one)  # of the same rows, side by side
    before, again = F.struct(F.col("_pred_before").alias("_pred"), F.col("leaves_before").alias("leaves")), F.struct("_pred", "leaves")
    return two.select("track_id", (before == again).alias("same"))


@register("a19_registry", with_(CATALOG) + """,
 per AS (SELECT explicit, count(*) AS n FROM catalog GROUP BY explicit)
 SELECT 'catalog' AS name, (SELECT count(*) FROM catalog) AS rows UNION ALL
 SELECT 'tracks_explicit_' || explicit, n FROM per UNION ALL
 SELECT 'tracks_by_year', count(DISTINCT coalesce(substr(release_date, 1, 4), 'none')) FROM catalog""")
def a19_registry(spark, sf):
    """Artefacts written from the catalogue enter a registry in two upserts
    (the second replaces one path and adds others); each registered path is
    then read again by name."""
    path = scratch_path(spark, f"a19_registry/{_tag(sf)}")
    c = fx.catalog(spark, sf)
    c.write.mode("overwrite").parquet(f"{path}/catalog")
    stored = spark.read.parquet(f"{path}/catalog")
    kinds = [r[0] for r in stored.select("explicit").distinct().orderBy("explicit").collect()]
    frames = {"catalog": stored, "tracks_by_year": stored.groupBy(F.coalesce(F.substring("release_date", 1, 4), F.lit("none")).alias("y")).count()}
    frames |= {f"tracks_explicit_{k}": stored.filter(F.col("explicit") == k) for k in kinds}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/artefacts/{name}")
    entry = lambda names, folder: spark.createDataFrame([(n, f"{path}/{folder}/{n}", sinks.now_iso(), "{}") for n in names], sinks.REGISTRY_SCHEMA)
    sinks.registry_upsert(spark, f"{path}/none", entry(["catalog", "tracks_by_year"], "stale")).write.mode("overwrite").parquet(f"{path}/v1")
    sinks.registry_upsert(spark, f"{path}/v1", entry(frames, "artefacts")).write.mode("overwrite").parquet(f"{path}/v2")
    out = None
    for r in sinks.registry_lookup(spark.read.parquet(f"{path}/v2")).collect():
        one = spark.read.parquet(r["path"]).agg(F.lit(r["name"]).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
