"""Ingest operators (A3-A15): seed references to artists, artists to tracks,
nested payloads to flat rows, and part-wise appends.  The reference calls a
web service one entity at a time; here the fetched tables are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tunesift.functions import text
from tunesift.operators.clean import dedupe_keep_first

# ---------------------------------------------------------------------------
# Entity reference patterns (URL path kind + 22-char base62 id)
# ---------------------------------------------------------------------------
REF_URL = r"(artist|playlist|track)/([A-Za-z0-9]{22})"
BARE_ID = r"^[A-Za-z0-9]{22}$"
NOTE = r"\s+#.*$"


def strip_note(c) -> F.Column:
    """Q19: drop a trailing ' # note' and surrounding whitespace."""
    return text.strip_ws(F.regexp_replace(text.strip_ws(c), NOTE, ""))


def parse_entity_ref(df: DataFrame, col: str = "ref") -> DataFrame:
    """A3: adds (kind, ref_id, ref_name): URL -> its kind and id, a bare
    22-character id -> kind 'id', anything else -> kind 'name'."""
    s = text.strip_ws(F.col(col))
    url_kind = F.regexp_extract(s, REF_URL, 1)
    kind = (F.when(url_kind != "", url_kind).when(s.rlike(BARE_ID), F.lit("id")).otherwise(F.lit("name")))
    rid = (F.when(url_kind != "", F.regexp_extract(s, REF_URL, 2)).when(s.rlike(BARE_ID), s))
    return df.withColumns({"kind": kind, "ref_id": rid,
                           "ref_name": F.when(kind == "name", s)})


def ordered_distinct(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """A5: one row per key at its first position (a partial min per key)."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def resolve_entities(refs: DataFrame, artists: DataFrame, ext_id: F.Column, pos: str = "pos") -> DataFrame:
    """A4: (pos, artist_ext_id) in first-occurrence order.

    Artist URLs and bare ids resolve to themselves; names resolve through an
    equi join on ``lower(trim(name))`` with the artist dimension (first hit =
    smallest artist id); playlists, tracks and unknown names are dropped."""
    p = parse_entity_ref(refs.withColumn("ref", strip_note(F.col("ref"))))
    # first hit per name = smallest artist id: a partial min per name key
    by_name = (artists.select(F.lower(text.strip_ws("name")).alias("_nk"), F.struct("artist_id", ext_id.alias("_ext")).alias("_a"))
               .groupBy("_nk").agg(F.min("_a").alias("_a")).select("_nk", "_a._ext"))
    j = p.join(by_name, F.lower(p["ref_name"]) == by_name["_nk"], "left")
    rid = (F.when(p["kind"].isin("artist", "id"), p["ref_id"])
            .when(p["kind"] == "name", F.col("_ext")))
    out = j.select(pos, rid.alias("artist_ext_id")).filter(F.col("artist_ext_id").isNotNull())
    return ordered_distinct(out, "artist_ext_id", pos)


def top_tracks_per_artist(track_artists: DataFrame, tracks: DataFrame, n: int = 10,
                          score: str = "popularity") -> DataFrame:
    """Top ``n`` tracks per artist by ``score`` desc, ``track_id`` asc.

    ``row_number() <= n`` is planned with a partial window group limit before
    the shuffle, so a huge artist sends at most ``n`` rows per task."""
    j = track_artists.join(tracks.select("track_id", score), "track_id")
    w = W.partitionBy("artist_id").orderBy(F.col(score).desc_nulls_last(), F.col("track_id"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(n))


def latest_albums_per_artist(albums: DataFrame, max_albums: int = 10) -> DataFrame:
    """Distinct albums per artist by release date desc (null as ''),
    album id asc; first ``max_albums`` (0 = all)."""
    d = albums.dropDuplicates(["artist_id", "album_id"])
    w = W.partitionBy("artist_id").orderBy(F.coalesce(F.col("release_date"), F.lit("")).desc(), F.col("album_id"))
    out = d.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= int(max_albums)) if max_albums else out


def album_tracks_of(albums: DataFrame, album_tracks: DataFrame) -> DataFrame:
    """The tracks of the selected albums, one row per (artist, track) at
    its first album (partial min per key)."""
    j = albums.join(album_tracks, "album_id")
    return (j.groupBy("artist_id", "track_id")
             .agg(F.min(F.struct(F.col("rank").alias("album_rank"), "album_id")).alias("_f"))
             .select("artist_id", "track_id", "_f.album_rank", "_f.album_id"))


def candidate_tracks(artist_order: DataFrame, top: DataFrame, album_trk: DataFrame | None) -> DataFrame:
    """Top tracks (then album tracks unless ``album_trk`` is None) per
    artist in artist order; per-artist and global first-occurrence dedupe.
    Output (track_id, artist_pos, src, src_rank)."""
    t = top.select("artist_id", "track_id", F.lit(0).alias("src"), F.col("rank").cast("long").alias("src_rank"))
    parts = t
    if album_trk is not None:
        a = album_trk.select("artist_id", "track_id", F.lit(1).alias("src"),
                             F.col("album_rank").cast("long").alias("src_rank"))
        parts = parts.unionByName(a)
    j = parts.join(artist_order.select("artist_id", F.col("pos").alias("artist_pos")), "artist_id")
    first = j.groupBy("track_id").agg(F.min(F.struct("artist_pos", "src", "src_rank")).alias("_f"))
    return first.select("track_id", "_f.artist_pos", "_f.src", "_f.src_rank")


def flatten_tracks(payload: DataFrame) -> DataFrame:
    """A10: nested track payload -> flat rows; null tracks or ids skipped;
    artist names joined with ', '; one row per id (first wins)."""
    t = payload.filter(F.col("track").isNotNull() & F.col("track.id").isNotNull())
    names = F.array_join(F.transform(F.filter("track.artists", lambda a: a["name"].isNotNull()),
                                     lambda a: a["name"]), ", ")
    flat = t.select(F.col("track.id").alias("track_id"), F.col("track.name").alias("track_name"),
                    names.alias("artist_name"), F.col("track.album.name").alias("album_name"),
                    F.col("track.album.release_date").alias("release_date"),
                    F.col("track.popularity").alias("popularity"), F.col("track.duration_ms").alias("duration_ms"),
                    F.col("track.explicit").alias("explicit"))
    return dedupe_keep_first(flat, "track_id", ["release_date", "track_name", "artist_name", "album_name"])


def attach_artist_genres(track_artist_ids: DataFrame, artists: DataFrame) -> DataFrame:
    """(track_id, artist_genres): union of all its artists' genres,
    sorted, joined with ', '.  A left equi join keeps tracks whose artists
    have no genres (empty string)."""
    j = track_artist_ids.join(artists.select("artist_id", "genres"), "artist_id", "left")
    g = j.select("track_id", F.explode_outer("genres").alias("g"))
    return g.groupBy("track_id").agg(
        F.array_join(F.array_sort(F.collect_set("g")), ", ").alias("artist_genres"))


def union_parts(master: DataFrame, part: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name, missing columns null."""
    return master.unionByName(part, allowMissingColumns=True)


def append_dedupe(frames: list[DataFrame], key: str = "track_id", order: list[str] | None = None) -> DataFrame:
    """A14 (batch): master then parts in order; per key the first source wins
    (then the B9 order inside a source)."""
    tagged = None
    for i, f in enumerate(frames):
        t = f.withColumn("_src", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    return dedupe_sources(tagged, "_src", key, order)


def dedupe_sources(tagged: DataFrame, source: str, key: str = "track_id", order: list[str] | None = None) -> DataFrame:
    """A14 on rows that carry their source's rank: one pass, without that column."""
    return dedupe_keep_first(tagged, key, [source] + list(order or [])).drop(source)


def skip_done_parts(parts: DataFrame, processed: DataFrame, key: str = "part") -> DataFrame:
    """Parts without an output yet (left anti join)."""
    return parts.join(processed.select(key), key, "left_anti")
