"""Filter and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunesift.functions import text
from tunesift.operators import search as S
from tunesift.operators import text_index as TI
from tunesift.plans.artifacts import stored_folder, stored_meta
from tunesift.plans.registry import register
from tunesift.plans.sqlfrag import META, with_

COLS = "track_id, track_name, artist_name, artist_genres, release_year, explicit"
_COLS = [c.strip() for c in COLS.split(",")]
GENRES = ["economy", "brand#1"]
QUERY = "red"


def _meta(spark, sf):
    return stored_meta(spark, sf).select(*_COLS)


def text_index(spark, sf):
    """The catalogue's trigram index (titles, genres, display labels), written once."""
    fields = {"track_name": F.col("track_name"), "artist_genres": F.col("artist_genres"), "label": text.display_label()}
    path = stored_folder(spark, "text_index", (sf,), lambda path: TI.build(_meta(spark, sf), fields, path))
    return TI.TextIndex(spark, _meta(spark, sf).schema, path, fields)


@register("c1_filter_year", with_(META) + f" SELECT {COLS} FROM meta WHERE release_year BETWEEN 1994 AND 1996")
def c1_filter_year(spark, sf):
    return S.filter_year(_meta(spark, sf), 1994, 1996)


@register("c2_filter_explicit", with_(META) + f" SELECT {COLS} FROM meta WHERE explicit = 1")
def c2_filter_explicit(spark, sf):
    return S.filter_explicit(_meta(spark, sf), 1)


@register("c3_filter_genres_any", with_(META) + f"""
 SELECT {COLS} FROM meta WHERE contains(lower(artist_genres), 'economy') OR contains(lower(artist_genres), 'brand#1')""")
def c3_filter_genres_any(spark, sf):
    return S.filter_genres_any(_meta(spark, sf), GENRES)


@register("c3_genres_any_indexed", with_(META) + f"""
 SELECT {COLS} FROM meta WHERE contains(lower(artist_genres), 'economy') OR contains(lower(artist_genres), 'brand#1')""")
def c3_genres_any_indexed(spark, sf):
    return TI.contains_any(text_index(spark, sf), [("artist_genres", g) for g in GENRES]).select(*_COLS)


@register("c4_contains_text", with_(META) + f" SELECT {COLS} FROM meta WHERE contains(lower(track_name), 'red')")
def c4_contains_text(spark, sf):
    """Through the trigram index: the postings of 'red', then its rows."""
    return TI.contains_any(text_index(spark, sf), [("track_name", "  Red ")]).select(*_COLS)


@register("c5_search", with_(META) + f"""
 SELECT {COLS} FROM meta
 WHERE contains(lower(concat(track_name, ' — ', artist_name)), 'red') OR contains(lower(artist_genres), 'red')
 ORDER BY track_id LIMIT 100""")
def c5_search(spark, sf):
    """Through the trigram index, of display labels and of genres."""
    return S.head_n(TI.contains_any(text_index(spark, sf), [("label", QUERY), ("artist_genres", QUERY)]).select(*_COLS), 100)


@register("c5_search_scan", with_(META) + f"""
 SELECT {COLS} FROM meta
 WHERE contains(lower(concat(track_name, ' — ', artist_name)), 'x') OR contains(lower(artist_genres), 'x')
 ORDER BY track_id LIMIT 100""")
def c5_search_scan(spark, sf):
    """A query too short for the index scans the catalogue."""
    return S.search(_meta(spark, sf), "x", 100)


@register("c6_search_ranked", with_(META) + f""",
 h AS (SELECT {COLS}, lower(concat(track_name, ' — ', artist_name)) AS d FROM meta
       WHERE contains(lower(concat(track_name, ' — ', artist_name)), 'red') OR contains(lower(artist_genres), 'red'))
 SELECT {COLS}, round(1.0 - levenshtein(replace(d, '—', '~'), 'red') / greatest(length(d), 3, 1), 4) AS similarity
 FROM h ORDER BY similarity DESC, track_id LIMIT 100""")
def c6_search_ranked(spark, sf):
    return S.search_ranked(_meta(spark, sf), QUERY, 100)


@register("c7_catalog_view", with_(META) + f"""
 SELECT {COLS} FROM meta WHERE release_year BETWEEN 1993 AND 1997 AND explicit = 0
   AND (contains(lower(artist_genres), 'economy') OR contains(lower(artist_genres), 'brand#1'))""")
def c7_catalog_view(spark, sf):
    return S.catalog_view(_meta(spark, sf), 1993, 1997, 0, GENRES)


@register("c8_head_n", with_(META) + f" SELECT {COLS} FROM meta ORDER BY track_id LIMIT 20")
def c8_head_n(spark, sf):
    return S.head_n(_meta(spark, sf), 20)
