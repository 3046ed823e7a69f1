"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, frame_digest

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(ORACLES[name]).df()
    sc, srows, sh = frame_digest(sdf)
    dc, drows, dh = frame_digest(ddf)
    assert sc == dc
    assert len(srows) == len(drows)
    assert sh == dh, (set(srows) - set(drows), set(drows) - set(srows))


#: Results of fits, beyond SQL; tests of the operators compare them with exact versions.
BEYOND_SQL = {"e13_knn_neighbours", "f1_kmeans_centres", "f4_silhouette_fitted", "f13_coordinates", "f6_artist_predictions", "f9_genre_report",
              "h17_fitted_profile", "h18_fitted_top_genres", "h19_fitted_top_artists", "h20_fitted_year_histogram"}


def test_every_query_of_the_library_itself_has_an_oracle():
    # the training-data operators are compared with brute force in tests/llm
    from tunesift.plans.registry import QUERIES as OWN
    assert OWN and not [n for n in OWN if n not in ORACLES and n not in BEYOND_SQL]


@pytest.mark.parametrize("name", sorted(BEYOND_SQL & set(QUERIES)))
def test_query_beyond_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["seed_id", "rank", "score"]
    assert 0 < df.count() <= 10


def test_part_files_are_made_once_and_each_sketch_reads_its_own(spark, monkeypatch):
    """h1_h9_part_sketches: no part's state and no total joins the source tables again."""
    from tunesift.operators import sketches as SK
    from tunesift.plans import q_profile as QP
    read, stored = [], SK.store_part

    def spied(part, name, path, *args):
        read.append(part.inputFiles())
        return stored(part, name, path, *args)
    monkeypatch.setattr(SK, "store_part", spied)
    out = QP.h1_h9_part_sketches(spark, SF_SMALL)
    assert len(read) > 1 and all("part_sketches" in f for files in read for f in files)
    assert not any("lineitem" in f for f in out.inputFiles())
    assert len(out.collect()) == 7
