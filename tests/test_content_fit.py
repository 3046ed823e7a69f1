"""The content fit makes a document's vector in one place: nothing but terms and texts is exchanged."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tunesift.config import BlockSpec, FeatureConfig
from tunesift.operators import features as FE
from tunesift.plans.artifacts import stored_meta

ROWS = [("a", "Red Hot", "Jo Lee", "rock, pop", 1990, 1), ("a", "Hot Wax", "Jo", "pop", 1994, 0), (None, "red hot sun", "Lee", "", 2000, 0),
        ("b", "red hot red hot", "Jo Lee", "Pop;Rock", 1990, 0), ("c", "", "", "", 2001, 1)]
COLS = "track_id string, track_name string, artist_name string, artist_genres string, release_year int, explicit int"


def config(bound):
    return FeatureConfig(blocks=(BlockSpec("g", "artist_genres", (1, 2), 1, 1.0, bound, "genre"), BlockSpec("a", "artist_name", (1, 1), 1, 1.0, bound),
                                 BlockSpec("t", "track_name", (2, 3), 1, 1.0, bound)))


def expected(rows):
    """{(id, key): value} of the long table, by hand (an id's second numbers under the keys with a star)."""
    docs = {}
    for i, name, artist, genres, *_ in rows:
        own = docs.setdefault(i, {"g": Counter(), "a": Counter(), "t": Counter()})
        for b, words, lo, hi in (("g", genres.lower().replace(";", ",").replace(",", " ").split(), 1, 2), ("a", artist.lower().split(), 1, 1), ("t", name.lower().split(), 2, 3)):
            own[b].update(" ".join(words[k:k + n]) for n in range(lo, hi + 1) for k in range(len(words) - n + 1))
    df = Counter((b, t) for own in docs.values() for b, terms in own.items() for t in terms)
    out = {}
    for i, own in docs.items():
        for b, weight in (("g", 1.0), ("a", 1.0), ("t", 0.2)):
            w = {t: c * (math.log((1 + len(rows)) / (1 + df[b, t])) + 1) for t, c in own[b].items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            out.update({(i, f"{b}:{t}"): weight * x / norm for t, x in w.items()})
    for key, place in (("n:year", 4), ("n:explicit", 5)):
        values = [r[place] for r in rows]
        mean = sum(values) / len(values)
        std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) or 1.0
        for r in rows:
            star = key if (r[0], key) not in out else key + "*"
            out[r[0], star] = 0.6 * (r[place] - mean) / std
    for i in docs:
        norm = math.sqrt(sum(v * v for (j, _), v in out.items() if j == i))
        out.update({k: v / norm for k, v in out.items() if k[0] == i})
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.track_id, r.key), []).append(r.value)
    return out


def same(got, want):
    wanted = {}
    for (i, key), v in want.items():
        wanted.setdefault((i, key.rstrip("*")), []).append(v)
    assert got.keys() == wanted.keys()
    assert all(sorted(got[k]) == pytest.approx(sorted(wanted[k]), abs=1e-12) for k in wanted)


@pytest.mark.parametrize("bound", [100, None])
def test_long_table_by_hand_with_repeated_and_null_ids(spark, bound):
    m = FE.fit_content(spark.createDataFrame(ROWS, COLS).repartition(3), config(bound))
    same(found(m.normalized_long()), expected(ROWS))
    rows = m.index_rows().collect()
    assert sorted((r.track_id or "", len(r["keys"])) for r in rows) == sorted(Counter(i or "" for i, _ in [k for k in expected(ROWS)]).items())
    assert sorted(x for r in m.blocks().collect() for x in (i or "" for i in r.ids)) == ["", "a", "b", "c"]


@pytest.mark.parametrize("bound", [100, None])
def test_unique_ids_give_the_same(spark, bound):
    once = ROWS[1:]
    m = FE.fit_content(spark.createDataFrame(once, COLS).repartition(2), config(bound), unique=True)
    same(found(m.normalized_long()), expected(once))
    assert {(r.track_id, r.block, r.term) for r in m.weights.collect()} == {(i, *k.split(":")) for i, k in expected(once) if k[0] != "n"}
    assert sorted(x for r in m.blocks().collect() for x in (i or "" for i in r.ids)) == ["", "a", "b", "c"]


def test_vectors_are_neither_exchanged_nor_sorted(spark):
    m = FE.fit_content(stored_meta(spark, SF_SMALL), unique=True)
    for df in (m.weights, m.normalized_long(), m.raw_long(), m.index_rows()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Sort" not in plan and "Window" not in plan
    plan = m.blocks()._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan[:plan.index("RepartitionByExpression")]  # kept: blocks hold items that are alike
    before = m.blocks()._jdf.queryExecution().optimizedPlan().toString()
    under = before[before.index("RepartitionByExpression"):]
    assert "MapInArrow" not in under  # texts go through the exchange, vectors are made behind it
    assert m.blocks().select(F.explode("ids")).count() == stored_meta(spark, SF_SMALL).count()
