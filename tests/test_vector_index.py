"""Exact and inverted-file search over dense vectors."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tunesift.operators import similarity as SIM
from tunesift.operators import vector_index as IVF
from tunesift.sources.tables import table


def brute(items, seeds, k):
    """{seed: ids by (rounded score, id)} of (id, vector) lists."""
    def unit(v):
        v = np.array(v, float)
        return v / np.linalg.norm(v)
    out = {}
    for s, q in seeds:
        scored = [(-np.floor(unit(q) @ unit(v) * 1e4 + 0.5), str(i)) for i, v in items if str(i) != str(s)]
        out[str(s)] = [i for _, i in sorted(scored)[:k]]
    return out


def by_seed(df):
    out = {}
    for r in df.orderBy("seed_id", "rank").collect():
        out.setdefault(r.seed_id, []).append(r.vec_id)
    return out


def test_exact_search_equals_brute_force(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in emb.collect()]
    picked = [r for r in rows if r[0] % 20 == 0]
    want = brute(rows, picked, 10)
    assert by_seed(SIM.knn_dense(spark, emb, emb.filter("vec_id % 20 = 0"), 10)) == want
    assert by_seed(SIM.knn_dense(spark, emb, emb.filter("vec_id % 20 = 0"), 10, per_group=(3, 1000))) == want


ODD = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5]), (8, []),
       (9, [1.0, 1.0]), (10, [1.0, 1.0]), (11, [-1.0, 0.2])]
SCHEMA = "vec_id long, embedding array<double>"


def test_odd_vectors_are_left_out(spark, tmp_path):
    items = spark.createDataFrame(ODD, SCHEMA)
    real = [r for r in ODD if r[0] in (1, 9, 10, 11)]
    want = brute(real, real, 3)
    assert by_seed(SIM.knn_dense(spark, items, items, 3)) == want
    index = IVF.build(items, str(tmp_path / "i"), 3)
    assert by_seed(IVF.search(index, items, str(tmp_path / "s"), 3).neighbours) == want  # all there are
    none = spark.createDataFrame([], SCHEMA)
    assert IVF.search(IVF.build(none, str(tmp_path / "n"), 3), items, str(tmp_path / "t"), 3).neighbours.count() == 0
    assert IVF.search(index, none, str(tmp_path / "u"), 3).neighbours.count() == 0
    assert SIM.knn_dense(spark, items, none, 3).count() == 0


@pytest.mark.parametrize("spread,most_probed", [(0.3, 0.25), (5.0, 1.0)])
def test_recall_and_pairs_compared(spark, tmp_path, spread, most_probed):
    """Grouped vectors are probed narrowly, and either kind is found; hot cells and seeds are several rows."""
    rnd = np.random.default_rng(4)
    v = np.repeat(rnd.normal(size=(40, 16)), 50, axis=0) + spread * rnd.normal(size=(2000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    items = spark.createDataFrame(rows, SCHEMA)
    seeds = items.filter("vec_id % 20 = 0")
    index = IVF.build(items, str(tmp_path / "i"), 10, block=16)
    found = IVF.search(index, seeds, str(tmp_path / "s"), 10, chunk=7)
    got, want = by_seed(found.neighbours), brute(rows, rows[::20], 10)
    assert all(len(x) == 10 for x in got.values()) and len(got) == 100
    assert sum(len(set(got[s]) & set(want[s])) for s in want) >= 0.95 * 1000
    assert found.candidates.count() <= 100 * IVF.REFINE < 0.05 * 100 * 2000
    assert found.probes.agg({"probed": "avg"}).first()[0] <= most_probed * 2000
    sizes = spark.read.parquet(f"{index.path}/lists").selectExpr("size(ids) as n").toPandas().n
    assert sizes.sum() == 2000 and sizes.max() < 64


def test_few_probes_go_on_until_enough_items(spark, tmp_path):
    rows = [(i, [float(i == j) + 0.01 * i for j in range(8)]) for i in range(8)] * 1
    items = spark.createDataFrame(rows, SCHEMA)
    index = IVF.build(items, str(tmp_path / "i"), 1, target=0.01)
    got = by_seed(IVF.search(index, items, str(tmp_path / "s"), 5, refine=5).neighbours)
    assert all(len(x) == 5 for x in got.values()) and len(got) == 8


def test_codes_keep_differences_within_a_level():
    rnd = np.random.default_rng(1)
    for dims in (1, 7, 64):
        centres, v = rnd.normal(size=(3, dims)), rnd.normal(size=(50, dims))
        cell = rnd.integers(0, 3, 50)
        rest = v - centres[cell]
        low, step = rest.min(0), np.maximum(rest.max(0) - rest.min(0), 1e-9) / IVF.LEVELS
        codes = IVF.encode(v, cell, centres, low, step)
        assert codes.shape == (50, dims)
        assert (np.abs(IVF.decode(codes, low, step) - rest) <= step / 2 + 1e-9).all()
