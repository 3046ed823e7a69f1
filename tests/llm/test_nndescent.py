import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tunesift.llm import nndescent as D


def brute(rows, threshold=0.93):
    """rows: [(id, vector or None, label)] -> {row number: (n_links, component_id)}."""
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = near[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    label = np.arange(n)
    linked = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        if (new == label).all():
            break
        label = new
    out = {}
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out[i] = (int(near[i].sum()), min(ids) if ids else None)
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: r for r in D.op5_embedding_nn_descent(spark, SF_SMALL).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {rows[i][0]: v for i, v in want.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_on_a_whole_table_at_a_lower_threshold(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {rows[i][0]: v[0] for i, v in brute(rows, 0.3).items()}
    found = D.near_duplicates(df, threshold=0.3)
    got = {r.vec_id: r.n_links for r in found.rows.collect()}
    assert sum(want.values()) > 50 and all(got[i] <= want[i] for i in want)  # nothing under the threshold is linked
    assert sum(got.values()) >= 0.95 * sum(want.values()) and found.recall >= 0.95


def test_rounds_reach_what_the_seeds_miss(spark, monkeypatch):
    """With one poor projection order the audited search still finds the links."""
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(900, 24))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(10_000 + i, (base[i] + rnd.normal(size=24) * 0.08).tolist(), "x") for i in range(100)]
    monkeypatch.setattr(D, "BLOCK", 24)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = D.near_duplicates(df, tables=2)
    got = {r.vec_id: r for r in found.rows.collect()}
    assert found.recall >= 0.9
    assert sum(got[10_000 + i].component_id == i for i in range(100)) >= 90


def test_dense_groups_are_counted_whole(spark, monkeypatch):
    """A group far larger than the lists (and than a block) keeps exact link counts."""
    monkeypatch.setattr(D, "BLOCK", 64)
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=16)
    rows = [(i, (centre + rnd.normal(size=16) * 0.05).tolist(), 1) for i in range(300)] + [(1000 + i, centre.tolist(), 1) for i in range(40)]
    rows += [(2000 + i, rnd.normal(size=16).tolist(), 1) for i in range(100)]
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    got = {r.vec_id: r for r in D.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).rows.collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want


def test_the_audit_sees_lost_pairs_beside_a_dense_group(spark, monkeypatch):
    """Links of an exactly counted group don't hide that all pairs are lost, however small the first sample."""
    nodes = spark.createDataFrame([(i, "x", [1.0, i / 1e4], 1) for i in range(300)] + [
        (1000 + i, f"y{i // 2}", [1.0, i % 2 / 10], 1) for i in range(400)], "node long, label string, e array<double>, copies long")
    dense = nodes.filter("node < 300").select("node", D.F.lit(299).cast("long").alias("n"))
    assert D._audit(nodes, dense, dense.select("node"), 0.93, 40)[0] == 0.0
    pairs = nodes.filter("node >= 1000").select("node", D.F.lit(1).cast("long").alias("n"))
    assert D._audit(nodes, dense.union(pairs), dense.select("node"), 0.93, 40)[0] == 1.0
    assert D._audit(nodes, dense.union(pairs.filter("node < 1200")), dense.select("node"), 0.93, 400)[0] == 0.5


def test_labels_under_the_target_are_compared_exactly(spark, monkeypatch):
    """Where the search finds next to nothing, counts and components are still exact."""
    monkeypatch.setattr(D, "ATTEMPTS", 1)
    monkeypatch.setattr(D, "BLOCK", 2)
    monkeypatch.setattr(D, "ROUNDS", 0)
    monkeypatch.setattr(D, "EXACT_BLOCK", 64)
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(200, 16))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(1000 * c + i, (base[i] + rnd.normal(size=16) * 0.15).tolist(), "x") for c in range(1, 4) for i in range(60)]
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    found = D.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), tables=1)
    assert found.recall < D.TARGET and found.compared == (("x", 16),)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.rows.collect()} == want


def test_a_hubs_far_followers_meet():
    import pyarrow as pa
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(40, 8))
    v[39] = v[38] + 1e-3
    q = D.quantised(v)
    b = pa.RecordBatch.from_arrays([pa.array([0] * 40), pa.array(range(40)), pa.array([-2.0] * 40, pa.float32()), pa.array([True] * 40),
                                    pa.array([x.tobytes() for x in q], pa.binary())], names=["pivot", "member", "worst", "fresh", "q"])
    pairs = {(r["node"], r["other"]) for out in D._local_join(3)([b]) for r in out.to_pylist()}
    assert {i for p in pairs for i in p} == set(range(40)) and (38, 39) in pairs


def test_links_of_long_vectors_with_a_dominant_component(spark):
    """Byte quantisation takes far more than 0.02 from these cosines."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(40):
        tail, near = rnd.uniform(0.505, 0.55, (2, 1000)) * rnd.choice([-1, 1], (2, 1000)) / 127
        rows += [(2 * i, [1.0, *tail.tolist()], f"x{i}"), (2 * i + 1, [1.0, *near.tolist()], f"x{i}")]
    v = np.array([r[1] for r in rows])
    q, u = D.quantised(v).astype(float), v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = (u[0::2] * u[1::2]).sum(axis=1)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    threshold = float(exact.min()) - 1e-6
    assert ((q[0::2] * q[1::2]).sum(axis=1) < threshold - 0.02).any()
    got = {r.vec_id: r.n_links for r in D.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), threshold=threshold, target=0).rows.collect()}
    assert got == {i: 1 for i in range(80)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
            (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.9, 0.1], 1),
            (None, [1.0, 0.0], 1), (None, [0.0, 5.0], 1), (14, [-1.0, 0.0], 1), (14, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node long, root string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in D.near_duplicates(df).rows.collect()), key=str)
    assert got == sorted(((rows[i][0], *v) for i, v in brute(rows).items()), key=str)
    none = D.near_duplicates(df.limit(0))
    assert none.rows.count() == 0 and none.recall == 1.0


@pytest.mark.parametrize("n", [2, 5, 40])
def test_best_entries_of_each_row(n):
    x = np.random.default_rng(n).normal(size=(n, n))
    i, j = D._best(x, 3)
    for r in range(n):
        off = [c for c in range(n) if c != r]
        assert sorted(j[i == r]) == sorted(sorted(off, key=lambda c: -x[r, c])[:3])
