"""Property tests for the model operators."""

import re

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tunesift.operators import models as MD
from tunesift.operators import features as FE
from tunesift.sources import fixtures as fx
from tunesift.sources.tables import table


def test_content_vectors_are_unit_and_match_long_table(spark):
    meta = fx.meta(spark, SF_SMALL)
    m = FE.fit_content(meta)
    long_norm = m.normalized_long().groupBy("track_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n"))
    assert long_norm.filter(F.abs(F.col("n") - 1.0) > 1e-9).count() == 0
    vec = MD.content_vectors(m, meta)
    keys = MD.vector_keys(m)
    one = vec.orderBy("track_id").first()
    arr = one["features"].toArray()
    dense = {keys[i]: arr[i] for i in np.nonzero(arr)[0]}
    lng = {r["key"]: r["value"] for r in m.normalized_long().filter(F.col("track_id") == one["track_id"]).collect()}
    assert dense.keys() == lng.keys()
    assert all(abs(dense[k] - lng[k]) < 1e-9 for k in lng)


def test_kmeans_assignment_is_argmin(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    cen = MD.label_centroids(emb, "label", "embedding", 64)
    a = {r["vec_id"]: r["cluster"] for r in MD.kmeans_assign_dense(emb, cen).collect()}
    C = {r["cluster"]: np.array(r["centre"]) for r in cen.collect()}
    for r in emb.limit(50).collect():
        v = np.array(r["embedding"], dtype=float)
        best = min(C, key=lambda c: (((v - C[c]) ** 2).sum(), c))
        assert a[r["vec_id"]] == best


def test_projection_equals_the_exact_svd(spark, monkeypatch):
    from tunesift.operators import similarity as SIM
    monkeypatch.setattr(MD, "SUM_FEATURES", 50)
    meta = fx.meta(spark, SF_SMALL)
    m = FE.fit_content(meta)
    rows = SIM.index_rows(m.normalized_long())
    keys = MD.vector_keys(m)
    got = {r.track_id: (r.x, r.y) for r in MD.project_2d(rows, keys).collect()}
    data, place = rows.collect(), {k: i for i, k in enumerate(keys)}
    X = np.zeros((len(data), len(keys)))
    for i, r in enumerate(data):
        X[i, [place[k] for k in r["keys"]]] = r["vals"]
    _, _, vt = np.linalg.svd(X, full_matrices=False)
    V = vt[:2].T * np.where(vt[:2].T[np.abs(vt[:2]).argmax(1), [0, 1]] < 0, -1.0, 1.0)
    assert np.abs(X @ V - np.array([got[r.track_id] for r in data])).max() < 1e-4
    plan = MD.project_2d(rows.checkpoint(eager=True), keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_projection_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", ["x", "?"], [2.0, 9.0]), ("b", [], []), ("c", ["x"], [1.0])], "track_id string, keys array<string>, vals array<double>")
    assert {r.track_id: (round(r.x, 9), r.y) for r in MD.project_2d(rows, ["x"]).collect()} == {"a": (2.0, 0.0), "b": (0.0, 0.0), "c": (1.0, 0.0)}
    assert MD.project_2d(rows.filter("false"), ["x", "y", "z"]).count() == 0


def test_stratified_split_one_member_class_stays_in_train(spark):
    df = spark.createDataFrame([(i, "big") for i in range(10)] + [(99, "solo")], "id int, y string")
    out = {r["id"]: r["split"] for r in MD.stratified_split(df, "y", "id", 0.2).collect()}
    assert out[99] == "train" and sum(1 for v in out.values() if v == "test") == 2


def test_silhouette_matches_numpy(spark):
    emb = table(spark, SF_SMALL, "embeddings").withColumnRenamed("label", "cluster")
    got = MD.silhouette_sampled(spark, emb, max_rows=6000).first()["silhouette"]
    pdf = emb.toPandas()
    X = np.stack(pdf["embedding"].to_numpy()).astype(float)
    lab = pdf["cluster"].to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - float(np.mean(s))) < 1e-9
    # many small blocks give the same value, in more than one task
    plan = MD.silhouette_sampled(spark, emb, max_rows=6000, block_rows=40)
    assert abs(plan.first()["silhouette"] - got) < 1e-9


def test_sampled_silhouette_is_dealt_over_all_cores(spark):
    emb = table(spark, SF_SMALL, "embeddings").withColumnRenamed("label", "cluster")
    plan = MD.silhouette_sampled(spark, emb, block_rows=40)._jdf.queryExecution().toString()
    n = spark.sparkContext.defaultParallelism
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(_i#\d+, _j#\d+, (\d+)\)", plan)]
    assert "FlatMapCoGroupsInPandas" in plan and dealt and min(dealt) >= n


def test_top_terms_cut_and_ties(spark):
    import random

    from tunesift.operators import features as FE
    rnd = random.Random(2)
    rows = [(b, f"t{i:03d}", rnd.randint(1, 9)) for b in ("g", "a", "x") for i in range(120)]
    df = spark.createDataFrame(rows, "block string, term string, cf long")
    for g, a in ((10, 200), (1, 37), (120, 119)):
        got = sorted((r.block, r.term) for r in FE.top_terms(df, {"g": g, "a": a}).collect())
        want = [r for r in rows if r[0] == "x"]
        for b, n in (("g", g), ("a", a)):
            want += sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1]))[:n]
        assert got == sorted((b, t) for b, t, _ in want)


def test_stratified_split_matches_full_rank_on_a_hot_class(spark):
    import hashlib
    rows = [(i, "hot" if i % 10 else f"c{i % 7}") for i in range(20000)]
    df = spark.createDataFrame(rows, "id int, y string")
    got = {r["id"]: r["split"] for r in MD.stratified_split(df, "y", "id", 0.2).collect()}
    by = {}
    for i, y in rows:
        by.setdefault(y, []).append((hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for y, items in by.items():
        items.sort()
        t = int(np.floor(len(items) * 0.2 + 0.5))
        exp_test = {i for _, i in items[:t]}
        assert {i for _, i in items if got[i] == "test"} == exp_test


def test_forest_numbers_its_labels_and_is_kept(spark, tmp_path):
    """More labels than Spark would infer, blank and odd ones among them; saved and loaded, it predicts the same."""
    names = ["", "\u0001", "É"] + [f"artist {i:03d}" for i in range(150)]
    coded = spark.createDataFrame([(f"t{i}-{j}", [i, 200], [1.0, float(j)], names[i]) for i in range(len(names)) for j in range(3)],
                                  "track_id string, at array<int>, vals array<double>, artist string")
    vec = MD.sparse_vectors(coded, 201, str(tmp_path / "v"))
    one = vec.filter("track_id = 't5-2'").first().features
    assert (one.size, one.indices.tolist(), one.values.tolist()) == (201, [5, 200], [1.0, 2.0])
    rows = vec.join(coded.select("track_id", "artist"), "track_id")
    forest = MD.rf_fit(rows, "artist", num_trees=3, max_depth=4)
    assert forest.model.numClasses == len(names)
    got = MD.predicted_labels(forest, rows).select("track_id", "predicted").collect()
    assert len(got) == 3 * len(names) and {r.predicted for r in got} <= set(names)
    forest.save(str(tmp_path / "m"))
    again = MD.predicted_labels(MD.Forest.load(spark, str(tmp_path / "m")), rows).select("track_id", "predicted").collect()
    assert sorted(got) == sorted(again)
