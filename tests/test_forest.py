"""The forest over sparse rows: splits against brute force, fits that don't depend on the rows' layout."""

import numpy as np
from pyspark.sql import functions as F

from tunesift.operators import forest as RF


def _gini_gain(y, right):
    def part(z):
        return (np.bincount(z) ** 2).sum() / len(z) if len(z) else 0.0
    return part(y[right]) + part(y[~right]) - part(y)


def test_best_split_equals_brute_force():
    rnd = np.random.default_rng(3)
    zero_bin = np.array([0, 2, 1])
    for _ in range(30):
        x = np.stack([rnd.integers(0, 3, 60), rnd.integers(0, 5, 60), rnd.integers(0, 3, 60)], axis=1)
        y, w = rnd.integers(0, 6, 60), rnd.integers(1, 4, 60)
        cells = {}
        for i in range(60):
            cells[7, -1, int(y[i]), 0] = cells.get((7, -1, int(y[i]), 0), 0) + int(w[i])
            for f in range(3):
                if x[i, f] != zero_bin[f]:  # zero's bin is never counted
                    k = (7, f, int(y[i]), int(x[i, f]))
                    cells[k] = cells.get(k, 0) + int(w[i])
        rows = sorted((*k, n) for k, n in cells.items())
        got = RF.best_splits(*np.array(rows).T, zero_bin, 6, 2)[0]
        yy, xx = np.repeat(y, w), np.repeat(x, w, axis=0)
        gains = {(f, s): _gini_gain(yy, xx[:, f] > s) for f in range(3) for s in range(5) if min((xx[:, f] > s).sum(), (xx[:, f] <= s).sum()) >= 2}
        assert abs(gains[got[1], got[2]] - max(gains.values())) < 1e-9
        assert (got[3], got[4]) == ((xx[:, got[1]] <= got[2]).sum(), (xx[:, got[1]] > got[2]).sum())


def test_predicted_class_is_the_one_with_most_votes():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 6, 40)
    classes = np.concatenate([rnd.choice(9, n, replace=False) for n in sizes])
    shares = np.concatenate([-np.sort(-rnd.dirichlet(np.ones(n))) for n in sizes])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(40, np.int64)
    m = RF.ForestModel(9, 1, 4, none - 1, none * 0.0, none, none, starts, classes, shares)
    nodes = rnd.integers(0, 40, (300, 4))
    for got, leaves in zip(m.predict(nodes), nodes):
        total = np.zeros(9)
        for k in leaves:
            np.add.at(total, classes[starts[k]:starts[k + 1]], shares[starts[k]:starts[k + 1]])
        assert got == total.argmax()


def test_counts_hold_no_place_for_classes_that_dont_occur(spark, tmp_path):
    """3,000 classes, each with a feature of its own: dense class counts of every node would not fit; the fit doesn't depend on the layout."""
    from tunesift.operators import models as MD
    coded = spark.range(9000).select(F.col("id").cast("string").alias("track_id"), F.array((F.col("id") % 3000).cast("int"), F.lit(3000)).alias("at"),
                                     F.array(F.lit(1.0), (F.col("id") % 2 - 0.5).cast("double")).alias("vals"), (F.col("id") % 3000).alias("y"))
    vec = MD.sparse_vectors(coded, 3001, str(tmp_path / "v")).join(coded.select("track_id", "y"), "track_id")
    one, two = (MD.rf_fit(v, "y", num_trees=4, max_depth=6) for v in (vec, vec.repartition(7)))
    assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(one.model.plain(), two.model.plain()))
    assert one.model.numClasses == 3000 and len(one.model.classes) <= 4 * 9000 < one.model.numClasses * (one.model.feat < 0).sum()
    got = MD.predicted_labels(one, vec).select("y", "predicted", "leaves").collect()
    assert len(got) == 9000 and sum(r.y == r.predicted for r in got) > 9
    assert all(len(r.leaves) == 4 for r in got)


def test_tasks_get_only_the_paths_to_open_nodes():
    from tunesift.operators import forest as RF
    # two trees: the first has an open node under its left child, the second is done
    feat = np.array([3, 5, 1, RF.LEAF, RF.LEAF, RF.LEAF, RF.OPEN, RF.LEAF])
    split, left = np.array([0, 2, 1, 0, 0, 0, 0, 0]), np.array([2, 4, 6, 0, 0, 0, 0, 0])
    ids, f, s, l = RF._open_paths(feat, split, left, [0, 2, 6, 8], 2)
    assert ids.tolist() == [0, 1, 2, 3, 6, 7]
    assert f.tolist() == [3, RF.LEAF, 1, RF.LEAF, RF.OPEN, RF.LEAF]
    assert s[[0, 2]].tolist() == [0, 1] and l[[0, 2]].tolist() == [2, 4]


def test_artist_forest_predicts_each_track_once(spark):
    from tests.conftest import SF_SMALL
    from tunesift.operators import models as MD
    from tunesift.plans import q_models as Q
    plan = Q.f6_rf_artist_fit(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    meta, model, _, _ = Q._rf_artist(spark, SF_SMALL)
    vectors = MD.content_vectors(model, meta, normalize=False, keep=("artist_name",))
    assert vectors.columns == ["track_id", "features", "artist_name"]
    assert "Exchange hash" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_paths_that_end_early_are_stepped_along_without_harm():
    rnd = np.random.default_rng(7)
    # a chain that goes left 40 times: every right child is a leaf
    feat, left = np.full(81, RF.LEAF), np.zeros(81, np.int64)
    inner = [0] + list(range(1, 79, 2))
    for k, node in enumerate(inner):
        feat[node], left[node] = k % 6, 2 * k + 1
    above = np.where(feat >= 0, np.arange(81) % 3, 0)
    dense = np.concatenate([rnd.integers(0, 4, (500, 6)), np.zeros((500, 1))], axis=1).astype(np.int16)
    dense[:100] = 0  # these go down the whole chain
    want = []
    for x in dense:
        k = 0
        while feat[k] >= 0:
            k = left[k] + int(x[feat[k]] > above[k])
        want.append(k)
    for kind in (np.int16, float):
        got = RF._descend(dense.astype(kind), np.arange(7, dtype=np.int32), np.arange(500), np.zeros(500, np.int64), feat, above, left)
        assert got.tolist() == want and max(want) > 70


def test_counts_are_added_alike_whether_one_number_or_two_are_sorted(monkeypatch):
    rnd = np.random.default_rng(9)
    k1, k2, n = rnd.integers(0, 50, 3000), rnd.integers(0, 70, 3000), rnd.integers(1, 13, 3000)
    one = RF._added(k1, k2, n)
    want = {}
    for a, b, c in zip(k1.tolist(), k2.tolist(), n.tolist()):
        want[a, b] = want.get((a, b), 0) + c
    assert [(*k, want[k]) for k in sorted(want)] == list(zip(*(x.tolist() for x in one)))
    monkeypatch.setattr(RF, "COUNT_BITS", 0)
    assert all((a == b).all() for a, b in zip(one, RF._added(k1, k2, n)))


def test_subsets_are_the_same_with_and_without_a_table(spark, monkeypatch, tmp_path):
    from tunesift.operators import models as MD
    coded = spark.range(600).select(F.col("id").cast("string").alias("track_id"), F.array((F.col("id") % 30).cast("int"), F.lit(30)).alias("at"),
                                    F.array(F.lit(1.0), (F.col("id") % 7 - 3).cast("double")).alias("vals"), (F.col("id") % 11).alias("y"))
    vec = MD.sparse_vectors(coded, 31, str(tmp_path / "v")).join(coded.select("track_id", "y"), "track_id")
    one = MD.rf_fit(vec, "y", num_trees=3, max_depth=5)
    monkeypatch.setattr(RF, "TABLE", 0)
    two = MD.rf_fit(vec, "y", num_trees=3, max_depth=5)
    assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(one.model.plain(), two.model.plain()))


def test_genre_labels_are_split_once_and_without_vectors(spark):
    from tests.conftest import SF_SMALL
    from tunesift.plans import q_models as Q
    lab, split = Q.lab_table(spark, SF_SMALL), Q.genre_split(spark, SF_SMALL)
    assert split.columns == ["track_id", "y", "split"] and Q.lab_vectors(spark, SF_SMALL).columns == ["track_id", "features"]
    for stored in (lab, split):  # read back, not made again for each use
        assert "Join" not in stored._jdf.queryExecution().optimizedPlan().toString() and stored.inputFiles()
    assert split.count() == lab.count() == split.select("track_id").distinct().count()
    share = split.filter("split = 'test'").count() / split.count()
    assert 0.15 < share < 0.25


def test_a_split_gives_the_classes_of_both_sides():
    rnd = np.random.default_rng(11)
    zero_bin = np.array([0, 2, 1])
    for _ in range(20):
        x = np.stack([rnd.integers(0, 3, 80), rnd.integers(0, 5, 80), rnd.integers(0, 3, 80)], axis=1)
        y, w = rnd.integers(0, 6, 80), rnd.integers(1, 4, 80)
        cells = {}
        for i in range(80):
            for k in [(4, -1, int(y[i]), 0)] + [(4, f, int(y[i]), int(x[i, f])) for f in range(3) if x[i, f] != zero_bin[f]]:
                cells[k] = cells.get(k, 0) + int(w[i])
        got = RF.best_splits(*np.array(sorted((*k, n) for k, n in cells.items())).T, zero_bin, 6, 1)[0]
        right = x[:, got[1]] > got[2]
        for on, (ys, ns) in ((~right, got[9:11]), (right, got[11:13])):
            want = np.bincount(y[on], weights=w[on], minlength=6).astype(np.int64)
            assert np.frombuffer(ys, np.int32).tolist() == np.flatnonzero(want).tolist()
            assert np.frombuffer(ns, np.int64).tolist() == want[want > 0].tolist()


def test_rows_met_by_entries_or_one_by_one_make_the_same_trees(spark, monkeypatch, tmp_path):
    """Nodes with many rows are met by their features' entries, others row by row: where the line is drawn doesn't matter,
    nor how many rows a pack has."""
    from tunesift.operators import models as MD
    coded = spark.range(3000).select(F.col("id").cast("string").alias("track_id"), F.array((F.col("id") % 30).cast("int"), (30 + F.col("id") % 7).cast("int"), F.lit(37)).alias("at"),
                                     F.array(F.lit(1.0), F.lit(0.5), (F.col("id") % 5 - 2).cast("double")).alias("vals"), (F.col("id") % 23).alias("y"))
    vec = MD.sparse_vectors(coded, 38, str(tmp_path / "v")).join(coded.select("track_id", "y"), "track_id")
    models = []
    for big, packed in ((64, 32_768), (1, 700), (10 ** 9, 100)):  # in between, only roots are big, all nodes are
        monkeypatch.setattr(RF, "BIG", big)
        monkeypatch.setattr(RF, "PACKED", packed)
        models.append(MD.rf_fit(vec, "y", num_trees=3, max_depth=8).model.plain())
    assert len(models[0][3]) > 20
    for other in models[1:]:
        assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(models[0], other))


def test_only_the_first_level_counts_classes_from_rows(spark, monkeypatch, tmp_path):
    from tunesift.operators import models as MD
    coded = spark.range(400).select(F.col("id").cast("string").alias("track_id"), F.array((F.col("id") % 9).cast("int")).alias("at"),
                                    F.array(F.lit(1.0)).alias("vals"), (F.col("id") % 9).alias("y"))
    vec = MD.sparse_vectors(coded, 9, str(tmp_path / "v")).join(coded.select("track_id", "y"), "track_id")
    seen, level = [], RF._level

    def spied(*args):
        out = level(*args)
        written = spark.read.parquet(f"{args[-1]}/level{len(seen) % 2}")
        seen.append((out.num_rows, written.filter("f >= 0 and yl is not null and yr is not null").count(), written.filter("f >= 0").count()))
        return out
    monkeypatch.setattr(RF, "_level", spied)
    m = MD.rf_fit(vec, "y", num_trees=2, max_depth=4).model
    assert len(seen) > 2 and all(a == b for _, a, b in seen) and sum(n for n, _, _ in seen) == len(m.feat)


def test_nodes_are_dealt_by_size():
    got = RF._dealt(np.array([1, 50, 1, 48, 1, 47, 0, 0]), 3)
    assert sorted(got[[1, 3, 5]].tolist()) == [0, 1, 2] and len(got) == 8
    assert RF._dealt(np.zeros(0, np.int64), 4).tolist() == []


def test_predictions_of_a_task_are_made_once_for_the_same_leaves(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    none, starts = np.zeros(6, np.int64), np.array([0, 2, 4, 6, 8, 10, 12])
    m = RF.ForestModel(4, 1, 2, none - 1, none * 0.0, none, none, starts, np.tile([0, 1], 6), np.tile([0.4, 0.6], 6))
    nodes = rnd.integers(0, 6, (50, 2))
    assert (m.predict(nodes, m.by_class()) == m.predict(nodes)).all() and (m.predict(nodes) == 1).all()


def test_leaf_rows_stand_one_a_track_and_are_not_exchanged(spark):
    from tests.conftest import SF_SMALL
    from tunesift.operators import models as MD
    from tunesift.plans import q_models as Q
    leaves = Q._leaves(spark, SF_SMALL)
    assert leaves.columns == ["track_id", "leaf"] and leaves.count() == leaves.select("track_id").distinct().count()
    idx = MD.leaf_index(leaves, Q.RF_TREES)
    for df in (idx, Q.f7_leaf_embedding(spark, SF_SMALL)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    long = {(r.track_id, f"{r.tree}:{r.leaf}") for r in MD.leaf_long(leaves).limit(400).collect()}
    keys = {(r.track_id, k) for r in idx.collect() for k in r["keys"]}
    assert long <= keys and len(keys) == Q.RF_TREES * leaves.count()
