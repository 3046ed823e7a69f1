"""E2 with score bounds: the same rows as scoring every item, most blocks unopened."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tunesift.operators import block_index as BLK
from tunesift.operators import similarity as SIM
from tunesift.plans.artifacts import content_artifact


def pairs(df):
    return sorted((r.seed_id, r["rank"], r.track_id, int(np.floor(r.score * 1e4 + 0.5))) for r in df.collect())


def made(spark, n, groups, negative):
    rnd = np.random.default_rng(n)
    rows = []
    for i in range(n):
        g = int(rnd.integers(groups))
        keys = [f"g:{g}", f"a:{g}-{rnd.integers(5)}", f"t:{rnd.integers(n)}", f"t:x{rnd.integers(3)}", "n:year", "n:explicit"]
        keys = list(dict.fromkeys(keys))
        vals = rnd.random(len(keys)) * [1.0 if k[0] in "ga" else 0.2 for k in keys]
        if negative:
            vals[-2:] = rnd.normal(size=2)
        norm = np.linalg.norm(vals)
        rows.append((f"id{i:05d}", keys, (vals / norm).tolist()))
    rows.append(("none", [], []))
    return spark.createDataFrame(rows, "track_id string, keys array<string>, vals array<double>").repartition(3)


@pytest.mark.parametrize("items", [1, 7, 64])
@pytest.mark.parametrize("negative", [False, True])
def test_equals_scoring_every_item(spark, items, negative):
    rows = made(spark, 600, 12, negative).checkpoint(eager=True)
    blocks = BLK.block_index(rows, items=items).checkpoint(eager=True)
    assert sorted(i for r in blocks.collect() for i in r.ids) == sorted(r.track_id for r in rows.collect())
    seeds = rows.filter("track_id = 'none' or substring(track_id, -1) = '4'").checkpoint(eager=True)
    for k, own in ((5, True), (40, False)):
        want = pairs(SIM.knn_batch(spark, rows, seeds, k, exclude_self=own))
        assert pairs(BLK.knn_blocks(spark, blocks, seeds, k, exclude_self=own)) == want
        assert pairs(BLK.knn_blocks(spark, blocks, seeds, k, exclude_self=own, per_group=(20, 10_000))) == want


def test_most_blocks_stay_closed(spark):
    rows = made(spark, 4000, 60, False).checkpoint(eager=True)
    blocks = BLK.block_index(rows, items=16).checkpoint(eager=True)
    seeds = rows.filter("substring(track_id, -2) = '00'").checkpoint(eager=True)
    tally = spark.sparkContext.accumulator(0)
    got = BLK.knn_blocks(spark, blocks, seeds, 10, tally=tally).checkpoint(eager=True)
    assert pairs(got) == pairs(SIM.knn_batch(spark, rows, seeds, 10))
    assert 0 < tally.value < 0.7 * blocks.count() * seeds.count()


def test_catalogue_blocks_hold_every_row_and_no_seeds_or_items(spark):
    a = content_artifact(spark, SF_SMALL)
    assert a.blocks.selectExpr("sum(size(ids))").first()[0] == a.rows.count()
    seeds = a.rows.orderBy("track_id").limit(20)
    assert pairs(BLK.knn_blocks(spark, a.blocks, seeds, 10)) == pairs(SIM.knn_batch(spark, a.rows, seeds, 10))
    assert BLK.knn_blocks(spark, a.blocks, seeds.filter("false"), 3).count() == 0
    assert BLK.knn_blocks(spark, a.blocks.filter("false"), seeds, 3).count() == 0
    assert BLK.block_index(a.rows.filter("false")).count() == 0


def test_long_table_and_blocks_are_written_when_asked_for(spark, tmp_path):
    import shutil
    from tunesift.session import path_exists
    shutil.copytree(SF_SMALL, tmp_path / "sf")
    a = content_artifact(spark, str(tmp_path / "sf"))
    assert not path_exists(spark, f"{a.path}/long") and not path_exists(spark, f"{a.path}/blocks")
    assert a.long.count() == a.rows.selectExpr("sum(size(keys))").first()[0]
    assert not path_exists(spark, f"{a.path}/blocks") and a.blocks.count() > 0
