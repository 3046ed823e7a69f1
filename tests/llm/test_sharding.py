import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import sharding as H


def test_curve_visits_every_cell_once_and_moves_one_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        at = H.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_law(rows, n_shards):
    n = len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(k, [])) for k in range(n_shards)]
    assert set(by) <= set(range(n_shards)) and max(counts) - min(counts) <= 1 and sum(counts) == n
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query_holds_the_law_and_the_bytes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = H.op2_shard_hilbert(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    check_law(got, 24)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def bucket(value, values, bits=6):
    """How many of the 2^bits - 1 quantile bounds lie below a value."""
    there = sorted(v for v in values if v is not None)
    bounds = [there[max(0, -(-k * len(there) // (1 << bits)) - 1)] for k in range(1, 1 << bits)]
    return 0 if value is None else sum(b < value for b in bounds)


def test_query_equals_sorting_all_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    columns = [[getattr(r, d) for r in docs] for d in ("lang", "source", "n_chars")]
    cells = np.array([[bucket(v, c) for v, c in zip(row, columns)] for row in zip(*columns)])
    order = sorted(zip(H.hilbert_index(cells, 6).tolist(), [r.doc_id for r in docs]))
    n = len(docs)
    shards = [k * 24 // n for k in range(n)]
    want = {i: (s, k - shards.index(s)) for k, (s, (_, i)) in enumerate(zip(shards, order))}
    assert {r.doc_id: (r.shard, r.slot) for r in H.op2_shard_hilbert(spark, SF_SMALL).collect()} == want


def test_runs_and_files_span_small_boxes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = H.shard(docs, str(tmp_path / "s"), 4, ["lang", "source", "n_chars"], run_bytes=70_000)
    rows = out.rows.collect()
    check_law(rows, 4)
    files = [f for f in (tmp_path / "s").rglob("*.parquet")]
    assert out.n_rows == 1000 and 20 <= len({r.run for r in rows}) == len(files) <= 50
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:]))
    runs = {}
    for r in rows:
        runs.setdefault(r.run, []).append(r)
    for dim, low, high in (("lang", "fr", "fr"), ("source", "src3", "src3"), ("n_chars", 100, 200), ("n_chars", 4000, 9000)):
        met = sum(min(getattr(r, dim) for r in v) <= high and max(getattr(r, dim) for r in v) >= low for v in runs.values())
        assert met <= 0.75 * len(runs), (dim, low, met)  # a random order meets every file


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    out = H.shard(docs, str(tmp_path / "a"), 5, ["lang", "source", "n_chars"], run_bytes=30).rows
    assert set(docs.columns) <= set(out.columns)
    check_law(out.collect(), 5)
    check_law(H.shard(docs, str(tmp_path / "b"), 24, ["source"]).rows.collect(), 24)
    assert H.shard(no_documents(spark), str(tmp_path / "c"), 24, ["lang", "source", "n_chars"]).rows.count() == 0


def test_columns_of_the_input_stay_as_they_are(spark, tmp_path):
    rows = [(f"id{i % 9}" if i % 5 else None, f"t{i % 4}", f"x{i}" if i else None, i, -i, 2 * i, None, i, i, i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, shard int, slot int, _slot int, Curve int, row int, id int, pos int")
    out = H.shard(docs, str(tmp_path / "a"), 7, ["source", "doc_id"], run_bytes=25)
    assert out.names == {"curve": "_curve", "run": "run", "slot": "__slot", "shard": "_shard"}
    assert sorted(map(tuple, out.rows.select(docs.columns).collect()), key=str) == sorted(rows, key=str)
    check_law(out.rows.select(F.col("_shard").alias("shard"), F.col("__slot").alias("slot")).collect(), 7)


@pytest.mark.parametrize("run_bytes", [1, 30, 1 << 20])
def test_rows_that_share_the_cut_key(spark, tmp_path, run_bytes):
    docs = spark.createDataFrame([(1, f"t{i % 3}", "x", i) for i in range(40)] + [(None, "t", "x", 100 + i) for i in range(90)] + [(2, "t", "y", 300)],
                                 "doc_id long, text string, source string, n int").repartition(3)
    out = H.shard(docs, str(tmp_path / "a"), 7, ["source"], run_bytes=run_bytes).rows.collect()
    check_law(out, 7)
    assert sorted(r.n for r in out) == sorted([*range(40), *range(100, 190), 300])
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.doc_id or 0, r.text) for r in order]
    assert sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys)) - 1  # equal keys lie side by side


def test_one_odd_value_leaves_the_other_strings_apart(spark):
    df = spark.createDataFrame([("a",)] + [(f"https://host/{i:03d}",) for i in range(200)], "source string")
    (_,), (bounds,) = H.quantised(df, ["source"])
    assert len(set(bounds)) == 63
