import gzip
import hashlib
import io
import json
import random
import zlib

import pytest

from tests.conftest import SF_SMALL
from tunesift.llm import warc as W


def test_stream_is_rewritten_record_by_record():
    rnd = random.Random(1)
    records = [W.record("response", i, None if i % 7 == 0 else f"http://x/{i}\n", rnd.randbytes(rnd.choice([0, 1, 99, 200_000])), "d", 1, None, "t")
               for i in range(30)]
    whole = b"".join(records)
    for raw in (gzip.compress(whole), gzip.compress(whole[:70_001]) + gzip.compress(whole[70_001:])):
        out = io.BytesIO()
        spans = list(W.normalise_stream(io.BytesIO(raw), out))
        assert [zlib.decompress(out.getvalue()[o:o + n], 31) for _, o, n in spans] == records
        assert gzip.decompress(out.getvalue()) == whole  # members in a row are the same stream
    with pytest.raises(ValueError):
        list(W.normalise_stream(io.BytesIO(gzip.compress(whole)[:-3000]), io.BytesIO()))
    with pytest.raises(ValueError):
        list(W.normalise_stream(io.BytesIO(gzip.compress(whole[:-300_000])), io.BytesIO()))


def expected(rows, least=100):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in W.op7_warc_normalise(spark, SF_SMALL).collect()), key=str) == expected(rows)


def test_odd_rows_and_the_sidecar(spark, tmp_path):
    big = "ü<p>" * 60_000
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "a" * 99), (4, "u", "a" * 99), (5, "u", "b" * 100), (6, "u", "b" * 100),
            (6, "u", "b" * 100), (5, "u", "b" * 100), (None, "u", "b" * 100), (None, "u", "c" * 200), (7, "u", big), (8, "u", big),
            (9, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, length long, archive string")
    got = W.round_trip(pages, str(tmp_path / "w"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    index = [json.loads(x) for f in (tmp_path / "w/index").glob("*.jsonl") for x in f.read_text().splitlines()]
    assert len(index) == len(rows)
    for x in index:
        with open(x["archive"], "rb") as f:
            f.seek(x["offset"])
            assert x["record_id"].encode() in zlib.decompress(f.read(x["length"]), 31)
    none = spark.createDataFrame([], pages.schema)
    assert W.round_trip(none, str(tmp_path / "none")).count() == 0
