import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import simhash as S
from tunesift.llm.graph import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    """fps: [(id, fp)] -> {id: least id reached}."""
    ids = [i for i, _ in fps]
    x = np.array([f for _, f in fps], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_masks_cover_every_pair_within_the_radius():
    for bits in (list(range(64)), list(range(3, 17)), [5, 9, 40]):
        masks = S.covering_masks(bits, 3)
        assert len(masks) == 15
        rnd = random.Random(1)
        for _ in range(2000):
            diff = sum(1 << b for b in rnd.sample(bits, min(3, len(bits))))
            assert any(m & diff == 0 for m in masks)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in S.op1_simhash_near_dup(spark, SF_SMALL).collect()}
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    want = brute_components(fps)
    assert len(got) == len(docs)
    for i, f in fps:
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == want[i]


def test_large_buckets_are_split_without_losing_links(spark):
    rnd = random.Random(7)
    hub = rnd.getrandbits(64)
    fps = {hub}
    while len(fps) < 1500:  # one ball of near fingerprints, far over BUCKET in every table
        x = hub
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 6])):
            x ^= 1 << b
        fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    rows = sorted((S._signed(f),) for f in fps)
    df = spark.createDataFrame(rows, "fp long")
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    want = brute_components([(f, f % (1 << 64)) for (f,) in rows])
    assert {f: got.get(f, f) for (f,) in rows} == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = S.near_duplicates(docs).withColumn("h", S.hex_digits(F.col("fp"))).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == 1
    assert {by[i][0].h for i in (3, 4, 5)} == {"0" * 16} and {by[i][0].component_id for i in (3, 4, 5)} == {3}
    assert [r.component_id for r in by[11]] == [11, 11]
    assert by[None][0].component_id is None  # alone in its component
    assert by[9][0].h == f"{brute_fingerprint('wort ' * 30_000):016x}"
    assert S.near_duplicates(no_documents(spark)).count() == 0


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (2, 1), (300, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
