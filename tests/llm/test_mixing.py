import re

import pytest

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import mixing as M


def highest_quotients(shares, seats, caps):
    got = [0] * len(shares)
    for _ in range(seats):
        best = max((i for i in range(len(shares)) if got[i] < caps[i] and shares[i] > 0), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("shares,seats", [([53, 24, 23], 7), ([1, 1, 1], 2), ([0, 5, 2.5], 40), ([1000, 1, 1], 3), ([3.3] * 9, 100), ([7], 5)])
def test_apportionment_equals_highest_quotients(shares, seats):
    caps = [10**6] * len(shares)
    assert M.sainte_lague([float(s) for s in shares], seats, caps) == highest_quotients(shares, seats, caps)
    caps = [max(1, seats // 2)] * len(shares)
    want = min(seats, sum(c for c, s in zip(caps, shares) if s))
    assert M.sainte_lague([float(s) for s in shares], seats, caps) == highest_quotients(shares, want, caps)


def test_targets_share_the_whole_under_the_cap():
    t = M.water_fill([10, 1000, 0, 5], [1, 2, 3, 1], 3)
    assert t[0] <= 30 and t[2] == 0 and t[3] <= 15 and abs(sum(t) - 1015) < 1e-9
    assert M.water_fill([], [], 3) == [] and M.water_fill([0, 0], [1, 2], 3) == [0.0, 0.0]


def test_block_rule_takes_exactly_the_quota():
    for n in (1, 2, 7, 30, 97):
        for quota in range(3 * n + 1):
            passes, extra, step, start = M.block_rule(n, quota, 1, "s", 0)
            times = [passes + ((i * step + start) % n < extra) for i in range(n)]
            assert sum(times) == quota and max(times) <= 3


def words(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def check(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, M.water_fill([sizes[s] for s in names], [k % 3 + 1 for k in range(len(names))], 3)))
    for s, v in by.items():
        taken = sum(r.taken for r in v)
        assert abs(taken - target[s]) <= max(0.02 * target[s], 2 * M.BLOCK * M.SHARDS)
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in v)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_query_meets_targets_and_repeats(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = M.op9_mix_sainte_lague(spark, SF_SMALL).collect()
    assert {r.doc_id: r.size for r in got} == {i: words(t) for i, t in docs.items()}
    check(got, docs)
    assert sorted(got) == sorted(M.op9_mix_sainte_lague(spark, SF_SMALL).collect())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = M.mix(docs).collect()
    assert len(got) == docs.count()
    check(got, None)
    assert {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert next(r.size for r in got if r.doc_id == 9) == 30_000
    assert M.mix(no_documents(spark)).count() == 0
