import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import divergence as D


def expected(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        counts = {s: {t: count[lang, s][t] for t in kept} for s in own}
        whole = {t: sum(counts[s][t] for s in own) for t in kept}

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        p, q = {s: share(counts[s]) for s in own}, share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in own:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def dense(a, b, same, columns, total_a, total_b):
    p, q = (D.shares(x, t[:, None]) for x, t in ((a, total_a), (b, total_b)))
    out = np.array([[D.difference(p[i], q[j]).sum() for j in range(len(b))] for i in range(len(a))], np.int64).reshape(len(a), len(b))
    return np.triu(out, 1) if same else out


@pytest.mark.parametrize("rows,columns,fill", [(1, 1, 1.0), (5, 40, 0.1), (33, 7, 0.3), (16, 64, 0.02), (3, 100, 0.0), (9, 9, 1.0)])
@pytest.mark.parametrize("frontier", [3, 1 << 19])
def test_walk_equals_dense_differences(rows, columns, fill, frontier):
    rnd = np.random.default_rng(rows * columns)

    def made(n):
        m = rnd.integers(1, 50, (n, columns)) * (rnd.random((n, columns)) < fill)
        total = m.sum(1) + 2 * columns + rnd.integers(0, 9, n)
        height = max(int(max(n, rows, columns) + 3).bit_length(), 1)
        r, c = np.nonzero(m)
        return m, total, D.Quadtree(r, c, D.shares(m[r, c], total[r]), height), D.shares(np.zeros(n, np.int64), total)
    a, ta, tree_a, empty_a = made(rows)
    b, tb, tree_b, empty_b = made(rows)
    assert (D.walk(tree_a, tree_a, empty_a, empty_a, columns, frontier) == dense(a, a, True, columns, ta, ta)).all()
    assert (D.walk(tree_a, tree_b, empty_a, empty_b, columns, frontier) == dense(a, b, False, columns, ta, tb)).all()


def test_shares_are_exact_beyond_64_bit_products():
    rnd = random.Random(1)
    for _ in range(300):
        total = rnd.randint(1, 9 * 10**15)
        c = rnd.randint(0, total)
        assert D.shares(np.array([c]), total)[0] == 1 + 10**9 * (c + 2) // total


def test_terms_are_runs_of_letters():
    texts = ["Ab,c1é<\x00>Éa", "", None, "x" * 100_000, "1 2", "a", "B 中文-z q"]
    terms, at = D.term_runs(pa.array(texts))
    want = [(t.translate({i: i + 32 for i in range(65, 91)}), i) for i, x in enumerate(texts) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    assert list(zip(terms.to_pylist(), at.tolist())) == want


@pytest.fixture
def corpus():
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "abcdeéz" for b in ("x", "yy", "中", "Q")]
    return [(rnd.choice(["en", "de", "", None]), rnd.choice(["s1", "s2", "s3", "s4", "é", "", None]),
             " ".join(rnd.choices(words[:k + 4], k=rnd.randint(0, 30)))) for k in (0, 5, 15, 24) for _ in range(120)] + [("solo", "one", "a b"), ("solo", "two", None)]


@pytest.mark.parametrize("tile,width,held", [(256, 1024, 300_000), (2, 3, 40), (1, 5, 300_000)])
def test_equals_brute_force(spark, corpus, monkeypatch, tile, width, held):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "HELD", held)
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus], "lang string, source string, text string, g int, term string")
    assert got(D.audit(docs, width=width)) == expected(corpus)


def test_odd_rows_and_no_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for least in (1, 2, 10):
        assert got(D.audit(docs, least_docs=least)) == expected(rows, least)
    assert D.audit(no_documents(spark)).count() == 0


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    mine = got(D.op11_divergence_quadtree(spark, SF_SMALL))
    assert mine == sorted(con.sql(D.OP11_SQL).fetchall())
    assert mine == expected(con.sql("select lang, source, text from documents").fetchall())
