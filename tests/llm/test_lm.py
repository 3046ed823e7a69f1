import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import lm as M
from tunesift.llm.eliasfano import EliasFano, map_arrays, write_arrays


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 2**63), (5, 3), (1000, 10), (1000, 2**62), (4097, 5000), (300, 2**64 - 1)])
def test_coded_sequence(n, top, tmp_path):
    rnd = np.random.default_rng(n)
    values = np.sort(rnd.integers(0, top + 1, n, dtype=np.uint64, endpoint=False) if top else np.zeros(n, np.uint64))
    write_arrays(str(tmp_path / "x"), EliasFano.of(values).arrays("v"))
    ef = EliasFano.open(map_arrays(str(tmp_path / "x")), "v")
    assert (ef.access(np.arange(n)) == values).all()
    probe = np.concatenate([values, values + np.uint64(1), rnd.integers(0, 2**64 - 1, 200, dtype=np.uint64), np.array([0, top], np.uint64)])
    assert (ef.rank(probe) == np.searchsorted(values, probe, "left")).all()
    found = ef.find(probe)
    assert ((found >= 0) == np.isin(probe, values)).all()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*(w for w in re.split("[\x20\x09-\x0d]+", low) if w), "\n"]


def brute(train, texts):
    """(n_tokens, n_known, N, base, score) of each text, with exact probabilities."""
    c, pairs = Counter(), Counter()
    for t in train:
        row = tokens(t)
        c.update(row)
        pairs.update(zip(["\n", *row[:-1]], row))
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(max(once / (once + 2 * twice) if once else M.DISCOUNT, 0.1), 0.95)
    kept = {k: x for k, x in pairs.items() if x >= M.LEAST}
    back = {h: 1.0 for h in c}
    for (h, _), x in kept.items():
        back[h] -= (x - M.DISCOUNT) / c[h]
    out = []
    for t in texts:
        row = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in row)
        score = 0.0
        for h, w in zip(["\n", *row[:-1]], row):
            alone = (c[w] - d) / n if c[w] else (d * v / n if n else 1.0)
            score += math.log10((kept[h, w] - M.DISCOUNT) / c[h] * ((h, w) in kept) + back.get(h, 1.0) * alone) if (h, w) in kept else math.log10(back.get(h, 1.0) * alone)
        out.append((len(row), sum(c[w] > 0 for w in row), n, base, score))
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check(got, docs):
    train = [t for i, t in docs if not held_out(i)]
    for (i, _), want, r in zip(docs, brute(train, [t for _, t in docs]), got):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, *want[:3])
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, want[4], rel_tol=0.01, abs_tol=0.05)  # 256 values a file


@pytest.mark.parametrize("tokens_a_file", [M.TOKENS_A_FILE, 500])
def test_scores_equal_brute_force(spark, tokens_a_file, monkeypatch):
    monkeypatch.setattr(M, "WORDS_A_FILE", 3000 if tokens_a_file == 500 else M.WORDS_A_FILE)
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = sorted(tuple(r) for r in df.collect())
    trie = M.fit(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, tokens_a_file=tokens_a_file)
    assert (len(trie.files2) > 50 and len(trie.files1) > 3 and trie.split) if tokens_a_file == 500 else len(trie.files2) == 1
    check(sorted(M.score(df, trie).collect()), docs)


def test_query_beats_the_base_on_held_out_texts(spark):
    got = M.op10_lm_elias_fano(spark, SF_SMALL).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_after_a_context_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a b a b c a b d"), (2, "a b a c c c"), (3, "b a b a")], "doc_id long, text string")
    trie = M.fit(df, F.lit(True))
    l1, l2 = trie.level1(), trie.level2()

    def after(t, at):
        """P of the token at a place, from its parts."""
        number, count = l1.look_up(t.hashes)
        w, h = t.at[at], t.before[at]
        alone = (count[w] - trie.discount) / trie.tokens if count[w] else trie.discount * trie.words / trie.tokens
        keys, possible = M._pair_keys(t, number, count)
        q = l2.look_up(keys[at:at + 1])[0] if possible[at] else 0.0
        return q + (l2.backoff(number[[h]])[0] if count[h] else 1.0) * alone

    for h in ("a", "b", "c", "zz"):
        words = sum(after(M.Tokens(pa.array([f"{h} {w}"])), 1) for w in ("a", "b", "c", "d", "unknown"))
        assert abs(words + after(M.Tokens(pa.array([h])), 1) - 1) < 1e-3


def test_odd_rows(spark):
    docs = odd_documents(spark)
    trie = M.fit(docs, F.lit(True))
    got = M.score(docs, trie).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert {by[i].n_tokens for i in (3, 4, 5)} == {1} and by[9].n_tokens == 30_001
    assert M.score(no_documents(spark), trie).count() == 0
    empty = M.fit(no_documents(spark), F.lit(True))
    r = {r.doc_id: r for r in M.score(docs, empty).collect()}[1]
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_a_pair_seen_once_counts(spark):
    train = spark.createDataFrame([(1, "x y"), (2, "p q")], "doc_id long, text string")
    trie = M.fit(train, F.lit(True))
    asked = spark.createDataFrame([(1, "x y"), (2, "x q")], "doc_id long, text string")
    seen, unseen = (r.score for r in sorted(M.score(asked, trie).collect()))
    assert seen > unseen + 0.1
