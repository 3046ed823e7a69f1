import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def spell(word):
    raw = b"\n" + word.encode() + b"\n"
    return [(raw[max(0, i - X.ORDER + 1):i], raw[i]) for i in range(1, len(raw))]


class Brute:
    """The two models written out with dictionaries."""

    def __init__(self, words):  # [(word, is toxic)]
        self.c = [Counter(), Counter()]
        for w, y in words:
            self.c[y].update(spell(w))
        self.k = {}  # shared counts by order: pooled at the top, continuation kinds below
        grams = {h + bytes([x]): n for (h, x), n in (self.c[0] + self.c[1]).items()}
        self.levels = [grams]
        while True:
            below = Counter(g[1:] for g in self.levels[-1] if len(g) > 1)
            if not below:
                break
            self.levels.append(dict(below))

    def q(self, g, level):
        if level >= len(self.levels):
            return 1 / 256
        t = self.levels[level]
        same = [n for o, n in t.items() if len(o) == len(g) and o[:-1] == g[:-1]]
        low = self.q(g[1:], level + 1) if len(g) > 1 else 1 / 256
        return (max(t[g] - X.BACKOFF_DISCOUNT, 0) + X.BACKOFF_DISCOUNT * len(same) * low) / sum(same)

    def ratio(self, word):
        out = 0.0
        for h, x in spell(word):
            g = h + bytes([x])
            known = g in self.levels[0]
            p = []
            for c in self.c:
                after = {k: n for k, n in c.items() if k[0] == h}
                total = sum(after.values())
                back = sum(min(n, X.DISCOUNT) for n in after.values()) / total if total else 1.0
                if known:
                    p.append((max(c[h, x] - X.DISCOUNT, 0) / total if total else 0) + back * self.q(g, 0))
                else:
                    p.append(back)
            out += math.log(p[1] / p[0])
        return out


def test_word_ratios_equal_the_models_written_out():
    words = [("the", 0)] * 9 + [("then", 0)] * 4 + [("thé", 1)] * 5 + [("loser", 1)] * 6 + [("lose", 0)] * 2 + [("rare", 1), ("other", 0)] + [("abcdefghij", 1)] * 4
    s = X.Spelled(pa.array([" ".join(w for w, _ in words)]))
    counts = Counter(g for w, _ in words for g in spell(w))
    key = {k: int.from_bytes(k[0] + bytes([k[1]]), "big") for k in counts}
    sides = [Counter(), Counter()]
    for w, y in words:
        sides[y].update(spell(w))
    grams = np.array([key[k] for k in key], np.uint64)
    model = X._from_counts(0.5, grams, np.array([sides[0][k] for k in key]), np.array([sides[1][k] for k in key]))
    brute = Brute(words)
    probe = ["the", "loser", "losers", "lo", "rare", "unseen", "thé", "abcdefghijk", "zz"]
    got = model.word_ratios(X.Spelled(pa.array([" ".join(probe)])))
    assert np.allclose(got, [brute.ratio(w) for w in probe])
    assert len(s.at) == len(words)


def made(words):
    """The model of (word, is toxic) pairs, and the same written out."""
    counts = Counter(g for w, _ in words for g in spell(w))
    key = {k: int.from_bytes(k[0] + bytes([k[1]]), "big") for k in counts}
    sides = [Counter(), Counter()]
    for w, y in words:
        sides[y].update(spell(w))
    grams = np.array([key[k] for k in key], np.uint64)
    return X._from_counts(0.5, grams, np.array([sides[0][k] for k in key]), np.array([sides[1][k] for k in key])), Brute(words)


def test_scores_equal_the_rule_written_out():
    words = [("fine", 0)] * 9 + [("day", 0)] * 7 + [("loser", 1)] * 6 + [("scum", 1)] * 8 + [("dayly", 0)] * 3
    model, brute = made(words)
    weights = np.array([-2.0, 0.7, 1.1, 0.3, -0.2])
    model = replace(model, weights=weights)
    texts = ["fine day", "loser scum loser scum scum fine", "fine " * 300 + "scum", "", None, " \n", "unseen", "Scum!", "\"day\" (loser)", "day"]
    got = model.scores(pa.array(texts))
    for t, score in zip(texts, got):
        x = [brute.ratio(w) for w in (w.strip(".,;:!?\"'()") for w in (t or "").lower().split()) if w]
        n = max(1, len(x))
        top = sorted(x, reverse=True)
        ratios = [sum(x) / n, math.sqrt(sum(max(0.0, v - X.TELLING) for v in x) / n), *(sum(top[:k]) / k for k in X.FEW)]
        assert abs(score - 1 / (1 + math.exp(-(weights[0] + np.dot(weights[1:], ratios))))) < 1e-4
    assert (model.scores(pa.array(texts[::-1]))[::-1] == got).all()


def test_logistic_curve_is_the_penalised_optimum():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x @ [1.0, 0.3, 4.0] + rnd.normal(size=400) > 5).astype(float)
    w = X._logistic(x, y)
    mean, scale = x.mean(0), x.std(0)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert abs((y - p).sum()) < 1e-4  # slopes of the loss: none for the bias, the ridge's for the others
    assert np.abs(((x - mean) / scale).T @ (y - p) - w[1:] * scale).max() < 1e-3


def test_held_out_rows_of_the_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = X.op8_toxicity_kneser_ney(spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.93
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.94
    assert np.mean([s >= 0.5 for s in neg]) < 0.02


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (6, 0), (9, 0), (10, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels, F.lit(True))
    got = X.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] == by[5]
    nothing = X.fit(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in X.score(docs, nothing).collect()} == {0.0}
    assert X.score(no_documents(spark), model).count() == 0
    assert {r.score for r in X.score(docs, X.fit(docs, labels.filter("toxic = 1"), F.lit(True))).collect()} == {1.0}
