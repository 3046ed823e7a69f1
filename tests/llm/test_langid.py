import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import langid as G

SF = "/root/testdata/sf0.01"


def one_viterbi(scores, switch):
    n, langs = scores.shape
    v, back = scores[0].copy(), []
    for row in scores[1:]:
        cost = v[:, None] - switch * (1 - np.eye(langs))
        back.append(cost.argmax(axis=0))
        v = cost.max(axis=0) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], v.max()


def worth(scores, path, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_viterbi_is_the_best_path_of_every_text():
    rnd = np.random.default_rng(4)
    per = np.array([0, 5, 1, 0, 40, 12, 12, 3])
    scores = rnd.normal(size=(per.sum(), 3)) * 3
    got = G.viterbi(scores, per, 2.5)
    at = 0
    for n in per:
        if n:
            own = scores[at:at + n]
            path, best = one_viterbi(own, 2.5)
            assert np.isclose(worth(own, got[at:at + n], 2.5), best) and list(got[at:at + n]) == path
        at += n


def brute_buckets(word):
    raw, out = ("\n" + word.lower() + "\n").encode(), []
    for k in G.ORDERS:
        for i in range(len(raw) - k + 1):
            g = raw[i:i + k]
            if b"\n" in g[1:-1] or (k == 1 and g == b"\n") or g == b"\n\n":
                continue
            out.append(((int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 + k * 0x632BE59BD9B4E019) % (1 << 64)) >> 49)
    return sorted(out)


def test_grams_of_a_word():
    w = G.Words(pa.array(["Été a 123", None, "été ab"]))
    assert w.per_text.tolist() == [3, 0, 2] and w.n == 5
    for i, word in enumerate(["Été", "a", "123", "été", "ab"]):
        mine = sorted(int(b) for own, bs in zip(w.word_of, w.buckets) for b in bs[own == i])
        assert mine == ([] if word == "123" else brute_buckets(word))
    assert w.letters.tolist() == [3, 1, 0, 3, 2]


def test_held_out_accuracy_of_the_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = G.op4_language_viterbi(spark, SF).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in ((f"the house and the tree were with them there {i}", "en"),
                                                            (f"мы были там и это дом под небом {i}", "ru"),
                                                            (f"der baum und das haus sind nicht schön {i}", "de"))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.fit(train, F.lit(True))
    assert model.langs == ["de", "en", "ru"]
    mixed = spark.createDataFrame([(1, "the tree and the house были там и дом nicht das haus und der baum"), (2, "日本語の本"), (3, "42 !!")],
                                  "doc_id long, text string")
    got = {r.doc_id: r for r in G.identify(mixed, model, switch=4.0).collect()}
    assert [(s.start, s.words, s.lang) for s in got[1].spans] == [(0, 5, "en"), (5, 4, "ru"), (9, 6, "de")]
    assert got[2].lang_pred in model.langs  # a script of no learned language leaves all as candidates
    assert (got[3].lang_pred, got[3].score, got[3].spans) == ("und", 0.0, [])


def test_fit_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = G.fit(docs, F.lit(True), fit_rows=20)
    whole = G.fit(docs, F.lit(True))
    assert small.langs == whole.langs == ["de", "en", "es", "fr"] and not np.array_equal(small.logp, whole.logp)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = G.fit(docs, F.lit(True))
    got = G.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (3, 4, 5, 8)} == {"und"} and by[9].lang_pred == "de"
    assert by[9].spans[0].words == 30_000
    assert G.identify(no_documents(spark), model).count() == 0
    nothing = G.fit(no_documents(spark), F.lit(True))
    assert nothing.langs == [] and {r.lang_pred for r in G.identify(docs, nothing).collect()} == {"und"}
