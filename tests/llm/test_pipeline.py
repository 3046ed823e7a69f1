import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.fixtures import odd_documents
from tests.llm.test_mixing import words
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tunesift.llm import mixing

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "language ID", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    kept = {"": docs.toPandas()}
    for name, stage in P.STAGES[:4]:
        docs = P.stored(stage(spark, docs, SF), "test")
        assert docs.columns == COLUMNS
        kept[name] = docs.toPandas()
    start, mild, spoken, single, mixed = kept.values()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(start.doc_id) - set(mild.doc_id)
    assert gone and np.mean([labels[i] for i in gone if i in labels]) > 0.8  # rejects are toxic
    assert sum(labels[i] == 0 for i in gone if i in labels) <= 0.02 * sum(v == 0 for v in labels.values())
    assert set(mild.doc_id) - set(spoken.doc_id) == {i for i, t in zip(mild.doc_id, mild.text) if not any(c.isalpha() for c in t)}
    comp = brute_components(sorted((i, brute_fingerprint(t)) for i, t in zip(spoken.doc_id, spoken.text)))
    assert sorted(single.doc_id) == sorted(set(comp.values()))
    size = {i: words(t) for i, t in zip(single.doc_id, single.text)}
    by = single.assign(size=[size[i] for i in single.doc_id]).groupby("source")["size"].sum().sort_index()
    target = mixing.water_fill(by.tolist(), [float(k % 3 + 1) for k in range(len(by))], 3)
    got = mixed.assign(size=[size[i] for i in mixed.doc_id]).groupby("source")["size"].sum()
    for s, t, n in zip(by.index, target, by):
        assert abs(got.get(s, 0) - t) <= 0.35 * t + 0.2 * n  # documents are taken whole
    assert mixed.doc_id.value_counts().max() <= 3 and set(mixed.doc_id) <= set(single.doc_id)
    rows = P.packed(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(mixed.doc_id)
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 4096 and len(fills) <= -(-sum(fills.values()) // 4096) + 1


def test_run_is_whole_and_repeats(spark):
    a, b = (P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").toPandas() for _ in range(2))
    order = list(a.columns)
    assert len(a) and a.sort_values(order).values.tolist() == b.sort_values(order).values.tolist()


def test_odd_rows_in_every_stage(spark):
    docs = odd_documents(spark).withColumn("extra", F.lit(1))
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    left = {r.doc_id for r in P.language(spark, docs, SF).collect()}
    assert left == {1, 2, 6, 7, 9, 10, 11, None}
    single = [r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()]
    assert 2 not in single and {1, 3, None} <= set(single) and not {4, 5} & set(single)
    assert single.count(11) == 1
    for _, stage in P.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = "the same few words of one document that is copied and copied again"
    rows = [(5, text, "en", "a", 1, i, -i, "k") for i in range(30)] + [(None, text, "en", "a", 1, 100, 0, "k")] * 9 + [(None, "another text without an id", "en", "b", 1, 200, 0, "k")] * 8 \
        + [(7, "a third text", "en", "b", 1, 300, 0, "k"), (9, "a fourth one of other words", "en", "c", 1, 400, 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key long, _row long, _Times string")
    out = P.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(5, text), (0, "another text without an id"), (7, "a third text"), (9, "a fourth one of other words")])
    mixed = P.mixture(spark, out, SF)
    assert mixed.columns == docs.columns and {r["_Times"] for r in mixed.collect()} == {"k"}
    for stage in (P.toxic, P.language):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() == len(rows)
