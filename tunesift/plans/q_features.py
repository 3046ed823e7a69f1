"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunesift.config import BlockSpec, FeatureConfig
from tunesift.functions import text
from tunesift.operators import features as FE
from tunesift.plans.artifacts import stored_meta
from tunesift.plans.registry import register
from tunesift.plans.sqlfrag import CATALOG, META, with_
from tunesift.plans.sqlfrag_features import block_ctes, content_ctes, doc_sql, numeric_ctes, terms_sql
from tunesift.sources import fixtures as fx
from tunesift.sources.tables import table

CFG = FeatureConfig()
# Spark's default English stop-word list (StopWordsRemover), passed explicitly (Q23)
from tunesift.functions.stopwords import ENGLISH_STOP_WORDS  # noqa: E402

_R6 = "round({x}, 6)"


@register("d1_genre_doc", with_(META) + f" SELECT track_id, {doc_sql(CFG.blocks[0])} AS genre_doc FROM meta")
def d1_genre_doc(spark, sf):
    return stored_meta(spark, sf).select("track_id", FE.block_doc(CFG.blocks[0]).alias("genre_doc"))


def _doc_summary_sql(tok_expr: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {tok_expr} AS t FROM documents)
 SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS token_chars,
   t[1] AS first_token, t[-1] AS last_token FROM d"""


def _doc_summary(df, toks):
    return df.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").cast("int").alias("n_tokens"),
        F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("token_chars"),
        F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@register("d2a_tokenize_word", _doc_summary_sql("regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"))
def d2a_tokenize_word(spark, sf):
    return _doc_summary(table(spark, sf, "documents"), text.word_tokens("text"))


def _stop_sql():
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    return _doc_summary_sql(
        f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains([{words}], w))")


@register("d2b_tokenize_stop", _stop_sql())
def d2b_tokenize_stop(spark, sf):
    return _doc_summary(table(spark, sf, "documents"),
                        text.word_tokens("text", min_len=2, stop_words=list(ENGLISH_STOP_WORDS)))


@register("d2c_tokenize_alpha", with_(CATALOG) + """
 SELECT track_id, array_to_string(regexp_extract_all(lower(coalesce(artist_genres, '')), '[a-zA-ZäöüÄÖÜß\\\\-]+'), ' ') AS genre_tokens,
   array_to_string(regexp_extract_all(lower(coalesce(track_name, '')), '[a-zA-Z0-9äöüÄÖÜß\\\\-]+'), ' ') AS title_tokens
 FROM catalog""")
def d2c_tokenize_alpha(spark, sf):
    c = fx.catalog(spark, sf)
    return c.select("track_id",
                    F.array_join(text.word_tokens("artist_genres", text.LAB_GENRE_TOKEN), " ").alias("genre_tokens"),
                    F.array_join(text.word_tokens("track_name", text.LAB_TITLE_TOKEN), " ").alias("title_tokens"))


@register("d3_ngrams", with_(META) + f""",
 d AS (SELECT track_id, regexp_extract_all({doc_sql(CFG.blocks[0])}, '[\\p{{L}}\\p{{N}}_]+') AS t FROM meta)
 SELECT track_id, CAST(len({terms_sql('t', 1, 2)}) AS INT) AS n_terms, array_to_string({terms_sql('t', 1, 2)}, '|') AS terms FROM d""")
def d3_ngrams(spark, sf):
    m = stored_meta(spark, sf).select("track_id", FE.block_terms(CFG.blocks[0]).alias("t"))
    return m.select("track_id", F.size("t").cast("int").alias("n_terms"), F.array_join("t", "|").alias("terms"))


def _vocab_sql():
    ctes = "".join(block_ctes(s) for s in CFG.blocks)
    sel = " UNION ALL ".join(f"SELECT '{s.name}' AS block, term, df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM voc_{s.name}"
                             for s in CFG.blocks)
    return with_(META) + ctes + " " + sel


@register("d4_vocabulary", _vocab_sql())
def d4_vocabulary(spark, sf):
    m = FE.fit_content(stored_meta(spark, sf), CFG, unique=True)
    return m.vocab.select("block", "term", "df", "cf", F.round("idf", 6).alias("idf"))


def _tfidf_sql():
    ctes = "".join(block_ctes(s) for s in CFG.blocks)
    sel = " UNION ALL ".join(f"SELECT track_id, '{s.name}' AS block, term, round(weight, 6) AS weight FROM w_{s.name}"
                             for s in CFG.blocks)
    return with_(META) + ctes + " " + sel


@register("d5_tfidf", _tfidf_sql())
def d5_tfidf(spark, sf):
    m = FE.fit_content(stored_meta(spark, sf), CFG, unique=True)
    return m.weights.select("track_id", "block", "term", F.round("weight", 6).alias("weight"))


DOC_SPEC = BlockSpec("w", "text", (1, 1), 2, 0.9, 50000, "plain")


@register("d5_tfidf_documents", "WITH " + block_ctes(DOC_SPEC, "documents", "doc_id")[2:] + """
 SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max
 FROM w_w GROUP BY doc_id""")
def d5_tfidf_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    _, w = FE.fit_block(docs, DOC_SPEC, "doc_id")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
                                   F.round(F.max("weight"), 6).alias("weight_max"))


@register("d6_zscore", with_(META) + numeric_ctes() + """
 SELECT track_id, round(z_release_year, 6) AS z_release_year, round(z_explicit, 6) AS z_explicit FROM z""")
def d6_zscore(spark, sf):
    m = stored_meta(spark, sf)
    z = FE.zscore(m, FE.numeric_stats(m))
    return z.select("track_id", F.round("z_release_year", 6).alias("z_release_year"),
                    F.round("z_explicit", 6).alias("z_explicit"))


@register("d8_weighted_blocks", with_(META) + content_ctes(CFG, normalize=False) + """
 SELECT track_id, CAST(count(*) AS BIGINT) AS n_keys, round(sqrt(sum(value * value)), 6) AS raw_norm FROM cv GROUP BY track_id""")
def d8_weighted_blocks(spark, sf):
    m = FE.fit_content(stored_meta(spark, sf), CFG, unique=True)
    return m.raw_long().groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_keys"), F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("raw_norm"))


@register("d9_row_l2", with_(META) + content_ctes(CFG) + """
 SELECT track_id, key, round(value, 6) AS value FROM cv""")
def d9_row_l2(spark, sf):
    m = FE.fit_content(stored_meta(spark, sf), CFG, unique=True)
    return m.normalized_long().select("track_id", "key", F.round("value", 6).alias("value"))


# a query row: the catalogue track with the smallest md5(track_id); query weights differ (Q6)
QCFG = CFG.with_weights(genre=1.5, artist=0.5, title=0.3, numeric=1.0)
QUERY_PICK_SQL = "(SELECT track_id FROM meta ORDER BY md5(track_id), track_id LIMIT 1)"


def query_rows(m):
    """The query track (one row) picked by hash order: a one-row sample."""
    return m.orderBy(F.md5("track_id"), "track_id").limit(1)


def query_ctes(qcfg: FeatureConfig = QCFG, pick_sql: str = QUERY_PICK_SQL, name: str = "qvec",
               normalize: bool = True) -> str:
    """CTEs vectorising the picked meta rows with the fitted vocabularies
    (``voc_*``) and statistics (``st``) under the query weights ``qcfg``."""
    q = f""",
 q AS (SELECT * FROM meta WHERE track_id IN {pick_sql})"""
    parts = []
    wts = qcfg.weights()
    for s in qcfg.active_blocks():
        b = s.name
        parts.append(f""",
 qt_{b} AS (SELECT track_id, unnest({terms_sql('t', *s.ngram)}) AS term FROM (SELECT track_id, regexp_extract_all({doc_sql(s)}, '[\\p{{L}}\\p{{N}}_]+') AS t FROM q)),
 qtf_{b} AS (SELECT track_id, term, count(*) AS tf FROM qt_{b} GROUP BY track_id, term),
 qw0_{b} AS (SELECT track_id, term, tf * idf AS w FROM qtf_{b} JOIN voc_{b} USING (term)),
 qw_{b} AS (SELECT track_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY track_id)) * {wts[b]} AS value FROM qw0_{b})""")
    nw = qcfg.numeric_weight
    union = " UNION ALL ".join([f"SELECT track_id, '{s.name}:' || term AS key, value FROM qw_{s.name}" for s in qcfg.active_blocks()] +
                               [f"SELECT track_id, 'n:year', (release_year - ym) / ys * {nw} FROM q, st",
                                f"SELECT track_id, 'n:explicit', (explicit - em) / es * {nw} FROM q, st"])
    tail = f""",
 {name}_raw AS (SELECT * FROM ({union}) u(track_id, key, value))"""
    if normalize:
        tail += f""",
 {name} AS (SELECT track_id, key, value / sqrt(sum(value * value) OVER (PARTITION BY track_id)) AS value FROM {name}_raw)"""
    else:
        tail += f""",
 {name} AS (SELECT * FROM {name}_raw)"""
    return q + "".join(parts) + tail


def _query_sql(normalize: bool):
    return (with_(META) + content_ctes(CFG) + query_ctes(QCFG, normalize=normalize) +
            " SELECT track_id, key, round(value, 6) AS value FROM qvec")


def _fitted(spark, sf):
    """(meta, model) of the stored content space."""
    from tunesift.plans.artifacts import content_artifact
    a = content_artifact(spark, sf, CFG)
    return a.meta, a.model


@register("d10_query_vector", _query_sql(True))
def d10_query_vector(spark, sf):
    meta, model = _fitted(spark, sf)
    q = FE.transform_rows(model, query_rows(meta), QCFG, normalize=True)
    return q.select("track_id", "key", F.round("value", 6).alias("value"))


@register("d11_raw_query_vector", _query_sql(False))
def d11_raw_query_vector(spark, sf):
    meta, model = _fitted(spark, sf)
    q = FE.transform_rows(model, query_rows(meta), QCFG, normalize=False)
    return q.select("track_id", "key", F.round("value", 6).alias("value"))
