"""Model queries (D7, D12, D13, E11, E13, F1-F13) and cluster profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunesift.config import VARIANTS, BlockSpec
from tunesift.functions import coerce, text
from tunesift.operators import clean
from tunesift.operators import dictionary as DC
from tunesift.operators import evaluation as EV
from tunesift.operators import features as FE
from tunesift.operators import models as MD
from tunesift.operators import profile as P
from tunesift.operators import search as S
from tunesift.operators import similarity as SIM
from tunesift.operators import sparse_kmeans as KM
from tunesift.operators import vector_index as IVF
from tunesift.plans.q_catalog import PRIMARY_SQL
from tunesift.plans.q_features import QUERY_PICK_SQL, query_rows
from tunesift.plans.q_similarity import CAND_SQL, DENSE_SEEDS, KFETCH, REC, SEEDS_SQL, content_rows, sample_seeds
from tunesift.plans.artifacts import stored_meta
from tunesift.plans.registry import register
from tunesift.session import scratch_path
from tunesift.plans.sqlfrag import CATALOG, GENRE_TOKENS, META, with_
from tunesift.plans.sqlfrag_features import block_ctes, content_ctes
from tunesift.sources import fixtures as fx
from tunesift.sources.tables import table

K_REC = 100
K_LAB = 12
# a deterministic cluster id both engines compute (so profiles have an oracle)
CL_SQL = "CAST(('0x' || substr(md5(track_id), 1, 6)) AS INTEGER) % 12"


def _cluster_col():
    return (F.conv(F.substring(F.md5("track_id"), 1, 6), 16, 10).cast("int") % 12).alias("cluster")


def meta_clustered(spark, sf):
    m = stored_meta(spark, sf)
    return m.withColumn("cluster", _cluster_col())


MC = with_(META) + f""",
 mc AS (SELECT *, {CL_SQL} AS cluster FROM meta)"""


# ---- K-Means -------------------------------------------------------------------------

_FITTED: dict[tuple, object] = {}


def _fitted(spark, key, fit):
    """Fitted models are reused within a session (train once, serve many); the key's second part is the source folder."""
    from tunesift.plans.artifacts import _LOCK, source_stamp
    from tunesift.session import ensure_checkpoint_dir
    k = (ensure_checkpoint_dir(spark), source_stamp(spark, key[1])) + key
    with _LOCK:
        if k not in _FITTED:
            _FITTED[k] = fit()
        return _FITTED[k]


def _coded(spark, sf):
    """(catalogue, content keys, index rows with their keys as numbers), the rows written once."""
    from tunesift.plans.artifacts import content_artifact, stored_once
    a = content_artifact(spark, sf)
    keys = MD.vector_keys(a.model)
    return a.meta, keys, stored_once(spark, "coded", (sf,), lambda: MD.coded_rows(a.index_rows(), keys))


def _fit_kmeans(spark, sf, k=K_REC):
    meta, keys, coded = _coded(spark, sf)
    return meta, keys, coded, _fitted(spark, ("kmeans", sf, k), lambda: KM.fit(coded, len(keys), k))


@register("f1_kmeans_fit", with_(META) + " SELECT track_id, true AS nearest FROM meta")
def f1_kmeans_fit(spark, sf):
    """K-Means k=100 (recommender setting) on the unit content vectors: every
    track's cluster is one whose centre is nearest to its index row."""
    _, _, coded, centres = _fit_kmeans(spark, sf)
    return MD.check_nearest(coded, KM.assign(coded, centres, keep=("at", "vals")), centres)


@register("f1_kmeans_centres", None)
def f1_kmeans_centres(spark, sf):
    """The fitted centres' entries, clusters numbered by size (largest first)."""
    _, keys, coded, centres = _fit_kmeans(spark, sf)
    path = scratch_path(spark, f"kmeans_centres/{uuid.uuid4().hex[:12]}")
    KM.save(spark, centres, keys, path)
    size = KM.assign(coded, centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # one row a cluster
    place = size.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "cluster")))
    return spark.read.parquet(f"{path}/centres").join(F.broadcast(place), "cluster").select("place", "size", "key", F.round("value", 6).alias("value"))


@register("f3_predict_query_cluster", with_(META) + f" SELECT track_id, true AS nearest FROM meta WHERE track_id IN {QUERY_PICK_SQL}")
def f3_predict_query_cluster(spark, sf):
    from tunesift.plans.artifacts import content_artifact
    meta, keys, _, centres = _fit_kmeans(spark, sf)
    model = content_artifact(spark, sf).model
    q = MD.coded_rows(SIM.index_rows(FE.transform_rows(model, query_rows(meta))), keys)
    return MD.check_nearest(q, KM.assign(q, centres), centres)


@register("f2_kmeans_assign", """
 WITH cen AS (SELECT label AS cluster, i, avg(CAST(embedding[i] AS DOUBLE)) AS e FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
 d AS (SELECT x.vec_id, cen.cluster, sum(pow(CAST(x.embedding[cen.i] AS DOUBLE) - cen.e, 2)) AS sq FROM embeddings x, cen
       GROUP BY x.vec_id, cen.cluster)
 SELECT vec_id, CAST(arg_min(cluster, (sq, cluster)) AS INT) AS cluster, round(min(sq), 6) AS sq_dist FROM d GROUP BY vec_id""")
def f2_kmeans_assign(spark, sf):
    emb = table(spark, sf, "embeddings")
    cen = MD.label_centroids(emb, "label", "embedding", 64)
    a = MD.kmeans_assign_dense(emb, cen)
    return a.select("vec_id", F.col("cluster").cast("int"), F.round("sq_dist", 6).alias("sq_dist"))


@register("f4_silhouette_sampled", """
 WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 6000),
 sz AS (SELECT label, count(*) AS n FROM s GROUP BY label),
 pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS md,
          sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS sd
        FROM s a, s b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
 ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN sd END) AS sa, min(CASE WHEN la <> lb THEN md END) AS b FROM pd GROUP BY vec_id, la),
 sv AS (SELECT ab.vec_id, CASE WHEN sz.n > 1 THEN ((b - coalesce(sa, 0) / (sz.n - 1)) / greatest(coalesce(sa, 0) / (sz.n - 1), b)) ELSE 0 END AS s
        FROM ab JOIN sz ON sz.label = ab.la)
 SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM sv""")
def f4_silhouette_sampled(spark, sf):
    emb = table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")
    s = MD.silhouette_sampled(spark, emb, "cluster", "embedding", "vec_id", 6000)
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


@register("f5_silhouette_full", """
 WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
 c0 AS (SELECT label, i, count(*) AS n, sum(v[i]) AS y FROM u, range(1, 65) r(i) GROUP BY label, i),
 c AS (SELECT label, max(n) AS n, list(y ORDER BY i) AS y FROM c0 GROUP BY label),
 psi AS (SELECT label, sum(list_dot_product(v, v)) AS p FROM u GROUP BY label),
 d AS (SELECT u.vec_id, u.label AS own, c.label AS other, c.n,
         list_dot_product(u.v, u.v) + psi.p / c.n - 2 * list_dot_product(u.v, c.y) / c.n AS dist
       FROM u, c JOIN psi ON psi.label = c.label),
 ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN dist * n / (n - 1) END) AS a,
          min(CASE WHEN own <> other THEN dist END) AS b FROM d GROUP BY vec_id)
 SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette_sq_euclid FROM ab""")
def f5_silhouette_full(spark, sf):
    emb = table(spark, sf, "embeddings")
    vec = MD.dense_unit_vectors(emb).join(emb.select("vec_id", F.col("label").alias("cluster")), "vec_id")
    val = MD.silhouette_full(vec, "cluster")
    return spark.createDataFrame([(round(float(val), 6),)], "silhouette_sq_euclid double")


# ---- forests and the leaf space --------------------------------------------------------

# forests of the registered queries; README has the time that deeper and larger ones take
RF_TREES, RF_GENRE_TREES, RF_DEPTH = 20, 30, 30
LEAF_VIEW = (1992, 1998)


def _rf_artist(spark, sf):
    from tunesift.plans.artifacts import content_artifact, stored_once
    a = content_artifact(spark, sf)
    meta, model = a.meta, a.model
    # read by the fit and by every prediction
    raw = stored_once(spark, "forest_rows", (sf,), lambda: MD.content_vectors(model, meta, normalize=False, keep=("artist_name",)))
    rf = _fitted(spark, ("rf_artist", sf, RF_TREES, RF_DEPTH), lambda: MD.rf_fit(raw, "artist_name", RF_TREES, RF_DEPTH, 1))
    return meta, model, raw, rf


@register("f6_rf_artist_fit", with_(META) + """
 SELECT count(*) AS rows, count(DISTINCT artist_name) AS labels, true AS known_labels, true AS beats_majority FROM meta""")
def f6_rf_artist_fit(spark, sf):
    """Every track is predicted an artist of the catalogue, more often the right one than the most frequent."""
    meta, _, raw, rf = _rf_artist(spark, sf)
    p = MD.predicted_labels(rf, raw).select("track_id", "artist_name", "predicted")
    counts = meta.groupBy("artist_name").agg(F.count(F.lit(1)).alias("n"))
    majority = counts.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("labels"))
    # one prediction of each track serves both measures
    seen = p.groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("artist_name") == F.col("predicted")).alias("hits"))
    seen = seen.join(counts.select(F.col("artist_name").alias("predicted"), F.lit(True).alias("known")), "predicted", "left")
    one = seen.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count_if(F.col("known").isNull()).alias("strange"))
    return one.crossJoin(majority).select(
        "rows", "labels", (F.col("strange") == 0).alias("known_labels"), (F.col("hits") > F.col("most")).alias("beats_majority"))


@register("f6_artist_predictions", None)
def f6_artist_predictions(spark, sf):
    """The artist that the forest gives each track, beside its own."""
    _, _, raw, rf = _rf_artist(spark, sf)
    return MD.predicted_labels(rf, raw).select("track_id", "artist_name", "predicted")


def _leaves(spark, sf):
    """Leaf rows (track_id, the leaf of every tree) of the stored artist forest, written once."""
    from tunesift.plans.artifacts import stored_once
    _, _, raw, rf = _rf_artist(spark, sf)
    return stored_once(spark, "leaves", (sf, RF_TREES, RF_DEPTH), lambda: MD.leaf_rows(rf.transform(raw)))


@register("f7_leaf_embedding", with_(META) + f"""
 SELECT track_id, CAST({RF_TREES} AS BIGINT) AS n_leaves, CAST({RF_TREES} AS BIGINT) AS n_trees, 1.0 AS norm FROM meta""")
def f7_leaf_embedding(spark, sf):
    """One leaf of every tree per track, as a unit row of the leaf space."""
    tree = F.transform("keys", lambda key: F.substring_index(key, ":", 1))
    # one row a track: counted and normed where it stands
    return MD.leaf_index(_leaves(spark, sf), RF_TREES).select(
        "track_id", F.size("keys").cast("long").alias("n_leaves"), F.size(F.array_distinct(tree)).cast("long").alias("n_trees"),
        F.round(F.sqrt(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def _of_tracks(idx, tracks):
    """The index rows of some tracks, counted and broadcast while they are few."""
    kept, hint = SIM.small_side(tracks.select("track_id").distinct())
    return idx.join(hint(kept), "track_id", "left_semi")


@register("e11_knn_leaf", with_(META) + f"""
 SELECT track_id AS seed_id, CAST(10 AS BIGINT) AS n, true AS exact FROM {SEEDS_SQL} s""")
def e11_knn_leaf(spark, sf):
    """Ten neighbours per seed; every score is the share of trees in which both
    have the same leaf, counted again from the leaf rows."""
    leaves = _leaves(spark, sf)
    idx = MD.leaf_index(leaves, RF_TREES)
    nn, hint = SIM.small_side(MD.knn_leaf(spark, idx, _of_tracks(idx, sample_seeds(stored_meta(spark, sf))), 10).select("seed_id", "track_id", "score"))
    own = leaves.select(F.col("track_id").alias("seed_id"), F.col("leaf").alias("own")).join(hint(nn), "seed_id")
    both = leaves.join(hint(own), "track_id")
    alike = F.size(F.filter(F.zip_with("own", "leaf", lambda a, b: a == b), lambda same: same))
    again = both.select("seed_id", "score", (alike / RF_TREES).alias("share"))
    return again.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), F.every(F.abs(F.col("score") - F.col("share")) < 1e-9).alias("exact"))


@register("e9_recommend_leaf", with_(META) + f"""
 SELECT track_id AS seed_id, true AS some, true AS in_view, true AS above_threshold
 FROM meta WHERE track_id IN {QUERY_PICK_SQL}""")
def e9_recommend_leaf(spark, sf):
    """E9 in the leaf space of the artist forest (whose neighbours share an
    artist, so artists may repeat): recommendations of the query track exist,
    inside the view and above the threshold."""
    meta = stored_meta(spark, sf)
    idx = MD.leaf_index(_leaves(spark, sf), RF_TREES)
    cands = MD.knn_leaf(spark, idx, _of_tracks(idx, query_rows(meta)), KFETCH, exclude_self=False).drop("rank")
    years = LEAF_VIEW
    recs = SIM.finish_recommendations(cands, meta, S.filter_year(meta, *years), REC.top_k, REC.score_threshold, False)
    return recs.groupBy("seed_id").agg(
        (F.count(F.lit(1)) > 0).alias("some"),
        F.every(F.col("release_year").between(*years)).alias("in_view"), F.every(F.col("score") >= REC.score_threshold).alias("above_threshold"))


@register("g10_evaluate_model_leaf", """
 SELECT m AS metric, true AS valid FROM (SELECT unnest(['Precision@K', 'Recall@K', 'F1@K', 'MAP@K', 'NDCG@K', 'Artist-Diversity', 'Coverage']) AS m) t""")
def g10_evaluate_model_leaf(spark, sf):
    """G10 in the leaf space: every mean lies between 0 and 1."""
    meta = stored_meta(spark, sf)
    idx = MD.leaf_index(_leaves(spark, sf), RF_TREES)
    seeds = sample_seeds(meta)
    nn = MD.knn_leaf(spark, idx, _of_tracks(idx, seeds), 10).checkpoint(eager=True)
    per = EV.per_seed_metrics(EV.flag_recommendations(nn, meta, "artist"), EV.relevant_counts(spark, meta, seeds, "artist"), 10)
    return EV.evaluate(per, EV.coverage(nn, meta)).select("metric", F.col("value").between(0, 1).alias("valid"))


@register("f8_leaf_query", with_(META) + f"""
 SELECT track_id, CAST({RF_TREES} AS BIGINT) AS n_leaves, true AS known, 1.0 AS norm FROM meta WHERE track_id IN {QUERY_PICK_SQL}""")
def f8_leaf_query(spark, sf):
    """The query track's leaves: all seen in training, of norm one."""
    meta, model, raw, rf = _rf_artist(spark, sf)
    known, _ = SIM.small_side(MD.leaf_long(_leaves(spark, sf)).select("tree", "leaf").distinct())  # read twice
    q = MD.content_vectors(model, query_rows(meta), normalize=False)
    v = MD.leaf_query(rf.transform(q).select("track_id", "leaves"), known)
    seen = known.select(F.concat_ws(":", "tree", "leaf").alias("key")).distinct().withColumn("seen", F.lit(True))
    return v.join(seen, "key", "left").groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_leaves"), F.every(F.coalesce("seen", F.lit(False))).alias("known"),
        F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"))


LAB_G = BlockSpec("lg", "artist_genres", (1, 2), 2, 0.95, None, "plain")
LAB_T = BlockSpec("lt", "track_name", (1, 2), 3, 0.95, None, "plain")
ARTIST_MIN_FREQ = 10
INFREQUENT = "__infrequent__"


def lab_table(spark, sf):
    """Lab input, written once: its features and labels read it many times."""
    from tunesift.plans.artifacts import stored_once
    return stored_once(spark, "lab_table", (sf,), lambda: _lab_table(spark, sf))


def _lab_table(spark, sf):
    """Lab input: text null -> '', year from the 4-digit prefix with the median
    for unknown years, explicit 0/1, popularity coerced."""
    c = fx.catalog(spark, sf)
    t = c.select("track_id", *[text.null_to_empty(x).alias(x) for x in ("artist_genres", "artist_name", "track_name")],
                 coerce.coerce_int_zero("popularity").cast("double").alias("popularity"),
                 coerce.year_prefix("release_date").alias("release_year"),
                 coerce.explicit_flag("explicit", c.schema["explicit"].dataType).alias("explicit_num"))
    return clean.impute_median(t, "release_year")


def lab_features(spark, sf):
    """Unweighted genre and title TF-IDF (lab patterns), one-hot artist
    with rare names bundled (D7), z-scored popularity / year / explicit; no
    row norm.  Long form (track_id, key, value)."""
    lab = lab_table(spark, sf)
    n = lab.agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for spec, pat in ((LAB_G, text.LAB_GENRE_TOKEN), (LAB_T, text.LAB_TITLE_TOKEN)):
        _, w = FE.fit_block(lab, spec, "track_id", n, pattern=pat)
        parts.append(w.select("track_id", F.concat(F.lit(spec.name + ":"), "term").alias("key"), F.col("weight").alias("value")))
    cat = clean.bundle_rare(lab.select("track_id", "artist_name"), "artist_name", ARTIST_MIN_FREQ, INFREQUENT, "cat")
    parts.append(cat.select("track_id", F.concat(F.lit("r:"), "cat").alias("key"), F.lit(1.0).alias("value")))
    st = lab.agg(*[x for c in ("popularity", "release_year", "explicit_num") for x in (
        F.avg(F.col(c).cast("double")).alias(f"{c}_m"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_s"))])
    z = lab.crossJoin(F.broadcast(st))
    for c in ("popularity", "release_year", "explicit_num"):
        sd = F.when(F.coalesce(F.col(f"{c}_s"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"{c}_s"))
        parts.append(z.select("track_id", F.lit("n:" + c).alias("key"), ((F.col(c) - F.col(f"{c}_m")) / sd).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("value") != 0)


def _lab_sql():
    lab = with_(CATALOG) + """,
 lab0 AS (SELECT track_id, coalesce(artist_genres, '') AS artist_genres, coalesce(artist_name, '') AS artist_name,
   coalesce(track_name, '') AS track_name, CAST(popularity AS DOUBLE) AS popularity,
   CAST(TRY_CAST(nullif(regexp_extract(release_date, '^(\\d{4})', 1), '') AS INT) AS DOUBLE) AS yr, explicit AS explicit_num FROM catalog),
 lab AS (SELECT track_id, artist_genres, artist_name, track_name, popularity, coalesce(yr, (SELECT median(yr) FROM lab0)) AS release_year,
   explicit_num FROM lab0)"""
    g = block_ctes(LAB_G, "lab", "track_id", "[a-zA-ZäöüÄÖÜß\\\\-]+")
    t = block_ctes(LAB_T, "lab", "track_id", "[a-zA-Z0-9äöüÄÖÜß\\\\-]+")
    num = " UNION ALL ".join(
        f"SELECT track_id, 'n:{c}' AS key, ({c} - (SELECT avg({c}) FROM lab)) / (SELECT CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM lab) AS value FROM lab"
        for c in ("popularity", "release_year", "explicit_num"))
    return lab + g + t + f""",
 ac AS (SELECT artist_name, count(*) AS n FROM lab GROUP BY artist_name),
 lf AS (SELECT track_id, 'lg:' || term AS key, weight AS value FROM w_lg UNION ALL
   SELECT track_id, 'lt:' || term, weight FROM w_lt UNION ALL
   SELECT track_id, 'r:' || CASE WHEN ac.n < {ARTIST_MIN_FREQ} THEN '{INFREQUENT}' ELSE lab.artist_name END, 1.0 FROM lab JOIN ac USING (artist_name) UNION ALL
   {num})"""


@register("d12_lab_features", _lab_sql() + " SELECT track_id, key, round(value, 6) AS value FROM lf WHERE value <> 0")
def d12_lab_features(spark, sf):
    return lab_features(spark, sf).select("track_id", "key", F.round("value", 6).alias("value"))


@register("d7_onehot_min_freq", with_(CATALOG) + f""",
 a AS (SELECT track_id, coalesce(artist_name, '') AS artist_name FROM catalog),
 c AS (SELECT artist_name, count(*) AS n FROM a GROUP BY artist_name),
 b AS (SELECT track_id, CASE WHEN n < {ARTIST_MIN_FREQ} THEN '{INFREQUENT}' ELSE artist_name END AS cat FROM a JOIN c USING (artist_name))
 SELECT track_id, cat, CAST(dense_rank() OVER (ORDER BY cat) - 1 AS INT) AS cat_index,
   CAST(dense_rank() OVER (ORDER BY cat) AS BIGINT) AS hot_place, 1.0 AS hot_sum FROM b""")
def d7_onehot_min_freq(spark, sf):
    """Rare artists bundled, then numbered in the order of their names and
    one-hot encoded; unseen categories map to the all-zero vector."""
    a = fx.catalog(spark, sf).select("track_id", text.null_to_empty("artist_name").alias("artist_name"))
    b = clean.bundle_rare(a, "artist_name", ARTIST_MIN_FREQ, INFREQUENT, "cat")
    codes = DC.dictionary(b, "cat")
    hot = DC.encode(b, "cat", codes, "cat_index").withColumn("hot", DC.one_hot("cat_index", codes.count()))
    return hot.select("track_id", "cat", F.col("cat_index").cast("int"), (F.col("hot.indices")[0] + 1).alias("hot_place"),
                      F.aggregate("hot.values", F.lit(0.0), lambda a, x: a + x).alias("hot_sum"))


def _variants_sql():
    """Each variant's counts from its own fit (a subquery with CTEs of its own)."""
    parts = [f"SELECT * FROM ({with_(META)}{content_ctes(cfg)} SELECT '{name}' AS variant, count(DISTINCT track_id) AS rows, "
             f"count(*) AS nonzeros, count(DISTINCT key) AS keys, round(sum(value * value), 3) AS squares FROM cv) v_{i}"
             for i, (name, cfg) in enumerate(VARIANTS.items())]
    return " UNION ALL ".join(parts)


@register("d13_feature_variants", _variants_sql())
def d13_feature_variants(spark, sf):
    """The three named variants: one fit each, summarised per variant."""
    meta = stored_meta(spark, sf)
    rows = None
    for name, cfg in VARIANTS.items():
        m = FE.fit_content(meta, cfg, unique=True)
        # one row per id: the first entry stands for it
        entry = F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("vals").alias("value"))).alias("place", "e")
        per = m.index_rows().select("track_id", entry).groupBy("e.key").agg(
            F.count(F.lit(1)).alias("n"), F.count_if((F.col("place") == 0) & F.col("track_id").isNotNull()).alias("firsts"),
            F.sum(F.col("e.value") * F.col("e.value")).alias("sq"))
        s = per.agg(F.coalesce(F.sum("firsts"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("nonzeros"),
                    F.count("key").alias("keys"), F.round(F.sum("sq"), 3).alias("squares")) \
             .select(F.lit(name).alias("variant"), "*")
        rows = s if rows is None else rows.unionByName(s)
    return rows


def lab_vectors(spark, sf):
    """D12 as ML ``SparseVector`` rows over a joined dictionary of keys: no part of the vocabulary passes through the driver."""
    coded, features = _lab_coded(spark, sf)
    path = scratch_path(spark, f"lab_vectors/{uuid.uuid4().hex[:12]}")
    return MD.sparse_vectors(coded, features, path)


def genre_split(spark, sf):
    """(track_id, y, split): the bundled primary genre of each track and its side, written once, so that no vector
    is carried through the counts and windows of either."""
    from tunesift.plans.artifacts import stored_once

    def make():
        genres = lab_table(spark, sf).filter(F.col("track_id").isNotNull()).select("track_id", text.primary_genre("artist_genres").alias("y"))
        return MD.stratified_split(clean.bundle_rare(genres, "y", 20), "y", "track_id", 0.2).select("track_id", "y", "split")
    return stored_once(spark, "genre_split", (sf,), make)


F9_SQL = with_(CATALOG) + f""",
 y0 AS (SELECT track_id, {PRIMARY_SQL} AS label FROM catalog),
 n AS (SELECT label, count(*) AS c FROM y0 GROUP BY label),
 y AS (SELECT track_id, CASE WHEN c < 20 THEN 'other' ELSE y0.label END AS y FROM y0 JOIN n USING (label)),
 sp AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || track_id), track_id)
     <= round(count(*) OVER (PARTITION BY y) * 0.2) AS test FROM y),
 t AS (SELECT y AS label, count(*) AS support FROM sp WHERE test GROUP BY y)
 SELECT label, support, true AS valid FROM t
 UNION ALL SELECT 'accuracy', sum(support), true FROM t"""


def _genre_report(spark, sf):
    """Lab features + forest on the bundled primary genre (Q15: genres are also
    features), fitted on four fifths of each class: the report on the others, written once."""
    from tunesift.plans.artifacts import stored_once

    def make():
        split = lab_vectors(spark, sf).join(genre_split(spark, sf), "track_id")
        model = MD.rf_fit(split.filter(F.col("split") == "train"), "y", RF_GENRE_TREES, RF_DEPTH, 2)
        p = MD.predicted_labels(model, split.filter(F.col("split") == "test")).select(F.col("y").alias("actual"), "predicted")
        return MD.classification_report(p)
    return stored_once(spark, "genre_report", (sf, RF_GENRE_TREES, RF_DEPTH), make)


@register("f9_genre_report", None)
def f9_genre_report(spark, sf):
    """F11 of the fitted genre model: precision, recall, F1 and support of each class, accuracy and averages."""
    return _genre_report(spark, sf).select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("f9_rf_genre_fit", F9_SQL)
def f9_rf_genre_fit(spark, sf):
    """The report's classes and their support, with scores between 0 and 1, and
    an accuracy above the share of the most frequent class."""
    rep = _genre_report(spark, sf)
    classes = rep.filter(~F.col("label").isin("accuracy", "macro avg", "weighted avg") & (F.col("support") > 0))
    most = classes.agg(F.max("support").alias("most"))
    inside = lambda c: F.col(c).between(0, 1)
    return classes.select("label", "support", (inside("precision") & inside("recall") & inside("f1")).alias("valid")).unionByName(
        rep.filter("label = 'accuracy'").crossJoin(most).select("label", "support", (F.col("f1") > F.col("most") / F.col("support")).alias("valid")))


PRED_SQL = """ pred AS (SELECT d.doc_id, quality AS actual, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _pred(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id").select("doc_id", F.col("quality").alias("actual"),
                                      F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted"))


@register("f10_stratified_split", "WITH" + PRED_SQL + """
 SELECT doc_id, actual, CASE WHEN row_number() OVER (PARTITION BY actual ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
     <= round(count(*) OVER (PARTITION BY actual) * 0.2) THEN 'test' ELSE 'train' END AS split FROM pred""")
def f10_stratified_split(spark, sf):
    return MD.stratified_split(_pred(spark, sf), "actual", "doc_id", 0.2).select("doc_id", "actual", "split")


@register("f11_classification_report", "WITH" + PRED_SQL + """,
 cm AS (SELECT actual, predicted, count(*) AS c FROM pred GROUP BY ALL),
 a AS (SELECT actual AS label, sum(c) AS support, sum(CASE WHEN actual = predicted THEN c ELSE 0 END) AS tp FROM cm GROUP BY actual),
 p AS (SELECT predicted AS label, sum(c) AS npred FROM cm GROUP BY predicted),
 per0 AS (SELECT CAST(coalesce(a.label, p.label) AS VARCHAR) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
   coalesce(npred, 0) AS npred FROM a FULL OUTER JOIN p ON a.label = p.label),
 per1 AS (SELECT label, support, tp, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per0),
 per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per1),
 tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
   sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per)
 SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per
 UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 6), CAST(n AS BIGINT) FROM tot
 UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM tot
 UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), CAST(n AS BIGINT) FROM tot""")
def f11_classification_report(spark, sf):
    r = MD.classification_report(_pred(spark, sf))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long"))


@register("f12_confusion_matrix", "WITH" + PRED_SQL + """
 SELECT actual, predicted, count(*) AS count FROM pred GROUP BY actual, predicted""")
def f12_confusion_matrix(spark, sf):
    return MD.confusion_matrix(_pred(spark, sf))


def projected(spark, sf):
    """(track_id, x, y) of the catalogue, written once."""
    from tunesift.plans.artifacts import stored_once
    _, model, rows = content_rows(spark, sf)
    return stored_once(spark, "projection", (sf,), lambda: MD.project_2d(rows, MD.vector_keys(model)))


@register("f13_coordinates", None)
def f13_coordinates(spark, sf):
    """Each track's place in the two-dimensional map of the catalogue."""
    return projected(spark, sf).select("track_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@register("f13_project_2d", with_(META) + " SELECT count(*) AS rows, true AS orthogonal, true AS ordered FROM meta")
def f13_project_2d(spark, sf):
    """Every track has two coordinates; the columns are orthogonal (as left
    singular vectors are) and the first carries more of the data."""
    d = lambda a, b: F.sum(F.col(a) * F.col(b))
    return projected(spark, sf).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("rows"), d("x", "x").alias("xx"),
                                    d("y", "y").alias("yy"), d("x", "y").alias("xy")).select(
        "rows", (F.abs(F.col("xy")) < 1e-3 * F.sqrt(F.col("xx") * F.col("yy"))).alias("orthogonal"), (F.col("xx") >= F.col("yy")).alias("ordered"))


@register("e13_knn_approx", f"""
 SELECT CAST(vec_id AS VARCHAR) AS seed_id, CAST(10 AS BIGINT) AS n, true AS recalled, true AS few FROM embeddings WHERE {DENSE_SEEDS}""")
def e13_knn_approx(spark, sf):
    """Ten neighbours of every seed from the inverted file; whether they hold at
    least nine in ten of the exact ones (E12) over all seeds, and whether under
    5 % of all seed x item pairs were compared exactly."""
    emb = table(spark, sf, "embeddings")
    picked = emb.filter(DENSE_SEEDS)
    found = _ivf_search(spark, sf, emb, picked)
    nn = found.neighbours.select("seed_id", "vec_id").checkpoint(eager=True)
    exact = SIM.knn_dense(spark, emb, picked, 10).select("seed_id", "vec_id").checkpoint(eager=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(exact.join(nn, ["seed_id", "vec_id"], "left_semi"), "hits")
    for other in (count(exact, "wanted"), count(found.candidates, "compared"), count(picked, "seeds"), count(emb, "items")):  # one row each
        one = one.crossJoin(other)
    said = one.select((F.col("hits") >= 0.9 * F.col("wanted")).alias("recalled"), (F.col("compared") < 0.05 * F.col("seeds") * F.col("items")).alias("few"))
    return nn.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(said))


def _ivf_search(spark, sf, emb, picked, k=10):
    from tunesift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, f"ivf/{uuid.uuid4().hex[:12]}")
    return IVF.search(IVF.build(emb, f"{base}/index", k), picked, f"{base}/search", k)


@register("e13_knn_neighbours", None)
def e13_knn_neighbours(spark, sf):
    """The neighbours that the inverted file finds, with their exact scores, and how many items each seed's cells held."""
    emb = table(spark, sf, "embeddings")
    found = _ivf_search(spark, sf, emb, emb.filter(DENSE_SEEDS))
    return found.neighbours.join(found.probes.select("seed_id", "probed"), "seed_id") \
        .select("seed_id", "vec_id", SIM.rounded("score").alias("score"), F.col("rank").cast("int"), "probed")


def fitted_clusters(spark, sf):
    """The catalogue with the cluster that F1 assigns, written once."""
    from tunesift.plans.artifacts import stored_once

    def make():
        meta, _, coded, centres = _fit_kmeans(spark, sf)
        return meta.join(KM.assign(coded, centres).select("track_id", "cluster"), "track_id")
    return stored_once(spark, "clusters", (sf, K_REC), make)


@register("f1_kmeans_lab", with_(CATALOG) + " SELECT count(*) AS rows, true AS few, true AS nearest FROM catalog")
def f1_kmeans_lab(spark, sf):
    """K-Means k=12 (lab setting) on the lab features, whose vocabulary has no bound: every track
    has one of at most twelve clusters, with the nearest centre."""
    coded, features, centres = _lab_kmeans(spark, sf)
    found = KM.assign(coded, centres, keep=("at", "vals"))
    nearest = MD.check_nearest(coded, found, centres).agg(F.every("nearest").alias("nearest"))
    return found.agg(F.count("cluster").alias("rows"), (F.count_distinct("cluster") <= K_LAB).alias("few")).crossJoin(nearest)


def _lab_coded(spark, sf):
    """Lab features as coded rows, written once, and their number of keys."""
    from tunesift.plans.artifacts import stored_once
    entries = lambda: stored_once(spark, "lab_long", (sf,), lambda: lab_features(spark, sf))  # noqa: E731  read for the keys' numbers and again for the rows
    coded = stored_once(spark, "lab_coded", (sf,), lambda: MD.coded_long(entries())[0])
    return coded, 1 + (coded.agg(F.max(F.array_max("at"))).first()[0] or 0)


def _lab_kmeans(spark, sf):
    coded, features = _lab_coded(spark, sf)
    return coded, features, _fitted(spark, ("kmeans_lab", sf, K_LAB), lambda: KM.fit(coded, features, K_LAB))


@register("f4_silhouette_fitted", None)
def f4_silhouette_fitted(spark, sf):
    """The sampled silhouette of the fitted clusters: the recommender's (k = 100) and the lab's (k = 12)."""
    out = None
    _, _, coded, centres = _fit_kmeans(spark, sf)
    lab, _, lab_centres = _lab_kmeans(spark, sf)
    for name, rows, c in (("content", coded, centres), ("lab", lab, lab_centres)):
        points = KM.assign(rows, c, keep=("at", "vals")).filter(F.col("track_id").isNotNull())
        one = MD.silhouette_sampled(spark, points, "cluster", "vals", "track_id", 6000, at_col="at") \
            .select(F.lit(name).alias("space"), F.round("silhouette", 4).alias("silhouette"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("h17_fitted_profile", None)
def h17_fitted_profile(spark, sf):
    """H16 and H17 of the fitted clusters: size, share of explicit tracks, median year."""
    return P.cluster_profile(fitted_clusters(spark, sf))


@register("h18_fitted_top_genres", None)
def h18_fitted_top_genres(spark, sf):
    return P.cluster_top_genres(fitted_clusters(spark, sf), 12)


@register("h19_fitted_top_artists", None)
def h19_fitted_top_artists(spark, sf):
    return P.cluster_top_artists(fitted_clusters(spark, sf), 10)


@register("h20_fitted_year_histogram", None)
def h20_fitted_year_histogram(spark, sf):
    return P.cluster_year_histogram(fitted_clusters(spark, sf), 30)


@register("h16_h20_fitted_clusters", with_(META) + f"""
 SELECT count(*) AS rows, count(*) AS years, true AS few, true AS top_genres, true AS top_artists, true AS medians FROM meta""")
def h16_h20_fitted_clusters(spark, sf):
    """H16-H20 over the stored K-Means assignment: sizes and year histograms
    cover the catalogue, tops are within their limits and in order, medians lie
    within the catalogue's years."""
    mc = fitted_clusters(spark, sf)
    sizes = P.cluster_sizes(mc).agg(F.sum("size").alias("rows"), (F.count(F.lit(1)) <= K_REC).alias("few"))
    years = P.cluster_year_histogram(mc, 30).agg(F.sum("count").alias("years"))

    def ordered(top, most):
        w = Window.partitionBy("cluster").orderBy("rank")
        falls = F.coalesce(F.col("count") <= F.lag("count").over(w), F.lit(True)) & (F.col("rank") <= most)
        return top.select(falls.alias("ok")).agg(F.every("ok"))

    genres = ordered(P.cluster_top_genres(mc, 12), 12).toDF("top_genres")
    artists = ordered(P.cluster_top_artists(mc, 10), 10).toDF("top_artists")
    span = mc.agg(F.min("release_year").alias("lo"), F.max("release_year").alias("hi"))
    medians = P.cluster_profile(mc).crossJoin(span).agg(F.every(F.col("year_median").between(F.col("lo"), F.col("hi"))).alias("medians"))
    out = sizes
    for one in (years, genres, artists, medians):  # one row each
        out = out.crossJoin(one)
    return out.select("rows", "years", "few", "top_genres", "top_artists", "medians")


# ---- cluster profiles ------------------------------------------------------------------

@register("h16_cluster_sizes", MC + """
 SELECT cluster, count(*) AS size, count(*) / sum(count(*)) OVER () AS share,
   sum(count(*)) OVER () / count(*) OVER () AS expected_size FROM mc GROUP BY cluster""")
def h16_cluster_sizes(spark, sf):
    return P.cluster_sizes(meta_clustered(spark, sf))


@register("h17_cluster_profile", MC + """
 SELECT cluster, count(*) AS size, avg(CAST(explicit = 1 AS DOUBLE)) AS explicit_share,
   CAST(trunc(quantile_cont(release_year, 0.5)) AS INT) AS year_median FROM mc GROUP BY cluster""")
def h17_cluster_profile(spark, sf):
    return P.cluster_profile(meta_clustered(spark, sf))


@register("h18_cluster_top_genres", MC + GENRE_TOKENS + """,
 gc AS (SELECT mc.cluster, g.genre, count(*) AS count FROM genre_tok g JOIN mc USING (track_id) GROUP BY mc.cluster, g.genre)
 SELECT * FROM (SELECT cluster, genre, count, CAST(row_number() OVER (PARTITION BY cluster ORDER BY count DESC, genre) AS INT) AS rank FROM gc)
 WHERE rank <= 12""")
def h18_cluster_top_genres(spark, sf):
    return P.cluster_top_genres(meta_clustered(spark, sf), 12)


@register("h19_cluster_top_artists", MC + """
 SELECT * FROM (SELECT cluster, artist_name AS artist, count(*) AS count,
   CAST(row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, artist_name) AS INT) AS rank FROM mc GROUP BY cluster, artist_name)
 WHERE rank <= 10""")
def h19_cluster_top_artists(spark, sf):
    return P.cluster_top_artists(meta_clustered(spark, sf), 10)


@register("h20_cluster_year_histogram", MC + """,
 b AS (SELECT cluster, min(CAST(release_year AS DOUBLE)) AS lo, max(CAST(release_year AS DOUBLE)) AS hi FROM mc GROUP BY cluster)
 SELECT cluster, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((release_year - lo) / (hi - lo) * 30), 29) END AS INT) AS bin,
   count(*) AS count FROM mc JOIN b USING (cluster) GROUP BY ALL""")
def h20_cluster_year_histogram(spark, sf):
    return P.cluster_year_histogram(meta_clustered(spark, sf), 30)


N_DIV = 1000


@register("h21_diversity_curve", CAND_SQL.replace(f"LIMIT {60}", f"LIMIT {N_DIV}") + """,
 nb AS (SELECT c.track_id, m.artist_name, row_number() OVER (ORDER BY round(c.score, 4) DESC, c.track_id) AS rank
        FROM cand c JOIN meta m USING (track_id) WHERE c.track_id <> c.seed_id),
 fr AS (SELECT lower(artist_name) AS akey, min(rank) AS r FROM nb GROUP BY 1),
 nd AS (SELECT count(DISTINCT lower(regexp_replace(artist_name, '^\\s+|\\s+$', '', 'g'))) AS m FROM nb),
 ks AS (SELECT unnest([5, 10, 15, 20, 25, 30, 40, 50]) AS K),
 w AS (SELECT K, greatest((SELECT count(*) FROM fr WHERE r <= K), 1) AS unique_artists_no_div,
   greatest(least(K, (SELECT m FROM nd)), 1) AS unique_artists_div FROM ks)
 UNPIVOT w ON unique_artists_no_div, unique_artists_div INTO NAME var VALUE unique_artists""")
def h21_diversity_curve(spark, sf):
    from pyspark.sql import Window as W
    from tunesift.plans.q_similarity import _single_candidates
    meta, cands = _single_candidates(spark, sf, N_DIV)
    nb = cands.filter(F.col("seed_id") != F.col("track_id")).join(meta.select("track_id", "artist_name"), "track_id")
    # the neighbour list of one query (at most N_DIV rows) is ranked as a whole
    nb = nb.withColumn("rank", F.row_number().over(W.orderBy(SIM.rounded("score").desc(), F.col("track_id"))))
    out = P.diversity_curve(nb)
    return out.select(F.col("K").cast("int"), "var", F.col("unique_artists").cast("long"))


@register("h22_cluster_compactness", """
 WITH p AS (SELECT vec_id, label AS cluster, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
 per AS (SELECT cluster, i, count(*) AS n, sum(x) AS sx FROM p GROUP BY cluster, i),
 tot AS (SELECT i, sum(n) AS tn, sum(sx) AS tx FROM per GROUP BY i),
 c AS (SELECT cluster, i, n, sx / n AS cx, CASE WHEN tn > n THEN (tx - sx) / (tn - n) END AS ox FROM per JOIN tot USING (i)),
 d AS (SELECT p.cluster, vec_id, sqrt(sum(pow(x - cx, 2))) AS di, sqrt(sum(pow(x - ox, 2))) AS dox FROM p JOIN c USING (cluster, i)
       GROUP BY p.cluster, vec_id)
 SELECT cluster, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(avg(di), 6) END AS intra, round(avg(dox), 6) AS extra FROM d GROUP BY cluster""")
def h22_cluster_compactness(spark, sf):
    """Over all 64 dimensions of the labelled vectors."""
    names = [f"x{i}" for i in range(64)]
    pts = table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return P.cluster_compactness(pts, "cluster", tuple(names)).select(
        "cluster", "n", F.round("intra", 6).alias("intra"), F.round("extra", 6).alias("extra"))
