"""Models (F4-F13) on Spark ML, plus leaf-space kNN (E11); K-Means is in ``sparse_kmeans``, forests are in ``forest``.

Feature vectors for the estimators are built JVM-side from the fitted
vocabularies: ``CountVectorizerModel`` (term counts) -> ``ElementwiseProduct``
(idf, then block weight) -> ``Normalizer`` per block -> ``VectorAssembler``
with the z-scored numerics -> ``Normalizer``.  This reproduces the long
content table exactly as ``SparseVector`` rows; the vocabularies are bounded
by ``max_features`` (what ``CountVectorizer.fit`` would hold as well).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.config import FeatureConfig
from tunesift.operators import dictionary as DC
from tunesift.operators import features as FE
from tunesift.operators import forest as RF
from tunesift.operators import sparse_kmeans as KM
from tunesift.operators.similarity import knn_batch, small_side

MAX_VOCAB_COLLECT = 1_000_000


# ---------------------------------------------------------------------------
# vectors for Spark ML
# ---------------------------------------------------------------------------

def _vocab_list(vocab: DataFrame):
    n = vocab.count()
    if n > MAX_VOCAB_COLLECT:
        raise ValueError(f"vocabulary of {n} terms is above {MAX_VOCAB_COLLECT}; lower max_features")
    rows = vocab.select("term", "idf").orderBy("term").collect()  # bounded by max_features
    return [r["term"] for r in rows], [float(r["idf"]) for r in rows]


def content_vector_pipeline(model: FE.ContentModel, cfg: FeatureConfig | None = None,
                            normalize: bool = True, out_col: str = "features") -> PipelineModel:
    """A fitted ``PipelineModel`` turning repaired catalogue rows (with
    ``_terms_<block>`` arrays and ``_z_*`` columns, see ``prepare_ml_input``)
    into the weighted (and optionally row-normalised) content vector."""
    cfg = cfg or model.cfg
    stages, cols = [], []
    for spec in cfg.active_blocks():
        terms, idf = _vocab_list(model.vocabs[spec.name])
        b = spec.name
        w = float(cfg.weights()[b])
        stages += [CountVectorizerModel.from_vocabulary(terms, inputCol=f"_terms_{b}", outputCol=f"_tf_{b}"),
                   ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=f"_tf_{b}", outputCol=f"_ti_{b}"),
                   Normalizer(p=2.0, inputCol=f"_ti_{b}", outputCol=f"_un_{b}"),
                   ElementwiseProduct(scalingVec=Vectors.dense([w] * max(len(terms), 1)) if terms else Vectors.dense([w]),
                                      inputCol=f"_un_{b}", outputCol=f"_v_{b}")]
        cols.append(f"_v_{b}")
    cols += ["_zn_release_year", "_zn_explicit"]
    raw_col = "_raw" if normalize else out_col
    stages.append(VectorAssembler(inputCols=cols, outputCol=raw_col))
    if normalize:
        stages.append(Normalizer(p=2.0, inputCol="_raw", outputCol=out_col))
    return PipelineModel(stages)


def prepare_ml_input(model: FE.ContentModel, rows: DataFrame, cfg: FeatureConfig | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns to ``keep``, terms of each block, weighted z-scores) of the rows with an id."""
    cfg = cfg or model.cfg
    nw = float(cfg.numeric_weight)
    scored = rows.filter(F.col(model.id_col).isNotNull()).crossJoin(F.broadcast(model.stats))
    z = {f"_zn_{c}": (F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std") * nw for c in FE.NUMERIC_COLS}
    return scored.select(model.id_col, *keep, *[FE.block_terms(s).alias(f"_terms_{s.name}") for s in cfg.active_blocks()], *[c.alias(k) for k, c in z.items()])


def content_vectors(model: FE.ContentModel, rows: DataFrame, cfg: FeatureConfig | None = None,
                    normalize: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, features, the columns to ``keep``) with features a ``SparseVector`` (D9 as ML vectors)."""
    pipe = content_vector_pipeline(model, cfg, normalize)
    return pipe.transform(prepare_ml_input(model, rows, cfg, keep)).select(model.id_col, "features", *keep)


# ---------------------------------------------------------------------------
# K-Means and silhouette
# ---------------------------------------------------------------------------

def check_nearest(coded: DataFrame, assigned: DataFrame, centres: KM.SparseCentres, id_col: str = "track_id") -> DataFrame:
    """(id, nearest): whether each assigned row's cluster centre is among the nearest to it.  Rows that were assigned with
    their entries kept aren't joined with the coded ones."""
    import pyarrow as pa
    sent = coded.sparkSession.sparkContext.broadcast((centres.plain(), centres.squares))
    if {"at", "vals"} <= set(assigned.columns):
        data = assigned.filter(F.col(id_col).isNotNull()).select(id_col, "at", "vals", "cluster")
    else:
        data = coded.join(assigned.select(id_col, "cluster"), id_col).select(id_col, "at", "vals", "cluster")

    def run(batches):
        c, squares = KM.SparseCentres(*sent.value[0]), sent.value[1]
        for b in batches:
            d = KM.distances(*_entries(b), b.num_rows, c, squares)
            own = d[np.arange(b.num_rows), b.column(3).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own <= d.min(axis=1) + 1e-6)], names=[id_col, "nearest"])

    return data.mapInArrow(run, f"{id_col} string, nearest boolean")


def coded_long(long_df: DataFrame, id_col: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """(id, at, vals) of a long table (id, key, value) whose keys need not fit the driver, and their dictionary (value, code)."""
    codes = DC.dictionary(long_df, "key")
    entry = F.struct(F.col("at").cast("int").alias("at"), "value")
    rows = DC.encode(long_df.select(id_col, "key", "value"), "key", codes, "at").groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select(F.col(id_col).cast("string").alias(id_col), F.col("e.at").alias("at"), F.col("e.value").alias("vals")), codes


def kmeans_assign_dense(points: DataFrame, centres: DataFrame, vec_col: str = "embedding",
                        id_col: str = "vec_id") -> DataFrame:
    """F2 given centres: nearest centre (squared Euclidean, smaller id on ties).

    The k centres (a small table) are packed into one row, broadcast, and
    compared in-row with array expressions: no join fan-out."""
    pack = centres.agg(F.collect_list(F.struct(F.col("cluster"), F.col("centre").cast("array<double>").alias("c")))
                       .alias("_cs"))
    v = F.col(vec_col).cast("array<double>")
    d = F.transform("_cs", lambda c: F.struct(
        F.aggregate(F.zip_with(v, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"),
        c["cluster"].alias("cluster")))
    return points.crossJoin(F.broadcast(pack)).select(id_col, F.array_min(d)["cluster"].alias("cluster"),
                                                      F.array_min(d)["d"].alias("sq_dist"))


def label_centroids(points: DataFrame, label: str = "label", vec_col: str = "embedding", dims: int = 64) -> DataFrame:
    """Mean vector per label (a partial aggregate per dimension)."""
    v = F.col(vec_col).cast("array<double>")
    agg = points.groupBy(F.col(label).alias("cluster")).agg(*[F.avg(v[i]).alias(f"_d{i}") for i in range(dims)])
    return agg.select("cluster", F.array(*[F.col(f"_d{i}") for i in range(dims)]).alias("centre"))


_RIGHT = "_right"


def _dense_blocks(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks' vectors as matrices; sparse ones (with places ``_at``) over the features that either block has."""
    if "_at" not in left.columns:
        return np.stack(left["_v"]).astype(float), np.stack(right["_v"]).astype(float)
    every = np.concatenate([np.asarray(x, np.int64) for x in [*left["_at"], *right["_at"]]])
    features = np.unique(every)
    out = []
    for block in (left, right):
        m = np.zeros((len(block), len(features)))
        size = np.array([len(x) for x in block["_at"]])
        at = np.concatenate([np.asarray(x, np.int64) for x in block["_at"]])
        m[np.repeat(np.arange(len(block)), size), np.searchsorted(features, at)] = np.concatenate([np.asarray(x, float) for x in block["_v"]])
        out.append(m)
    return out[0], out[1]


def _distance_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sum of distances of each left row to the right rows of every label (itself left out)."""
    if not len(left) or not len(right):
        return pd.DataFrame({"_id": [], "_l": [], "_other": [], "_sum": []})
    right = right.rename(columns=lambda c: c.removesuffix(_RIGHT))
    a, b = _dense_blocks(left, right)
    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))
    d[left["_id"].to_numpy()[:, None] == right["_id"].to_numpy()[None, :]] = 0.0
    labels, at = np.unique(right["_l"].to_numpy().astype(str), return_inverse=True)
    sums = np.zeros((len(a), len(labels)))
    np.add.at(sums.T, at, d.T)
    n = len(labels)
    return pd.DataFrame({"_id": np.repeat(left["_id"].to_numpy(), n), "_l": np.repeat(left["_l"].to_numpy(), n),
                         "_other": np.tile(labels, len(a)), "_sum": sums.reshape(-1)})


def silhouette_sampled(spark: SparkSession, points: DataFrame, label: str = "cluster", vec_col: str = "embedding",
                       id_col: str = "vec_id", max_rows: int = 6000, seed: int = 42, block_rows: int = 256, at_col: str | None = None) -> DataFrame:
    """mean silhouette (Euclidean) on a seeded hash sample of at most
    ``max_rows`` rows (the sample size is the measure's own parameter, since
    the measure is quadratic).

    The sample is dealt into blocks of about ``block_rows``; every pair of
    blocks is one group of a co-grouped job, which sums distances per row and
    label, and the silhouettes are aggregates of those sums.  Nothing of the
    sample reaches the driver.  Sparse vectors come with their places in ``at_col``."""
    from tunesift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    sample = points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(int(max_rows)).select(
        F.col(id_col).cast("string").alias("_id"), F.col(label).cast("string").alias("_l"),
        F.col(vec_col).cast("array<double>").alias("_v"), *([F.col(at_col).alias("_at")] if at_col else [])).checkpoint(eager=True)
    own_columns = [c for c in sample.columns if c in ("_id", "_l", "_v", "_at")]
    blocks = max(1, -(-sample.count() // block_rows))
    parts = max(spark.sparkContext.defaultParallelism, min(blocks * blocks, 4 * spark.sparkContext.defaultParallelism))
    own = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = sample.select(own.alias("_i"), every.alias("_j"), *own_columns).repartition(parts, "_i", "_j")
    # columns of its own on the right: attributes that both sides share may be pruned from one of them
    right = sample.select(every.alias("_i"), own.alias("_j"), *[F.col(c).alias(c + _RIGHT) for c in own_columns]).repartition(parts, "_i", "_j")
    sums = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(
        _distance_sums, "_id string, _l string, _other string, _sum double")
    sizes = sample.groupBy(F.col("_l").alias("_other")).agg(F.count(F.lit(1)).alias("_n"))
    per = sums.groupBy("_id", "_l", "_other").agg(F.sum("_sum").alias("_sum")).join(F.broadcast(sizes), "_other")
    same = F.col("_l") == F.col("_other")
    row = per.groupBy("_id").agg(
        F.max(F.when(same & (F.col("_n") > 1), F.col("_sum") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("a"),
        F.coalesce(F.min(F.when(~same, F.col("_sum") / F.col("_n"))), F.lit(0.0)).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return row.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_full(vectors: DataFrame, prediction: str = "cluster", distance: str = "squaredEuclidean") -> float:
    """``ClusteringEvaluator`` over all rows (linear; squared Euclidean or
    cosine, so its value differs from F4's Euclidean silhouette)."""
    return ClusteringEvaluator(featuresCol="features", predictionCol=prediction,
                               distanceMeasure=distance).evaluate(vectors)


# ---------------------------------------------------------------------------
# Forests and the leaf space
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """A fitted forest and the numbers of its labels (value, code)."""
    model: RF.ForestModel
    labels: DataFrame

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with leaf indices (``leaves``) and the predicted label's number (``_pred``)."""
        return self.model.transform(rows)

    def save(self, path: str) -> None:
        self.model.save(self.labels.sparkSession, f"{path}/model")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        return cls(RF.ForestModel.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/labels"))


def rf_fit(vectors: DataFrame, label_col: str, num_trees: int = 200, max_depth: int = 25, min_leaf: int = 1,
           seed: int = 42, max_bins: int = 32, id_col: str = "track_id") -> Forest:
    """labels numbered in the order of their values (``LabelEncoder``
    order) without a list of them on the driver, forest with the leaves of
    each row.  Depth is at most 30."""
    codes = DC.dictionary(vectors, label_col)
    numbered = DC.encode(vectors, label_col, codes, "_y")
    return Forest(RF.fit(numbered, codes.count(), int(num_trees), min(int(max_depth), 30), int(min_leaf), int(seed), max_bins, id_col), codes)


def predicted_labels(forest: Forest, rows: DataFrame) -> DataFrame:
    """The rows with the forest's ``predicted`` label (a join on the labels' numbers)."""
    kept, hint = small_side(forest.labels)
    names = kept.select(F.col("code").cast("double").alias("_pred"), F.col("value").alias("predicted"))
    return forest.transform(rows).join(hint(names), "_pred", "left")


def sparse_vectors(coded: DataFrame, features: int, path: str, id_col: str = "track_id") -> DataFrame:
    """(id, features) of coded rows as ``SparseVector``: written as the vector type's own fields and read back as vectors."""
    fields = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(int(features)).alias("size"), F.col("at").alias("indices"), F.col("vals").alias("values"))
    coded.select(id_col, fields.alias("features")).write.mode("overwrite").parquet(path)
    schema = T.StructType([T.StructField(id_col, T.StringType()), T.StructField("features", VectorUDT())])
    return coded.sparkSession.read.schema(schema).parquet(path)


def leaf_rows(leaves: DataFrame, id_col: str = "track_id") -> DataFrame:
    """(id, leaf): the leaf of every tree, in the order of the trees."""
    return leaves.select(id_col, vector_to_array("leaves").cast("array<int>").alias("leaf"))


def leaf_long(rows: DataFrame, id_col: str = "track_id") -> DataFrame:
    """(id, tree, leaf): one row per tree, of ``leaf_rows``."""
    return rows.select(id_col, F.posexplode("leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("long"))


def leaf_index(rows: DataFrame, n_trees: int, id_col: str = "track_id") -> DataFrame:
    """leaf one-hot, L2-normalised (each row has ``n_trees`` ones), of
    ``leaf_rows`` (one row per id) as kernel index rows with keys 'tree:leaf'."""
    w = 1.0 / float(np.sqrt(n_trees))
    key = F.transform("leaf", lambda x, tree: F.concat(tree.cast("string"), F.lit(":"), x.cast("string")))
    return rows.select(id_col, key.alias("keys"), F.transform("leaf", lambda x: F.lit(w)).alias("vals"))


def leaf_query(model_leaves: DataFrame, known: DataFrame, id_col: str = "track_id") -> DataFrame:
    """F8: a query's leaves, keeping only (tree, leaf) pairs seen in training,
    then L2-normalised."""
    q = leaf_long(leaf_rows(model_leaves, id_col), id_col).join(known.select("tree", "leaf").distinct(), ["tree", "leaf"], "left_semi")
    n = F.count(F.lit(1)).over(W.partitionBy(id_col))
    return q.select(id_col, F.concat(F.col("tree").cast("string"), F.lit(":"), F.col("leaf").cast("string")).alias("key"),
                    (F.lit(1.0) / F.sqrt(n)).alias("value"))


def knn_leaf(spark: SparkSession, leaf_idx: DataFrame, seed_idx: DataFrame, k: int, exclude_self: bool = True):
    """Cosine in leaf space = shared leaves / trees, through the E2 kernel."""
    return knn_batch(spark, leaf_idx, seed_idx, k, exclude_self=exclude_self, dense_keys=())


# ---------------------------------------------------------------------------
# vectors of Spark ML from arrays
# ---------------------------------------------------------------------------

def dense_unit_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    v = F.col(vec_col).cast("array<double>")
    nrm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.select(id_col, array_to_vector(F.transform(v, lambda x: x / nrm)).alias("features"))


# ---------------------------------------------------------------------------
# Split and reports
# ---------------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """exact per-class test share: inside each class, rows in seeded hash
    order (``md5``, then id) go to test while their rank is at most
    ``round(f * class size)``.

    No class is sorted in one task (a class may hold a third of all rows):
    the hash's first four hex digits form 65,536 ordered buckets; per
    (class, bucket) counts and their running sums (an aggregate of at most
    classes x 65,536 rows) place every bucket wholly in test or train except
    the one bucket per class that holds the cut, and only that bucket's rows
    are ranked."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    d = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 4))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wl = W.partitionBy(label)
    cum = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(
                wl.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                 .withColumn("_t", F.round(F.sum("_c").over(wl) * F.lit(float(test_fraction)))))
    j = d.join(cum, [label, "_b"])
    whole = j.filter((F.col("_before") + F.col("_c") <= F.col("_t")) | (F.col("_before") >= F.col("_t")))
    whole = whole.withColumn("split", F.when(F.col("_before") < F.col("_t"), F.lit("test")).otherwise(F.lit("train")))
    cut = j.filter((F.col("_before") < F.col("_t")) & (F.col("_before") + F.col("_c") > F.col("_t")))
    r = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", id_col))
    cut = cut.withColumn("split", F.when(F.col("_before") + r <= F.col("_t"), F.lit("test")).otherwise(F.lit("train")))
    return whole.unionByName(cut).drop("_h", "_b", "_c", "_before", "_t")


def confusion_matrix(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """counts by (actual, predicted)."""
    return pred.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("count"))


def classification_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """per-class precision / recall / f1 / support, accuracy, macro and
    weighted averages; zero division -> 0.  Built from the confusion counts
    (one row per (actual, predicted) pair)."""
    cm = confusion_matrix(pred, actual, predicted)
    a = cm.groupBy(F.col(actual).alias("label")).agg(F.sum("count").alias("support"),
                                                     F.sum(F.when(F.col(actual) == F.col(predicted), F.col("count"))
                                                           .otherwise(0)).alias("tp"))
    p = cm.groupBy(F.col(predicted).alias("label")).agg(F.sum("count").alias("npred"))
    per = a.join(p, "label", "full_outer").select(
        F.col("label").cast("string").alias("label"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("npred", F.lit(0)).alias("npred"))
    per = per.select("label", "support",
                     F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0).alias("precision"),
                     F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"), "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                          F.col("n").alias("support"))
    return per.select("label", "precision", "recall", "f1", "support").unionByName(acc).unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------------------
# rank-2 projection
# ---------------------------------------------------------------------------

def vector_keys(model: FE.ContentModel, cfg: FeatureConfig | None = None) -> list[str]:
    """Content keys in the vector index order of ``content_vector_pipeline``."""
    cfg = cfg or model.cfg
    keys = []
    for spec in cfg.active_blocks():
        terms, _ = _vocab_list(model.vocabs[spec.name])
        keys += [f"{spec.name}:{t}" for t in terms]
    return keys + ["n:year", "n:explicit"]


#: Features whose sums travel as one row.
SUM_FEATURES = 2_048


def coded_rows(rows: DataFrame, keys: list[str], id_col: str = "track_id") -> DataFrame:
    """Index rows with their keys as numbers (places in ``keys``; others are left out): (id, at, vals)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    names = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        known = pa.array(names.value, pa.string())
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(pc.list_flatten(lists), value_set=known)
            on = at.is_valid()
            owner = pc.list_parent_indices(lists).filter(on).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))]).astype(np.int32))
            vals = pc.list_flatten(b.column(2)).filter(on)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, at.filter(on)), pa.ListArray.from_arrays(offsets, vals)],
                                             names=[id_col, "at", "vals"])

    return rows.select(F.col(id_col).cast("string").alias(id_col), "keys", "vals").mapInArrow(run, f"{id_col} string, at array<int>, vals array<double>")


def _entries(b):
    """(row, place, value) of every entry of a batch of coded rows."""
    import pyarrow.compute as pc
    return (pc.list_parent_indices(b.column(1)).to_numpy(zero_copy_only=False), pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False),
            pc.list_flatten(b.column(2)).to_numpy(zero_copy_only=False))


def _rows_times(b, m: np.ndarray) -> tuple[np.ndarray, tuple]:
    """A batch of coded rows times a features x p matrix, and the batch's entries."""
    row, at, v = _entries(b)
    y = np.stack([np.bincount(row, weights=v * m[at, j], minlength=b.num_rows) for j in range(m.shape[1])], axis=1).astype(float)  # no entries count as whole numbers
    return y, (row, at, v)


def gram_times(coded: DataFrame, m: np.ndarray) -> np.ndarray:
    """X^T (X M) for the rows X and a features x p matrix M, in one pass over the rows.

    Each task holds one features x p sum and emits it in rows of ``SUM_FEATURES``
    features; those are added up per range of features as they stream in, so the
    rows themselves are never exchanged."""
    import pyarrow as pa
    spark, (n, p) = coded.sparkSession, m.shape
    sent = spark.sparkContext.broadcast(m)

    def partial(batches):
        m, z = sent.value, None
        for b in batches:
            if b.num_rows:
                y, (row, at, v) = _rows_times(b, m)
                z = np.zeros((p, n)) if z is None else z
                for j in range(p):
                    z[j] += np.bincount(at, weights=v * y[row, j], minlength=n)
        if z is not None:
            cuts = range(0, n, SUM_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(cuts))), pa.int32()), pa.array([z[:, c:c + SUM_FEATURES].tobytes() for c in cuts], pa.binary())],
                                             names=["part", "sums"])

    def added(batches):
        part, total = None, None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                one = np.frombuffer(raw.as_buffer(), float)
                if k != part:
                    if part is not None:
                        yield row(part, total)
                    part, total = k, np.zeros(len(one))
                total += one
        if part is not None:
            yield row(part, total)

    def row(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = max(1, min(-(-n // SUM_FEATURES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sums = coded.mapInArrow(partial, "part int, sums binary").repartitionById(parts, F.col("part")).sortWithinPartitions("part") \
        .mapInArrow(added, "part int, sums binary")
    out = np.zeros((n, p))
    for r in sums.collect():  # features x p, bounded by the vocabulary
        c = r.part * SUM_FEATURES
        out[c:c + SUM_FEATURES] = np.frombuffer(r.sums, float).reshape(p, -1).T
    return out


def right_singular(coded: DataFrame, features: int, k: int = 2, oversample: int = 8, seed: int = 42, tolerance: float = 1e-6,
                   most_passes: int = 60) -> np.ndarray:
    """The first ``k`` right singular vectors (features x k) of coded rows, by subspace iteration on
    X^T X until each one's residual is under ``tolerance`` of the greatest squared singular value
    (``most_passes`` is a last resort).  Each vector's greatest entry is positive."""
    p = min(k + oversample, features)
    v, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, p)))
    for _ in range(most_passes):
        z = gram_times(coded, v)
        values, u = np.linalg.eigh((v.T @ z + z.T @ v) / 2)
        u, values = u[:, ::-1][:, :k], values[::-1][:k]
        if np.linalg.norm(z @ u - (v @ u) * values, axis=0).max() <= tolerance * max(values[0], 1e-300):
            break
        v, _ = np.linalg.qr(z)
    out = v @ u
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)


def project_2d(rows: DataFrame, keys: list[str], id_col: str = "track_id", k: int = 2, oversample: int = 8, seed: int = 42) -> DataFrame:
    """rank-2 truncated SVD without centring, then the projection X.V: (id, x, y) of every index
    row.  Only features x p matrices pass between driver and tasks, and each pass reads the rows in place."""
    import pyarrow as pa
    from tunesift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    coded = coded_rows(rows, keys, id_col).checkpoint(eager=True)
    sent = rows.sparkSession.sparkContext.broadcast(right_singular(coded, len(keys), k, oversample, seed))

    def project(batches):
        for b in batches:
            y, _ = _rows_times(b, sent.value)
            y = y if y.shape[1] > 1 else np.pad(y, ((0, 0), (0, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], names=[id_col, "x", "y"])

    return coded.mapInArrow(project, f"{id_col} string, x double, y double")
