"""User-facing entry points: the recommender workflow on any catalogue
DataFrame (fit -> recommend -> evaluate), built from the operators.

    rec = Recommender.fit(spark, catalog_df, path="hdfs://.../models/content")
    rec.recommend(["track-1"]).show()                 # E9 semantics
    rec.recommend(seed_ids_df, top_k=10)              # E10, batch
    rec.evaluate(relevance="genre", k=10, seeds=200)  # G10
    Recommender.load(spark, path)                     # serve from the written tables
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesift.config import EvalParams, FeatureConfig, RecommendParams
from tunesift.operators import clean
from tunesift.operators import block_index as BLK
from tunesift.operators import evaluation as EV
from tunesift.operators import features as FE
from tunesift.operators import search as S
from tunesift.operators import similarity as SIM
from tunesift.plans.artifacts import read_content_space, write_content_space
from tunesift.sources.fixtures import DEDUPE_ORDER


class Recommender:
    def __init__(self, spark: SparkSession, path: str, cfg: FeatureConfig, meta: DataFrame,
                 params: RecommendParams | None = None):
        from tunesift.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)  # evaluate() checkpoints its bounded kNN result
        self.spark, self.path, self.cfg, self.meta = spark, path, cfg, meta
        self.params = params or RecommendParams()
        self.model, self.long, self.rows, self.blocks = read_content_space(spark, cfg, path)

    # -- train ------------------------------------------------------------------
    @classmethod
    def fit(cls, spark: SparkSession, catalog: DataFrame, path: str, cfg: FeatureConfig | None = None,
            params: RecommendParams | None = None) -> "Recommender":
        """Repair (B1-B7), keep-first de-duplicate (B9), fit and write the
        content space (D4-D9) under ``path`` (a shared folder on a cluster)."""
        from tunesift.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        cfg = cfg or FeatureConfig()
        order = [c for c in DEDUPE_ORDER if c in catalog.columns]
        meta = clean.prepare_meta(clean.dedupe_keep_first(clean.ensure_columns(catalog), "track_id", order))
        meta = meta.select(*clean.REQUIRED_META)
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        meta = spark.read.parquet(f"{path}/meta")
        write_content_space(meta, cfg, path)
        spark.createDataFrame([(cfg.to_json(),)], "config string").write.mode("overwrite").json(f"{path}/config")
        return cls(spark, path, cfg, meta, params)

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: RecommendParams | None = None) -> "Recommender":
        from tunesift.sources.sinks import _config_from_json
        cfg = _config_from_json(json.loads(spark.read.json(f"{path}/config").first()["config"]))
        return cls(spark, path, cfg, spark.read.parquet(f"{path}/meta"), params)

    # -- serve ------------------------------------------------------------------
    def _seed_rows(self, track_ids) -> DataFrame:
        if isinstance(track_ids, DataFrame):
            ids = track_ids.select(F.col(track_ids.columns[0]).cast("string").alias("track_id"))
        else:
            ids = self.spark.createDataFrame([(str(t),) for t in track_ids], "track_id string")
        return self.meta.join(ids.distinct(), "track_id", "left_semi")

    def recommend(self, track_ids, top_k: int | None = None, threshold: float | None = None,
                  one_per_artist: bool | None = None, view: DataFrame | None = None,
                  weights: dict | None = None, prefilter: bool = False,
                  space: DataFrame | None = None) -> DataFrame:
        """Nearest top_k + overfetch items per query (self included,
        then dropped), restricted to ``view``, thresholded, one per artist,
        top_k.  ``weights`` (genre/artist/title/numeric) re-weights the query
        side only (asymmetric cosine, Q6).  ``prefilter`` searches the view's
        items alone instead of filtering what was found (Q7).  ``space`` is
        another model's index rows to search instead of the content space's,
        e.g. a forest's leaf space (``models.leaf_index``)."""
        p = self.params
        top_k = top_k or p.top_k
        threshold = p.score_threshold if threshold is None else threshold
        one = p.one_per_artist if one_per_artist is None else one_per_artist
        seeds = self._seed_rows(track_ids)
        qcfg = self.cfg.with_weights(**weights) if weights else self.cfg
        index = self.rows if space is None else space
        if weights and space is None:
            seed_index = SIM.index_rows(FE.transform_rows(self.model, seeds, qcfg))
        else:
            seed_index = index.join(seeds.select("track_id"), "track_id", "left_semi")
        searched = index
        if prefilter and view is not None:
            searched, view = searched.join(view.select("track_id"), "track_id", "left_semi"), None
        if searched is self.rows:
            cands = BLK.knn_blocks(self.spark, self.blocks, seed_index, top_k + p.overfetch, exclude_self=False)
        else:
            cands = SIM.knn_batch(self.spark, searched, seed_index, top_k + p.overfetch, exclude_self=False)
        return SIM.finish_recommendations(cands.drop("rank"), self.meta, view, top_k, threshold, one)

    def search(self, query: str, limit: int = 100, ranked: bool = False) -> DataFrame:
        """C5 / C6 over the catalogue."""
        return (S.search_ranked if ranked else S.search)(self.meta, query, limit)

    def evaluate(self, params: EvalParams | None = None, weights: dict | None = None,
                 space: DataFrame | None = None) -> DataFrame:
        """(metric, value) for seeded seeds, K and a relevance definition,
        with the queries re-weighted by ``weights`` or in another ``space`` (as
        in ``recommend``)."""
        e = params or EvalParams()
        seeds = EV.sample_seeds(self.meta, e.seeds, e.random_state)
        index = self.rows if space is None else space
        if weights and space is None:
            seed_index = SIM.index_rows(FE.transform_rows(self.model, seeds, self.cfg.with_weights(**weights)))
        else:
            seed_index = index.join(seeds.select("track_id"), "track_id", "left_semi")
        nn = BLK.knn_blocks(self.spark, self.blocks, seed_index, e.k) if space is None else SIM.knn_batch(self.spark, index, seed_index, e.k)
        nn = nn.checkpoint(eager=True)
        flags = EV.flag_recommendations(nn, self.meta, e.relevance)
        per = EV.per_seed_metrics(flags, EV.relevant_counts(self.spark, self.meta, seeds, e.relevance), e.k)
        return EV.evaluate(per, EV.coverage(nn, self.meta))
