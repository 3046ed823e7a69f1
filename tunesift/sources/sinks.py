"""Sinks and artefacts (A16-A19): CSV and JSON outputs, model save/load,
and the model registry.  Every write goes to a caller-given path (on a
cluster: a shared folder, e.g. under ``spark.checkpoint.dir``)."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.config import BlockSpec, FeatureConfig
from tunesift.operators.features import ContentModel
from tunesift.session import path_exists
from tunesift.sources.tables import CSV_OPTIONS

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("created_at", T.StringType()), T.StructField("config", T.StringType())])


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, one folder of part files written in parallel; line
    breaks stay inside quotes and quotes are doubled."""
    (df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Metrics / report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_content_model(model: ContentModel, path: str, index: DataFrame | None = None) -> None:
    """A18 save: vocabularies, numeric statistics, config (and optionally the
    normalised index) as Parquet/JSON tables under ``path``."""
    spark = model.stats.sparkSession
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.stats.write.mode("overwrite").parquet(f"{path}/stats")
    cfg = spark.createDataFrame([(model.cfg.to_json(), model.id_col)], "config string, id_col string")
    cfg.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    if index is not None:
        index.write.mode("overwrite").parquet(f"{path}/index")


def load_content_model(spark: SparkSession, path: str) -> ContentModel:
    """A18 load: a model that can vectorise queries (D10) again."""
    meta = spark.read.json(f"{path}/meta").first()  # one small row: the config
    cfg = _config_from_json(json.loads(meta["config"]))
    vocab = spark.read.parquet(f"{path}/vocab")
    stats = spark.read.parquet(f"{path}/stats")
    return ContentModel(cfg, vocab, stats, None, None, meta["id_col"])


def save_ml_model(model, path: str) -> None:
    """A18 save of a fitted Spark ML model or pipeline (K-Means, forests)."""
    model.write().overwrite().save(path)


def load_ml_model(path: str, kind: type):
    """A18 load: ``kind`` is the model's class."""
    return kind.load(path)


def _config_from_json(raw: dict) -> FeatureConfig:
    blocks = tuple(BlockSpec(b["name"], b["column"], tuple(b["ngram"]), b["min_df"], b["max_df"],
                             b["max_features"], b["doc"]) for b in raw["blocks"])
    return FeatureConfig(raw["genre_weight"], raw["artist_weight"], raw["title_weight"], raw["numeric_weight"],
                         raw["use_title"], blocks)


def registry_upsert(spark: SparkSession, registry_path: str, entries: DataFrame) -> DataFrame:
    """Insert or replace name -> path (full outer join by name, new wins).

    Returns the merged table, for the caller to write as a new version (what
    is read is never overwritten).  Only a registry that does not exist counts
    as empty; one that can't be read raises."""
    old = (spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path) if path_exists(spark, registry_path)
           else spark.createDataFrame([], REGISTRY_SCHEMA))
    new = entries.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in REGISTRY_SCHEMA.fields])
    n, o = new.alias("n"), old.alias("o")
    merged = n.join(o, F.col("n.name") == F.col("o.name"), "full_outer").select(
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in REGISTRY_SCHEMA.fieldNames()])
    return merged


def registry_lookup(registry: DataFrame) -> DataFrame:
    """Model names sorted (the model picker)."""
    return registry.select("name", "path").orderBy("name")


def now_iso() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
