"""The corpus pipeline: toxicity, language, near-duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept and calls one
operator on all of them.  ``run`` writes every stage's result as Parquet in the
shared folder and rereads it as the next stage's documents.

Defined results: documents with null or empty text are not toxic but have no
language, so the second stage drops them; rows without an id are known by their
text; rows of one id share its fate in the first two stages, and of those that
the third would keep one stays (the least by a hash of its own columns), so a
group of near-duplicates leaves one row; columns beside the documents' own stay
in the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesift.llm import langid, mixing, packing, simhash, toxicity
from tunesift.llm.common import stored

#: A document is rejected as toxic from this score on.
TOXIC = 0.5
SEED = 42
TOKENIZER = "word_bpe_49k.json"


#: Marks keys made from texts; ids of documents are smaller.
_NO_ID = 1 << 62


def _key() -> Column:
    """A document's id, or a hash of its text where it has none."""
    return F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _key())


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def _reject(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents without those whose key has a row in ``rejected``."""
    key = _free(docs, "_key")
    return docs.join(rejected.select(F.col("doc_id").alias(key)).distinct(), _key() == F.col(key), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the class-conditional models score as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.in_fold("doc_id", 5, 0))
    return _reject(docs, toxicity.score(_keyed(docs), model).filter(F.col("score") >= TOXIC))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found."""
    model = langid.fit(docs, langid.remainder("doc_id", 4) != 2)
    return _reject(docs, langid.identify(_keyed(docs), model).filter(F.col("lang_pred") == "und"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    found = simhash.near_duplicates(_keyed(docs))
    kept = _reject(docs, found.filter(F.col("doc_id") != F.col("component_id")))
    key, row = _free(docs, "_key"), _free(docs, "_row")
    repeated = docs.groupBy(_key().alias(key)).count().filter("count > 1").select(key)
    if repeated.isEmpty():
        return kept
    one = F.min_by(F.struct(*kept.columns), F.xxhash64("text", "lang", "source", "n_chars")).alias(row)
    return kept.join(repeated, _key() == F.col(key), "left_anti").unionByName(
        kept.join(repeated, _key() == F.col(key), "left_semi").groupBy(_key().alias(key)).agg(one).select(f"{row}.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its target.

    The mix takes a document's words a number of times, which need not be
    whole; the document is taken as often as that, rounded up or down by a
    seeded draw that keeps the mean.  A document without words goes.
    """
    key, times, n = _free(docs, "_key"), _free(docs, "_times"), _free(docs, "_n")
    share = F.try_divide("taken", "size")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    taken = mixing.mix(_keyed(docs)).withColumn(times, (F.floor(share) + (draw < share - F.floor(share)).cast("int")).cast("int")) \
        .filter(F.col(times) > 0).groupBy(F.col("doc_id").alias(key)).agg(F.max(times).alias(times))
    return docs.join(taken, _key() == F.col(key)).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into sequences: one row per piece, with its place."""
    pieces = packing.tokenised_pieces(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces)


STAGES = [
    ("toxicity", toxic),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Learned scores, hashes and packings are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs
