"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled out as byte sequences with a boundary on both sides.  Each
class (toxic, ordinary) has its own counts of the next byte after up to
``ORDER - 1`` bytes of the word; what they discount backs off to one lower-order
Kneser-Ney model of both classes' continuation counts.  So a rare expression,
whose counts the discount takes whole, weighs the same in both classes and
tells nothing, while its frequent stem still does.

A text's two log-likelihoods are compared by the number of words that they are
of: over all its words, over its telling expressions (what they have above a
bound), and over its few most telling words, which a long ordinary text around
them would not move.  A logistic curve over these length-normalised ratios,
fitted on rows that the counts leave out, gives the score.  Words are spelled
one at a time: a toxic phrase of ordinary words is not seen.

``fit`` learns from a bounded sample, about ``FIT_ROWS`` rows of each class
(those with the least id hash); scores read the whole text and nothing else.

Defined results: null, empty and wordless texts have all ratios 0 and the
score that these get; where one class or both have no rows, every score is the
share of toxic rows (0 without rows); a row with a null label or id is not
learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.llm.common import gathered, ship, slices, small_batches, stored

ship(__name__)

FIT_ROWS = 20_000
ORDER = 6
#: Class counts up to this are rare: backoff takes them whole.
DISCOUNT = 2.0
BACKOFF_DISCOUNT = 0.75
#: Log-likelihood ratio (nats) above which a word counts as a telling expression.
TELLING = 3.0
#: Numbers of most telling words that are compared beside the whole text.
FEW = (1, 4)
#: Steps of a nat that a word's ratio is rounded to.
STEPS = 1 << 20
GATHER = 6 << 20
RATIOS = 2 + len(FEW)


class Spelled:
    """Distinct words of texts, and the gram of up to ORDER bytes that ends at each of their bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        words = pc.utf8_trim(pc.list_flatten(split), characters=".,;:!?\"'()")
        some = pc.greater(pc.binary_length(words), 0)
        flat = words.filter(some).dictionary_encode()
        self.at = flat.indices.to_numpy(zero_copy_only=False)
        self.text = pc.list_parent_indices(split).filter(some).to_numpy(zero_copy_only=False)
        self.n_texts, self.n = len(texts), len(flat.dictionary)
        raw = np.frombuffer(("\n" + "\n".join([*flat.dictionary.to_pylist(), ""])).encode(), np.uint8)
        stop = raw == 10
        at = np.arange(1, len(raw))
        begin = np.maximum.accumulate(np.where(stop, np.arange(len(raw)), 0))[:-1]  # the boundary before each byte
        self.word = (np.cumsum(stop) - 1)[begin]
        self.gram = np.zeros(len(at), np.uint64)
        for k in range(ORDER - 1, -1, -1):
            inside = at - begin >= k
            self.gram = np.where(inside, self.gram << np.uint64(8) | raw[np.maximum(at - k, 0)], self.gram)
        if not self.n:
            self.word, self.gram = self.word[:0], self.gram[:0]


def _positions(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


def backoff(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each gram's last byte after the rest, from counts of both
    classes at the longest order and from continuation counts (distinct bytes before) below."""
    context, after = np.unique(grams >> np.uint64(8), return_inverse=True)
    total = np.bincount(after, weights=counts, minlength=len(context))
    kinds = np.bincount(after, weights=counts > 0, minlength=len(context))
    q = np.full(len(grams), 1 / 256)
    length = np.zeros(len(grams), np.int64)
    for k in range(1, ORDER + 1):
        length += grams >= np.uint64(1 << (8 * (k - 1)))
    longer = length > 1
    if longer.any():
        own = length[longer]
        shorter = grams[longer] & ((np.uint64(1) << (np.uint64(8) * (own - 1).astype(np.uint64))) - np.uint64(1))
        # the length keeps apart grams whose bytes begin with a zero
        tagged, at = np.unique(shorter | ((own - 1).astype(np.uint64) << np.uint64(56)), return_inverse=True)
        below = backoff(tagged & np.uint64((1 << 56) - 1), np.bincount(at, weights=counts[longer] > 0))
        q[longer] = below[at]
    return (np.maximum(counts - BACKOFF_DISCOUNT, 0) + BACKOFF_DISCOUNT * kinds[after] * q) / np.maximum(total[after], 1e-9)


@dataclass(frozen=True)
class ToxicityModel:
    base_rate: float
    grams: np.ndarray  # sorted; those some class counts above the discount
    gram_ratio: np.ndarray
    contexts: np.ndarray  # sorted
    context_ratio: np.ndarray
    weights: np.ndarray | None  # logistic curve over the ratios: bias first

    def word_ratios(self, s: Spelled) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary).  Grams that no class counts above
        the discount share their backoff, so only the contexts' backoff weights differ."""
        at, known = _positions(self.grams, s.gram)
        out = np.zeros(len(s.gram))
        out[known] = self.gram_ratio[at[known]]
        at, met = _positions(self.contexts, s.gram[~known] >> np.uint64(8))
        rest = np.zeros(len(met))
        rest[met] = self.context_ratio[at[met]]
        out[~known] = rest
        return np.bincount(s.word, weights=out, minlength=s.n)

    def ratios(self, texts: pa.Array) -> np.ndarray:
        """Per text, log-likelihood ratios by the number of words that they are of: of all its words; what its
        telling expressions have above ``TELLING``, over all its words (as a root); of its so many most telling
        words, for each of ``FEW`` (words that it lacks count as 0)."""
        s = Spelled(texts)
        # in steps that sums keep exactly, so a text's ratios don't depend on its neighbours
        x = np.rint(self.word_ratios(s) * STEPS)[s.at] / STEPS
        words = np.bincount(s.text, minlength=s.n_texts)
        over = np.bincount(s.text, weights=np.maximum(x - TELLING, 0), minlength=s.n_texts)
        order = np.lexsort((-x, s.text))
        place = np.arange(len(x)) - np.repeat(np.cumsum(words) - words, words)
        few = [np.bincount(s.text[order][place < k], weights=x[order][place < k], minlength=s.n_texts) / k for k in FEW]
        words = np.maximum(words, 1)
        return np.stack([np.bincount(s.text, weights=x, minlength=s.n_texts) / words, np.sqrt(over / words), *few], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base_rate)
        z = self.weights[0] + self.ratios(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (bias first) by Newton steps with a ridge penalty on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return np.concatenate([[w[0] - mean @ slope], slope])


def _from_counts(base_rate: float, grams: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    order = np.argsort(grams)
    grams, counts = grams[order], [ordinary[order].astype(float), toxic[order].astype(float)]
    q = backoff(grams, counts[0] + counts[1])
    contexts, after = np.unique(grams >> np.uint64(8), return_inverse=True)
    p, back = [], []
    for c in counts:
        total = np.bincount(after, weights=c, minlength=len(contexts))
        share = np.bincount(after, weights=np.minimum(c, DISCOUNT), minlength=len(contexts)) / np.maximum(total, 1)
        share = np.where(total > 0, share, 1.0)  # a context the class never met backs off whole
        back.append(share)
        p.append(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[after] + share[after] * q)
    frequent = np.maximum(*counts) > DISCOUNT
    return ToxicityModel(base_rate, grams[frequent], np.log(p[1] / p[0])[frequent], contexts, np.log(back[1] / back[0]), None)


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from labelled rows that meet ``training`` (a condition on the id), about ``fit_rows`` of each class.

    The sampled ids are bounded, so they are broadcast and the texts stay where
    they are; counts of the sample's grams are aggregated and reach the driver,
    where the model is made.  A quarter of the sample fits the logistic curve.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna() \
        .filter("_y in (0, 1)").withColumnRenamed("_id", id_col).filter(training).withColumnRenamed(id_col, "_id").distinct()
    sizes = {r[0]: r[1] for r in marked.groupBy("_y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    base_rate = n1 / (n0 + n1) if n1 else 0.0
    share = F.when(F.col("_y") == 1, F.lit(min(1.0, fit_rows / max(1, n1)))).otherwise(F.lit(min(1.0, fit_rows / max(1, n0))))
    sample = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30)) \
        .withColumn("_curve", F.pmod(F.xxhash64("_id", F.lit("curve")), F.lit(4)) == 0)
    texts = stored(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
                   .join(F.broadcast(sample), "_id").select("text", "_y", "_curve"), "toxicity-sample")

    def count(batches):
        for b in gathered(batches, 0, GATHER):
            for at, n in slices(b.column(0), GATHER):
                s = Spelled(b.column(0).slice(at, n))
                toxic = b.column(1).slice(at, n).to_numpy(zero_copy_only=False) == 1
                grams, inverse = np.unique(s.gram, return_inverse=True)
                cols = [np.bincount(inverse, weights=np.bincount(s.at, weights=kind[s.text], minlength=s.n)[s.word], minlength=len(grams))
                        for kind in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols)],
                                                 names=["gram", "ordinary", "toxic"])

    counted = texts.filter(~F.col("_curve")).select("text", "_y").mapInArrow(count, "gram long, ordinary long, toxic long")
    counts = stored(stored(counted, "toxicity-grams").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")),
                    "toxicity-counts").toArrow()
    model = _from_counts(base_rate, *(counts[c].to_numpy().view(np.uint64) if c == "gram" else counts[c].to_numpy() for c in ("gram", "ordinary", "toxic")))
    if not n0 or not n1 or not len(model.grams):
        return model
    shipped = spark.sparkContext.broadcast(model)

    def curve(batches):
        for b in gathered(batches, 0, GATHER):
            x = shipped.value.ratios(b.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(RATIOS)), b.column(1)], names=[*(f"x{k}" for k in range(RATIOS)), "y"])

    rows = texts.filter("_curve").select("text", "_y").mapInArrow(curve, ", ".join(f"x{k} double" for k in range(RATIOS)) + ", y int")
    with small_batches(spark):
        found = rows.toArrow()
    y = found["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.stack([found[f"x{k}"].to_numpy() for k in range(RATIOS)], axis=1)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of rows
    return ToxicityModel(model.base_rate, model.grams, model.gram_ratio, model.contexts, model.context_ratio, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType.fromDDL("doc_id long, score double")

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            for at, n in slices(b.column(1), GATHER):
                own = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(shipped.value.scores(own.column(1)))], names=schema.names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, schema), "toxicity-scores")


def in_fold(id_col: str, mod: int, at: int) -> Column:
    """Whether crc32 of the id as text leaves ``at`` modulo ``mod`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod == at


def op8_toxicity_kneser_ney(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~in_fold("doc_id", 5, 0))
    return score(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
