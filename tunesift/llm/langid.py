"""Language identification of mixed-language text.

Every word scores each learned language by its byte n-grams (Bayes, hashed to
a fixed number of buckets); languages that never used the word's script in
training are no candidates for it.  Viterbi over the words with a penalty for
each change of language labels spans, and the language that holds most letters
is the document's.

``fit`` learns from a bounded sample: at most about ``FIT_ROWS`` documents of
each language, those with the least id hash.  Prediction reads the text alone.

Defined results: null text and text without a letter are ``und`` with score 0;
so is everything where nothing was learned; words without letters score
nothing and go with the words around them; ties go to the first language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.llm.common import gathered, n_partitions, ship, slices, small_batches, stored

ship(__name__)

FIT_ROWS = 20_000
BUCKETS = 1 << 15
CHUNK = 1 << 11
ORDERS = (1, 2, 3, 4)
#: Nats that a change of language costs.
SWITCH = 12.0
#: Share of a language's letters above which a script counts as its own.
SCRIPT_SHARE = 0.01
#: Bytes of text that a worker holds at once; word scores and paths come on top.
GATHER = 2 << 20

# First code points of script blocks (letters of the block belong
# to the script until the next entry); "" ends a run.
SCRIPTS = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""),
    (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"), (0x00F7, ""), (0x00F8, "latin"),
    (0x0250, "latin"), (0x02B0, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, ""), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, ""),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x2C60, "latin"), (0x2C80, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"),
    (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""),
    (0x20000, "han"), (0x32000, ""),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS} - {""})
#: Bit of each run's script; runs of no script have none.
_BITS = np.array([1 << _NAMES.index(n) if n else 0 for _, n in SCRIPTS], np.int64)


class Words:
    """Distinct words of texts: n-gram buckets, scripts and letters of each."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        split = pc.ascii_split_whitespace(texts)
        words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
        some = pc.greater(pc.binary_length(words), 0)  # outer white space leaves empty parts
        flat = words.filter(some).dictionary_encode()
        self.at = flat.indices.to_numpy(zero_copy_only=False)
        self.per_text = np.bincount(parents.filter(some).to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)
        low = pc.utf8_lower(flat.dictionary)
        self.n = len(low)
        listed = low.to_pylist()
        points = np.frombuffer("\n".join([*listed, ""]).encode("utf-32-le"), np.uint32)
        bits = _BITS[np.searchsorted(_STARTS, points, "right") - 1]
        ends = np.flatnonzero(points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if self.n else np.empty(0, np.int64)
        self.scripts = np.bitwise_or.reduceat(bits, starts) if self.n else np.empty(0, np.int64)
        letter = pc.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False)
        # letters counted by script runs; letters of no known script count one a word
        self.letters = np.maximum(np.add.reduceat((bits != 0).astype(np.int64), starts), 1) * letter if self.n else np.empty(0, np.int64)
        raw = np.frombuffer(("\n" + "\n".join([*listed, ""])).encode(), np.uint8)
        stop = raw == 10
        word = np.cumsum(stop) - 1  # a word's first boundary counts with it
        self.word_of, self.buckets = [], []
        code = np.zeros(len(raw), np.uint64)
        inner = np.zeros(len(raw), bool)  # a boundary inside the gram
        for k in range(1, max(ORDERS) + 1):
            if len(raw) < k:
                break
            code = code[:len(raw) - k + 1] << np.uint64(8) | raw[k - 1:]
            if k > 2:
                inner = inner[:len(raw) - k + 1] | stop[k - 2:len(raw) - 1]
            valid = ~inner[:len(code)] if k > 2 else np.ones(len(code), bool)
            if k == 1:
                valid = ~stop
            elif k == 2:
                valid = ~(stop[:-1] & stop[1:])
            where = np.flatnonzero(valid)
            own = word[where]
            keep = own < self.n
            where, own = where[keep], own[keep]
            keep = letter[own]
            hashed = (code[where[keep]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - 15)
            self.word_of.append(own[keep].astype(np.int32))
            self.buckets.append(hashed.astype(np.int32))

    def counts(self) -> np.ndarray:
        """Buckets counted over all words, repeats included."""
        times = np.bincount(self.at, minlength=self.n)
        out = np.zeros(BUCKETS)
        for own, b in zip(self.word_of, self.buckets):
            out += np.bincount(b, weights=times[own], minlength=BUCKETS)
        return out.astype(np.int64)

    def scores(self, logp: np.ndarray) -> np.ndarray:
        """(word, language): mean over gram orders of summed log-probabilities; 0 without letters."""
        langs = logp.shape[1]
        out = np.zeros((self.n, langs), np.float32)
        for own, b in zip(self.word_of, self.buckets):
            for k in range(langs):
                out[:, k] += np.bincount(own, weights=logp[b, k], minlength=self.n) / len(ORDERS)
        return out


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # (bucket, language)
    scripts: np.ndarray  # bits of each language's scripts


def _sum_chunks(batches):
    held: dict[tuple, np.ndarray] = {}
    for b in batches:
        for lang, chunk, data in zip(*(b.column(k).to_pylist() for k in range(3))):
            v = np.frombuffer(data, np.int64)
            held[lang, chunk] = held[lang, chunk] + v if (lang, chunk) in held else v
    keys = list(held)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                      pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["lang", "chunk", "data"])


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn the languages of the ``training`` rows with a language, about ``fit_rows`` documents of each at most.

    The number of languages is the label set's own size; per language a fixed number of counts reaches the driver.
    """
    rows = docs.filter(training & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, fit_rows / sizes[lang]))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < share * (1 << 30)) \
        .select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    n_scripts = len(_NAMES)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in gathered(batches, 0, GATHER):
            for lang in set(b.column(1).to_pylist()):
                own = b.column(0).filter(pc.equal(b.column(1), lang))
                for at, n in slices(own, GATHER):
                    w = Words(own.slice(at, n))
                    letters = w.letters * np.bincount(w.at, minlength=w.n)
                    script = [int(letters[w.scripts >> k & 1 == 1].sum()) for k in range(n_scripts)]
                    held[lang] = held.get(lang, 0) + np.concatenate([w.counts(), np.array([*script, *[0] * (CHUNK - n_scripts)], np.int64)])
        cols = [(lang, k, v[k * CHUNK:(k + 1) * CHUNK].tobytes()) for lang, v in held.items() for k in range(BUCKETS // CHUNK + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cols], pa.string()), pa.array([c[1] for c in cols], pa.int32()),
                                          pa.array([c[2] for c in cols], pa.binary())], names=["lang", "chunk", "data"])

    schema = "lang string, chunk int, data binary"
    parts = stored(sample.mapInArrow(count, schema), "language-counts")
    summed = parts.repartition(n_partitions(docs.sparkSession), "lang", "chunk").mapInArrow(_sum_chunks, schema)
    counts = np.zeros((BUCKETS + CHUNK, len(langs)), np.int64)
    with small_batches(docs.sparkSession):
        for r in summed.collect():
            counts[r.chunk * CHUNK:(r.chunk + 1) * CHUNK, langs.index(r.lang)] = np.frombuffer(r.data, np.int64)
    grams, letters = counts[:BUCKETS], counts[BUCKETS:BUCKETS + n_scripts]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    own = letters >= np.maximum(1, SCRIPT_SHARE * letters.sum(axis=0))
    return LanguageModel(langs, logp, (own * (1 << np.arange(n_scripts, dtype=np.int64))[:, None]).sum(axis=0))


def viterbi(scores: np.ndarray, per_text: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word (texts in a row), all texts of the batch in step.

    A step goes over the texts that still have a word, longest first; staying
    is kept where it beats the best other language less the penalty.
    """
    n_words, langs = scores.shape
    if not n_words:
        return np.empty(0, np.int32)
    by_length = np.argsort(-per_text, kind="stable")
    rank = np.empty_like(by_length)
    rank[by_length] = np.arange(len(by_length))
    steps = int(per_text.max())
    active = len(per_text) - np.searchsorted(np.sort(per_text), np.arange(steps), "right")
    step_at = np.concatenate([[0], np.cumsum(active)])
    first = np.cumsum(per_text) - per_text
    t = np.arange(n_words) - np.repeat(first, per_text)
    place = step_at[t] + np.repeat(rank, per_text)  # step-major place of every word
    del t
    ordered = np.empty_like(scores)
    ordered[place] = scores
    del scores
    stay = np.ones((n_words, langs), bool)
    jump = np.zeros(n_words, np.int32)
    v = ordered[:active[0]].copy()
    last = np.zeros(len(per_text), np.int32)
    for s in range(1, steps):
        n, at = active[s], step_at[s]
        if n < len(v):
            last[n:len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        best = v.argmax(axis=1)
        other = v[np.arange(n), best][:, None] - switch
        keep = v >= other
        stay[at:at + n], jump[at:at + n] = keep, best
        v = np.where(keep, v, other) + ordered[at:at + n]
    last[:len(v)] = v.argmax(axis=1)
    label = np.empty(n_words, np.int32)
    now = last
    for s in range(steps - 1, -1, -1):
        n, at = active[s], step_at[s]
        label[at:at + n] = now[:n]
        if s:
            now[:n] = np.where(stay[np.arange(at, at + n), now[:n]], now[:n], jump[at:at + n])
    return label[place]


def label_words(texts: pa.Array, model: LanguageModel, switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    """The distinct words of texts, and every word's language number (texts in a row)."""
    words = Words(texts)
    scores = words.scores(model.logp)
    allowed = (words.scripts[:, None] & ~model.scripts[None, :]) == 0
    allowed |= ~allowed.any(axis=1, keepdims=True)
    scores = np.where(allowed | (words.letters == 0)[:, None], scores, np.float32(-1e9))
    words.word_of, words.buckets = [], []  # no longer needed
    return words, viterbi(scores[words.at], words.per_text, switch)


SPANS = "array<struct<start:int,words:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language with most letters, its share of
    all letters, and the runs of words of one language (first word, number of words)."""
    schema = T.StructType.fromDDL(f"doc_id long, lang_pred string, score double, spans {SPANS}")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = shipped.value
        langs = model.langs
        for b in gathered(batches, 1, GATHER):
            for at, n in slices(b.column(1), GATHER):
                own = b.column(1).slice(at, n)
                pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
                if langs:
                    words, label = label_words(own, model, switch)
                    doc = np.repeat(np.arange(n), words.per_text)
                    letters = np.bincount(doc * len(langs) + label, weights=words.letters[words.at], minlength=n * len(langs)).reshape(n, -1)
                    total, most = letters.sum(axis=1), letters.argmax(axis=1)
                    for i in np.flatnonzero(total > 0):
                        pred[i], score[i] = langs[most[i]], float(letters[i, most[i]] / total[i])
                    if len(doc):
                        first = np.cumsum(words.per_text) - words.per_text
                        begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
                        for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(doc)]):
                            if total[doc[s]] > 0:
                                spans[doc[s]].append({"start": int(s - first[doc[s]]), "words": e - s, "lang": langs[label[s]]})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(spans, span_type)], names=schema.names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, schema), "languages")


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def op4_language_viterbi(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
