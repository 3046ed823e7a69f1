"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds every distinct token of the training texts: its 64-bit hash
(XXH64) and its exact count, as two monotone sequences (hashes, and running
sums of counts).  Level 2 holds, for each token that was a context, its
successors, all of them (``LEAST`` is 1): successor numbers made monotone by
adding what the contexts before ended at, pointers to each context's range,
and discounted probabilities quantised to 65,536 values.  Both levels are cut
into key ranges, one file each in the shared folder, which scoring tasks map
into memory and query by successor search inside the context's range.

P(w | h) = q(h, w) + back(h) * P(w), where q is the discounted share of w after
h, back(h) what the kept successors leave, and P(w) the discounted share of w
among all tokens.  The discounted mass of all tokens is the probability of an
unknown token, so probabilities after any context sum to one.

Every text is a row of words and one end token, which is also the context of
the first word.

Defined results: null is the empty text, which is the end token alone; rows
that repeat count as often as they occur; without training texts no token is
known, train_tokens is 0 and every token has probability one.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.llm.common import gathered, shared_path, ship, slices, stored
from tunesift.llm.eliasfano import EliasFano, map_arrays, write_arrays

ship(__name__)

SEED = 42
#: White space can't be in a word, so this text stands for the end token.
END = b"\n"
#: Pairs seen less often are left to the backoff: none.
LEAST = 1
DISCOUNT = 0.75
#: Values of a file's quantised probabilities.
LEVELS = 1 << 16
#: Distinct tokens of a level-1 file, and training tokens of a level-2 file.
WORDS_A_FILE = 1 << 20
TOKENS_A_FILE = 1 << 21
GATHER = 8 << 20
#: Token numbers take this many bits of a pair's key.
BITS = 31


class Tokens:
    """Distinct words of texts and the texts as rows of word numbers, an end token (number 0) after each."""

    def __init__(self, texts: pa.Array):
        import xxhash
        texts = texts.fill_null("") if texts.null_count else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
        some = pc.greater(pc.binary_length(words), 0)
        flat = words.filter(some).dictionary_encode()
        of = xxhash.xxh64_intdigest
        self.hashes = np.array([of(END, SEED), *(of(w, SEED) for w in flat.dictionary.cast(pa.binary()).to_pylist())], np.uint64)
        text = parents.filter(some).to_numpy(zero_copy_only=False)
        per_text = np.bincount(text, minlength=len(texts))
        self.ends = np.cumsum(per_text + 1) - 1
        self.text = np.repeat(np.arange(len(texts)), per_text + 1)
        self.at = np.zeros(len(self.text), np.int64)
        inner = np.ones(len(self.text), bool)
        inner[self.ends] = False
        self.at[inner] = flat.indices.to_numpy(zero_copy_only=False) + 1
        self.before = np.concatenate([[0], self.at[:-1]])  # after an end comes a first word, whose context is the end


class Level1:
    """Token numbers and counts by hash, over files of successive hash ranges."""

    def __init__(self, files: list[tuple[str, int, int, int]]):
        """files: (path, first hash, tokens before, distinct tokens before) in hash order."""
        self.firsts = np.array([f[1] for f in files], np.uint64)
        self.tokens = [f[2] for f in files]
        self.words = [f[3] for f in files]
        self.parts = []
        for path, *_ in files:
            a = map_arrays(path)
            self.parts.append((EliasFano.open(a, "hash"), EliasFano.open(a, "sums")))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count or 0) of each token."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = np.searchsorted(self.firsts, hashes, "right") - 1
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(len(self.parts) + 1))
        for k, (keys, sums) in enumerate(self.parts):
            own = order[cuts[k]:cuts[k + 1]]
            at = keys.find(hashes[own] - self.firsts[k])
            own, at = own[at >= 0], at[at >= 0]
            number[own] = self.words[k] + at
            count[own] = (sums.access(at + 1) - sums.access(at)).astype(np.int64)
        return number, count

    def at_token(self, x: int) -> tuple[int, float]:
        """The number of the token that the x-th training token (in hash order) is an instance of, and how far into it x is (0 to 1)."""
        k = int(np.searchsorted(np.array(self.tokens), x, "right")) - 1
        sums = self.parts[k][1]
        i = int(sums.rank(np.array([x - self.tokens[k] + 1]))[0]) - 1
        a, b = (int(v) for v in sums.access(np.array([i, i + 1])))
        return self.words[k] + i, (x - self.tokens[k] - a) / (b - a)


class Level2:
    """Discounted probabilities of kept pairs and backoff weights of contexts, over files of successive key ranges."""

    def __init__(self, cuts: list[int], paths: list[str | None], split: dict[int, float]):
        self.cuts, self.split = np.array(cuts, np.int64), split
        self.parts = [Part2(map_arrays(p)) if p else None for p in paths]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """q of each pair key (context number << BITS | token number), sorted; 0 where not kept."""
        out = np.zeros(len(keys))
        places = np.searchsorted(keys, self.cuts[1:])
        for k, (a, b) in enumerate(zip([0, *places], [*places, len(keys)])):
            if a < b and self.parts[k] is not None:
                out[a:b] = self.parts[k].shares(keys[a:b])
        return out

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        """Backoff weight of each context number (sorted); 1 where nothing is kept after it."""
        out = np.ones(len(contexts))
        key = contexts << BITS
        places = np.searchsorted(key, self.cuts[1:])
        for k, (a, b) in enumerate(zip([0, *places], [*places, len(key)])):
            if a < b and self.parts[k] is not None:
                out[a:b] = self.parts[k].weights(contexts[a:b])
        if self.split:  # contexts that a cut divides
            which = np.array(sorted(self.split), np.int64)
            at = np.minimum(np.searchsorted(which, contexts), len(which) - 1)
            hit = which[at] == contexts
            out[hit] = np.array([self.split[int(c)] for c in which])[at[hit]]
        return out


class Part2:
    def __init__(self, a: dict[str, np.ndarray]):
        self.contexts, self.starts, self.successors = (EliasFano.open(a, x) for x in ("contexts", "starts", "successors"))
        self.codes, self.code_values, self.back, self.back_values = a["codes"], a["code_values"], a["back"], a["back_values"]

    @staticmethod
    def write(uri: str, keys: np.ndarray, q: np.ndarray, contexts: np.ndarray, back: np.ndarray) -> None:
        """keys: sorted pair keys; contexts: their distinct contexts with backoff weights."""
        own = keys >> BITS
        starts = np.concatenate([np.searchsorted(own, contexts), [len(keys)]])
        token = (keys & ((1 << BITS) - 1)) + 1
        last = token[starts[1:] - 1]  # what each context's range adds to those after it
        base = np.cumsum(last) - last
        codes, code_values = quantise(q)
        back_codes, back_values = quantise(back)
        write_arrays(uri, {**EliasFano.of(contexts).arrays("contexts"), **EliasFano.of(starts).arrays("starts"),
                           **EliasFano.of(np.repeat(base, np.diff(starts)) + token).arrays("successors"),
                           "codes": codes, "code_values": code_values, "back": back_codes, "back_values": back_values})

    def shares(self, keys: np.ndarray) -> np.ndarray:
        contexts, which = np.unique(keys >> BITS, return_inverse=True)
        at = self.contexts.find(contexts)
        met = np.maximum(at, 0)
        start, end = self.starts.access(met).astype(np.int64), self.starts.access(met + 1).astype(np.int64)
        base = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)), 0).astype(np.uint64)
        top = self.successors.access(end - 1)
        want = base[which] + ((keys & ((1 << BITS) - 1)) + 1).astype(np.uint64)
        out = np.zeros(len(keys))
        # a value past the context's last successor belongs to the next context's range
        ask = np.flatnonzero((at[which] >= 0) & (want <= top[which]))
        found = self.successors.find(want[ask])
        out[ask[found >= 0]] = self.code_values[self.codes[found[found >= 0]]]
        return out

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        at = self.contexts.find(contexts)
        return np.where(at >= 0, self.back_values[self.back[np.maximum(at, 0)]], 1.0)


def quantise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two-byte codes of probabilities and the ``LEVELS`` values at most they stand for: the means (of logarithms) of equally full bins of distinct values."""
    if not len(p):
        return np.empty(0, np.uint16), np.ones(1, np.float32)
    distinct, at = np.unique(np.log(p), return_inverse=True)
    bins = (np.arange(len(distinct)) * LEVELS // len(distinct)) if len(distinct) > LEVELS else np.arange(len(distinct))
    codes = bins[at]
    n = np.bincount(codes)
    values = np.bincount(codes, weights=distinct[at]) / np.maximum(n, 1)
    return codes.astype(np.uint16), np.exp(values).astype(np.float32)


@dataclass(frozen=True)
class Trie:
    files1: list[tuple[str, int, int, int]]
    tokens: int  # N
    words: int  # V
    discount: float  # of single tokens
    cuts: list[int]
    files2: list[str | None]
    split: dict[int, float]

    def level1(self) -> Level1:
        return Level1(self.files1)

    def level2(self) -> Level2:
        return Level2(self.cuts, self.files2, self.split)


def _level1(training: DataFrame, folder: str) -> Trie:
    spark = training.sparkSession

    def count(batches):
        for b in gathered(batches, 0, GATHER):
            for at, n in slices(b.column(0), GATHER):
                t = Tokens(b.column(0).slice(at, n))
                yield pa.RecordBatch.from_arrays([pa.array(t.hashes.view(np.int64)), pa.array(np.bincount(t.at, minlength=len(t.hashes)))],
                                                 names=["h", "n"])

    # unsigned order of hashes is the order of the signed number with its top bit turned
    turned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    counted = training.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 0")
    words = stored(counted.select(turned.alias("h"), "n"), "lm-words")
    total = words.agg(F.count(F.lit(1)), F.sum("n"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    distinct, tokens, once, twice = total[0], total[1] or 0, total[2], total[3]
    if not distinct:
        return Trie([], 0, 0, 0.0, [0], [None], {})

    def write(batches):
        keys, counts = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
            counts.append(b.column(1).to_numpy())
        if sum(map(len, keys)):
            h, n = np.concatenate(keys), np.concatenate(counts)
            path = f"{folder}/words-{uuid.uuid4().hex}"
            write_arrays(path, {**EliasFano.of(h - h[0]).arrays("hash"), **EliasFano.of(np.concatenate([[0], np.cumsum(n)])).arrays("sums")})
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([str(h[0])]), pa.array([int(n.sum())]), pa.array([len(h)])],
                                             names=["path", "first", "tokens", "words"])

    parts = max(1, -(-distinct // WORDS_A_FILE))
    made = stored(words.repartitionByRange(parts, "h").sortWithinPartitions("h").mapInArrow(
        write, "path string, first string, tokens long, words long"), "lm-level1").collect()
    files, n, v = [], 0, 0
    for r in sorted(made, key=lambda r: int(r.first)):
        files.append((r.path, int(r.first), n, v))
        n, v = n + r.tokens, v + r.words
    discount = once / (once + 2 * twice) if once else DISCOUNT
    return Trie(files, tokens, distinct, min(max(discount, 0.1), 0.95), [0], [None], {})


def _cuts(trie: Trie, tokens_a_file: int) -> list[int]:
    """Keys that deal the pairs out about evenly: places in the running counts of contexts, and
    inside one context, which may have most pairs, places in the running counts of tokens."""
    level = trie.level1()
    parts = max(1, -(-trie.tokens // tokens_a_file))
    cuts = {0}
    for k in range(1, parts):
        context, inside = level.at_token(k * trie.tokens // parts)
        token, _ = level.at_token(min(trie.tokens - 1, int(inside * trie.tokens)))
        cuts.add(context << BITS | token)
    return sorted(cuts)


def _pair_keys(t: Tokens, number: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of every token with its context, whether a kept pair is possible)."""
    known = count >= LEAST  # a pair is no more frequent than its parts
    possible = known[t.at] & known[t.before]
    return number[t.before] << BITS | np.maximum(number[t.at], 0), possible


def _level2(training: DataFrame, trie: Trie, folder: str, tokens_a_file: int) -> Trie:
    spark = training.sparkSession
    cuts = _cuts(trie, tokens_a_file)
    edges = np.array(cuts, np.int64)

    def count(batches):
        level = trie.level1()
        for b in gathered(batches, 0, GATHER):
            for at, n in slices(b.column(0), GATHER):
                t = Tokens(b.column(0).slice(at, n))
                keys, possible = _pair_keys(t, *level.look_up(t.hashes))
                keys, times = np.unique(keys[possible], return_counts=True)
                ends = [*np.searchsorted(keys, edges[1:]), len(keys)]
                rows = [(k, zlib.compress(np.diff(keys[a:z], prepend=0).tobytes(), 1), zlib.compress(times[a:z].astype(np.uint32).tobytes(), 1))
                        for k, (a, z) in enumerate(zip([0, *ends], ends)) if a < z]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                                  pa.array([r[2] for r in rows], pa.binary())], names=["part", "pairs", "times"])

    def merge(held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(a), np.int64)) for a, _ in held])
        times = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint32) for _, b in held]).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # few sorted runs
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(times, first)

    def write(batches):
        level, out = trie.level1(), []

        def finish(part, held):
            keys, times = merge(held)
            keep = times >= LEAST
            keys, times = keys[keep], times[keep]
            if not len(keys):
                return
            contexts, which = np.unique(keys >> BITS, return_inverse=True)
            share = (times - DISCOUNT) / level_counts(level, contexts)[which]
            kept = np.bincount(which, weights=share)
            path = f"{folder}/pairs-{uuid.uuid4().hex}"
            Part2.write(path, keys, share, contexts, np.maximum(1 - kept, 1e-12))
            out.append((part, path, int(contexts[0]), float(kept[0]), int(contexts[-1]), float(kept[-1])))

        part, held = None, []
        for b in batches:
            for p, pairs, times in zip(*(b.column(k).to_pylist() for k in range(3))):
                if p != part:
                    if held:
                        finish(part, held)
                    part, held = p, []
                held.append((pairs, times))
        if held:
            finish(part, held)
        if out:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["part", "path", "first", "first_kept", "last", "last_kept"])

    rows = stored(training.mapInArrow(count, "part int, pairs binary, times binary"), "lm-pairs")
    made = stored(rows.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("part").mapInArrow(
        write, "part int, path string, first long, first_kept double, last long, last_kept double"), "lm-level2").collect()
    paths = {r.part: r.path for r in made}
    kept: dict[int, dict[int, float]] = {}
    for r in made:  # only the first and last context of a file can go on in another
        kept.setdefault(r.first, {})[r.part] = r.first_kept
        kept.setdefault(r.last, {})[r.part] = r.last_kept
    divided = {c >> BITS for c in cuts[1:]}
    split = {c: max(1 - sum(v.values()), 1e-12) for c, v in kept.items() if c in divided}
    return replace(trie, cuts=cuts, files2=[paths.get(k) for k in range(len(cuts))], split=split)


def level_counts(level: Level1, numbers: np.ndarray) -> np.ndarray:
    """Counts of tokens by their numbers (sorted)."""
    out = np.zeros(len(numbers), np.int64)
    bounds = [*np.searchsorted(numbers, level.words[1:]), len(numbers)]
    for k, (a, b) in enumerate(zip([0, *bounds], bounds)):
        at = numbers[a:b] - level.words[k]
        out[a:b] = (level.parts[k][1].access(at + 1) - level.parts[k][1].access(at)).astype(np.int64)
    return out


def fit(docs: DataFrame, training: Column, text_col: str = "text", folder: str | None = None,
        tokens_a_file: int = TOKENS_A_FILE) -> Trie:
    """Build both levels from all rows that meet ``training``, under ``folder`` (in the shared folder by default)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "lm")
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    texts = docs.filter(training).select(F.col(text_col).cast("string").alias("text"))
    trie = _level1(texts, folder)
    return _level2(texts, trie, folder, tokens_a_file) if trie.tokens else trie


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(texts: pa.Array, trie: Trie, level1: Level1, level2: Level2) -> list[np.ndarray]:
    """n_tokens, n_known, base score and model score of each text."""
    t = Tokens(texts)
    number, count = level1.look_up(t.hashes)
    total = max(trie.tokens, 1)
    base = np.log10((count + 1) / (trie.tokens + trie.words + 1))
    unknown = trie.discount * trie.words / total if trie.tokens else 1.0
    alone = np.where(count > 0, (count - trie.discount) / total, unknown)
    keys, possible = _pair_keys(t, number, count)
    share, back = np.zeros(len(t.at)), np.ones(len(t.at))
    if trie.tokens:
        distinct, which = np.unique(keys[possible], return_inverse=True)
        share[possible] = level2.look_up(distinct)[which]
        met = np.unique(number[count > 0])
        weight = np.ones(len(t.hashes))
        weight[count > 0] = level2.backoff(met)[np.searchsorted(met, number[count > 0])]
        back = weight[t.before]
    p = np.log10(share + back * alone[t.at])
    n = len(texts)
    return [np.bincount(t.text, minlength=n), np.bincount(t.text, weights=count[t.at] > 0, minlength=n).astype(np.int64),
            np.bincount(t.text, weights=base[t.at], minlength=n), np.bincount(t.text, weights=p, minlength=n)]


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCORES`` of every row: tokens, those seen in training, N, and log10 probabilities of the
    text under add-one counts (base) and under the trie."""
    schema = T.StructType.fromDDL(SCORES)
    shipped = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        trie = shipped.value
        level1, level2 = trie.level1(), trie.level2()
        for b in gathered(batches, 1, GATHER):
            for at, n in slices(b.column(1), GATHER):
                tokens, known, base, model = score_texts(b.column(1).slice(at, n), trie, level1, level2)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(tokens), pa.array(known), pa.array(np.full(n, trie.tokens)),
                                                  pa.array(base), pa.array(model)], names=schema.names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, schema), "lm-scores")


def op10_lm_elias_fano(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    trie = fit(docs, ~held_out)
    return score(docs, trie).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
