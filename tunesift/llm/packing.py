"""Packing documents into training sequences by bin completion.

Documents become token ids (plus an end id) and are cut only where longer than
a sequence.  Packing works on the histogram of piece lengths, which has at
most ``capacity`` entries however many pieces there are: around the largest
remaining length, undominated fillings are searched branch-and-bound (sizes in
falling order, each as often as fits and then less, pruned where the waste
can't fall below the incumbent's, which starts as the best-fit filling),
and the best filling is repeated while its lengths last.  Whole packings are
pruned by their waste against the incumbent packing, first best-fit's, until
the lower bound is met or the search effort is spent; every piece is always
packed.  Pieces then find their place by their rank among all pieces.

Defined results: a null or empty text is one piece of the end id alone;
repeated rows are packed as often as they occur; a null id is kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesift.llm.common import gathered, global_rank, kept_by_worker, ship, slices, stored, utf8_view

ship(__name__)

CAPACITY = 4096
#: Search nodes per filling and whole packings tried: effort, not data; what they
#: leave undecided keeps the best packing found.
FILL_EFFORT = 400
PACKINGS = 4
#: Distinct stems that a worker keeps tokenised.
CACHE = 500_000
#: Trailing marks that are kept apart from a word.
TAIL = ".,;:!?"
#: Bytes of text whose distinct words are looked up together.
GATHER = 8 << 20


class WordTokens:
    """Token ids of texts, one dictionary of distinct words at a time.

    White space always ends a token here, so a text's ids are its words' ids
    in a row.  Punctuation after a letter or digit is a token run of its own
    and the case of A-Z is dropped, so words are kept as stems and tails.
    The most used half survives when more than ``CACHE`` are kept.
    """

    def __init__(self, spec: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self._keep([], np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64))

    def _keep(self, units: list[str], pool: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> None:
        self.units, self.pool, self.sizes, self.uses = units, pool, sizes, uses
        self.starts = np.cumsum(sizes) - sizes
        self.place = dict(zip(units, range(len(units))))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in a row, and how many each has."""
        return _runs(self.pool, self.starts[at], self.sizes[at]), self.sizes[at]

    def _units(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the cache; those not there are tokenised."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, ids, sizes = [words[i] for i in missing.tolist()], [], []
            for k in range(0, len(new), 4096):
                for e in self.tokenizer.encode_batch_fast(new[k:k + 4096], add_special_tokens=False):
                    own = e.ids
                    ids += own
                    sizes.append(len(own))
            first = len(self.units)
            at[missing] = np.arange(first, first + len(new))
            self.place.update(zip(new, range(first, first + len(new))))
            self.units += new
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
            self.pool = np.concatenate([self.pool, np.array(ids, "<u4")])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[at] += 1
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        bare = pc.utf8_rtrim(low, characters=TAIL)
        cut = pc.and_(pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"), pc.less_equal(pc.subtract(pc.binary_length(low), pc.binary_length(bare)), 8))
        bare = pc.if_else(cut, bare, low).dictionary_encode()
        which = bare.indices.to_numpy(zero_copy_only=False)
        raw, ends = utf8_view(low)
        tail = np.diff(ends) - pc.binary_length(bare.dictionary).to_numpy(zero_copy_only=False)[which]
        code = np.zeros(len(low), np.uint64)
        for k in range(8):
            on = np.flatnonzero(tail > k)
            code[on] = code[on] << np.uint64(8) | raw[ends[on + 1] - tail[on] + k]
        codes, tails = np.unique(code, return_inverse=True)
        stem_at = self._units(bare.dictionary.to_pylist())[which]
        tail_at = self._units([int(c).to_bytes(8, "big").lstrip(b"\0").decode() for c in codes])[tails]
        ids, sizes = self._gather(np.stack([stem_at, tail_at], axis=1).reshape(-1))
        if len(self.units) > CACHE:
            best = np.sort(np.argsort(-self.uses, kind="stable")[:CACHE // 2])
            self._keep([self.units[i] for i in best.tolist()], *self._gather(best), self.uses[best] // 2)
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (n + 1 offsets)."""
        if texts.null_count:
            texts = texts.fill_null("")
        split = pc.ascii_split_whitespace(texts)
        flat = pc.list_flatten(split).dictionary_encode()
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids, sizes = self._words(flat.dictionary)
        word = flat.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[word])]).astype(np.int64)
        return _runs(ids, (np.cumsum(sizes) - sizes)[word], sizes[word]), ends[per_text]


def _runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pool's runs of the given starts and sizes, in a row."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(n) + np.repeat(starts - ends + sizes, sizes)]


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut at ``capacity``.

    Splitting at ASCII white space first needs a tokenizer that never joins or
    tells apart tokens across it.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)

    def run(batches):
        # a worker's tasks share one cache of tokenised words
        tokens = kept_by_worker(("word_tokens", zlib.crc32(spec.value.encode()), len(spec.value)), lambda: WordTokens(spec.value))
        for b in gathered(batches, 1, GATHER):
            for at, n in slices(b.column(1), GATHER):
                ids, ends = tokens.texts(b.column(1).slice(at, n))
                doc, piece, start, length, crc, own = [], [], [], [], [], []
                for i in range(n):
                    mine = np.append(ids[ends[i]:ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(mine), capacity)):
                        part = mine[s:s + capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int32))
                cols = [b.column(0).slice(at, n).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(own, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, schema), "pieces")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: by tokens, or by pieces of which no two fit together (Martello and Toth's L2)."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    tokens, pieces = np.concatenate([[0], np.cumsum(counts * size)]), np.concatenate([[0], np.cumsum(counts)])
    half = capacity // 2
    for k in np.flatnonzero(counts[:half + 1]):
        huge = int(pieces[capacity + 1] - pieces[capacity - k + 1])
        large = int(pieces[capacity - k + 1] - pieces[half + 1])
        free = large * capacity - int(tokens[capacity - k + 1] - tokens[half + 1])
        rest = int(tokens[half + 1] - tokens[k])
        best = max(best, huge + large + max(0, -(-(rest - free) // capacity)))
    return best


def fill(counts: np.ndarray, room: int, effort: int, rank: int = 0) -> list[int]:
    """The least wasteful filling of ``room`` by sizes in ``counts`` (falling order).

    The best-fit filling is the incumbent, whatever the effort; ``effort``
    bounds the (size, times) nodes of the search for better ones.  ``rank`` > 0
    sets aside that many of the best ones (for another branch).
    """
    present = np.flatnonzero(counts[:room + 1]).tolist()
    if not present:
        return []
    have = counts[present].tolist()
    tokens = np.concatenate([[0], np.cumsum(np.array(present) * np.array(have))]).tolist()
    best: list[tuple[int, int]] | None = None
    least, nodes, skip = room + 1, 0, rank
    chosen: list[tuple[int, int]] = []
    k, r, first = len(present) - 1, room, True
    while True:
        # from here down, as many as fit of the largest that fits
        k = min(k, bisect_right(present, r) - 1)
        while k >= 0 and tokens[k + 1] > r - least and (first or nodes < effort):
            times = min(have[k], r // present[k])
            chosen.append((k, times))
            r -= times * present[k]
            nodes += not first
            k = min(k - 1, bisect_right(present, r) - 1)
        if k < 0 and r < least:  # nothing fits any more: undominated
            if skip and r == 0:
                skip -= 1
            else:
                best, least = chosen[:], r
        first = False
        if not least or nodes >= effort:
            break
        # one less of the last size that smaller ones may replace with less waste
        while chosen:
            k, times = chosen.pop()
            again = r + present[k]
            if again >= 2 * present[0] and tokens[k] > again - least:
                if times > 1:
                    chosen.append((k, times - 1))
                k, r = k - 1, again
                break
            r += times * present[k]
        else:
            break
    if best is None:
        return fill(counts, room, effort)
    return [present[k] for k, times in best for _ in range(times)]


Pattern = tuple[int, tuple[int, ...]]  # times, lengths


def packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (times, lengths of a sequence) that use every length as often as it occurs."""
    counts = np.zeros(capacity + 2, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    total, bound = int((counts * np.arange(len(counts))).sum()), lower_bound(counts, capacity)
    best = _pack(counts.copy(), capacity, 0, 0, None)
    for turn in range(1, PACKINGS + 1):
        used = sum(t for t, _ in best)
        if used <= bound:
            break
        allowed = (used - 1) * capacity - total  # waste beyond this can't improve on the incumbent
        found = _pack(counts.copy(), capacity, FILL_EFFORT * 4 ** (turn - 1), turn - 1, allowed)
        if found is not None and sum(t for t, _ in found) < used:
            best = found
    return best


def _pack(left: np.ndarray, capacity: int, effort: int, branch: int, allowed: int | None) -> list[Pattern] | None:
    """One packing from the largest piece down; None once its waste exceeds ``allowed``.
    ``branch`` > 0 takes another than the best filling for the first patterns."""
    out: list[Pattern] = []
    top, waste, bins = capacity, 0, 0
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        left[top] -= 1
        lengths = (top, *fill(left, capacity - top, effort, branch if len(out) < branch else 0))
        left[top] += 1
        use: dict[int, int] = {}
        for s in lengths:
            use[s] = use.get(s, 0) + 1
        times = min(int(left[s]) // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
        out.append((times, lengths))
        waste += times * (capacity - sum(lengths))
        bins += times
        if allowed is not None and waste > allowed + (capacity - sum(lengths)) * (not left.any()):
            return None


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (long).

    Needs the columns doc_id, piece and length; others stay.  Only the length
    histogram reaches the driver, and only the patterns (bounded by it) leave it.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = packing(histogram, capacity)
    order = sorted(histogram, reverse=True)
    first, at = {}, 0
    for size in order:
        first[size] = at
        at += histogram[size]
    entries, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            n = lengths.count(size)
            entries.append((first[size], size, n, sequence, offset))
            first[size] += n * times
            offset += n * size
        sequence += times
    table = np.array(sorted(entries) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    ranked = global_rank(pieces, [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), "piece"], "piece-ranks", "_rank")
    schema = T.StructType([*ranked.drop("_rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            start, size, per, sequence, offset = table[np.searchsorted(table[:, 0], rank, "right") - 1].T
            i = rank - start
            cols = [b.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence + i // per), pa.array(offset + i % per * size)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed token ids; pieces need their ``ids``. A group is one sequence."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op6_pack_bin_completion(spark, sf):
    import public_tokenizers
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = tokenised_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
