"""Alignment of two tokenizers' tokens over the same bytes.

A text with a space before it is cut by a byte-level BPE (A) and a piece model
with byte fallback (B).  Each side's cumulative token ends become a dictionary
from end to token index; the ends in both dictionaries' key sets, sorted, slice
the two id lists into groups.  Every A id of a group is linked with every B id
of it.  A pair's count is the number of documents, over all documents, that
hold it linked.

No token of either side runs from a letter or mark into a following space (the
text patterns of A end there, and no piece of B goes on after one with a space;
a model of which that isn't true is applied to whole texts), so a text is cut
before such spaces and equal segments are aligned once: a worker keeps up to
``CACHE`` of them (of more, the more used half).  Dictionaries cover ``WINDOW`` bytes at a time, so a long
segment needs no more memory for them than a short one.  Links are kept as each document's distinct
pairs with how often they occur; a group whose sides are long is expanded by
its distinct ids.  Counts come from a partial aggregate over those pairs and
go back to the documents in parts of ``PART`` sorted pairs, read by the tasks
from the shared folder, so no worker holds more than a part; pairs of one
document need no entry.  Each A id's highest count has the vocabulary as bound.

Ids of A are those of its JSON file: its vocabulary runs as byte ranks, which
give the same ids, and the JSON tokenizer itself takes texts whose white space
runs are too long for that.

Defined results: null and empty texts, and those whose joined token bytes differ
from the text, have no tokens: zeros and an empty group list; null ids and
repeated rows are rows and documents of their own; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import kept_by_worker, shared_path, ship, slices, stored

ship(__name__)

#: Bytes of text worked on together, and of a dictionary's window.
GATHER, WINDOW = 1 << 20, 1 << 18
#: Links expanded at once; a group with more goes by its distinct ids.
EXPAND = 1 << 20
#: Pairs of a part of the counts.
PART = 1 << 22
#: Files of a part, one a task.
PART_FILES = 8
#: Segments that a worker keeps, and the longest of those in characters.
CACHE, KEPT_LENGTH = 400_000, 64
#: Where a text is cut: before spaces that follow anything but white space, and that anything but spaces follows.
CUT = re.compile(r"(?<=\S)(?= +[^ ])")
#: Characters of white space in a row from which the ranks' pattern matcher isn't used.
LONG_SPACE = re.compile(r"\s{50000}")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with every id's bytes."""

    def __init__(self, a_spec: str, b_model: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        self.a_spec = a_spec
        said = json.loads(a_spec)
        letters = byte_alphabet()
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in said["model"]["vocab"].items() if w not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for w, i in ranks.items():
            self.a_bytes[i] = w
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(w) for w in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.cuts = not any(re.search(r"[^▁]▁", p) for p in pieces)
        self.segments = Segments(self)
        self.said = [[np.array([b"%d%s" % (i, end) for i in range(len(x))], object) for end in ends]
                     for x, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";")))]

    def a_ids(self, text: str) -> list[int]:
        if len(text) >= 50000 and LONG_SPACE.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(self.a_spec)
        t.encode_special_tokens = True
        return t


def common_ends(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted ends that two token runs share: how many tokens of each lie up to there."""
    cut_a, cut_b = [], []
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.arange(window, a[-1] + window, window)
    i = j = 0
    for to_a, to_b in zip(np.searchsorted(a, bounds, "right").tolist(), np.searchsorted(b, bounds, "right").tolist()):
        by_a = dict(zip(a[i:to_a].tolist(), range(i + 1, to_a + 1)))
        by_b = dict(zip(b[j:to_b].tolist(), range(j + 1, to_b + 1)))
        both = sorted(by_a.keys() & by_b.keys())
        cut_a += map(by_a.__getitem__, both)
        cut_b += map(by_b.__getitem__, both)
        i, j = to_a, to_b
    return np.array(cut_a, np.int64), np.array(cut_b, np.int64)


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, back, times)
    return distinct, out


def link_pairs(text: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, b_ids: int,
               expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text << 32 | a * b_ids + b) of all links of the groups, sorted, and how often each occurs.

    Group g holds ids_a[at_a[g]:at_a[g + 1]] and ids_b[at_b[g]:at_b[g + 1]] and lies in text[g]."""
    na, nb = np.diff(at_a), np.diff(at_b)
    links = na * nb
    keys, times = [], []
    for g in np.flatnonzero(links > expand).tolist():
        a, ca = np.unique(ids_a[at_a[g]:at_a[g + 1]], return_counts=True)
        b, cb = np.unique(ids_b[at_b[g]:at_b[g + 1]], return_counts=True)
        keys.append((text[g] << 32 | (a[:, None] * b_ids + b[None, :])).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
    small = np.flatnonzero(links <= expand)
    total = np.cumsum(links[small])
    for k in np.split(small, np.searchsorted(total, np.arange(expand, total[-1], expand))) if len(small) else []:
        pairs_a = np.repeat(_runs(na[k]) + np.repeat(at_a[k], na[k]), np.repeat(nb[k], na[k]))
        # each A token of a group meets the group's B tokens in order
        pairs_b = _runs(np.repeat(nb[k], na[k])) + np.repeat(np.repeat(at_b[k], na[k]), np.repeat(nb[k], na[k]))
        found = np.unique(np.repeat(text[k], links[k]) << 32 | (ids_a[pairs_a] * b_ids + ids_b[pairs_b]), return_counts=True)
        keys.append(found[0])
        times.append(found[1])
    if len(keys) == 1:
        return keys[0], times[0]
    return _summed(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align_texts(texts: list[str | None], t: Tokenizers) -> tuple:
    """Tokens, groups, links, groups in words, and distinct pairs with how often they are linked, of a few texts (0, no
    words and no pairs where a text has no tokens): five lists, offsets of the pairs, pairs, times."""
    n = len(texts)
    real = [i for i, x in enumerate(texts) if x]
    cut = [(i, t.a_ids(" " + texts[i]), ids_b) for i, ids_b in zip(real, t.b.encode([texts[i] for i in real], num_threads=1))]
    kept = []
    for i, a, b in cut:
        raw = (" " + texts[i]).encode()
        if b"".join(map(t.a_bytes.__getitem__, a)) == raw == b"".join(map(t.b_bytes.__getitem__, b)):
            kept.append((i, a, b))
    del cut
    count_a, count_b = (np.array([len(x[k]) for x in kept], np.int64) for k in (1, 2))
    ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x[k] for x in kept), np.int64, c.sum()) for k, c in ((1, count_a), (2, count_b)))
    # ends run on from text to text; a text's last is common, so no group spans two
    cut_a, cut_b = common_ends(np.cumsum(t.a_size[ids_a]), np.cumsum(t.b_size[ids_b]))
    at_a, at_b = np.concatenate([[0], cut_a]), np.concatenate([[0], cut_b])
    na, nb = np.diff(at_a), np.diff(at_b)
    text = np.searchsorted(np.cumsum(count_a), at_a[:-1], "right") if len(kept) else np.zeros(0, np.int64)

    def per_text(values):
        out = np.zeros(n, np.int64)
        out[[x[0] for x in kept]] = values
        return out
    links = np.zeros(len(kept), np.int64)
    np.add.at(links, text, na * nb)
    # groups in words: each one's A ids, then its B ids, the last of each with the mark that follows
    words = np.empty(len(ids_a) + len(ids_b), object)
    words[np.arange(len(ids_a)) + np.repeat(at_b[:-1], na)] = t.said[0][0][ids_a]
    words[at_a[1:] - 1 + at_b[:-1]] = t.said[0][1][ids_a[at_a[1:] - 1]]
    words[np.arange(len(ids_b)) + np.repeat(at_a[1:], nb)] = t.said[1][0][ids_b]
    words[at_a[1:] + at_b[1:] - 1] = t.said[1][1][ids_b[at_b[1:] - 1]]
    words, said, at = words.tolist(), [b""] * n, 0
    for x, size in zip(kept, (count_a + count_b).tolist()):
        said[x[0]] = b"".join(words[at:at + size])[:-1]
        at += size
    del words
    keys, times = link_pairs(text, at_a, at_b, ids_a, ids_b, len(t.b_bytes))
    own = np.zeros(n, np.int64)
    own[[x[0] for x in kept]] = np.bincount(keys >> 32, minlength=len(kept))
    counts = [per_text(v) for v in (count_a, count_b, np.bincount(text, minlength=len(kept)), links)]
    return *counts, said, np.concatenate([[0], np.cumsum(own)]), keys & 0xFFFFFFFF, times


class Segments:
    """Aligned segments of texts, by their text."""

    def __init__(self, tokenizers: "Tokenizers"):
        self.tokenizers = tokenizers
        self.place: dict[str, int] = {}
        self.long: list[str] = []
        self.counts, self.said, self.uses = np.zeros((4, 0), np.int64), [], np.zeros(0, np.int64)
        self.ends, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, segments: list[str]) -> np.ndarray:
        """Places of segments (each with its leading space); those not met are aligned first."""
        new = [x for x in dict.fromkeys(segments) if x not in self.place]
        if new:
            self.long = [x for x in new if len(x) > KEPT_LENGTH]  # last, so that they can go again
            new = [x for x in new if len(x) <= KEPT_LENGTH] + self.long
            *counts, said, ends, pairs, times = align_texts([x[1:] for x in new], self.tokenizers)
            self.place.update(zip(new, range(len(self.said), len(self.said) + len(new))))
            self.counts = np.concatenate([self.counts, np.stack(counts)], axis=1)
            self.said += said
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
            self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at

    def trim(self) -> None:
        """Forget the long ones that came in last and, where there are too many, the less used half."""
        keep = len(self.said) - len(self.long)
        if keep > CACHE:
            self._only(np.sort(np.argsort(-self.uses[:keep], kind="stable")[:CACHE // 2]))
        elif self.long:
            self._only(np.arange(keep))

    def _only(self, kept: np.ndarray) -> None:
        names = list(self.place)  # in the order of their places
        count = self.ends[kept + 1] - self.ends[kept]
        at = np.repeat(self.ends[kept] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.counts, self.said, self.uses, self.long = self.counts[:, kept], [self.said[i] for i in kept.tolist()], self.uses[kept], []
        self.ends, self.pairs, self.times = np.concatenate([[0], np.cumsum(count)]), self.pairs[at], self.times[at]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<int>, times array<long>"


def aligned_columns(texts: list[str | None], t: Tokenizers) -> list[pa.Array]:
    """The columns of ``ALIGNED`` but the id, for a few texts."""
    n = len(texts)
    cut = [(CUT.split(" " + x) if t.cuts else [" " + x]) if x else [] for x in texts]
    at = t.segments.find(list(itertools.chain.from_iterable(cut)))
    size = np.array([len(x) for x in cut], np.int64)
    text = np.repeat(np.arange(n), size)
    cache = t.segments
    # a text one of whose segments has no tokens has none
    bad = np.zeros(n, bool)
    bad[text[cache.counts[0, at] == 0]] = True
    at, text = at[~bad[text]], text[~bad[text]]
    size = np.where(bad, 0, size)
    sums = np.zeros((4, n), np.int64)
    for out, own in zip(sums, cache.counts):
        np.add.at(out, text, own[at])
    said, words, first = [], [cache.said[i] for i in at.tolist()], 0
    for k in size.tolist():
        said.append(b";".join(words[first:first + k]))
        first += k
    each, often = np.unique(text << 32 | at, return_counts=True)
    text, at = each >> 32, each & 0xFFFFFFFF
    count = cache.ends[at + 1] - cache.ends[at]
    place = np.repeat(cache.ends[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    keys, times = _summed(np.repeat(text, count) << 32 | cache.pairs[place], np.repeat(often, count) * cache.times[place])
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=n))]).astype(np.int32))
    cache.trim()
    return [*(pa.array(v) for v in sums), pa.array(said, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array((keys & 0xFFFFFFFF).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(times))]


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ALIGNED`` of every row: tokens, groups as ``a1,a2|b1;a3|b2``, and distinct linked pairs (a * size of B + b) with their number."""
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    names, key = [c.split()[0] for c in ALIGNED.split(", ")], ("alignment", uuid.uuid4().hex)

    def run(batches):
        t = kept_by_worker(key, lambda: Tokenizers(*files.value))
        for b in batches:
            for at, n in slices(b.column(1), GATHER):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), *aligned_columns(b.column(1).slice(at, n).to_pylist(), t)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, b_ids: int) -> tuple[DataFrame, np.ndarray]:
    """(pair, n) of pairs in two documents or more, and each A id's highest count."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "alignment-counts")
    # one row an A id: the vocabulary is the bound
    most = counts.groupBy(F.expr(f"pair div {b_ids}").alias("a")).agg(F.max("n").alias("n")).collect()
    highest = np.zeros(1 + max((r.a for r in most), default=0), np.int64)
    for r in most:
        highest[r.a] = r.n
    return counts.filter("n > 1"), highest


def _part_of_counts(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=files, columns=["pair", "n"], partitioning=None) for f in found if f.path.endswith(".parquet")]
    if not tables:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    t = pa.concat_tables(tables).sort_by("pair")
    return t.column("pair").to_numpy(), t.column("n").to_numpy()


def score_links(rows: DataFrame, counts: DataFrame, highest: np.ndarray, b_ids: int, part_pairs: int = PART) -> DataFrame:
    """The stored rows without their pairs, but with ``n_best`` (links whose count is their A id's highest) and ``count_sum`` (over links)."""
    spark = rows.sparkSession
    parts = max(1, -(-counts.count() // part_pairs))
    folder = shared_path(spark, "alignment-parts")
    part = F.pmod("pair", F.lit(parts))
    dealt = counts.withColumn("part", part).repartitionById(PART_FILES * parts, part * PART_FILES + F.pmod(F.hash("pair"), F.lit(PART_FILES)))
    dealt.write.partitionBy("part").parquet(folder)
    top = spark.sparkContext.broadcast(highest)
    own = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = rows.select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).schema

    def scored(part):
        def run(batches):
            known, n = kept_by_worker(("alignment-part", folder, part), lambda: _part_of_counts(folder, part))
            for b in batches:
                lists = b.column(len(own))
                pairs, times = lists.flatten().to_numpy(), b.column(len(own) + 1).flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                if parts > 1:
                    here = pairs % parts == part
                    pairs, times, row = pairs[here], times[here], row[here]
                count = np.ones(len(pairs), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    met = known[at] == pairs
                    count[met] = n[at[met]]
                best, total = np.zeros((2, b.num_rows), np.int64)
                np.add.at(best, row, times * (count == top.value[pairs // b_ids]))
                np.add.at(total, row, times * count)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(own))), pa.array(best), pa.array(total)], names=schema.names)
        return rows.select(*own, "pairs", "times").mapInArrow(run, schema)

    passes = functools.reduce(DataFrame.unionAll, [scored(k) for k in range(parts)])
    if parts > 1:
        passes = passes.groupBy("row").agg(*[F.first(c).alias(c) for c in own[1:]], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored(passes.drop("row"), "alignment-scores")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
          part_pairs: int = PART) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row; with ``digest``, the
    hex SHA-256 of the groups (empty where there are none) as ``groups_sha256`` in their place."""
    import sentencepiece
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    rows = aligned(docs, a_file, b_file, id_col, text_col)
    said = F.when(F.octet_length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256") if digest else F.decode("groups", "utf-8").alias("groups")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", said, "pairs", "times"), "alignment")
    counts, highest = pair_counts(rows, b_ids)
    return score_links(rows, counts, highest, b_ids, part_pairs) \
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digest else "groups")


def op12_align_dictionaries(spark, sf):
    import public_tokenizers
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
