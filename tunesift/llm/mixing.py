"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are counted in words.  Targets share the whole by weight, but no source
gets more than ``max_epochs`` times what it holds (the excess is reshared by
weight).  Every source's documents lie in a seeded order inside each shard and
are cut into blocks of equally many words.  Blocks go to sources by highest
quotients t/(2k+1), then each source's blocks go to its shards the same way,
so all quotas are whole numbers; inside a shard a seeded selection of exactly
the quota takes blocks (whole passes first).

Defined results: null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 take 0; a source of size 0 has target 0;
repeated rows are rows of their own; an empty table gives an empty result.
The number of sources is the mix's own configuration (one weight each): their
totals are the only data on the driver.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import running_total, ship, stored, word_counts

ship(__name__)

SHARDS = 8
#: Words of a block: small against any source's share, so rounding stays under one block a shard.
BLOCK = 16
#: With steps below this, block number times step fits 63 bits for up to 2^35 blocks a shard and source.
MAX_STEP = 1 << 28


def water_fill(sizes: list[int], weights: list[float], max_epochs: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above max_epochs * size."""
    total, left = float(sum(sizes)), set(i for i, s in enumerate(sizes) if s)
    target = [0.0] * len(sizes)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / w > max_epochs * sizes[i]]
        if not over:
            for i in left:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = float(max_epochs * sizes[i])
        total -= sum(target[i] for i in over)
        left -= set(over)
    return target


def sainte_lague(shares: list[float], seats: int, caps: list[int]) -> list[int]:
    """Whole seats by highest quotients share/(2k+1), none above its cap; ties to the first.

    Starts from the whole part of the exact share less one, which the method
    always reaches, so the heap deals only the last few seats of each.
    """
    total = sum(shares)
    if not total or seats <= 0:
        return [0] * len(shares)
    seats = min(seats, sum(c for c, s in zip(caps, shares) if s > 0))
    got = [0] * len(shares)
    # a divisor that deals too few for sure, then one seat at a time
    lo = total / seats * (1 - 1e-12)
    for _ in range(200):
        trial = [min(c, int(s / lo + 0.5)) for s, c in zip(shares, caps)]
        if sum(trial) <= seats - len(shares) or sum(trial) == 0:
            got = trial
            break
        lo *= 1 + max(1, len(shares)) / max(1, seats)
    heap = [(-s / (2 * got[i] + 1), i) for i, s in enumerate(shares) if s > 0 and got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def _seeded(*parts) -> int:
    import xxhash
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode(), 42)


def block_rule(n: int, quota: int, *seed) -> tuple[int, int, int, int]:
    """(whole passes, extra blocks r, step, start): block i is taken passes + (1 if
    (i * step + start) mod n < r).  The step is prime to n, so exactly r of n blocks are extra."""
    if not n:
        return 0, 0, 1, 0
    step = _seeded("step", *seed) % min(n, MAX_STEP) or 1
    while gcd(step, n) != 1:
        step = step % min(n, MAX_STEP) + 1
    return quota // n, quota % n, step, _seeded("start", *seed) % n


def word_sizes(docs: DataFrame, text_col: str) -> DataFrame:
    """The frame without its text, with its number of words as ``_size``."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest).withColumn("_size", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(word_counts(b.column(text_col)))],
                                             names=[*rest, "_size"])
    return docs.mapInArrow(run, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=lambda k: k % 3 + 1, max_epochs: int = 3, shards: int = SHARDS, block: int = BLOCK,
        seed: int = 42) -> DataFrame:
    """(doc_id, source, shard, size, source_size, target, taken) of every row.

    ``weights(k)`` is the weight of the k-th source by code point.  ``taken``
    counts the words the mix takes of a row, repeats included.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.col(text_col), F.lit(seed)).alias("_mark"), F.col(text_col).cast("string").alias("text"))
    sized = stored(word_sizes(slim, "text").withColumnRenamed("_size", "size").withColumns({
        "shard": F.pmod(F.xxhash64("doc_id", "_mark", F.lit(seed)), F.lit(shards)).cast("int"),
        "_order": F.xxhash64("doc_id", "_mark", F.lit(seed + 1))}), "mix-words")
    # one seeded line of all words, source by source and shard by shard
    placed = running_total(sized, [F.col("source").asc_nulls_last(), "shard", "_order", "doc_id", "_mark"], "size", "mix-sizes")
    groups = placed.groupBy("source", "shard").agg(F.sum("size").alias("n"), F.min("before").alias("start")).collect()

    sources = sorted({g.source for g in groups}, key=lambda s: (s is None, s or ""))
    sizes = [sum(g.n for g in groups if g.source == s) for s in sources]
    target = water_fill(sizes, [float(weights(k)) for k in range(len(sources))], max_epochs)
    by = {(g.source, g.shard): g for g in groups}
    blocks = [[-(-by[s, k].n // block) if (s, k) in by else 0 for k in range(shards)] for s in sources]
    # a short last block counts as one, so a source's whole-block share is its target times blocks/words
    caps = [max_epochs * sum(b) for b in blocks]
    share = [t * sum(b) / n if n else 0.0 for t, b, n in zip(target, blocks, sizes)]
    quota = sainte_lague(share, round(sum(share)), caps)
    rules = []
    for s, n, t, b, q in zip(sources, sizes, target, blocks, quota):
        for k, own in enumerate(sainte_lague([float(x) for x in b], q, [max_epochs * x for x in b])):
            if (s, k) in by:
                rules.append((s, k, n, t, by[s, k].start, b[k], *block_rule(b[k], own, seed, s, k)))
    rules = spark.createDataFrame(rules, "source string, shard int, source_size long, target double, _start long, "
                                         "_n long, _passes long, _extra long, _step long, _from long")
    joined = placed.alias("d").join(F.broadcast(rules.alias("r")), F.col("d.source").eqNullSafe(F.col("r.source"))
                                    & (F.col("d.shard") == F.col("r.shard"))) \
        .select("d.doc_id", "d.source", "d.shard", "d.size", "d.before", *[f"r.{c}" for c in rules.columns[2:]])

    def take(batches):
        for b in batches:
            c = {x: b.column(x).to_numpy(zero_copy_only=False) for x in b.schema.names if x not in ("doc_id", "source", "target")}
            at = c["before"] - c["_start"]
            end, taken = at + c["size"], c["_passes"] * c["size"]
            # pairs of a document and a block that it lies in
            first, last = at // block, np.where(c["size"] > 0, (end - 1) // block, at // block - 1)
            rows = np.repeat(np.arange(len(at)), last - first + 1)
            i = np.arange(len(rows)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[rows]
            chosen = (i * c["_step"][rows] + c["_from"][rows]) % np.maximum(c["_n"][rows], 1) < c["_extra"][rows]
            words = np.minimum(end[rows], (i + 1) * block) - np.maximum(at[rows], i * block)
            np.add.at(taken, rows[chosen], words[chosen])
            yield pa.RecordBatch.from_arrays([b.column(x) for x in ("doc_id", "source", "shard", "size", "source_size", "target")]
                                             + [pa.array(taken)], names=["doc_id", "source", "shard", "size", "source_size", "target", "taken"])
    return joined.mapInArrow(take, "doc_id long, source string, shard int, size long, source_size long, target double, taken long")


def op9_mix_sainte_lague(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")
