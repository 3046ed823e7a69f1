"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three successive bytes of a text hash to one of 256 buckets.  The digest
holds a logarithmic length code and, for each bucket, how many of the three
quartiles of all bucket counts its count exceeds (0-3, two bits).  Two digests
differ by the sum of their code distances (opposite ends count double) plus a
bounded length distance; ``likeness`` maps that to 0..1, where 0 is what
independent codes differ by on average, or more.

Defined results: null is the empty text; texts under three bytes have no
triplets, so only their length code tells them apart; equal texts have equal
digests.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import n_partitions, ship, stored

ship(__name__)

BUCKETS = 256
#: Code distances of independent uniform codes average (6*1 + 4*2 + 2*6)/16 a bucket.
BOUND = BUCKETS * 26 // 16
LENGTH_BOUND = 24
#: Bytes hashed at once, so a very long text needs bounded memory.
STRIDE = 1 << 20
_DISTANCE = np.array([0, 1, 2, 6], np.int64)


def triplet_counts(raw: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(x) - 2), STRIDE):
        part = x[at:at + STRIDE + 2].astype(np.uint32)
        code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        counts += np.bincount(code * np.uint32(2654435761) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(raw: bytes) -> bytes:
    """One length byte and 64 bytes of bucket codes."""
    counts = triplet_counts(raw)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    length = min(255, int(np.log1p(len(raw)) / np.log(1.1)))
    return bytes([length]) + (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def codes(d: bytes) -> np.ndarray:
    packed = np.frombuffer(d, np.uint8)[1:]
    return (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1).astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    return int(_DISTANCE[np.abs(codes(a) - codes(b))].sum()) + min(abs(a[0] - b[0]), LENGTH_BOUND)


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, 1.0 - difference(a, b) / (BOUND + LENGTH_BOUND))


def fingerprints(docs: DataFrame, text_col: str = "text", col: str = "fingerprint") -> DataFrame:
    """The frame with the digest of every whole text (lower-case hex) as one more column."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest((t or "").encode()).hex())
    return docs.withColumn(col, of(F.col(text_col).cast("string")))


#: A null id sorts after every other in descending order.
_NO_ID = -(1 << 63)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(span, donor, key, doc_id, text): rows dealt into spans of descending id, rows of one id by
    their text's hash, each span followed by the first row of the next (donor = true; after the last
    span, the first's).

    A span begins with a row that occurs: at an id from the quantiles of the id column, and inside an
    id that fills several of them at hashes from its quantiles.  So an id that a third of the rows
    share, or lack, is many spans.  The texts are shuffled once, and only rows that a span begins
    with are sent twice.
    """
    # quantiles pass through doubles: 53 bits of a hash survive that, and an id that doesn't isn't met again
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.shiftright(F.xxhash64(F.col(text_col).cast("string")), 11)
    spans = 4 * n_partitions(docs.sparkSession)
    steps = [k / spans for k in range(1, spans)] if spans > 1 else [0.5]
    q = docs.agg(F.percentile_approx(key, steps, 100 * spans).alias("q"), F.max(key).alias("top")).first()
    bounds = Counter([*(q.q or []), *([q.top] if q.top is not None else [])])
    inside = docs.select(key.alias("key"), mark.alias("mark")).filter(F.col("key").isin(list(bounds))) if bounds else docs.select(key.alias("key"), mark.alias("mark")).limit(0)
    # at most one row a span
    found = inside.groupBy("key").agg(F.min("mark").alias("least"), F.percentile_approx("mark", steps, 100 * spans).alias("marks")).collect()
    heads = set()
    for r in found:
        n = bounds[r.key]
        heads |= {(-r.key, r.least), *((-r.key, r.marks[k * len(r.marks) // n]) for k in range(1, n) if n > 2)}
    heads = sorted(heads)

    @F.pandas_udf("span int, head boolean")
    def place_of(keys: pd.Series, marks: pd.Series) -> pd.DataFrame:
        order = list(zip((-k for k in keys.tolist()), marks.tolist()))
        span = [bisect_right(heads, o) - 1 for o in order]
        return pd.DataFrame({"span": np.array(span, np.int32), "head": [heads[s] == o for s, o in zip(span, order)]})

    keyed = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("mark", F.xxhash64("text")).withColumn("at", place_of("key", F.shiftright("mark", 11)))
    n = max(1, len(heads))
    place = F.struct(F.col("at.span").alias("span"), F.lit(False).alias("donor"))
    again = F.struct(F.pmod(F.col("at.span") - 1, F.lit(n)).cast("int").alias("span"), F.lit(True).alias("donor"))
    dealt = keyed.withColumn("place", F.explode(F.when(F.col("at.head"), F.array(place, again)).otherwise(F.array(place)))) \
        .select("place.span", "place.donor", "key", "mark", "doc_id", "text")
    ordered = dealt.repartitionById(n, F.col("span")).sortWithinPartitions("span", "donor", F.col("key").desc(), "mark")
    return ordered, n


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's digest against its edited text's and the next document's (descending id).

    The edited text's last floor(n/2) code points are the next document's first
    as many, or all it has.  Rows that share an id follow in the order of their
    text's hash; null ids come last; after the last row comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        span, held = None, None  # the row that waits for the next one: (id, text, digest)
        for b in batches:
            out = []
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, (s, donor, doc_id) in enumerate(zip(b.column("span").to_pylist(), b.column("donor").to_pylist(), ids)):
                if s != span:
                    span, held = s, None
                if donor and held is None:
                    continue  # a further copy of the donor
                text = texts[i].as_py() or ""
                own = digest(text.encode())
                if held is not None:
                    before, t, d = held
                    cut = len(t) // 2
                    edited = (t[:len(t) - cut] + text[:cut]).encode()
                    e = digest(edited)
                    out.append((before, len(t), hashlib.sha256(edited).hexdigest(), d.hex(), e.hex(), likeness(d, e), likeness(d, own)))
                held = None if donor else (doc_id, text, own)
            cols = list(zip(*out)) if out else [[] for _ in names]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows, _ = with_next(docs, id_col, text_col)
    return stored(rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double"), "fingerprints")


def op3_fingerprint_quartile(spark, sf):
    return edited_likeness(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
