"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if it is set in over half of the text's shingle
hashes.  Two fingerprints link when they differ in at most ``radius`` bits.
Candidate search uses structured masks: every bit gets a non-zero vector of
``radius + 1`` binary digits, and the mask of each non-zero vector v keeps the
bits whose vector has an odd product with v.  ``radius`` differing bits span
too few dimensions to meet every v, so each such pair agrees under one of the
``2^(radius+1) - 1`` masks: no link is lost.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; fewer words than a shingle make one shingle of the whole text;
rows that repeat an id or a text share a component; a null id never becomes a
component id unless the component has no other.  Columns beside id and text
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import ship, slices, stored
from tunesift.llm.graph import components

ship(__name__)

#: Fingerprints compared pairwise at once; larger buckets are split by further masks.
BUCKET = 256
BITS = 64


def simhash(text: bytes, width: int, seed: int) -> int:
    import xxhash
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), seed)
    join = b" ".join
    hashes = np.array([h(join(s), seed) for s in zip(*(words[i:] for i in range(width)))], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[at:at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                 seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the 64-bit fingerprint of every whole text."""
    def run(batches):
        for b in batches:
            for start, n in slices(b.column(1)):
                fps = [simhash((t or "").encode(), width, seed) for t in b.column(1).slice(start, n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, n), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit places; any ``radius`` of them miss one mask wholly."""
    n = 1 << (radius + 1)
    return [sum(1 << bit for k, bit in enumerate(bits) if ((k % (n - 1) + 1) & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_signed(v)) for v in values]), (index + 1).cast("int"))


def _bucket_links(radius: int):
    """Rows of one bucket's fingerprints -> links that connect what is connected inside it."""
    def run(batches):
        for b in batches:
            fps_col, a, z = b.column(0), [], []
            for i in range(len(fps_col)):
                fps = np.unique(fps_col[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
                u = fps.view(np.uint64)
                near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
                label = np.arange(len(u))
                while True:  # least label among the linked, until nothing changes
                    new = np.where(near, label[None, :], len(u)).min(axis=1)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                leaf = np.flatnonzero(label != np.arange(len(u)))
                a.append(fps[leaf])
                z.append(fps[label[leaf]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, z)], names=["a", "b"])
    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that span every component.

    Each fingerprint goes into one bucket per mask.  Buckets of one are
    dropped, buckets of up to ``BUCKET`` are compared pairwise in numpy, and
    larger ones are dealt out again by covering masks over the bits they don't
    fix yet, until so few bits are free that no larger bucket is possible.
    """
    masks = covering_masks(list(range(BITS)), radius)
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask"))
    out = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(_pick(masks, F.col("mask"))))
        sizes = stored(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
        small = rows.join(sizes.filter(F.col("n") <= BUCKET), ["mask", "key"]) \
            .groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = stored(small.mapInArrow(_bucket_links(radius), "a long, b long").distinct(), "simhash-links")
        out = found if out is None else out.union(found)
        if sizes.filter(F.col("n") > BUCKET).isEmpty():
            return out
        hot = rows.join(sizes.filter(F.col("n") > BUCKET).select("mask", "key"), ["mask", "key"]).select("fp", "mask")
        finer, per = [], (1 << (radius + 1)) - 1
        for m in masks:
            finer += [m | x for x in covering_masks([i for i in range(BITS) if not m >> i & 1], radius)]
        masks = finer
        rows = stored(hot, "simhash-hot").select(
            "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.col("mask") * per + j)).alias("mask"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row: equal fingerprints are one node of the link graph."""
    fps = stored(fingerprints(docs, id_col, text_col, width, seed), "simhash-fp")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash_near_dup(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
