"""Embedding near-duplicates by NN-descent.

Vectors that are equal, component by component, are one node.  Every node
keeps its ``k`` nearest found so far among the nodes of its label.  The first
lists come from random-projection orders (neighbours in blocks of rows sorted
by sign codes); each round then compares the neighbours of every node with each
other, where one of them is new in its list, and lists keep what is nearer,
until few entries change.  Search uses byte-quantised vectors; links are
decided by cosine in double precision.

A list whose ``k`` entries all pass the threshold is saturated: there may be
more.  Such lists are enlarged to all nodes of their linked component, which
are compared exactly in blocks, so no group is expanded into pairs.  An audit
compares the links of sampled nodes whose counts are not exact yet with brute
force over all nodes of their labels, and the sample grows until ``ENOUGH`` of
them have links (to ``AUDIT_MOST`` nodes).  While their average recall is
under the target, lists are doubled, further projections join the search and
it goes on, ``ATTEMPTS`` times at most.  Labels whose own audited recall is
under the target after that are compared exactly, in blocks; a block pair gives
counts and a spanning forest, so these aren't expanded into pairs either.

Defined results: a row with a null label or vector, a null or non-finite
component, or norm 0 links with nothing; vectors of different length never
link; rows that repeat an id count as vectors of their own; a null id is never
a component id unless no member has one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunesift.llm.common import global_rank, group_starts, n_partitions, ship, stored, utf8_view, whole_groups
from tunesift.llm.graph import components

ship(__name__)

K = 10
TABLES = 8
#: Rows of a projection order that are compared with each other.
BLOCK = 256
#: Nodes of a block where whole labels are compared.
EXACT_BLOCK = 1024
#: Best improvements of one member that one node's round reports (each of its other nodes reports too).
REPORT = 5
ROUNDS = 10
#: Rounds end when fewer list entries than this share are new.
SETTLED = 0.002
#: What single precision may take from the cosine of byte vectors, and from an angle.
ROUNDING = 1e-5
#: Nodes of the first audit sample, links-bearing nodes that a sample should hold, and nodes of the largest sample.
AUDIT = 1000
ENOUGH = 100
AUDIT_MOST = 16_000
TARGET = 0.98
ATTEMPTS = 3


def quantised(v: np.ndarray) -> np.ndarray:
    return np.rint(v / np.abs(v).max(axis=1, keepdims=True) * 127).astype(np.int8)


def turned(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The angle between each vector and its byte vector."""
    x = q.astype(np.float64)
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    return 2 * np.arcsin(np.minimum(1, np.linalg.norm(u - w, axis=1) / 2)) + ROUNDING


def unit(raw: np.ndarray, n: int) -> np.ndarray:
    x = raw.view(np.int8).reshape(n, -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sign_codes(v: np.ndarray, tables: range, seed: int) -> list[np.ndarray]:
    """A 32-bit code per table: on which side of each random plane a vector lies."""
    out = []
    for t in tables:
        planes = np.random.default_rng([seed, t, v.shape[1]]).standard_normal((v.shape[1], 32))
        out.append(((v @ planes > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64))).astype(np.int64))
    return out


def valid(label: str, vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite & some, F.lit(False))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, label, d, e, least, copies): distinct vectors of each label, numbered."""
    distinct = rows.filter("ok").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("e").alias("e"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return global_rank(stored(distinct, "nn-distinct"), ["label", "h1", "h2"], "nn-nodes", "node")


def _coded(nodes: DataFrame, tables: range, seed: int) -> DataFrame:
    """(node, label, d, q, turn, code of each table): byte vectors, their angles to the vectors and sign codes."""
    names = [f"c{t}" for t in tables]

    def run(batches):
        for b in batches:
            d = np.diff(b.column(2).offsets.to_numpy())
            for size in np.unique(d):
                own = b.take(pa.array(np.flatnonzero(d == size)))
                v = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
                q = quantised(v)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.full(len(v), size, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()),
                     pa.array(turned(v, q)), *(pa.array(c) for c in sign_codes(v, tables, seed))], names=["node", "label", "d", "q", "turn", *names])

    return stored(nodes.select("node", "label", "e").mapInArrow(
        run, ", ".join(["node long, label string, d int, q binary, turn double", *(f"{n} long" for n in names)])), "nn-coded")


def _best(x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest entries of each row off the diagonal, where allowed."""
    s = x.copy()
    np.fill_diagonal(s, -2)
    if allowed is not None:
        s[~allowed] = -2
    k = min(k, len(s))
    col = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(s) else np.tile(np.arange(len(s)), (len(s), 1))
    row = np.repeat(np.arange(len(s)), col.shape[1])
    col = col.reshape(-1)
    ok = s[row, col] > -2
    return row[ok], col[ok]


def _pairs(out: list) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.float32)
    cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], names=["node", "other", "sim"])


LISTS = "node long, other long, sim float"


def _seed_lists(coded: DataFrame, tables: range, k: int) -> DataFrame:
    """Candidate neighbours from blocks of rows next to each other in each table's order."""
    def run(batches):
        for b in batches:
            out = []
            starts = group_starts(b, 3)  # rows of one table, label and length
            ids = b.column(3).to_numpy()
            raw, off = utf8_view(b.column(4))
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                for s in range(a, z, BLOCK):
                    e = min(s + BLOCK, z)
                    if e - s < 2:
                        continue
                    x = unit(raw[off[s]:off[e]], e - s)
                    sims = x @ x.T
                    i, j = _best(sims, k)
                    out.append((ids[s:e][i], ids[s:e][j], sims[i, j]))
            yield _pairs(out)

    codes = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"c{t}").alias("c")) for t in tables])).alias("x")
    rows = coded.select(codes, F.xxhash64("label").alias("l"), "d", "node", "q")
    order = ["x.t", "l", "d", "x.c", "node"]
    # a block takes rows of one batch, so pairs across a batch's end are left to the other tables
    own = rows.repartitionByRange(n_partitions(coded.sparkSession), *order).sortWithinPartitions(*order).select("x.t", "l", "d", "node", "q")
    return stored(own.mapInArrow(run, LISTS), "nn-seeds")


def _lists(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, from rows (node, other, sim, fresh) in which a pair may repeat."""
    nearest = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    once = candidates.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k).drop("r")


def _local_join(k: int):
    """Members of each node's neighbourhood -> pairs of members nearer than what their lists hold."""
    def run(batches):
        for b in whole_groups(batches, 1):
            out = []
            starts = group_starts(b, 1)
            member, worst = b.column(1).to_numpy(), b.column(2).to_numpy()
            fresh = b.column(3).to_numpy(zero_copy_only=False)
            raw, off = utf8_view(b.column(4))
            # rows come nearest first; a hub's followers meet in chunks of like distance
            for a, z in ((s, min(s + 3 * k, e)) for f, e in zip(starts, [*starts[1:], b.num_rows]) for s in range(f, e, 3 * k)):
                own = fresh[a:z]
                if z - a < 2 or not own.any():
                    continue
                x = unit(raw[off[a]:off[z]], z - a)
                sims = x @ x.T
                i, j = _best(sims, REPORT, (own[:, None] | own[None, :]) & (sims > worst[a:z, None]))
                out.append((member[a:z][i], member[a:z][j], sims[i, j]))
            yield _pairs(out)
    return run


def descend(lists: DataFrame, coded: DataFrame, k: int, n: int) -> DataFrame:
    """Refine lists (node, other, sim, fresh) through neighbours of neighbours until they settle."""
    parts = n_partitions(coded.sparkSession)
    for _ in range(ROUNDS):
        worst = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        both = lists.select(F.col("node").alias("pivot"), F.col("other").alias("member"), "sim", "fresh").union(
            lists.select("other", "node", "sim", "fresh"))
        around = both.groupBy("pivot", "member").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
        active = around.groupBy("pivot").agg(F.max("fresh").alias("any")).filter("any").select("pivot")
        members = around.join(active, "pivot", "left_semi") \
            .join(coded.select("node", "q").join(worst, "node", "left").withColumnRenamed("node", "member"), "member") \
            .select("pivot", "member", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "fresh", "q", "sim")
        nearer = stored(members.repartition(parts, "pivot").sortWithinPartitions("pivot", F.col("sim").desc(), "member").drop("sim")
                        .mapInArrow(_local_join(k), LISTS), "nn-nearer")
        lists = stored(_lists(lists.withColumn("fresh", F.lit(False)).select("node", "other", "sim", "fresh").union(
            nearer.withColumn("fresh", F.lit(True))), k), "nn-lists")
        if lists.filter("fresh").count() <= SETTLED * n * k:
            break
    return lists


def _cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, cos) in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    one = nodes.select(F.col("node").alias("a"), F.col("e").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("e").alias("y"))
    x, y = F.col("x"), F.col("y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", (dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))).alias("cos"))


def _exact_counts(threshold: float):
    """Rows of two blocks of one component -> how many vectors of the other block (or the same) each node links with."""
    def run(batches):
        for b in whole_groups(batches, 3):
            out = []
            starts = group_starts(b, 3)
            low, high, block = (b.column(i).to_numpy() for i in (1, 2, 3))
            node, copies = b.column(4).to_numpy(), b.column(5).to_numpy()
            flat, off = b.column(6).flatten().to_numpy(zero_copy_only=False), b.column(6).offsets.to_numpy()
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                v = flat[off[a] - off[0]:off[z] - off[0]].reshape(z - a, -1).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                first, second = np.flatnonzero(block[a:z] == low[a]), np.flatnonzero(block[a:z] == high[a])
                near = v[first] @ v[second].T >= threshold
                if low[a] == high[a]:
                    np.fill_diagonal(near, False)
                else:
                    out.append((node[a:z][second], copies[a:z][first] @ near))
                out.append((node[a:z][first], near @ copies[a:z][second]))
            cols = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.empty(0, np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "n"])
    return run


def _block_pairs(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (root, node, copies, e) dealt into blocks of a root, once for each pair of blocks, grouped by root and pair."""
    ranked = global_rank(rows, ["root", "node"], name)
    sizes = ranked.groupBy("root").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("m"))
    block = F.floor((F.col("rank") - F.col("start")) / size).cast("int")
    dealt = ranked.join(sizes, "root").withColumn("block", block).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / size).cast("int"))))
    keyed = dealt.select("root", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "copies", "e")
    return keyed.repartition(n_partitions(rows.sparkSession), "root", "low", "high").sortWithinPartitions("root", "low", "high")


def enlarged(saturated: DataFrame, threshold: float) -> DataFrame:
    """(node, n): exact link counts inside components, from rows (root, node, copies, e).

    A component's nodes are dealt into blocks and each pair of blocks is one
    group of two blocks at most, whatever the component's size.
    """
    counts = _block_pairs(saturated, BLOCK, "nn-saturated").mapInArrow(_exact_counts(threshold), "node long, n long")
    return stored(counts, "nn-exact").groupBy("node").agg(F.sum("n").alias("n"))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j, ...) edges that connect what ``near`` (rows by columns) links: the places, rows first
    and columns after them, of a piece's first row and of each of its others."""
    seen, met = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    roots, others = [], []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        if seen[i]:
            continue
        seen[i], rows = True, np.array([i])
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & ~met)
            met[cols] = True
            rows = np.flatnonzero(near[:, cols].any(axis=1) & ~seen)
            seen[rows] = True
            new = np.concatenate([near.shape[0] + cols, rows])
            roots.append(np.full(len(new), i))
            others.append(new)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (roots, others))


def _exact_labels(threshold: float):
    """Rows of two blocks of one label -> link counts (node, null, n) and connecting edges (node, other, null)."""
    def run(batches):
        for b in whole_groups(batches, 3):
            starts = group_starts(b, 3)
            low, high, block, node, copies = (b.column(i).to_numpy() for i in range(1, 6))
            flat, off = b.column(6).flatten().to_numpy(zero_copy_only=False), b.column(6).offsets.to_numpy()
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                v = flat[off[a] - off[0]:off[z] - off[0]].reshape(z - a, -1).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                first, second = np.flatnonzero(block[a:z] == low[a]), np.flatnonzero(block[a:z] == high[a])
                near = v[first] @ v[second].T >= threshold
                counts = []
                if low[a] == high[a]:
                    np.fill_diagonal(near, False)
                else:
                    counts.append((node[a:z][second], copies[a:z][first] @ near))
                counts.append((node[a:z][first], near @ copies[a:z][second]))
                i, j = _forest(near)
                ends = node[a:z][np.concatenate([first, second])]
                ids, n = (np.concatenate(c).astype(np.int64) for c in zip(*counts))
                ids, n = ids[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, ends[i]])), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ends[j])]),
                     pa.concat_arrays([pa.array(n), pa.nulls(len(i), pa.int64())])], names=["node", "other", "n"])
    return run


def compared(nodes: DataFrame, labels: list[tuple[str, int]], threshold: float) -> DataFrame:
    """(node, other, n): exact link counts (other null) and connecting edges (n null) of all nodes of these (label, vector length)."""
    spark = nodes.sparkSession
    failing = spark.createDataFrame([(l, d, i) for i, (l, d) in enumerate(sorted(labels))], "label string, d int, root long")
    own = stored(nodes.select("node", "label", F.size("e").alias("d"), "copies", "e").join(F.broadcast(failing), ["label", "d"])
                 .select("root", "node", "copies", "e"), "nn-failing")
    pairs = _block_pairs(own, EXACT_BLOCK, "nn-failing-ranks")
    return stored(pairs.mapInArrow(_exact_labels(threshold), "node long, other long, n long"), "nn-compared")


@dataclass(frozen=True)
class NearDuplicates:
    rows: DataFrame  # vec_id, n_links, component_id, kept
    links: DataFrame  # a, b, cos: links between distinct vectors that the search found
    recall: float  # average of audited nodes that have links and whose counts were not exact (before labels are compared)
    compared: tuple = ()  # (label, vector length) whose recall stayed under the target, so that all their nodes were compared


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", k: int = K, tables: int = TABLES, target: float = TARGET, audit: int = AUDIT,
                    seed: int = 42) -> NearDuplicates:
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                                 F.col(vector_col).alias("e")).withColumn("ok", valid("label", "e"))
                  .withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "e")), "h2": F.when(F.col("ok"), F.hash("e", "label"))}), "nn-rows")
    nodes = _nodes(rows)
    n = nodes.count()
    found, coded, lists = None, None, None
    for attempt in range(ATTEMPTS):
        own = range(attempt * tables, (attempt + 1) * tables)
        coded = _coded(nodes, own, seed)
        seeds = _seed_lists(coded, own, k).withColumn("fresh", F.lit(True))
        lists = stored(_lists(seeds if lists is None else lists.union(seeds.select(lists.columns)), k), "nn-lists")
        lists = descend(lists, coded, k, n)
        found = _linked(nodes, coded, lists, k, threshold)
        recall, by_label = _audit(nodes, found[1], found[3], threshold, audit)
        if recall >= target:
            break
        k *= 2
        lists = lists.withColumn("fresh", F.lit(True))
    links, counts, roots, _ = found
    failing = [key for key, r in by_label.items() if r < target]
    if failing:
        exact = compared(nodes, failing, threshold)
        own = exact.filter("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
        # the search finds true links only, so whoever has one in these labels is counted here
        counts = stored(counts.join(own.select("node"), "node", "left_anti").union(own), "nn-counts")
        edges = exact.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        roots = stored(components(links.select("a", "b").union(edges)), "nn-roots")
    known = nodes.select("node", "h1", "h2", "least", "copies").join(counts, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = known.join(ids, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").select("vec_id", "h1", "h2").join(per_node, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return NearDuplicates(stored(out, "nn-out"), links, recall, tuple(failing))


def _possible(lists: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """The list entries that may pass the threshold: a pair's angle is at most its byte vectors' and both their turns."""
    most = coded.agg(F.max("turn")).first()[0] or 0.0
    limit = float(np.arccos(np.clip(threshold, -1, 1)))
    near = lists.filter(F.col("sim") >= float(np.cos(min(np.pi, limit + 2 * most))) - ROUNDING)
    near = near.join(coded.select("node", F.col("turn").alias("t1")), "node").join(coded.select(F.col("node").alias("other"), F.col("turn").alias("t2")), "other")
    return near.filter(F.col("sim") >= F.cos(F.least(F.lit(float(np.pi)), limit + F.col("t1") + F.col("t2"))) - ROUNDING).select(lists.columns)


def _linked(nodes: DataFrame, coded: DataFrame, lists: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links, link counts by node, roots by node, nodes whose counts are exact) from lists, enlarged where they are saturated."""
    near = _possible(lists, coded, threshold)
    pairs = near.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    links = stored(_cosines(pairs, nodes.select("node", "e")).filter(F.col("cos") >= threshold), "nn-links")
    roots = stored(components(links.select("a", "b")), "nn-roots")
    full = near.groupBy("node").count().filter(F.col("count") >= k).select("node")
    hot = full.join(roots, "node").select("root").distinct()
    members = stored(roots.join(hot, "root", "left_semi").join(nodes.select("node", "copies", "e"), "node")
                     .select("root", "node", "copies", "e"), "nn-members")
    exact = enlarged(members, threshold)
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    listed = ends.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("n"))
    counts = stored(listed.join(members.select("node"), "node", "left_anti").union(exact), "nn-counts")
    return links, counts, roots, members.select("node")


def _audit(nodes: DataFrame, counts: DataFrame, exact: DataFrame, threshold: float, most: int) -> tuple[float, dict[tuple, float]]:
    """Average recall of sampled nodes that have links, against all nodes of their labels (1 where
    none has), and that of each (label, vector length).

    Nodes with exact counts are left out; the sample starts at about ``most``
    of the others and grows until ``ENOUGH`` have links.
    """
    spark = nodes.sparkSession
    open_ = stored(nodes.select("node", "label", "e").join(exact, "node", "left_anti"), "nn-unsaturated")
    n = open_.count()
    while n:
        share = min(1.0, most / n)
        rows = open_.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)).collect()
        asked = spark.sparkContext.broadcast(_asked(rows))
        want = nodes.select("node", "label", "e", "copies").mapInArrow(_wanted(asked, threshold), "node long, want long") \
            .groupBy("node").agg(F.sum("want").alias("want"))
        got = want.join(counts, "node", "left").join(open_.select("node", "label", F.size("e").alias("d")), "node").groupBy("label", "d").agg(
            F.count(F.lit(1)).alias("linked"), F.sum(F.least("want", F.coalesce("n", F.lit(0))) / F.col("want")).alias("found")).collect()
        asked.unpersist()
        linked = sum(r.linked for r in got)
        if linked >= ENOUGH or share >= 1 or most >= AUDIT_MOST:
            return (sum(r.found for r in got) / linked if linked else 1.0), {(r.label, r.d): r.found / r.linked for r in got}
        most = min(most * 4, AUDIT_MOST)
    return 1.0, {}


def _asked(rows: list) -> dict[tuple, tuple]:
    """Sampled nodes and their unit vectors by label and length."""
    by: dict[tuple, tuple] = {}
    for r in rows:
        ids, vectors = by.setdefault((r.label, len(r.e)), ([], []))
        ids.append(r.node)
        vectors.append(np.array(r.e, np.float64))
    return {key: (np.array(i, np.int64), np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)) for key, (i, v) in by.items()}


def _wanted(asked, threshold: float):
    """Rows (node, label, e, copies) -> how many of them each asked node of their label links with (copies of its own left out)."""
    def run(batches):
        by = asked.value
        for b in batches:
            out = []
            node, copies = b.column(0).to_numpy(), b.column(3).to_numpy()
            labels = b.column(1).dictionary_encode()
            which, d = labels.indices.to_numpy(zero_copy_only=False), np.diff(b.column(2).offsets.to_numpy())
            for l, label in enumerate(labels.dictionary.to_pylist()):
                for size in np.unique(d[which == l]).tolist():
                    if (label, size) not in by:
                        continue
                    ids, v = by[label, size]
                    own = np.flatnonzero((which == l) & (d == size))
                    x = b.column(2).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    near = (v @ x.T >= threshold) & (ids[:, None] != node[own])
                    n = near @ copies[own]
                    out.append((ids[n > 0], n[n > 0]))
            cols = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.empty(0, np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "want"])
    return run


def op5_embedding_nn_descent(spark, sf):
    return near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet")).rows


#: All links by brute force, and components by reachability.
OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL
  AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT r.vec_id, coalesce(max(n.n_links), 0) AS n_links, min(r.root) AS component_id, r.vec_id = min(r.root) AS kept
FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
"""
