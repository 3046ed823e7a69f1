"""Source divergence audit: a K-squared quadtree over the group-term count matrix.

Each language's sources are rows and its kept terms columns of a sparse count
matrix.  A row's smoothed share of a term is ``1 + floor(10^9 (count + 2) / (N + 2V))``
and two rows differ by the sum of ``floor((p - q)^2 / (p + q))`` over all terms.
Columns are dealt into blocks of about ``WIDTH`` terms and rows into tiles of
``TILE``.  For a pair of tiles and a block, both tiles' cells become quadtrees
(a node is there if its square holds a count), which are walked together for all
pairs of rows at once, level by level: where both squares are empty, every term
in them has one and the same difference, so the square counts as its width
times that difference; what is left at the last level is compared cell by cell.
Terms that no row of a pair's tiles has are priced the same way at the end.

A walk holds at most some multiples of ``FRONTIER`` nodes, a task one block of
two tiles, whatever share of the rows one source or language has.  Integers
throughout: shares are exact while N + 2V is under 9.2 * 10^15.

Defined results: null text, language and source are empty strings; a language
without kept terms has differences 0; repeated rows are documents of their own;
very long texts and terms are read whole; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunesift.llm.common import gathered, ship, stored, utf8_view

ship(__name__)

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms of a block on average, rows of a tile, pairs of nodes that a walk opens at once.
WIDTH, TILE, FRONTIER = 1024, 256, 1 << 19
#: Bytes of text counted together; partial counts that a task holds.
GATHER, HELD = 8 << 20, 300_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order (runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased), and each one's text."""
    raw, off = utf8_view(texts)
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    data = _LOWER[raw[letter]].tobytes()
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return terms, np.searchsorted(off, starts, "right") - 1


COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(b: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term), and one row with the empty term for each (lang, source)."""
    terms, text = term_runs(b.column(2))
    coded = terms.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = pa.table({"lang": b.column(0), "source": b.column(1), "row": np.arange(b.num_rows)})
    groups = pair.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
    group_of = np.empty(b.num_rows, np.int64)
    lists = groups.column("row_list").combine_chunks()
    group_of[lists.flatten().to_numpy()] = np.repeat(np.arange(groups.num_rows), np.diff(lists.offsets.to_numpy()))
    each = max(len(words), 1)
    per_text, times = np.unique(text * each + code, return_counts=True)
    key, back = np.unique(group_of[per_text // each] * each + per_text % each, return_inverse=True)
    n, docs = np.zeros(len(key), np.int64), np.bincount(back, minlength=len(key))
    np.add.at(n, back, times)
    zero = np.zeros(groups.num_rows, np.int64)
    g = np.concatenate([key // each, np.arange(groups.num_rows)])
    return pa.table({"lang": groups.column("lang").take(pa.array(g)), "source": groups.column("source").take(pa.array(g)),
                     "term": pa.chunked_array([words.take(pa.array(key % each)).cast(pa.string()), pa.array([""] * groups.num_rows, pa.string())]),
                     "n": np.concatenate([n, zero]), "docs": np.concatenate([docs, zero])})


def term_counts(docs: DataFrame) -> DataFrame:
    """``COUNTS`` of (lang, source, text) rows, added up over each task's texts as far as ``HELD`` goes."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        held, rows = [], 0
        for b in gathered(batches, 2, GATHER):
            held.append(_counted(b))
            rows += held[-1].num_rows
            if rows > HELD:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].cast(schema).to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from merged(held).cast(schema).to_batches(max_chunksize=50_000)

    def merged(tables):
        t = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTS) \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) by long division, three decimal digits a step."""
    total = np.maximum(total, 1)
    left, out = np.broadcast_arrays(np.asarray(count, np.int64) + 2, total)[0].copy(), 0
    out, left = left // total, left % total
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + out


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Quadtree:
    """Which squares of a sparse matrix hold a cell, at every level, and the cells' shares."""

    def __init__(self, row: np.ndarray, col: np.ndarray, share: np.ndarray, height: int):
        order = np.argsort(row << height | col)
        self.height, self.share = height, share[order]
        self.levels = [np.unique((row >> s) << (height - s) | col >> s) for s in range(height + 1)]

    def find(self, s: int, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each square of level s holds a cell, and its place among those that do."""
        keys, want = self.levels[s], row << (self.height - s) | col
        if not len(keys):
            return np.zeros(len(want), bool), np.zeros(len(want), np.int64)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return keys[at] == want, at


def walk(a: Quadtree, b: Quadtree, empty_a: np.ndarray, empty_b: np.ndarray, columns: int, frontier: int = FRONTIER) -> np.ndarray:
    """Differences of all pairs of a row of ``a`` and one of ``b`` over the columns; where they are
    one tree, only above the diagonal.  ``empty_*`` are the rows' shares of a term they lack."""
    same, rows = a is b, (len(empty_a), len(empty_b))
    sums = np.zeros(rows, np.int64)
    wide = [np.zeros(((rows[0] - 1 >> s) + 1, (rows[1] - 1 >> s) + 1), np.int64) for s in range(a.height + 1)]
    zero = np.zeros(1, np.int64)
    todo = [(a.height, zero, zero, zero)] if columns and min(rows) else []
    while todo:
        s, i, j, c = todo.pop()
        if len(i) > frontier:
            todo += [(s, i[k:k + frontier], j[k:k + frontier], c[k:k + frontier]) for k in range(0, len(i), frontier)]
            continue
        has_a, at_a = a.find(s, i, c)
        has_b, at_b = b.find(s, j, c)
        none = ~(has_a | has_b)
        # squares that are empty in both trees: so many columns of one price
        width = np.minimum(columns, c[none] + 1 << s) - (c[none] << s)
        np.add.at(wide[s], (i[none], j[none]), width)
        some = ~none
        i, j, c = i[some], j[some], c[some]
        if not len(i):
            continue
        if s == 0:
            p = empty_a[i] if not len(a.share) else np.where(has_a[some], a.share[at_a[some]], empty_a[i])
            q = empty_b[j] if not len(b.share) else np.where(has_b[some], b.share[at_b[some]], empty_b[j])
            np.add.at(sums, (i, j), difference(p, q))
            continue
        i, j, c = ((2 * x[:, None] + np.array(bit)).ravel() for x, bit in zip(
            (i, j, c), ([0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 0, 0, 1, 1], [0, 1, 0, 1, 0, 1, 0, 1])))
        s -= 1
        real = (i << s < rows[0]) & (j << s < rows[1]) & (c << s < columns)
        if same:
            real &= i <= j if s else i < j
        todo.append((s, i[real], j[real], c[real]))
    widths = sum(np.repeat(np.repeat(w, 1 << s, 0), 1 << s, 1)[:rows[0], :rows[1]] for s, w in enumerate(wide))
    out = sums + widths * difference(empty_a[:, None], empty_b[None, :])
    return np.triu(out, 1) if same else out


FOUND = "lang string, g int, h int, item string, value long, columns long"


def block_pairs(t: pa.Table, top: int = TOP) -> pa.Table:
    """``FOUND`` of one block of a pair of tiles: differences of all pairs of rows, and on the diagonal
    each row's ``top`` terms above its language.  Rows of the empty term carry the groups' totals."""
    lang, left, right = t.column("lang")[0].as_py(), t.column("left")[0].as_py(), t.column("right")[0].as_py()
    marker = pc.equal(t.column("term"), "")
    heads, cells = t.filter(marker).sort_by("g"), t.filter(pc.invert(marker))
    g, total = heads.column("g").to_numpy(), heads.column("size").to_numpy() + 2 * heads.column("terms").to_numpy()
    coded = cells.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    words, col = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, n = np.searchsorted(g, cells.column("g").to_numpy()), cells.column("n").to_numpy()
    # columns that the same rows have lie side by side, so that empty squares are large
    pattern = np.zeros(len(words), np.int64)
    np.bitwise_or.at(pattern, col, np.int64(1) << (row % 62))
    place = np.empty(len(words), np.int64)
    place[np.argsort(pattern, kind="stable")] = np.arange(len(words))
    share, empty = shares(n, total[row]), shares(np.zeros(len(g), np.int64), total)
    height = max(int(max(len(g), len(words), 1) - 1).bit_length(), 1)
    tile = g // TILE

    def tree(k):
        own = tile[row] == k
        return Quadtree(row[own] - np.searchsorted(tile, k), place[col[own]], share[own], height), np.flatnonzero(tile == k)
    a, rows_a = tree(left)
    b, rows_b = (a, rows_a) if left == right else tree(right)
    values = walk(a, b, empty[rows_a], empty[rows_b], len(words))
    i, j = np.triu_indices(len(rows_a), 1) if left == right else map(np.ravel, np.indices(values.shape))
    out = [pa.table({"g": g[rows_a[i]].astype(np.int32), "h": g[rows_b[j]].astype(np.int32), "item": pa.nulls(len(i), pa.string()),
                     "value": values[i, j], "columns": np.full(len(i), len(words))})]
    if left == right and len(row):
        whole = cells.column("total").to_numpy()
        q = shares(whole, heads.column("lang_size")[0].as_py() + 2 * heads.column("terms")[0].as_py())
        value = difference(share, q)
        rank = np.argsort(np.argsort(words.cast(pa.binary()).to_numpy(zero_copy_only=False)))[col] if len(words) else col
        order = np.lexsort((rank, -value, row))
        order = order[(share > q)[order]]
        first = np.searchsorted(row[order], row[order])
        order = order[np.arange(len(order)) - first < top]
        out.append(pa.table({"g": g[row[order]].astype(np.int32), "h": np.full(len(order), -1, np.int32), "item": words.take(pa.array(col[order])).cast(pa.string()),
                             "value": value[order], "columns": np.zeros(len(order), np.int64)}))
    out = pa.concat_tables(out)
    return out.add_column(0, "lang", pa.array([lang] * out.num_rows, pa.string()))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's difference from every other source of its
    language (part ``pair``), and its ``top`` terms above the language as a whole (part ``term``)."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
                         for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = term_counts(slim)
    term = Window.partitionBy("lang", "term")
    cells = stored(counts.withColumns({"_docs": F.sum("docs").over(term), "total": F.sum("n").over(term),
                                       "_first": (F.row_number().over(term.orderBy("source")) == 1) & (F.col("term") != "")})
                   .filter((F.col("_docs") >= least_docs) | (F.col("term") == ""))
                   .select("lang", "source", "term", "n", "total", F.col("_first").cast("long").alias("first")), "divergence-cells")
    lang = Window.partitionBy("lang")
    groups = stored(cells.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("terms"))
                    .withColumns({"g": F.row_number().over(lang.orderBy(F.desc("size"), "source")) - 1, "rows": F.count(F.lit(1)).over(lang),
                                  "lang_size": F.sum("size").over(lang), "terms": F.sum("terms").over(lang)}), "divergence-groups")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / width))
    tiles = F.floor((F.col("rows") - 1) / TILE).cast("int")
    tile, other = F.floor(F.col("g") / TILE).cast("int"), F.col("other")
    own = ["lang", "left", "right", "block", "g", "term", "n", "total", "size", "terms", "lang_size"]
    placed = cells.filter("term != ''").join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    heads = groups.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)), "term": F.lit(""),
                                "n": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    both = placed.unionByName(heads, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), tiles))) \
        .withColumns({"left": F.least(tile, other), "right": F.greatest(tile, other)}).select(own)
    found = stored(both.groupBy("lang", "left", "right", "block").applyInArrow(lambda t: block_pairs(t, top), FOUND), "divergence-found")

    named = groups.select("lang", "g", "source", (F.col("size") + 2 * F.col("terms")).alias("d"), "terms")
    # terms that neither tile has, priced like other empty squares
    p, q = ((F.lit(1) + F.expr(f"{2 * SCALE} div greatest({d}, 1)")) for d in ("d", "d2"))
    pairs = found.filter("h >= 0").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns")) \
        .join(named, ["lang", "g"]).join(named.select("lang", F.col("g").alias("h"), F.col("source").alias("s2"), F.col("d").alias("d2")), ["lang", "h"]) \
        .withColumns({"p": p, "q": q}).withColumn("value", F.col("value") + (F.col("terms") - F.col("columns")) * F.expr("(p - q) * (p - q) div (p + q)"))
    ways = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("s2").alias("b")), F.struct(F.col("s2").alias("a"), F.col("source").alias("b"))))
    pair = pairs.select("lang", ways.alias("w"), "value").select("lang", F.col("w.a").alias("source"), F.lit("pair").alias("part"), F.col("w.b").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.filter("h < 0").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item"))) \
        .filter(F.col("rank") <= top).join(named.select("lang", "g", "source"), ["lang", "g"])
    return pair.withColumn("rank", F.row_number().over(ranked)) \
        .unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_divergence_quadtree(spark, sf):
    return audit(spark.read.parquet(f"{sf}/documents.parquet"))


OP11_SQL = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*)::hugeint as total from w group by all having count(distinct doc) >= 10),
l as (select d.lang, coalesce(any_value(v), 0)::hugeint as v, coalesce(any_value(n), 0)::hugeint as n
  from (select distinct lang from d) d left join (select lang, count(*) as v, sum(total) as n from k group by lang) s on d.lang = s.lang group by d.lang),
c as (select lang, source, term, count(*)::hugeint as n from w semi join k using (lang, term) group by all),
g as (select d.lang, d.source, coalesce(sum(c.n), 0)::hugeint as n from (select distinct lang, source from d) d left join c on d.lang = c.lang and d.source = c.source group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) as p,
  1 + (1000000000::hugeint * (k.total + 2)) // (l.n + 2 * l.v) as q
  from g join l on g.lang = l.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
term as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', item, value from term)
select lang, source, part, item, value::bigint as value, cast(r as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from u) where part = 'pair' or r <= 10"""
