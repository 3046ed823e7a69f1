"""Feature engineering (D1-D13): TF-IDF blocks, z-scored numerics, weighted
and L2-normalised content vectors, all as long DataFrames.

Layout of the content index (one row per non-zero):
``(track_id, key, value)`` with ``key = block + ':' + term`` for text blocks
and ``'n:year'`` / ``'n:explicit'`` for the two numerics.

Plan shape: a document's terms, weights and norms are made together, batch by
batch (Arrow and NumPy, with the broadcast vocabulary), so that documents are
neither exchanged, exploded nor sorted.  The vocabulary is the only aggregation
by term (a batch's distinct terms first, so a term in a third of all rows costs
one row per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunesift.config import BlockSpec, FeatureConfig
from tunesift.functions import text

# largest vocabulary that is broadcast (rows); larger ones are shuffle-joined
MAX_BROADCAST_VOCAB = 2_000_000

NUMERIC_COLS = ("release_year", "explicit")


def block_doc(spec: BlockSpec) -> Column:
    """D1 / plain: the text handed to the tokenizer for a block."""
    if spec.doc == "genre":
        return text.genre_doc(spec.column)
    return text.strip_ws(F.lower(text.null_to_empty(spec.column)))


def block_terms(spec: BlockSpec, pattern: str = text.WORD_TOKEN, min_len: int = 1,
                stop_words: list[str] | None = None) -> Column:
    """D2 + D3: tokens then all n-grams of the block's range."""
    toks = text.word_tokens(block_doc(spec), pattern, min_len, stop_words)
    return text.with_ngrams(toks, *spec.ngram)


def term_counts(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf) by exploding each document and counting per (id, term).

    When ``docs`` is already hash-partitioned by ``id_col`` the count needs no
    exchange (the required clustering on (id, term) is satisfied by id)."""
    return (docs.select(id_col, F.explode(terms).alias("term"))
                .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def top_terms(v: DataFrame, most: dict[str, int]) -> DataFrame:
    """Per block, the ``most[block]`` terms with the largest corpus count ``cf``
    (term breaks ties); blocks without a bound keep all.

    A histogram (block, cf) -> terms places the cut: terms above the cut's
    count stay, and of those that have exactly that count the first by term
    fill up.  No block's terms are ranked in one task.  The histogram is what
    reaches the driver; distinct counts are fewer than the square root of
    twice the number of tokens."""
    from tunesift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(v.sparkSession)
    v = v.checkpoint(eager=True)  # the candidates are read again for the cut and its ties
    hist: dict[str, list] = {}
    for r in v.groupBy("block", "cf").agg(F.count(F.lit(1)).alias("c")).collect():
        hist.setdefault(r["block"], []).append((r["cf"], r["c"]))
    above, ties = F.lit(True), []
    for block, bound in most.items():
        taken = 0
        for cf, c in sorted(hist.get(block, []), reverse=True):
            if taken + c > bound:
                above = above & ((F.col("block") != block) | (F.col("cf") > cf))
                if bound > taken:
                    ties.append(v.filter((F.col("block") == block) & (F.col("cf") == cf)).orderBy("term").limit(bound - taken))
                break
            taken += c
    out = v.filter(above)
    for t in ties:
        out = out.unionByName(t)
    return out


def fit_vocabulary(tf: DataFrame, n_docs: DataFrame, id_col: str, min_df: int = 1, max_df: float = 1.0,
                   max_features: int | None = None) -> DataFrame:
    """(term, df, cf, idf) with ``min_df`` (count), ``max_df`` (fraction)
    and ``max_features`` (top by corpus count, term breaks ties); smooth idf
    ``ln((1 + n) / (1 + df)) + 1``.  ``n_docs`` is a one-row frame ``(n)``."""
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    v = stats.crossJoin(F.broadcast(n_docs))
    v = v.filter((F.col("df") >= F.lit(min_df)) & (F.col("df") <= F.lit(float(max_df)) * F.col("n")))
    if max_features:
        v = top_terms(v.withColumn("block", F.lit("")), {"": int(max_features)})
    return v.select("term", "df", "cf",
                    (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def tfidf_weights(tf: DataFrame, vocab: DataFrame, id_col: str, vocab_bound: int | None) -> DataFrame:
    """Tf * idf, L2-normalised per document: (id, term, weight).

    The vocabulary is broadcast only when its size is bounded by
    ``max_features`` (and that bound is below ``MAX_BROADCAST_VOCAB``);
    otherwise the planner joins it by term."""
    v = vocab.select("term", "idf")
    if vocab_bound is not None and vocab_bound <= MAX_BROADCAST_VOCAB:
        v = F.broadcast(v)
    j = tf.join(v, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_col)))
    return j.select(id_col, "term", (F.col("_w") / norm).alias("weight"))


def fit_block(docs: DataFrame, spec: BlockSpec, id_col: str = "track_id", n_docs: DataFrame | None = None,
              pattern: str = text.WORD_TOKEN, stop_words: list[str] | None = None, min_len: int = 1):
    """Fit one TF-IDF block: returns (vocab, weights)."""
    n_docs = n_docs if n_docs is not None else docs.agg(F.count(F.lit(1)).alias("n"))
    # documents exchanged by id once; the count and the norm window reuse it
    tf = term_counts(docs.repartition(id_col), id_col, block_terms(spec, pattern, min_len, stop_words))
    vocab = fit_vocabulary(tf, n_docs, id_col, spec.min_df, spec.max_df, spec.max_features)
    return vocab, tfidf_weights(tf, vocab, id_col, spec.max_features)


def numeric_stats(docs: DataFrame, cols=NUMERIC_COLS) -> DataFrame:
    """D6 fit: one row of population mean and std per column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    st = docs.agg(*aggs)
    return st.select(*[x for c in cols for x in (
        F.col(f"{c}_mean"),
        F.when((F.col(f"{c}_std") == 0) | F.col(f"{c}_std").isNull(), F.lit(1.0))
         .otherwise(F.col(f"{c}_std")).alias(f"{c}_std"))])


def zscore(docs: DataFrame, stats: DataFrame, id_col: str = "track_id", cols=NUMERIC_COLS) -> DataFrame:
    """D6 apply: (id, z_<col>...) with the one-row stats broadcast."""
    j = docs.select(id_col, *cols).crossJoin(F.broadcast(stats))
    return j.select(id_col, *[((F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"z_{c}")
                              for c in cols])


class ContentModel:
    """Fitted content space: one vocabulary table (block, term, df, cf, idf),
    numeric stats, and (when fitted on a corpus) the documents' tokens and
    z-scores (``docs``, see ``_documents``; ``source`` is what they are made of, if no id repeats), of which the index rows, the
    per-block unit TF-IDF weights (id, block, term, weight) and the long tables
    are made document by document.

    Where every block has a ``max_features`` bound the vocabulary is broadcast;
    otherwise ``docs`` is exploded and joined with it by term."""

    def __init__(self, cfg: FeatureConfig, vocab: DataFrame, stats: DataFrame, weights: DataFrame | None,
                 z: DataFrame | None, id_col: str = "track_id", docs: DataFrame | None = None, source: DataFrame | None = None):
        self.cfg, self.vocab, self.stats, self.id_col = cfg, vocab, stats, id_col
        self.z, self.docs, self.source, self._weights, self._terms = z, docs, source, weights, None

    @property
    def weights(self) -> DataFrame | None:
        if self._weights is not None or self.docs is None:
            return self._weights
        if not _bounded(self.cfg):
            return _weights(_block_tf(self.docs, self.cfg, self.id_col), self.vocab, self.id_col, self.cfg)
        unit = self._vectors({b.name: 1.0 for b in self.cfg.active_blocks()}, None, False)
        colon = F.instr("key", ":")
        return _entries(unit, self.id_col).select(self.id_col, F.substring_index("key", ":", 1).alias("block"),
                                                  F.substring("key", colon + 1, F.length("key")).alias("term"), F.col("value").alias("weight"))

    @property
    def vocabs(self) -> dict[str, DataFrame]:
        return {b.name: self.vocab.filter(F.col("block") == b.name).drop("block") for b in self.cfg.active_blocks()}

    @property
    def block_weights(self) -> dict[str, DataFrame]:
        return {b.name: self.weights.filter(F.col("block") == b.name).drop("block") for b in self.cfg.active_blocks()}

    def _vectors(self, wts: dict[str, float], numeric_weight: float | None, normalize: bool, docs: DataFrame | None = None, then=None, schema: str = "") -> DataFrame:
        """(id, keys, vals) of every document: unit blocks times their weights, the z-scores times theirs, all divided by the row's norm.
        ``docs`` are the documents in another order; ``then`` takes the batches of these rows to others of ``schema`` in the same task.

        The vocabulary (bounded by ``max_features``) is collected once a model."""
        docs = self.docs if docs is None else docs
        if self._terms is None:
            self._terms = self.vocab.select("block", "term", "idf").toArrow().combine_chunks()
        specs = [(b.name, *b.ngram, float(wts[b.name])) for b in self.cfg.active_blocks()]
        kernel = _vector_kernel(docs.sparkSession.sparkContext.broadcast(self._terms), self.id_col, specs, numeric_weight, normalize)
        run = kernel if then is None else lambda batches: then(kernel(batches))
        kind = docs.schema[self.id_col].dataType.simpleString()
        return docs.select(self.id_col, *[f"_tok_{name}" for name, *_ in specs], "_z").mapInArrow(
            run, schema or f"`{self.id_col}` {kind}, keys array<string>, vals array<double>")

    # -- D8 / D9 ---------------------------------------------------------------
    def raw_long(self, cfg: FeatureConfig | None = None, weights: DataFrame | None = None,
                 z: DataFrame | None = None) -> DataFrame:
        """Weighted, un-normalised entries (id, key, value)."""
        cfg = cfg or self.cfg
        if weights is None and z is None and self.docs is not None and _bounded(self.cfg):
            return _entries(self._vectors(cfg.weights(), float(cfg.numeric_weight), False), self.id_col)
        wl = weights if weights is not None else self.weights
        z = z if z is not None else self.z
        wts = cfg.weights()
        bw = F.create_map(*[x for b, w in wts.items() for x in (F.lit(b), F.lit(float(w)))])
        text_part = wl.select(self.id_col, F.concat("block", F.lit(":"), "term").alias("key"),
                              (F.col("weight") * bw[F.col("block")]).alias("value"))
        nw = float(cfg.numeric_weight)
        num = z.select(self.id_col, F.explode(F.array(
            F.struct(F.lit("n:year").alias("key"), (F.col("z_release_year") * nw).alias("value")),
            F.struct(F.lit("n:explicit").alias("key"), (F.col("z_explicit") * nw).alias("value")))).alias("e")
        ).select(self.id_col, "e.key", "e.value")
        # text weights are > 0 by construction; the two numeric entries are
        # kept even when 0, so every item (and query) has them and a one-query
        # join on the key scores every item, including items whose score is 0
        return text_part.unionByName(num)

    def normalized_long(self, cfg: FeatureConfig | None = None, **kw) -> DataFrame:
        """Unit rows (zero rows stay zero)."""
        cfg = cfg or self.cfg
        if not kw and self.docs is not None and _bounded(self.cfg):
            return _entries(self._vectors(cfg.weights(), float(cfg.numeric_weight), True), self.id_col)
        raw = self.raw_long(cfg, **kw)
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(self.id_col)))
        return raw.select(self.id_col, "key", (F.col("value") / norm).alias("value"))

    def index_rows(self, cfg: FeatureConfig | None = None) -> DataFrame:
        """The entries of ``normalized_long`` as one row per item (id, keys, vals)."""
        cfg = cfg or self.cfg
        if self.docs is not None and _bounded(self.cfg):
            return self._vectors(cfg.weights(), float(cfg.numeric_weight), True)
        from tunesift.operators.similarity import index_rows
        return index_rows(self.normalized_long(cfg), self.id_col)

    def blocks(self) -> DataFrame:
        """``block_index`` of the index rows.  Documents with unique ids are put in order and vectorised
        there (with a broadcast vocabulary), so that their texts are exchanged and not their entries."""
        from tunesift.operators import block_index as BLK
        if self.source is None or not _bounded(self.cfg):
            return BLK.block_index(self.index_rows(), self.id_col)
        docs, columns = self.source, {b.name: b.column for b in self.cfg.active_blocks()}
        lead, either = (F.lower(columns[p.rstrip(":")]) if p.rstrip(":") in columns else F.lit("") for p in (BLK.LEAD, BLK.EITHER))
        # numbers in steps, so that those alike stay together and genres order them further
        scored = _scored(docs.withColumn(self.id_col, F.col(self.id_col).cast("string")), self.stats)
        ordered = BLK.in_order(scored, [text.strip_ws(lead), F.transform("_z", lambda z: F.round(2 * z)), either, F.col(self.id_col)])
        ordered = _tokens(ordered, self.cfg, self.id_col)  # no join above the sort: the planner would drop the order
        return self._vectors(self.cfg.weights(), float(self.cfg.numeric_weight), True, ordered, BLK.cut(BLK.BLOCK_ITEMS), BLK.BLOCKS)


def _bounded(cfg: FeatureConfig) -> bool:
    """Whether the vocabulary may be broadcast."""
    bounds = [b.max_features for b in cfg.active_blocks()]
    return all(bounds) and sum(bounds) <= MAX_BROADCAST_VOCAB


def _entries(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, key, value) of index rows."""
    e = F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("vals").alias("value"))).alias("e")
    return rows.select(id_col, e).select(id_col, "e.key", "e.value")


def _documents(docs: DataFrame, stats: DataFrame, cfg: FeatureConfig, id_col: str, unique: bool) -> DataFrame:
    """(id, one array of tokens per block, z-scores of year and explicit as ``_z``): one row per id.

    With ``unique`` ids nothing is exchanged; otherwise rows with the same id become one, with the
    z-scores of all and their tokens one after the other, each row's followed by a null."""
    rows = _tokens(_scored(docs, stats), cfg, id_col)
    if unique:
        return rows
    end = F.array(F.lit(None).cast("string"))
    return rows.groupBy(id_col).agg(*[F.flatten(F.collect_list(F.concat(k, end))).alias(k) for k in rows.columns[1:-1]], F.flatten(F.collect_list("_z")).alias("_z"))


def _scored(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """The documents with the z-scores of year and explicit as ``_z``."""
    z = F.array(*[(F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in NUMERIC_COLS])
    return docs.crossJoin(F.broadcast(stats)).select(*docs.columns, z.alias("_z"))


def _tokens(scored: DataFrame, cfg: FeatureConfig, id_col: str) -> DataFrame:
    """(id, one array of tokens per block, ``_z``)."""
    return scored.select(id_col, *[text.word_tokens(block_doc(s)).alias(f"_tok_{s.name}") for s in cfg.active_blocks()], "_z")


def _gram_counts(lists, lo: int, hi: int):
    """(row, place, count) of the n-grams of lists of tokens, by row, and the different n-grams; a null token ends a text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    flat = pc.list_flatten(lists)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    tokens, code = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.flatnonzero(code >= 0)  # where the n-grams of the size at hand begin
    grams, of = tokens, code[start]
    rows, places, names, at = [], [], [], 0
    for n in range(1, hi + 1):
        if n > 1:
            last = np.minimum(start + n - 1, max(len(code) - 1, 0))
            on = (start + n - 1 < len(code)) & (code[last] >= 0) & (row[last] == row[start]) if len(code) else np.zeros(0, bool)
            start, of, last = start[on], of[on], last[on]
            pair, of = np.unique(of * max(len(tokens), 1) + code[last], return_inverse=True)
            grams = pc.binary_join_element_wise(grams.take(pa.array(pair // max(len(tokens), 1))), tokens.take(pa.array(pair % max(len(tokens), 1))), " ")
        if n >= lo:
            rows.append(row[start]), places.append(of + at), names.append(grams)
            at += len(grams)
    key, count = np.unique(np.concatenate(rows) * max(at, 1) + np.concatenate(places), return_counts=True)
    return key // max(at, 1), key % max(at, 1), count, pa.concat_arrays(names)


def _block_tf(docs: DataFrame, cfg: FeatureConfig, id_col: str) -> DataFrame:
    """(id, block, term, tf) of ``_documents``."""
    import pyarrow as pa
    specs = [(s.name, *s.ngram) for s in cfg.active_blocks()]
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        for b in batches:
            for (name, lo, hi), lists in zip(specs, b.columns[1:]):
                row, place, tf, grams = _gram_counts(lists, lo, hi)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([name] * len(row), pa.string()), grams.take(pa.array(place)), pa.array(tf)],
                                                 names=[id_col, "block", "term", "tf"])
    return docs.select(id_col, *[f"_tok_{name}" for name, _, _ in specs]).mapInArrow(kernel, f"`{id_col}` {kind}, block string, term string, tf long")


def _term_counts(docs: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """(block, term, df, cf) of ``_documents``: each batch's different terms are added up by term."""
    import numpy as np
    import pyarrow as pa
    specs = [(s.name, *s.ngram) for s in cfg.active_blocks()]

    def kernel(batches):
        for b in batches:
            for (name, lo, hi), lists in zip(specs, b.columns):
                _, place, tf, grams = _gram_counts(lists, lo, hi)
                df, cf = np.bincount(place, minlength=len(grams)), np.bincount(place, weights=tf, minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), grams, pa.array(df), pa.array(cf)], names=["block", "term", "df", "cf"])
    one = docs.select(*[f"_tok_{name}" for name, _, _ in specs]).mapInArrow(kernel, "block string, term string, df long, cf long")
    return one.groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _vector_kernel(sent, id_col: str, specs: list[tuple], numeric_weight: float | None, normalize: bool):
    """Index rows (id, keys, vals) of batches of ``_documents``, for blocks (name, n-gram range, weight);
    without a numeric weight the z-scores are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def kernel(batches):
        vocab, known, idf, keys = sent.value, [], [], []
        for name, *_ in specs:
            own = vocab.filter(pc.equal(vocab.column("block"), name))
            known.append(own.column("term").combine_chunks())
            idf.append(own.column("idf").to_numpy())
            keys.append(pc.binary_join_element_wise(pa.scalar(name), known[-1], ":").cast(pa.string()))
        keys = pa.concat_arrays([*keys, pa.array(["n:year", "n:explicit"])])
        for b in batches:
            n, rows, codes, vals, at = b.num_rows, [], [], [], 0
            for lists, terms, weight, (_, lo, hi, w) in zip(b.columns[1:-1], known, idf, specs):
                row, place, tf, grams = _gram_counts(lists, lo, hi)
                code = pc.fill_null(pc.index_in(grams, value_set=terms), -1).to_numpy(zero_copy_only=False)[place]
                on = code >= 0
                row, code, v = row[on], code[on], tf[on] * weight[code[on]]
                v = v / np.sqrt(np.bincount(row, weights=v * v, minlength=n))[row] * w
                rows.append(row), codes.append(code + at), vals.append(v)
                at += len(terms)
            if numeric_weight is not None:
                z = b.column(b.num_columns - 1)
                rows.append(pc.list_parent_indices(z).to_numpy(zero_copy_only=False).astype(np.int64))
                vals.append(pc.list_flatten(z).to_numpy(zero_copy_only=False).astype(float) * numeric_weight)  # a null is NaN
                codes.append(at + np.arange(len(vals[-1])) % 2)
            row, code, v = (np.concatenate(x) for x in (rows, codes, vals))
            order = np.argsort(row, kind="stable")
            row, code, v = row[order], code[order], v[order]
            lost = np.isnan(v)
            if normalize:
                norm = np.sqrt(np.bincount(row, weights=np.where(lost, 0.0, v * v), minlength=n))
                v = v / np.where(norm > 0, norm, 1.0)[row]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, keys.take(pa.array(code))),
                                              pa.ListArray.from_arrays(offsets, pa.array(v, pa.float64(), mask=lost))], names=[id_col, "keys", "vals"])
    return kernel


def _param_map(cfg: FeatureConfig, attr: str, default) -> Column:
    vals = []
    for b in cfg.active_blocks():
        v = getattr(b, attr)
        vals += [F.lit(b.name), F.lit(v if v is not None else default)]
    return F.create_map(*vals)


def _weights(tf: DataFrame, vocab: DataFrame, id_col: str, cfg: FeatureConfig) -> DataFrame:
    """tf * idf, L2-normalised per (document, block); vocabulary broadcast
    when every block has a ``max_features`` bound."""
    v = vocab.select("block", "term", "idf")
    bounds = [b.max_features for b in cfg.active_blocks()]
    if all(bounds) and sum(bounds) <= MAX_BROADCAST_VOCAB:
        v = F.broadcast(v)
    j = tf.join(v, ["block", "term"]).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_col, "block")))
    return j.select(id_col, "block", "term", (F.col("_w") / norm).alias("weight"))


def fit_content(docs: DataFrame, cfg: FeatureConfig | None = None, id_col: str = "track_id", unique: bool = False) -> ContentModel:
    """D4-D9 fit on a repaired catalogue (``prepare_meta`` output).

    Tasks count each batch's terms with Arrow, and only its distinct terms meet
    by (block, term): that sum is the fit's one exchange.  Rows with the same id
    count as one document and are put together before; ``unique`` says that
    there are none, as in the stored catalogue.  Per-block ``min_df`` /
    ``max_df`` filters are a lookup on the block, and ``max_features`` cuts by
    ``top_terms``."""
    cfg = cfg or FeatureConfig()
    docs = docs.select(id_col, *{b.column for b in cfg.active_blocks()}, *NUMERIC_COLS)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    nstats = numeric_stats(docs)
    rows = _documents(docs, nstats, cfg, id_col, unique)
    v = _term_counts(rows, cfg).crossJoin(F.broadcast(n_docs))
    v = v.filter((F.col("df") >= _param_map(cfg, "min_df", 1)[F.col("block")]) &
                 (F.col("df") <= _param_map(cfg, "max_df", 1.0)[F.col("block")].cast("double") * F.col("n")))
    vocab = top_terms(v, {b.name: b.max_features for b in cfg.active_blocks() if b.max_features})
    vocab = vocab.select("block", "term", "df", "cf",
                         (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    return ContentModel(cfg, vocab, nstats, None, zscore(docs, nstats, id_col), id_col, rows, docs if unique else None)


def transformed(model: ContentModel, rows: DataFrame, cfg: FeatureConfig | None = None, id_col: str | None = None, unique: bool = False) -> ContentModel:
    """The fitted vocabularies and statistics over other rows."""
    cfg, id_col = cfg or model.cfg, id_col or model.id_col
    rows = rows.select(id_col, *{b.column for b in cfg.active_blocks()}, *NUMERIC_COLS)
    return ContentModel(cfg, model.vocab, model.stats, None, zscore(rows, model.stats, id_col), id_col,
                        _documents(rows, model.stats, cfg, id_col, unique), rows if unique else None)


def transform_rows(model: ContentModel, rows: DataFrame, cfg: FeatureConfig | None = None,
                   normalize: bool = True, id_col: str | None = None, unique: bool = False) -> DataFrame:
    """Vectorise new rows (queries) with the fitted vocabularies and
    statistics and the given (query) weights: (id, key, value).  ``unique`` says that no id repeats."""
    tmp = transformed(model, rows, cfg, id_col, unique)
    return tmp.normalized_long() if normalize else tmp.raw_long()
