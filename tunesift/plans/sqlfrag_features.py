"""DuckDB SQL builders for the feature oracles (TF-IDF, z-score, content vectors)."""

from __future__ import annotations

from tunesift.config import BlockSpec, FeatureConfig

WORD = "[\\p{L}\\p{N}_]+"
STRIP = "'^\\s+|\\s+$'"


def doc_sql(spec: BlockSpec, src_col: str | None = None) -> str:
    c = src_col or spec.column
    if spec.doc == "genre":
        s = f"regexp_replace(lower(coalesce({c}, '')), '[;|]', ',', 'g')"
        s = f"replace({s}, ',', ' ')"
        s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
        return f"regexp_replace({s}, {STRIP}, '', 'g')"
    return f"regexp_replace(lower(coalesce({c}, '')), {STRIP}, '', 'g')"


def terms_sql(tok: str, lo: int, hi: int) -> str:
    """List of n-grams lo..hi of a token list expression (DuckDB lists are 1-based)."""
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(tok)
        else:
            joined = " || ' ' || ".join(f"{tok}[i + {j}]" for j in range(n))
            parts.append(f"(CASE WHEN len({tok}) >= {n} THEN list_transform(range(1, len({tok}) - {n - 2}), "
                         f"lambda i: {joined}) ELSE []::VARCHAR[] END)")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def block_ctes(spec: BlockSpec, src: str = "meta", id_col: str = "track_id", pattern: str = WORD) -> str:
    b = spec.name
    maxf = f" ORDER BY cf DESC, term LIMIT {spec.max_features}" if spec.max_features else ""
    return f""",
 tok_{b} AS (SELECT {id_col}, regexp_extract_all({doc_sql(spec)}, '{pattern}') AS t FROM {src}),
 trm_{b} AS (SELECT {id_col}, unnest({terms_sql('t', *spec.ngram)}) AS term FROM tok_{b}),
 tf_{b} AS (SELECT {id_col}, term, count(*) AS tf FROM trm_{b} GROUP BY {id_col}, term),
 nd_{b} AS (SELECT count(*) AS n FROM {src}),
 voc_{b} AS (SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
   SELECT term, count(*) AS df, sum(tf) AS cf FROM tf_{b} GROUP BY term) s, nd_{b}
   WHERE df >= {spec.min_df} AND df <= {float(spec.max_df)} * n{maxf}),
 w0_{b} AS (SELECT {id_col}, term, tf * idf AS w FROM tf_{b} JOIN voc_{b} USING (term)),
 w_{b} AS (SELECT {id_col}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS weight FROM w0_{b})"""


def numeric_ctes(src: str = "meta") -> str:
    return f""",
 st AS (SELECT avg(CAST(release_year AS DOUBLE)) AS ym,
   CASE WHEN coalesce(stddev_pop(CAST(release_year AS DOUBLE)), 0) = 0 THEN 1.0 ELSE stddev_pop(CAST(release_year AS DOUBLE)) END AS ys,
   avg(CAST(explicit AS DOUBLE)) AS em,
   CASE WHEN coalesce(stddev_pop(CAST(explicit AS DOUBLE)), 0) = 0 THEN 1.0 ELSE stddev_pop(CAST(explicit AS DOUBLE)) END AS es FROM {src}),
 z AS (SELECT track_id, (release_year - ym) / ys AS z_release_year, (explicit - em) / es AS z_explicit FROM {src}, st)"""


def content_ctes(cfg: FeatureConfig, src: str = "meta", name: str = "cv", normalize: bool = True,
                 weights_from: FeatureConfig | None = None) -> str:
    """All blocks + numerics -> ``{name}(track_id, key, value)``."""
    out = "".join(block_ctes(s, src) for s in cfg.active_blocks()) + numeric_ctes(src)
    wcfg = weights_from or cfg
    wts = wcfg.weights()
    sel = [f"SELECT track_id, '{b}:' || term AS key, weight * {float(wts[b])} AS value FROM w_{b}" for b in wts]
    nw = float(wcfg.numeric_weight)
    sel.append(f"SELECT track_id, 'n:year' AS key, z_release_year * {nw} AS value FROM z")
    sel.append(f"SELECT track_id, 'n:explicit' AS key, z_explicit * {nw} AS value FROM z")
    out += f""",
 {name}_raw AS (SELECT * FROM ({' UNION ALL '.join(sel)}) u)"""
    if normalize:
        out += f""",
 {name} AS (SELECT track_id, key, value / sqrt(sum(value * value) OVER (PARTITION BY track_id)) AS value FROM {name}_raw)"""
    else:
        out += f""",
 {name} AS (SELECT * FROM {name}_raw)"""
    return out
