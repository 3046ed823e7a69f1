"""DuckDB SQL fragments shared by the oracles (hand-written, not translated)."""

CATALOG_RAW = """
catalog_raw AS (
 WITH j AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type, s.s_name
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)
 SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS track_id,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE p_name END AS track_name,
  CASE WHEN l_suppkey % 41 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN concat(' ', upper(s_name), ' ') ELSE s_name END AS artist_name,
  CASE WHEN l_partkey % 31 = 0 THEN NULL
       WHEN l_partkey % 4 = 0 THEN concat(p_type, ', ', p_brand)
       WHEN l_partkey % 4 = 1 THEN concat(p_type, ';', p_brand)
       WHEN l_partkey % 4 = 2 THEN concat(lower(p_type), ' | ', p_name, ', ', p_brand)
       ELSE p_type END AS artist_genres,
  CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN substr(CAST(l_shipdate AS VARCHAR),1,4)
       ELSE substr(CAST(l_shipdate AS VARCHAR),1,10) END AS release_date,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS explicit,
  CAST(l_quantity AS INT) AS popularity,
  CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms
 FROM j)"""

CATALOG = CATALOG_RAW + """,
catalog AS (
 SELECT track_id, track_name, artist_name, artist_genres, release_date, explicit, popularity, duration_ms
 FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY
         release_date NULLS FIRST, track_name NULLS FIRST, artist_name NULLS FIRST, artist_genres NULLS FIRST,
         explicit NULLS FIRST, popularity NULLS FIRST, duration_ms NULLS FIRST) AS rn FROM catalog_raw) t
 WHERE rn = 1)"""

META = CATALOG + """,
meta AS (
 SELECT track_id, coalesce(track_name, '') AS track_name, coalesce(artist_name, '') AS artist_name,
  coalesce(artist_genres, '') AS artist_genres,
  coalesce(TRY_CAST(regexp_extract(release_date, '^(\\d{4})', 1) AS INT), 0) AS release_year,
  explicit, release_date, popularity, duration_ms
 FROM catalog)"""

# genre tokens (B11): one row per (track_id, pos, genre), bag semantics
GENRE_TOKENS = """,
genre_tok AS (
 SELECT track_id, pos, genre FROM (
  SELECT track_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS g FROM (
   SELECT track_id, string_split(regexp_replace(lower(artist_genres), '[;|]', ',', 'g'), ',') AS parts FROM meta)) t,
  LATERAL (SELECT regexp_replace(g, '^\\s+|\\s+$', '', 'g') AS genre) x
 WHERE genre <> '')"""


def with_(*ctes: str) -> str:
    return "WITH " + "".join(ctes)
