"""URL filter: pattern rules found through their rarest literal token.

A rule is a pattern over a url's host (A-Z lower-cased) followed by its path:
``||`` at the front ties it to a host or any of its parents, ``|`` to the front
or the end, ``*`` stands for anything, ``^`` for a separator or the end, and
all else for itself.  A literal token is a run of ASCII letters and digits with
a fixed neighbour on both sides, so a url that fits the rule has it as a whole
token.  Each rule is filed under whichever of its tokens the fewest urls have;
a url's own tokens fetch the rules filed under them, and only those run their
regular expression.  A rule without such a token is filed under the empty one,
which every url has.

Of the rules that fit, the lowest tier wins, then the longest pattern, then
block before allow, then the first by code point; where none fits, the verdict
is the default.

Everything is DataFrame functions.  Equal (id, url) rows are counted together
first, and matching keeps that partitioning, so an index under
``BROADCAST_BYTES`` costs one exchange in all, of ids and urls; a larger one is
joined by token, in ``SALTS`` copies, so that a token that most urls have is
spread out.

Defined results: a null url, or one without ``://``, has empty host and path
and can fit only rules that an empty text fits; null ids and repeated rows are
kept as they are; null or empty patterns are no rules; an empty table gives an
empty result; other columns of the pages aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of patterns up to which the index is broadcast.
BROADCAST_BYTES = 8 << 20
#: Copies of a larger index, and keys that repeats of one row are spread over.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[A-Za-z0-9]+"
#: What ``||`` and ``^`` stand for.
SUBDOMAINS, SEPARATOR = r"^(?:[^/]*\.)?", r"(?:[^A-Za-z0-9_.%-]|\z)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(tier, pattern, action) of a configured list; longer lists come as a DataFrame of these columns."""
    rows = [F.struct(F.lit(t).alias("tier"), F.lit(p).alias("pattern"), F.lit(a).alias("action")) for t, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def compiled(rules: DataFrame) -> DataFrame:
    """The rules with their regular expression and literal tokens, one row for each distinct rule."""
    p = F.col("pattern")
    front = F.when(p.startswith("||"), SUBDOMAINS).when(p.startswith("|"), "^").otherwise("")
    skip = F.when(p.startswith("||"), 2).when(p.startswith("|"), 1).otherwise(0)
    tied = p.endswith("|") & (F.length(p) > skip)
    body = F.substring(p, skip + 1, F.length(p) - skip - tied.cast("int"))
    body = F.regexp_replace(body, r"([!-)+-/:-@\[-\]_`{-~])", r"\\$1")  # all ASCII marks but * and ^
    body = F.regexp_replace(body, r"\^", SEPARATOR.replace("\\", "\\\\"))
    body = F.regexp_replace(body, r"(?<!\\)\*", ".*")
    words = F.regexp_extract_all(p, F.lit(f"(?<=[^A-Za-z0-9*]){TOKEN}(?=[^A-Za-z0-9*])"), F.lit(0))
    return rules.select("tier", "pattern", "action").filter("length(pattern) > 0").distinct().select(
        "*", F.concat(F.lit("(?s)"), front, body, F.when(tied, r"\z").otherwise("")).alias("regex"), F.array_distinct(words).alias("words"))


def _tokens(target: Column) -> Column:
    """A url's distinct tokens, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(target, F.lit(TOKEN), F.lit(0))))


def rarest_token_index(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(token, tier, pattern, action, regex): each compiled rule under its token that the fewest rows of ``target`` have."""
    each = rules.select("*", F.explode_outer("words").alias("token")).drop("words").fillna("", ["token"])
    asked = each.filter("token != ''").select("token").distinct()
    met = targets.select(F.explode(_tokens(F.col("target"))).alias("token")).join(asked, "token", "left_semi") \
        .groupBy("token").agg(F.count(F.lit(1)).alias("met"))
    rarity = F.struct(F.coalesce("met", F.lit(0)).alias("met"), F.col("token"))
    return each.join(met, "token", "left").groupBy("tier", "pattern", "action", "regex") \
        .agg(F.min(rarity).alias("least")).select("least.token", "tier", "pattern", "action", "regex")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, host, path, tier, pattern, verdict) of every row; tier and pattern are null where no rule fits."""
    url = F.col(url_col).cast("string")
    given = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    rules = compiled(rules)
    index = rarest_token_index(rules, given.select(F.concat(host_of(url), path_of(url)).alias("target")))
    size = rules.agg(F.sum(F.octet_length("regex") + F.octet_length("pattern"))).first()[0] or 0
    small = size <= broadcast_bytes
    # repeats of one row meet here, in as many places as there were input partitions, up to SALTS
    rows = given.withColumn("spread", F.pmod(F.spark_partition_id(), F.lit(SALTS))) \
        .groupBy("page_id", "url", "spread").agg(F.count(F.lit(1)).alias("times"))
    parts = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asking = parts.withColumn("target", F.concat("host", "path")).withColumn("token", F.explode(_tokens(F.col("target"))))
    if small:
        met = asking.join(F.broadcast(index), "token", "left")
    else:
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asking.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "spread"), F.lit(SALTS)).cast("int")).join(copies, ["token", "salt"], "left")
    fits = F.when(F.col("regex").isNotNull(), F.expr("target rlike regex"))
    order = F.struct(F.col("tier"), (-F.length("pattern")).alias("long"), (F.col("action") != "block").alias("late"), F.col("pattern"), F.col("action"))
    best = met.groupBy("page_id", "url", "spread").agg(
        F.first("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(F.when(fits, order)).alias("best"))
    verdict = F.coalesce("best.action", F.lit(default)).alias("verdict")
    # each row as often as it came, in two short steps
    return best.withColumn("times", F.explode(F.expr("transform(sequence(0L, (times - 1) div 1000), k -> least(1000L, times - k * 1000L))"))) \
        .withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))) \
        .select("page_id", "url", "host", "path", F.col("best.tier").alias("tier"), F.col("best.pattern").alias("pattern"), verdict)


#: Fixed values of the query: host and path rules, longest first to win.
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: What decides where no host rule fits: a crawl's usual traps, logins and junk hosts.
PATTERNS = [
    ("block", "||spam-"), ("block", "-spam."), ("block", "-pills."), ("block", "||pills."), ("block", "-casino."), ("block", "||casino."),
    ("block", "||adserver."), ("block", "||ads."), ("block", "/cgi-bin/"), ("block", "/wp-login.php"), ("block", "/wp-admin/"),
    ("allow", "/wp-admin/about^"), ("block", "/login^"), ("block", "/logout^"), ("block", "/cart^"), ("block", "/checkout^"),
    ("block", "/calendar/*/day/"), ("block", "/print/*/print/"), ("block", ".exe|"), ("block", ".zip|"), ("block", ".iso|"), ("allow", "/robots.txt|"),
]


def production_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [(0, "||" + r, a) for a, r in HOST_RULES] + [(1, p, a) for a, p in PATTERNS])


def op13_url_rarest_token(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rule = F.when(F.col("tier") == 0, F.substring("pattern", 3, 1 << 20))
    return judge(pages, production_rules(spark)).select("page_id", "host", "path", rule.alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("pattern")).alias("pattern"))


def _as_regex(pattern: str) -> str:
    """The same regular expression in DuckDB's syntax, for the oracle alone."""
    import re
    front, body = (SUBDOMAINS, pattern[2:]) if pattern.startswith("||") else ("^", pattern[1:]) if pattern.startswith("|") else ("", pattern)
    body, back = (body[:-1], r"\z") if body.endswith("|") else (body, "")
    said = {"*": ".*", "^": SEPARATOR}
    return "(?s)" + front + "".join(said.get(c) or re.escape(c) for c in body) + back


def _sql() -> str:
    def values(rows):
        return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    hosts = values([(a, r, r.split("/")[0], "/" + r.split("/", 1)[1]) for a, r in HOST_RULES])
    patterns = values([(a, p, _as_regex(p)) for a, p in PATTERNS])
    return f"""
with h(action, rule, host, path) as (values {hosts}), m(action, pattern, re) as (values {patterns}),
u as (select row_number() over () as n, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
a as (select n, h.rule, h.action, row_number() over (partition by n order by length(h.rule) desc, h.action = 'block' desc, h.rule) as k
  from u join h on (u.host = h.host or ends_with(u.host, '.' || h.host)) and starts_with(u.path, h.path)),
b as (select n, m.pattern, m.action, row_number() over (partition by n order by length(m.pattern) desc, m.action = 'block' desc, m.pattern) as k
  from u join m on regexp_matches(u.host || u.path, m.re))
select page_id, u.host, u.path, a.rule, coalesce(a.action, b.action, 'allow') as verdict, case when a.rule is null then b.pattern end as pattern
from u left join a on u.n = a.n and a.k = 1 left join b on u.n = b.n and b.k = 1"""


OP13_SQL = _sql()
