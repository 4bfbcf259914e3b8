"""URL filtering by host and path rules.

Each distinct URL is expanded into the expressions it could match: every
suffix of its host (cut at dots) with every prefix of its path whose length
some rule has.  The expressions meet the rules in an equi-join on the first
bytes of their digests; the full digests then confirm, and the longest rule
wins.  Only built-in expressions are used.

Defined results: a null URL, or one without ``://``, has empty host and path,
matches no rule and gets the default verdict; repeated rows are all judged;
other columns of ``pages`` don't matter; an empty table gives an empty result.
Of two rules of equal length the one with the longer host wins, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path) as the query's contract states them.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 8  # hex digits of the digest that the join compares
BROADCAST_ROWS = 20_000  # more rules than this are joined by a shuffle


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows; of rules with one host and path, ``block`` counts."""
    rows = [(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in rules]
    df = spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")
    df = df.groupBy("rule", "rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    return df.withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))


def split_url(url):
    """Columns host and path of a URL column."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr("substr(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    rule_df = rules_frame(spark, rules).withColumn("head", F.substring("digest", 1, PREFIX_CHARS))
    lengths = sorted({len(r[r.index("/") :]) for _, r in rules})
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array(F.lit(None).cast("string")), lambda p: p.isNotNull())
    expressions = (
        places.filter("host <> '' and path <> ''")
        .withColumn("h", F.explode(suffixes))
        .withColumn("p", F.explode(prefixes))
        .withColumn("full", F.sha2(F.concat_ws("\n", "h", "p"), 256))
        .withColumn("head", F.substring("full", 1, PREFIX_CHARS))
    )
    side = F.broadcast(rule_df) if len(rules) <= BROADCAST_ROWS else rule_df
    best = (
        expressions.join(side, "head")
        .filter(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("hn"), "rule_verdict", "rule")).alias("best"))
    )
    return (
        base.join(best, ["host", "path"], "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"))
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
with parts as (
  select page_id,
    case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules(v, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1) as rule,
  coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1), 'allow') as verdict
from split
"""
