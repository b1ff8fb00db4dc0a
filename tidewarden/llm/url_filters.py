"""URL allow and block rules by a sort-merge range join, DataFrame functions only.

A host is keyed by its labels in reverse, ``com.example.www.``; a rule's host and all
its subdomains are then one interval of keys. Intervals of hosts nest or are disjoint, so
their end points cut the key space into segments, each with a stack of the rules that are
active in it. URLs and segment starts are sorted together, and a running ``last`` carries
the stack of the latest segment on to the URLs that follow: one sweep, no pairs.

The sweep runs in many independent lanes. URLs are dealt to lanes in turn, so a host, or
one repeated row, with a third of all rows spreads over all lanes. Each lane sorts its own
copy of the segments in, ``lanes`` x 2 rows for each host that has a rule. ``lanes`` follows
from counts: as many as keep the copies fewer than the URLs, and enough for a lane's URLs
to fit a task.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; repeated rows stay; an empty table gives an empty result; an empty rule
table gives every URL the default; rules that are equal count once; of contrary rules for
one host and path the verdict last in order holds (block before allow); a rule with a null
verdict or host is none, and a null path is an empty one; extra columns of the input are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.shared import ascii_lower, written

#: The rules of the registered query: verdict, host, path.
QUERY_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT_VERDICT = "allow"
#: URLs of a lane, at most.
LANE_URLS = 4_000_000
RULE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("verdict", "rule_host", "rule_path")]
)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    rest = F.substring_index(_after_scheme(url), "/", 1)
    return ascii_lower(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    rest = _after_scheme(url)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise("")


def _after_scheme(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def segments(rules: DataFrame) -> DataFrame:
    """(key, stack): from this key on, up to the next one, these rules are active.

    A rule's interval is [key, key with its last dot replaced by the next character).
    Rules of one host share an interval, and the rules of the hosts above it are found by
    its own key's prefixes, of which there are as many as it has labels.
    """
    rules = (
        rules.select(
            "verdict",
            ascii_lower("rule_host").alias("rule_host"),
            F.coalesce("rule_path", F.lit("")).alias("rule_path"),
        )
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule_key", host_key(F.col("rule_host")))
    )
    item = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        "rule_host",
        "rule_path",
        "verdict",
    )
    own = rules.groupBy("rule_key").agg(F.collect_list(item).alias("items"))
    labels = F.split(F.expr("substr(rule_key, 1, length(rule_key) - 1)"), "\\.")
    above = own.select("rule_key", F.posexplode(labels).alias("at", "label")).select(
        "rule_key",
        F.concat(
            F.array_join(F.slice(labels, F.lit(1), F.col("at") + 1), "."), F.lit(".")
        ).alias("above_key"),
    )
    stacks = (
        above.join(own.select(F.col("rule_key").alias("above_key"), "items"), "above_key")
        .groupBy("rule_key")
        .agg(F.sort_array(F.flatten(F.collect_list("items")), asc=False).alias("stack"))
    )
    # After an interval's end the stack of its nearest ancestor is on again.
    opened = stacks.select(F.col("rule_key").alias("key"), F.lit(1).alias("opens"), "stack")
    upper = F.expr("concat(substr(rule_key, 1, length(rule_key) - 1), '/')")
    nearest = (
        above.where("above_key <> rule_key")
        .join(stacks.withColumnRenamed("rule_key", "above_key"), "above_key")
        .groupBy("rule_key")
        .agg(F.max_by("stack", F.length("above_key")).alias("outer"))
    )
    closed = stacks.join(nearest, "rule_key", "left").select(
        upper.alias("key"),
        F.lit(0).alias("opens"),
        F.coalesce("outer", F.expr("slice(stack, 1, 0)")).alias("stack"),
    )
    # Where one interval ends and the next begins, the opening one counts; where nested
    # intervals end together they can't: a longer key ends before its prefix's does.
    return (
        opened.unionByName(closed)
        .groupBy("key")
        .agg(F.max_by("stack", "opens").alias("stack"))
    )


def lanes_for(urls: DataFrame, cuts: DataFrame) -> int:
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = urls.count()
    return max(1, n // LANE_URLS, min(4 * parts, n // max(1, cuts.count())))


def judge(
    urls: DataFrame,
    rules: DataFrame,
    default: str = DEFAULT_VERDICT,
    id_col: str = "page_id",
    lanes: int | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``urls`` (id, url)."""
    cuts = written(segments(rules), "url-segments")
    lanes = lanes or lanes_for(urls, cuts)
    keyed = urls.select(
        F.col(id_col).alias(id_col),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    ).select(
        F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int").alias("lane"),
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("is_url"),
        id_col,
        "host",
        "path",
        F.lit(None).cast(cuts.schema["stack"].dataType).alias("stack"),
    )
    copies = cuts.select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        "key",
        F.lit(0).alias("is_url"),
        F.lit(None).cast(keyed.schema[id_col].dataType).alias(id_col),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
        "stack",
    )
    swept = (
        keyed.unionByName(copies)
        .withColumn(
            "active",
            F.expr(
                "last(stack, true) over (partition by lane order by key, is_url"
                " rows between unbounded preceding and current row)"
            ),
        )
        .where("is_url = 1")
    )
    fits = F.expr("get(filter(active, r -> startswith(path, r.rule_path)), 0)")
    return swept.select(id_col, "host", "path", fits.alias("fit")).select(
        id_col,
        "host",
        "path",
        F.concat("fit.rule_host", "fit.rule_path").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    values = ", ".join(str(rule) for rule in QUERY_RULES)
    return judge(pages, spark.sql(f"SELECT * FROM VALUES {values} AS r(verdict, rule_host, rule_path)"))


ORACLE = r"""
WITH r(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
f AS (
  SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict),
    1000 * (length(rule_host) + length(rule_path)) + length(rule_host)) AS best
  FROM v JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path) GROUP BY page_id)
SELECT v.page_id, v.host, v.path, f.best.rule AS rule,
  coalesce(f.best.verdict, 'allow') AS verdict
FROM v LEFT JOIN f ON v.page_id = f.page_id
"""
