"""URL filters over time: dated list entries, as of each capture's fetch.

A list is a log of changes (kind, pattern, verdict, action 'add' or 'remove', day). Each 'add' holds from its day until
the next change of the same (kind, pattern, in lower case); these validity intervals are joined to captures by key and containment.
A capture's keys are its host's name and every parent domain (kind 'domain'), the words of its host between dots and
hyphens ('word'), and host plus first path segment ('path'). The longest active pattern decides, 'allow' before
'block'; without one the decision is 'none'.

Everything is DataFrame operations. A list of at most `SMALL_LIST` intervals is broadcast; a longer one meets the keys
in a shuffled join, where Spark splits frequent hosts. A capture's own matches are reduced by row, never by host.

Rows: a null or unparsable url has no host and no keys, a null fetch day no active entry; both decide 'none'. Changes
with a null field are left out; of changes of one day, 'remove' comes last. Repeated captures each get a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import keyed, save

SMALL_LIST = 100_000

#: The registered query's list: (kind, pattern, verdict, action, day). Fixed values.
CHANGES = [
    ("domain", "casino-win.example.com", "block", "add", "2024-02-01"),
    ("domain", "casino-win.example.com", "block", "remove", "2024-05-01"),
    ("domain", "casino-win.example.com", "block", "add", "2024-07-01"),
    ("domain", "m.casino-win.example.com", "allow", "add", "2024-08-01"),
    ("domain", "free-bets.example.com", "block", "add", "2024-01-01"),
    ("domain", "free-bets.example.com", "block", "remove", "2024-11-15"),
    ("domain", "example.net", "block", "add", "2024-03-01"),
    ("domain", "example.net", "block", "remove", "2024-03-15"),
    ("domain", "blog.therst.example.net", "allow", "add", "2024-01-15"),
    ("domain", "example.org", "allow", "add", "2024-06-01"),
    ("domain", "example.org", "allow", "remove", "2024-06-01"),
    ("word", "casino", "block", "add", "2024-01-10"),
    ("word", "casino", "block", "remove", "2024-01-31"),
    ("word", "bets", "block", "add", "2024-10-01"),
    ("word", "win", "block", "add", "2024-12-01"),
    ("path", "www.ththin.example.com/fr", "block", "add", "2024-04-01"),
    ("path", "casino-win.example.com/en", "allow", "add", "2024-09-01"),
    ("path", "casino-win.example.com/en", "allow", "remove", "2024-09-20"),
]


def changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANGES, "kind string, pattern string, verdict string, action string, day string").withColumn("day", F.to_date("day"))


def host_changes(captures: DataFrame, url: str = "url") -> DataFrame:
    """A list that grows with the captures: of their hosts, those whose MD5 says so, added on a day of 2024 that it gives
    and some removed again later."""
    hosts = with_keys(captures, url).select("host").filter("host <> ''").distinct().withColumn("v", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")).filter("v % 4 = 0")
    added = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("v") % 366).cast("int"))
    removed = F.date_add(added, (F.col("v") % 100 + 30).cast("int"))
    days = F.array(F.struct(F.lit("add").alias("action"), added.alias("day")), F.struct(F.when(F.col("v") % 3 == 0, "remove").alias("action"), removed.alias("day")))
    rows = hosts.select("host", "v", F.explode(days).alias("c")).filter("c.action is not null")
    return rows.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern"), F.when(F.col("v") % 5 == 0, "allow").otherwise("block").alias("verdict"), "c.action", "c.day")


def intervals(log: DataFrame) -> DataFrame:
    """(kind, pattern, verdict, since, until): half-open; until is null while the entry holds."""
    whole = log.select("kind", F.lower("pattern").alias("pattern"), "verdict", "action", "day").dropna()
    after = Window.partitionBy("kind", "pattern").orderBy("day", "action", "verdict")
    return whole.withColumn("until", F.lead("day").over(after)).filter("action = 'add' and (until is null or day < until)").select("kind", "pattern", "verdict", F.col("day").alias("since"), "until")


def with_keys(captures: DataFrame, url: str = "url") -> DataFrame:
    """captures with host, and keys: array<struct<kind,pattern>>."""
    address = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(address, "^.*@", ""), ":[0-9]*$", ""))
    first = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]*)", 1)
    keys = F.expr("""
        case when host = '' then array() else array_distinct(concat(
            transform(sequence(1, size(split(host, '[.]'))), i -> named_struct('kind', 'domain', 'pattern', array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))),
            transform(split(host, '[.-]'), w -> named_struct('kind', 'word', 'pattern', w)),
            array(named_struct('kind', 'path', 'pattern', lower(concat(host, first_segment)))))) end""")
    return captures.withColumn("host", host).withColumn("first_segment", first).withColumn("keys", keys).drop("first_segment")


def evaluate(captures: DataFrame, log: DataFrame, id_col: str = "page_id", day: str = "fetched_on") -> DataFrame:
    """id_col, host, fetched day, n_active, pattern, decision of every capture. captures: (id_col, url, day)."""
    rows = with_keys(keyed(captures, id_col, ("url", day), "url-keyed"))
    held = save(intervals(log), "url-intervals")
    if held.count() <= SMALL_LIST:
        held = F.broadcast(held)
    on = rows.select("rid", F.col(day).alias("at"), F.explode("keys").alias("key")).select("rid", "at", "key.kind", "key.pattern")
    active = on.join(held, ["kind", "pattern"]).filter("since <= at and (until is null or at < until)")
    best = active.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("pattern").alias("length"), (F.col("verdict") == "allow").alias("allow"), "pattern", "verdict")).alias("best"))
    return rows.join(best, "rid", "left").select(id_col, "host", F.col(day).cast("string").alias(day), F.coalesce("n", F.lit(0)).alias("n_active"), F.col("best.pattern").alias("pattern"), F.coalesce("best.verdict", F.lit("none")).alias("decision"))


def report(pages: DataFrame) -> DataFrame:
    """Every page against the fixed list and that of the pages' own hosts; a page counts as fetched on day page_id mod 366
    of 2024."""
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))
    return evaluate(captures, changes(pages.sparkSession).unionByName(host_changes(pages)))


ORACLE = f"""
WITH base AS (
  SELECT page_id, CAST('2024-01-01' AS DATE) + CAST(page_id % 366 AS INTEGER) AS fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1) AS seg FROM pages),
hosts AS (SELECT host, v, CAST('2024-01-01' AS DATE) + CAST(v % 366 AS INTEGER) AS added FROM (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS v FROM base WHERE host <> '') h WHERE v % 4 = 0),
log(kind, pattern, verdict, action, day) AS (
  SELECT kind, pattern, verdict, action, CAST(day AS DATE) FROM (VALUES {", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in CHANGES)}) f(kind, pattern, verdict, action, day)
  UNION ALL SELECT 'domain', host, CASE WHEN v % 5 = 0 THEN 'allow' ELSE 'block' END, 'add', added FROM hosts
  UNION ALL SELECT 'domain', host, CASE WHEN v % 5 = 0 THEN 'allow' ELSE 'block' END, 'remove', added + CAST(v % 100 + 30 AS INTEGER) FROM hosts WHERE v % 3 = 0),
held AS (
  SELECT kind, pattern, verdict, since, until FROM (
    SELECT kind, pattern, verdict, action, day AS since, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day, action, verdict) AS until FROM log) x
  WHERE action = 'add' AND (until IS NULL OR since < until)),
keys AS (
  SELECT page_id, fetched, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS pattern FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM base) a
  UNION SELECT page_id, fetched, 'word', unnest(string_split(replace(host, '-', '.'), '.')) FROM base
  UNION SELECT page_id, fetched, 'path', lower(host || seg) FROM base),
active AS (
  SELECT k.page_id, h.pattern, h.verdict, row_number() OVER (PARTITION BY k.page_id ORDER BY length(h.pattern) DESC, h.verdict = 'allow' DESC, h.pattern DESC) AS rn, count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keys k JOIN held h ON k.kind = h.kind AND k.pattern = h.pattern AND h.since <= k.fetched AND (h.until IS NULL OR k.fetched < h.until))
SELECT b.page_id, b.host, CAST(b.fetched AS VARCHAR) AS fetched_on, coalesce(a.n, 0) AS n_active, a.pattern, coalesce(a.verdict, 'none') AS decision
FROM base b LEFT JOIN active a ON a.page_id = b.page_id AND a.rn = 1
"""
