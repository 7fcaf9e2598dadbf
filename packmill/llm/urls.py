"""Operator 4: URL lists that change over time.

A list is a history of dated entries (list, kind, pattern, action, at): from `at` on, a pattern is
added or removed. Entries become validity intervals; a capture is judged by the intervals that hold
its fetch time. A pattern is a host, which covers its subdomains, with an optional path that ends in
"/" and covers what lies below it. Each capture is looked up under its host suffixes and path
prefixes, an equi-join that Spark broadcasts if the intervals are small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packmill.llm.common import table

#: (list, kind, pattern, action, at)
ENTRIES = [
    ("spam", "block", "spam-farm.example.org", "add", "2024-01-01 00:00:00"),
    ("spam", "block", "spam-farm.example.org", "remove", "2024-05-15 00:00:00"),
    ("spam", "block", "spam-farm.example.org", "add", "2024-07-01 12:00:00"),
    ("spam", "block", "cheap-pills.example.com", "add", "2024-02-10 00:00:00"),
    ("adult", "block", "adult-x.example.com", "add", "2023-11-01 00:00:00"),
    ("adult", "block", "adult-x.example.com/de/", "add", "2024-03-01 00:00:00"),
    ("casino", "block", "casino.example.net", "add", "2024-03-01 00:00:00"),
    ("casino", "block", "casino.example.net", "remove", "2024-03-01 00:00:00"),
    ("legal", "block", "tionsh.example.net/es/", "add", "2024-04-01 00:00:00"),
    ("legal", "block", "tionsh.example.net/es/", "remove", "2024-10-01 00:00:00"),
    ("legal", "block", "tionble.example.com", "add", "2024-06-01 00:00:00"),
    ("trusted", "allow", "blog.tionble.example.com/en/", "add", "2024-08-01 00:00:00"),
    ("trusted", "allow", "www.cheap-pills.example.com", "add", "2024-09-15 00:00:00"),
    ("trusted", "allow", "www.cheap-pills.example.com", "remove", "2024-11-15 00:00:00"),
]
_HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def fetch_time(page_id: Column) -> Column:
    """pages has no fetch time; this one is made from page_id: a moment of 2024, in UTC."""
    seconds = F.pmod(page_id * 7919, F.lit(366)) * 86400 + F.pmod(page_id * 104729, F.lit(86400))
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def entries(spark: SparkSession, rows: list | None = None) -> DataFrame:
    made = spark.createDataFrame(ENTRIES if rows is None else rows, "list string, kind string, pattern string, action string, at string")
    return made.withColumn("at", F.to_timestamp("at"))


def intervals(lists: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): when each pattern was on its list; until is null for one still there.

    Of entries of one moment, a removal counts. Adding what is there, or removing what is not, changes
    nothing. Entries with a null list, pattern, action or time are not used.
    """
    used = lists.filter("list is not null and pattern is not null and at is not null and action in ('add', 'remove')").withColumn("pattern", F.lower("pattern")).distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    return used.withColumn("until", F.lead("at").over(order)).filter("action = 'add' and (until is null or until > at)").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def lookup_keys(url: Column) -> Column:
    """All patterns that would cover a URL: its host's suffixes, alone and with each directory of its path."""
    labels = F.split(F.regexp_extract(F.lower(url), _HOST, 1), "\\.")
    steps = F.split(F.regexp_extract(url, _PATH, 1), "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.lower(F.concat(h, p)))))


def judge(captures: DataFrame, lists: DataFrame) -> DataFrame:
    """(page_id, url, fetched, list, pattern, blocked) for every row of captures (page_id, url, fetched).

    The longest active pattern decides; of equal ones a block wins over an allowance, then the first list
    by name. blocked is false, and list and pattern are null, where no entry was active: also for a null
    or unreadable URL and a null fetch time. A row that occurs several times gets as many rows. Paths
    are compared in lower case. Empty captures give no rows; an empty list blocks nothing.
    """
    row = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("times"))
    keyed = row.withColumn("key", F.explode_outer(F.array_distinct(lookup_keys(F.col("url")))))
    active = intervals(lists)
    met = keyed.join(active, (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))), "left")
    rank = F.struct((-F.length("pattern")).alias("a"), F.when(F.col("kind") == "block", 0).otherwise(1).alias("b"), F.col("list").alias("list"), F.col("pattern").alias("pattern"))
    best = met.groupBy("page_id", "url", "fetched", "times").agg(F.min(F.when(F.col("pattern").isNotNull(), rank)).alias("best"))
    out = best.select("page_id", "url", "fetched", F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"), F.coalesce(F.col("best.b") == 0, F.lit(False)).alias("blocked"), "times")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url", fetch_time(F.col("page_id")).alias("fetched")), entries(spark)).withColumn("fetched", F.unix_micros("fetched"))


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
OP4_SQL = f"""
WITH entry(list, kind, pattern, action, moment) AS (VALUES {_VALUES}),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400) AS fetched,
         string_split(regexp_extract(lower(url), '{_HOST}', 1), '.') AS labels, string_split(regexp_extract(url, '{_PATH}', 1), '/') AS steps
  FROM pages),
hosts AS (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM captures),
keys AS (SELECT page_id, url, fetched, array_to_string(labels[i:], '.') AS host, steps, unnest(range(1, greatest(2, len(steps)))) AS j FROM hosts),
looked AS (SELECT page_id, url, fetched, lower(host || CASE WHEN j = 1 THEN '' ELSE array_to_string(steps[1:j], '/') || '/' END) AS key FROM keys),
latest AS (  -- the last word of each list on each pattern before the fetch
  SELECT l.page_id, l.url, l.fetched, e.list, e.kind, e.pattern, arg_max(e.action, (e.moment, e.action)) AS action
  FROM looked l JOIN entry e ON l.key = e.pattern AND e.moment <= l.fetched GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, CASE WHEN kind = 'block' THEN 0 ELSE 1 END, list) AS r
  FROM latest WHERE action = 'add')
SELECT c.page_id, c.url, epoch_us(c.fetched) AS fetched, r.list, r.pattern, coalesce(r.kind = 'block', false) AS blocked
FROM captures c LEFT JOIN ranked r ON c.page_id = r.page_id AND c.url = r.url AND r.r = 1
"""
