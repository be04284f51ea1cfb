"""URL filters as a temporal list join, in DataFrame operations only.

A list has dated entries: from ``at`` on, ``action`` 'add' puts a pattern on the list and 'remove' takes
it off. Entries become validity intervals [from, until). A pattern is a host, which covers its
subdomains, or a host with the beginning of a path, by whole segments. Every capture is evaluated
against the entries active when it was fetched: its host's suffixes and its path's prefixes are
equi-joined with the patterns, then the interval decides. The longest active pattern wins; of equal
patterns 'allow' wins over 'block'.

Decisions are made once for each distinct URL and fetch time and joined back. The list's intervals are
counted: up to ``BROADCAST`` of them go to every task; a longer list is joined by pattern and salt, so
that a pattern which nearly all captures share (a listed top-level domain, a hot host) meets them in
``SALTS`` tasks and more. A null URL or fetch time and a URL without a host match nothing and are
kept. Entries with a null pattern, time or action are ignored; of entries of one pattern, kind and time
'remove' wins. Repeated entries count once. Extra columns of captures are kept. Empty tables: no
entries block nothing; no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Intervals, at most, that are sent to every task, some 100 bytes each; parts of a pattern's captures beyond that.
BROADCAST, SALTS = 200_000, 64


def list_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, kind, category, valid_from, valid_until`` (null: still valid) from dated entries."""
    known = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    known = known.select(F.lower("pattern").alias("pattern"), "kind", "category", "at", "action")
    known = known.groupBy("pattern", "kind", "at").agg(F.max("action").alias("action"), F.max("category").alias("category"))
    order = Window.partitionBy("pattern", "kind").orderBy("at")
    turns = known.withColumn("last", F.lag("action").over(order)).where("last is null or last <> action")
    spans = turns.withColumn("valid_until", F.lead("at").over(order)).where("action = 'add'")
    return spans.select("pattern", "kind", "category", F.col("at").alias("valid_from"), "valid_until")


def url_host(url: str = "url"):
    return F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def url_patterns(url: str = "url"):
    """All patterns that would cover a URL: each suffix of its host, and its host with each prefix of its path."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.concat(suffixes, F.coalesce(prefixes, F.expr("cast(array() as array<string>)")))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at) with ``host``, ``blocked``, and the deciding ``rule`` and ``category``."""
    names = [n for n in captures.columns if n not in ("host", "blocked", "rule", "category")]
    captures = captures.select(*names).withColumn("host", url_host())
    asked = captures.where("host is not null and fetched_at is not null").select("url", "fetched_at", "host").distinct()
    keys = asked.select("url", "fetched_at", F.explode(F.array_distinct(url_patterns())).alias("pattern"))
    spans = list_intervals(entries)
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col("fetched_at") < F.col("valid_until")))
    if spans.count() <= BROADCAST:
        met = keys.join(F.broadcast(spans), "pattern").where(active)
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keys.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"]).where(active)
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"), F.col("pattern"), F.col("category"))).alias("best")
    decided = met.groupBy(F.col("url").alias("d_url"), F.col("fetched_at").alias("d_at")).agg(best)
    out = captures.join(decided, (F.col("url") == F.col("d_url")) & (F.col("fetched_at") == F.col("d_at")), "left")
    return out.select(*names, "host", F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"), F.col("best.pattern").alias("rule"), F.col("best.category").alias("category"))


def dated_list(pages: DataFrame) -> DataFrame:
    """The list that the query uses: two fixed hosts, an allowed path of one, and a hashed third of the hosts of ``pages``.

    A host's digest gives the day it was added and whether and when it was removed.
    """
    spark = pages.sparkSession
    fixed = spark.sql(
        """select * from values
        ('spam-farm.example.org', 'block', 'spam', date'2023-06-01', 'add'),
        ('cheap-pills.example.com', 'block', 'pharma', date'2024-03-01', 'add'),
        ('cheap-pills.example.com', 'block', 'pharma', date'2024-09-01', 'remove'),
        ('spam-farm.example.org/en', 'allow', 'reviewed', date'2024-07-01', 'add')
        as t(pattern, kind, category, at, action)"""
    )
    digest = lambda i: F.conv(F.substring(F.md5("pattern"), i, 2), 16, 10).cast("int")
    hosts = pages.select(url_host().alias("pattern")).where("pattern is not null").distinct().where(digest(1) < 86)
    added = hosts.withColumn("on", F.date_add(F.to_date(F.lit("2024-01-01")), digest(3)))
    make = lambda at, action: added.where(digest(5) < (256 if action == "add" else 128)).select("pattern", F.lit("block").alias("kind"), F.lit("hashed").alias("category"), at.alias("at"), F.lit(action).alias("action"))
    return fixed.unionByName(make(F.col("on"), "add")).unionByName(make(F.date_add("on", 1 + digest(7)), "remove"))


ORACLE_SQL = r"""
with hosts as (select page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host,
                      cast(date '2024-01-01' + cast(page_id % 366 as integer) as date) as fetched_at from pages),
listed as (select h, date '2024-01-01' + cast('0x' || substr(md5(h), 3, 2) as integer) as a from (select distinct host as h from hosts where host is not null)
           where cast('0x' || substr(md5(h), 1, 2) as integer) < 86),
spans(pattern, kind, category, f, u) as (
  select 'spam-farm.example.org', 'block', 'spam', date '2023-06-01', null where 'spam-farm.example.org' is not null
  union all select 'cheap-pills.example.com', 'block', 'pharma', date '2024-03-01', date '2024-09-01'
  union all select 'spam-farm.example.org/en', 'allow', 'reviewed', date '2024-07-01', null
  union all select h, 'block', 'hashed', a, case when cast('0x' || substr(md5(h), 5, 2) as integer) < 128 then a + 1 + cast('0x' || substr(md5(h), 7, 2) as integer) end from listed),
met as (
  select p.page_id, s.pattern, s.kind, s.category, row_number() over (partition by p.page_id order by length(s.pattern) desc, s.kind, s.category desc) as k
  from hosts p join spans s on (p.host = s.pattern or ends_with(p.host, '.' || s.pattern)
       or (contains(s.pattern, '/') and starts_with(regexp_replace(regexp_extract(lower(p.url), '^[a-z]+://([^?#]*)', 1), '/*$', '') || '/', s.pattern || '/')))
  where p.fetched_at >= s.f and (s.u is null or p.fetched_at < s.u))
select p.page_id, p.url, p.host, p.fetched_at, coalesce(m.kind = 'block', false) as blocked, m.pattern as rule, m.category
from hosts p left join met m on p.page_id = m.page_id and m.k = 1
"""
