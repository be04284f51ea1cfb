"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source; targets share ``SHARE`` times all words by weight, stop at ``MOST`` times
their source and pass the excess on by weight (water filling in closed form: sources ordered by their
cap per weight, with running sums). A document is emitted floor(rate) times, rate being target over
source size, and once more with the probability of the fraction. That draw is a hash-seeded Bernoulli
trial of each document; the trials of about ``GROUP`` documents of one source share one seed and go
by size, so that every fraction-th of them is taken: each keeps its probability, while the words taken
stay near the target however uneven the sizes are. A hot source falls into as many groups as it needs.

Null or wordless texts have size 0. Null sources form one source, sorted last. Rows of one id and text are
ordered by their other columns; rows equal in all columns count one by one. If all sizes are 0 all targets are 0. Extra columns are kept. An
empty table gives an empty result. The result doesn't depend on the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of a source that share a seed, on average.
GROUP = 1000

_UNIT = float(1 << 60)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash60(*parts: Column | str) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def _dealt(rows: DataFrame, order: list[Column], scratch: Scratch, label: str) -> DataFrame:
    """``rows`` dealt over parts by ranges of ``order``, written with the number of their part, so that parts stay what they are."""
    return scratch.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """For each part the sums over the parts before it. There are no more parts than shuffle partitions."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("part").agg(*(c.alias(n) for n, c in sums.items())).select("part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows of ``source, size``.

    Sources are numbered and their caps summed in ranges: sums within a part, and sums of the parts before it.
    """
    with Scratch(sizes.sparkSession) as scratch:
        per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        by_name = [F.col("source").asc_nulls_last()]
        named = _dealt(per, by_name, scratch, "sources")
        place = F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*by_name)) - 1
        per = named.join(F.broadcast(_before(named, rows_before=F.count("*"))), "part").withColumn("place", place).drop("part", "rows_before")
        per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
        by_cap = [(F.col("cap") / F.col("weight")).asc(), F.col("place").asc()]
        caps = _dealt(per, by_cap, scratch, "caps")
        whole = caps.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
        inside = Window.partitionBy("part").orderBy(*by_cap)
        running = lambda c: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = caps.join(F.broadcast(_before(caps, caps_before=F.sum("cap"), weights_before=F.sum("weight"))), "part")
        level = (F.lit(share * float(whole.words or 0)) - (F.col("caps_before") + running("cap"))) / (F.lit(whole.weights or 0) - (F.col("weights_before") + running("weight")))
        rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(inside)).where(F.col("cap") / F.col("weight") > F.col("level"))
        found = rows.agg(F.min_by("level", F.struct("part", "at"))).first()[0]
        full = F.col("cap").cast("double")
        target = full if found is None else F.least(full, F.col("weight") * F.lit(found))
        return written(caps.select("source", "n_docs", "source_size", target.alias("target")), "targets")


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, how often the mix emits the row."""
    names = [n for n in docs.columns if n not in ("size", "source_size", "target", "copies")]
    docs = docs.select(*names)
    targets = source_targets(docs.select("source", word_count().alias("size"))).withColumnsRenamed({"source": "mix_source", "n_docs": "mix_docs"})
    rows = docs.withColumn("size", word_count()).withColumn("mix_hash", _hash60("mix", F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("mix_rate", rate).withColumn("mix_group", F.col("mix_hash") % F.ceil(F.col("mix_docs") / GROUP))
    start = _hash60("start", F.col("source"), F.col("mix_group")).cast("double") / _UNIT
    rest = [F.col(n) for n in sorted(names) if n not in ("doc_id", "text", "source") and "map" not in docs.schema[n].dataType.simpleString() and "variant" not in docs.schema[n].dataType.simpleString()]
    place = F.row_number().over(Window.partitionBy("source", "mix_group").orderBy(F.col("size").desc(), F.col("mix_hash"), F.xxhash64(F.lit("rest"), *rest)))
    rows = rows.withColumn("mix_place", place).withColumn("mix_start", start).withColumn("mix_part", F.col("mix_rate") - F.floor("mix_rate"))
    once_more = F.floor(F.col("mix_place") * F.col("mix_part") + F.col("mix_start")) - F.floor((F.col("mix_place") - 1) * F.col("mix_part") + F.col("mix_start"))
    return rows.withColumn("copies", (F.floor("mix_rate") + once_more).cast("bigint")).select(*names, "size", "source_size", "target", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is emitted."""
    rows = with_copies(docs).where("copies > 0")
    return rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) as bigint) as size,
         cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
per as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from (
    select source, count(*) as n_docs, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source)),
levels as (
  select *, cap / weight as ratio, row_number() over (order by cap / weight, place) as pos,
         (1.5::double * cast(sum(source_size) over () as bigint) - cast(coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as bigint))
         / cast(sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as bigint) as level
  from per),
found as (select min_by(level, pos) as level from levels where ratio > level),
targets as (
  select l.source, n_docs, source_size, case when f.level is null then cap::double else least(cap::double, weight * f.level) end as target from levels l cross join found f),
rated as (
  select d.doc_id, d.source, d.size, d.h, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
         d.h % cast(ceil(t.n_docs / 1000.0::double) as bigint) as grp
  from sized d join targets t on d.source is not distinct from t.source),
placed as (
  select *, row_number() over (partition by source, grp order by size desc, h) as place, rate - floor(rate) as part,
         cast(cast('0x' || substr(md5('start|' || coalesce(source, '') || '|' || cast(grp as varchar)), 1, 15) as bigint) as double) / 1152921504606846976::double as start
  from rated)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + floor(place * part + start) - floor((place - 1) * part + start)) as bigint) as taken
from placed
"""
