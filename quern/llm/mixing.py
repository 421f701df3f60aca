"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target of words. Its documents first get the whole copies that the
target certainly allows; what is left makes their inclusion odds f / (1 - f), which
differ by source. One Pareto order sample of fixed size is then drawn from all
documents: each is ranked by its random odds u / (1 - u) over its inclusion odds, and
the lowest ranks are taken until their words are nearest to what all sources lack.

The random numbers are collocated: a hash deals the documents of a source on 4,096
ranges, and u is the share of the source's words that lie before the document's place
on them. So the words of a source with u below f are f of its words but for about a
document, and each source comes near its own target although one cut serves all. The
cut is found by refining a histogram of the ranks; no rows are sorted in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; the hash is of doc_id and text, and rows that share both are told apart by their
place in the table; a source without words has target 0; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bits52, stage, words

LIMIT = 3
LEVEL_BITS = 13
LEVELS = 4
RANGE_BITS = 12  # of the hash: ranges of a source on which its words are collocated


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df with ``place``, 1 for the first row in the order of column by (nulls last).

    Ranges are numbered in parallel; only one count a range meets in a single task.
    """
    parts = stage(df.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    order = Window.partitionBy("_part").orderBy(F.col(by).asc_nulls_last())
    return parts.join(before, "_part").withColumn("place", F.row_number().over(order) + F.col("_before")).drop("_part", "_before")


def source_targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From (source, source_size): weight and target, shared by weight with each target at most limit times its size."""
    table = stage(ranked(sizes, "source").select("source", "source_size", (1 + (F.col("place") - 1) % 3).alias("weight")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wide = lambda c: c.cast("decimal(38,0)")
    rest, free, capped = total, None, -1
    while True:
        over = F.lit(False) if free is None else wide(limit * F.col("source_size")) * F.lit(free) < F.lit(rest) * wide(F.col("weight"))
        row = table.agg(
            F.coalesce(F.sum(F.when(over, limit * F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        rest, free, capped = total - row["held"], row["free"], row["capped"]
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(free or 1))
    return table.withColumn("target", F.least((limit * F.col("source_size")).cast("double"), share))


def _level(key: Column, level: int) -> Column:
    return F.shiftright(key, LEVEL_BITS * (LEVELS - level))


def cut_of(ranked: DataFrame, wanted: float) -> int:
    """The largest key to take, so that the words of ranked (key, size) up to it are nearest to wanted.

    Each level splits the one range that the cut falls into in 2**13 parts and sums the
    words of each exactly; at most that many sums reach the driver.
    """
    prefix, before, held = 0, 0, 0
    for level in range(1, LEVELS + 1):
        inside = ranked.where(_level(F.col("key"), level - 1) == F.lit(prefix))
        parts = inside.groupBy(_level(F.col("key"), level).alias("part")).agg(F.sum("size").alias("held")).orderBy("part").collect()
        if not parts:
            return -1
        # the last part that starts at or below the wanted words holds the cut
        upto = before
        for r in parts:
            if upto > wanted:
                break
            before, prefix, held = upto, r["part"], r["held"]
            upto += held
    return prefix if before + held - wanted < wanted - before else prefix - 1


def collocated(h: Column, before: Column, held: Column, total: Column) -> Column:
    """The share of a source's words before a hash: those of earlier ranges, and of its own range the hash's share."""
    inside = (h.bitwiseAND(F.lit((1 << (52 - RANGE_BITS)) - 1)).cast("double") + 0.5) / F.lit(float(1 << (52 - RANGE_BITS)))
    return (before.cast("double") + held.cast("double") * inside) / F.nullif(total.cast("double"), F.lit(0.0))


def mix(docs: DataFrame, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """For each row of docs: ``row`` (all its columns), size, source_size, target, copies, and taken, the words the mix takes."""
    source_id = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    parts = [F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source"),
        source_id.alias("source_id"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        bits52(*parts).alias("h"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = stage(sized.drop("row"), "mix-rows")
    repeated = stage(rows.groupBy("h").count().where("count > 1").select(F.col("h").alias("h"), F.lit(True).alias("again")), "mix-repeated")

    def told_apart(df: DataFrame) -> DataFrame:
        own = F.when(F.col("again"), bits52(F.col("h"), F.col("nth"))).otherwise(F.col("h"))
        return df.join(repeated, "h", "left").withColumn("h", own).drop("again", "nth")

    rows = told_apart(rows)
    ranges = stage(rows.groupBy("source", "source_id", F.shiftright("h", 52 - RANGE_BITS).alias("range")).agg(F.sum("size").alias("held")), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("held").alias("source_size"))
    per_word = F.nullif(F.col("source_size"), F.lit(0))
    plan = source_targets(sources, limit).withColumn("whole", F.coalesce(F.floor(F.col("target") / per_word), F.lit(0)).cast("long"))
    plan = plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("f", F.coalesce(F.col("extra") / per_word, F.lit(0.0)))
    plan = stage(plan.withColumn("source_id", source_id).drop("source"), "mix-plan")
    # at most 4,096 ranges a source
    order = Window.partitionBy("source_id").orderBy("range")
    placed = ranges.select("source_id", "range", "held", (F.sum("held").over(order) - F.col("held")).alias("before"))
    placed = stage(placed.join(plan, "source_id").select("source_id", "range", "held", "before", "source_size", "target", "whole", "f"), "mix-places")

    def ranked_rows(df: DataFrame) -> DataFrame:
        at = df.withColumn("range", F.shiftright("h", 52 - RANGE_BITS)).join(placed, ["source_id", "range"])
        return at.withColumn("key", rank_key(collocated(F.col("h"), F.col("before"), F.col("held"), F.col("source_size")), F.col("f")))

    wanted = plan.agg(F.sum(F.col("extra").cast("decimal(38,6)"))).first()[0]
    ranks = stage(ranked_rows(rows).where("key is not null").select("source_id", "h", "key", "size"), "mix-ranks")
    cut = cut_of(ranks, float(wanted or 0))
    # within a source the rank grows with the hash, so the one cut is a largest hash for each source
    last = ranks.where(F.col("key") <= F.lit(cut)).groupBy("source_id").agg(F.max("h").alias("last"))
    full = stage(plan.join(last, "source_id", "left").select("source_id", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last")), "mix-cuts")
    joined = told_apart(sized.drop("source")).join(full, "source_id").withColumn("copies", F.col("whole") + (F.col("h") <= F.col("last")).cast("int"))
    return joined.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def rank_key(u: Column, f: Column) -> Column:
    """The Pareto rank q = odds of u over odds of f, as 52 bits of q / (1 + q), which keeps its order; null without a chance."""
    one = F.lit(1.0)
    q = (u / F.nullif(one - u, F.lit(0.0))) / (F.nullif(f, F.lit(0.0)) / F.nullif(one - f, F.lit(0.0)))
    return F.least(F.floor(q / (one + q) * F.lit(float(1 << 52))), F.lit((1 << 52) - 1)).cast("long")


def apply_mix(docs: DataFrame, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as the mix takes it."""
    taken = mix(docs, limit, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
    ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '~') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
fill as (select 0 as it, sum(source_size)::hugeint as rest, sum(weight)::hugeint as free from s
  union all select it + 1, (select sum(source_size) from s) - coalesce(sum(3 * source_size) filter (3 * source_size * free < rest * weight), 0), sum(weight) filter (not 3 * source_size * free < rest * weight)
  from fill, s where it < 40 group by it, rest, free),
t as (select s.*, least((3 * source_size)::double, rest::double * weight / free::double) as target from s, fill where it = 40),
p as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from t),
f as (select *, target - whole * source_size as extra, coalesce((target - whole * source_size) / nullif(source_size, 0), 0) as f from p),
g as (select source, h >> 40 as range, sum(size)::bigint as held from d group by all),
b as (select *, (sum(held) over (partition by source order by range) - held)::bigint as before from g),
k as (select r, doc_id, d.size, f.*, (b.before::double + b.held::double * (((h & 1099511627775)::double + 0.5) / 1099511627776.0)) / nullif(source_size::double, 0) as u
  from d join f on d.source is not distinct from f.source join b on d.source is not distinct from b.source and h >> 40 = b.range),
o as (select *, (u / nullif(1.0::double - u, 0)) / (nullif(f, 0) / nullif(1.0::double - f, 0)) as q from k),
x as (select *, least(floor(q / (1.0::double + q) * 4503599627370496.0::double), 4503599627370495)::bigint as key from o),
c as (select key, sum(held) over (order by key) - held as before, held from (select key, sum(size) as held from x where key is not null group by key)),
w as (select sum(extra::decimal(38,6))::double as wanted from f),
n as (select x.*, c.before, c.held, wanted from x left join c using (key), w)
select doc_id, size, source_size, target, (size * (whole + case when key is not null and (before + held <= wanted or (before <= wanted and before + held - wanted < wanted - before)) then 1 else 0 end))::bigint as taken from n"""
