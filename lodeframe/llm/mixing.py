"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source is expected target / source_size times. Documents of a
source stand in one order; the running sum of their expected copies, moved by one
random offset of the source, crosses integers, and a document is emitted once for
each integer it crosses. So it gets floor or ceil of its expectation, and the error
of a source's words stays below the size of its largest document: the order is by
falling size, in steps of about 3 %, and by a hash of the id within a step.

The running sum takes three levels, so that no source meets in one task: over the size
steps of a source (some hundred rows), over the 256 parts of a step (by two hex digits of the
md5 of the id, or of the text where the id is null), and over the rows of a part. The first two are over counts. Shares are computed
over one row a source.

Defined cases: a null or empty text has size 0; a text of any length is one document; a null source is a source of its own, last in
order; null ids and repeated rows are rows like any other; rows that tie in all
columns are interchangeable; an empty table gives an empty mix; a source without
words has target 0 and none of its rows is taken; further columns, whatever their names, stay out of the plan and in the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.tables import fits, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"


def size_step(size: Column) -> Column:
    """Bit length and next four bits: grows with size, about 3 to 6 % a step."""
    bits = F.length(F.bin(size))
    return (bits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))")).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source_key, source, source_size -> also target: shares by weight, none above most * source_size.

    With sources in order of cap / weight, level i is what a unit of weight gets if the
    sources before i stand at their caps; the highest level is the one where no source
    is above its cap. One row a source, so the plain window is over a small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = per_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - most * before) / left)
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("source_key", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def unit(key: Column) -> Column:
    """[0, 1) from 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken, and columns to carry; one row a document."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))  # null ids are many, so their texts part them
    part = F.substring(F.md5(name.cast("binary")), 1, 2).alias("part")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), part, *carry)
    rows = written(sized, "mix-sizes", keep=True)  # the texts are read once; what follows reads these narrow rows
    rows = rows.withColumns({"source_key": key, "step": size_step(F.col("size"))})
    cell = ["source_key", "step", "part"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    so_far = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("step"), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy("source_key", "step").agg(F.sum("n").alias("n")).withColumn("part", F.lit(""))
    steps = steps.select("source_key", "step", so_far("source_key").alias("step_start"))
    starts = counts.select(*cell, so_far("source_key", "step").alias("part_start")).join(steps, ["source_key", "step"])
    starts = starts.select(*cell, (F.col("step_start") + F.col("part_start")).alias("start"))
    share_of = targets(rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share, most)
    starts = starts.join(share_of, "source_key").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", unit(F.concat(F.lit(seed), F.col("source_key")).cast("binary")))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "size"))
    at = F.col("start") + F.col("rank")
    crossed = F.floor(F.col("offset") + F.col("rate") * at) - F.floor(F.col("offset") + F.col("rate") * (at - 1))
    copies = F.least(crossed, F.ceil(F.col("rate")))
    return (
        rows.withColumn("rank", rank)
        .join(starts, cell)
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: docs' rows and columns, each as often as the plan says.

    Rows meet their plan by two hashes of all their columns. Rows that are alike in all columns are one row with all of their copies;
    only such rows are brought together. Columns may be of any type but maps.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    d = docs.toDF(*plain)
    d = d.withColumns({"k1": F.xxhash64(*plain), "k2": F.xxhash64(F.lit(1), *plain)})
    asked = d.select(*(F.col(plain[names.index(c)]).alias(c) for c in ("doc_id", "text", "source")), "k1", "k2")
    keys = ["k1", "k2"]
    p = plan(asked, carry=("k1", "k2"), **options).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    p = written(p.filter("copies > 0"), "mix-copies", keep=True)
    single, several = p.filter("rows = 1").drop("rows"), p.filter("rows > 1").drop("rows")
    if not fits(p):
        single = single.hint("shuffle_hash")
    alike = d.join(several.select(*keys), keys, "left_semi").dropDuplicates(keys).join(several, keys)
    rows = d.join(single, keys).select(*plain, "copies").union(alike.select(*plain, "copies"))
    at_once = 4096  # of a row's copies, however many
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / at_once))))
    rows = rows.withColumn("nr", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(at_once), F.col("copies") - at_once * F.col("block")))))
    return rows.select(*plain).toDF(*names)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 2) AS part
  FROM documents),
stepped AS (
  SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS step FROM sized),
per_source AS (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM stepped GROUP BY source_key),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS cap FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - 2.0::DOUBLE * coalesce(sum(source_size) OVER
            (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
shares AS (
  SELECT source_key, source_size, least(weight * max(level) OVER (), cap) AS target,
         ('0x' || substr(md5('mix-1' || source_key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS off FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY step DESC, part, doc_id NULLS FIRST, size) AS nth FROM stepped),
rated AS (
  SELECT r.*, s.source_size, s.target, s.off, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked r JOIN shares s USING (source_key))
SELECT doc_id, size, source_size, target,
       (least(floor(off + rate * nth) - floor(off + rate * (nth - 1)), ceil(rate)))::BIGINT * size AS taken
FROM rated
"""
