"""Quality figures as tables: histograms, rates, bands, roll-ups and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T


def source_report(boe: DataFrame) -> DataFrame:
    """raw_field_count, n_rows, repaired, replaced (with U+FFFD): how the lines of the gazette were loaded, by number of raw fields."""
    marked = F.contains(F.concat_ws(" ", *[c for c, t in boe.dtypes if t == "string"]), F.lit("�"))
    return boe.groupBy("raw_field_count").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("repaired_columns").alias("repaired"), F.count_if(marked).alias("replaced"))


def parse_rate(lines: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: lines, rejected lines, share that was parsed; null for no lines."""
    a, b = lines.agg(F.count(F.lit(1)).alias("n_lines")), rejected.agg(F.count(F.lit(1)).alias("n_rejected"))
    return a.crossJoin(b).select("n_lines", "n_rejected", F.bround(F.try_divide(F.col("n_lines") - F.col("n_rejected"), F.col("n_lines")), 6).alias("parsed"))


def sources_of(df: DataFrame, by: str, source: str = "source") -> DataFrame:
    """by, sources: the distinct sources of each group in order, lower case; blank ones don't count."""
    s = F.lower(F.trim(source))
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.when(s != "", s))), ",").alias("sources"))


def bands(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """band, n: rows below the first bound (0), from it on (1) and so on; nulls in band null."""
    v = F.col(value)
    band = F.when(v.isNotNull(), sum(((v >= b).cast("int") for b in bounds), F.lit(0)))
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def range_validity(df: DataFrame, value: str, least: float, most: float) -> DataFrame:
    """One row: rows, values in and out of the range, missing ones, share of the values that is inside."""
    v = F.col(value)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(v.between(least, most)).alias("inside"), F.count_if(~v.between(least, most)).alias("outside"), F.count_if(v.isNull()).alias("missing"))
    return one.withColumn("ratio", F.bround(F.try_divide("inside", F.col("inside") + F.col("outside")), 6))


def monotone(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, rises: mean of the value per group in order of it, and whether it is at least that of the group before (true for the first)."""
    means = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.bround(F.avg(value), 4).alias("mean"))
    return means.withColumn("rises", F.coalesce(F.col("mean") >= F.lag("mean").over(Window.orderBy(by)), F.lit(True)))  # one row a group


#: Order of the states in a roll-up, worst first.
STATES = ("fail", "warning", "pass", "n/a")


def rolled_up(checks: DataFrame, by: str) -> DataFrame:
    """by, state, n_checks: the worst state of each group; unknown states count as failed."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")).cast("int"), F.lit(0))
    worst = F.min(F.when(rank == 0, 1).otherwise(rank))
    return checks.groupBy(by).agg(F.element_at(F.array(*[F.lit(s) for s in STATES]), worst).alias("state"), F.count(F.lit(1)).alias("n_checks"))


def compared_loads(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys in both, unchanged ones and their share, mean difference and mean absolute difference (null-safe: null equals null)."""
    both = before.select(key, F.col(value).alias("x")).join(now.select(key, F.col(value).alias("y")), key)
    d = F.col("y") - F.col("x")
    one = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("unchanged"), F.bround(F.avg(d), 4).alias("mean_change"), F.bround(F.avg(F.abs(d)), 4).alias("mean_abs_change"))
    return one.withColumn("unchanged_ratio", F.bround(F.try_divide("unchanged", "n"), 6))


def category_frequency(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """value, n, ratio for every known value, zero where it doesn't occur; the ratio is of all rows."""
    total = df.count()
    base = df.sparkSession.createDataFrame([(k,) for k in known], "value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.bround(F.try_divide(F.coalesce("n", F.lit(0)), F.lit(total)), 6).alias("ratio"))


def spread(df: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, min, q1, median, q3, max, mean, std of a value per group (quartiles linear between ranks, std of the population).

    Values are counted per group first; the ranks of the quartiles are found among the counted values by prefix
    sums over a logarithmic histogram, so a group's values are never ordered as a whole in one task. NaN and null don't count; null groups do (a struct keeps them).
    """
    v = F.col("v")
    bucket = F.when(v == 0, 0).when(v > 0, 100_000 + F.floor(F.log2(v) * 64)).otherwise(-100_000 - F.floor(F.log2(-v) * 64)).cast("int")
    counts = df.select(F.struct(by).alias("g"), F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("b", bucket)
    buckets = counts.groupBy("g", "b").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g").orderBy("b")
    buckets = buckets.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), (F.col("total") - 1).cast("double").alias("t")) for i in (1, 2, 3)])
    asked = buckets.select("g", "b", "total", "upto", "n", F.explode(ranks).alias("r")).select("g", "b", "upto", "n", F.col("r.q").alias("q"), (F.col("r.t") * F.col("r.q") / 4).alias("pos"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank")).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    inside = counts.join(asked.select("g", "b", (F.col("upto") - F.col("n")).alias("before")).distinct(), ["g", "b"])
    inside = inside.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("g", "b").orderBy("v")))
    at = asked.drop("n", "upto").join(inside.select("g", "b", "v", "end", (F.col("end") - F.col("n")).alias("begin")), ["g", "b"]).where("rank >= begin and rank < end")
    lo, hi, f = F.min("v"), F.max("v"), F.max(F.col("pos") - F.floor("pos"))
    quartile = at.groupBy("g", "q").agg((lo + (hi - lo) * f).alias("x")).groupBy("g").agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(c) for i, c in ((1, "q1"), (2, "median"), (3, "q3"))])
    rest = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.struct(by).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return rest.join(quartile, "g").select(F.col(f"g.{by}").alias(by), "n", "min", "q1", "median", "q3", "max", "mean", "std")


def health(present: dict[str, bool], blocking: set[str]) -> list[tuple[str, str]]:
    """(input, state) of every input: ok, missing (may be done without) or blocked."""
    return [(k, "ok" if v else "blocked" if k in blocking else "missing") for k, v in sorted(present.items())]


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text with its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def used_fields(c: Column) -> Column:
    """Entries of a map of texts whose value isn't blank, in order of their keys, as JSON."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(c, lambda _, v: ~T.blank(v))))))
