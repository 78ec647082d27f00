"""Quality profile of the columns of a table, load by load.

Every distinct value of a column is reduced to a shape (character classes with run lengths). Expressions are
induced from the counted shapes by minimum description length: an expression is kept where the bits it saves
on its values outweigh the bits of writing it down. Rows that fit no kept (or no declared) expression are
counted, the coverage of each expression is compared between loads, and null shares, ranges, exact medians,
heaviest values and shares of categories come with them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.session import stage_table

MISSING = ("", "-", "n/d", "no disponible")
#: Shapes up to which all reach the driver; of more, those that no expression of their own pays for are added up by their open form.
SHAPE_BOUND = 10_000


def present(c: Column) -> Column:
    """Not null, blank or a stand-in word."""
    return c.isNotNull() & ~F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))).isin(*MISSING)


def shape(c: Column) -> Column:
    """Capital letters A, small letters a, digits 9, blanks and signs as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")


@dataclass(frozen=True)
class Expression:
    regex: str
    rows: int
    saved_bits: float


_SIZE = {"A": 26, "a": 26, "9": 10, "X": 36}


def _pieces(s: str) -> list[tuple[str, int]]:
    return [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", s, re.S)]


def _regex(pieces: tuple[tuple[str, int | str], ...]) -> str:
    names = {"A": "[A-Z]", "a": "[a-z]", "9": "[0-9]", "X": "[A-Z0-9]"}
    return "".join(names.get(c, re.escape(c)) + (n if isinstance(n, str) else f"{{{n}}}" if n > 1 else "") for c, n in pieces)


def _value_bits(s: str) -> float:
    return sum(math.log2(_SIZE.get(c, 1)) for c in s)


def _open(pieces: list[tuple[str, int]]) -> tuple:
    return tuple((c, "+" if c in _SIZE else n) for c, n in pieces)


def _twin(s: str) -> tuple[str, tuple] | None:
    """The shape with the other one of capital letter and digit at its end, and the pieces that fit both."""
    if s and s[-1] in "A9":
        return s[:-1] + ("9" if s[-1] == "A" else "A"), (*_pieces(s[:-1]), ("X", 1))
    return None


_TWIN_BITS = math.log2(36) - 0.5 * math.log2(260)


def _gain(s: str) -> float:
    """Bits that a value of the shape saves over 7 a character, before the share of its expression."""
    return 7 * len(s) - _value_bits(s)


def _most_bits(members: list[tuple[int, float]], extra: float, regex: str, total: int) -> float:
    """Bits that an expression for members (rows, gain of each) saves at most, whichever of them are left."""
    share = math.log2(sum(n for n, _ in members) / total)
    return sum(n * max(0.0, gain - extra + share) for n, gain in members) - 8 * len(regex)


def induce(shapes: dict[str, int], rest: list[tuple[str, tuple, int, float]] = (), total: int | None = None) -> list[Expression]:
    """Expressions for counted shapes by minimum description length.

    Candidates are each shape itself, shapes whose last class may be a letter or a digit where both occur, and
    shapes with open lengths. Greedily, the candidate that saves most is kept while it saves anything. Coding
    a value without an expression takes 7 bits a character. rest: further shapes that only an open form can
    be worth it for, added up by it: the first of them, the pieces of the form, rows, sum of gains. total: all rows.
    """
    total = total or sum(shapes.values())
    if not total:
        return []
    candidates: dict[str, tuple[float, set]] = {}
    left = {s: (n, n * _gain(s)) for s, n in shapes.items()}

    def offer(pieces: tuple, members: set, bits) -> None:
        regex = _regex(pieces)
        if regex not in candidates:
            candidates[regex] = (bits, set())
        candidates[regex][1].update(members)

    for s in shapes:
        p = _pieces(s)
        offer(tuple(p), {s}, 0.0)
        if (t := _twin(s)) and t[0] in shapes:
            offer(t[1], {s, t[0]}, _TWIN_BITS)
        offer(_open(p), {s}, 4.0 * len(p))
    for first, pieces, rows, gain in rest:
        left[(first,)] = (rows, gain)
        offer(pieces, {(first,)}, 4.0 * len(pieces))
    kept = []
    while left and candidates:
        best = None
        for regex, (extra, members) in candidates.items():
            of = [left[m] for m in members if m in left]
            rows = sum(n for n, _ in of)
            if not rows:
                continue
            saved = sum(gain for _, gain in of) + rows * (math.log2(rows / total) - extra) - 8 * len(regex)
            if best is None or saved > best[0]:
                best = (saved, regex, rows, members)
        if best is None or best[0] <= 0:
            break
        kept.append(Expression(best[1], best[2], best[0]))
        for m in best[3]:
            left.pop(m, None)
        del candidates[best[1]]
    return kept


def value_counts(df: DataFrame, load: str, column: Column) -> DataFrame:
    """load_id, v, n: counted distinct values of each load, partly counted before the shuffle."""
    return df.select(F.col(load).alias("load_id"), column.alias("v")).groupBy("load_id", "v").agg(F.count(F.lit(1)).alias("n"))


def column_expressions(counts: DataFrame, bound: int = SHAPE_BOUND) -> list[Expression]:
    """Expressions induced from all distinct values of counts(v, n), however many shapes they have."""
    shapes = counts.where(F.col("v").isNotNull()).groupBy(shape(F.col("v")).alias("s")).agg(F.sum("n").alias("n"))
    few = shapes.limit(bound + 1).collect()
    if len(few) <= bound:
        return induce({r["s"]: r["n"] for r in sorted(few, key=lambda r: (-r["n"], r["s"]))})
    return _induce_many(stage_table(shapes, "shapes"))


def _induce_many(shapes: DataFrame) -> list[Expression]:
    """induce() of any number of shapes(s, n), with the same expressions.

    A candidate whose members save nothing, whichever of them are left, is never kept. The driver gets the shapes
    whose own expression or that with their twin may be, one by one; the rest are added up by open form, and
    only the open forms that may be kept are sent.
    """
    total = shapes.agg(F.sum("n")).collect()[0][0]

    def forms(batches):
        for b in batches:
            out = []
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _pieces(s)
                t = _twin(s)
                alone = _most_bits([(n, _gain(s))], 0.0, _regex(tuple(p)), total) > 0
                out.append((s, n, _gain(s), alone, _regex(t[1]) if t else None, _regex(_open(p)), 4.0 * len(p)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    names, kinds = ["s", "n", "gain", "alone", "twin", "open", "extra"], [pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.float64()]
    each = stage_table(shapes.select("s", F.col("n").cast("bigint").alias("n")).mapInArrow(forms, "s string, n bigint, gain double, alone boolean, twin string, open string, extra double"), "forms")

    def worth(by: str, extra: Column) -> DataFrame:
        """The forms of column ``by`` that may save bits, and their members."""
        share = F.log2(F.col("rows") / F.lit(total))
        sums = each.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("members"))
        most = F.sum(F.col("n") * F.greatest(F.lit(0.0), F.col("gain") - extra + share)) - 8 * F.length(by)
        return each.join(sums, by).groupBy(by).agg(most.alias("most"), F.max("members").alias("members")).where(F.col("most") > -1e-6)

    twins = worth("twin", F.lit(_TWIN_BITS)).where("members = 2").select("twin", F.lit(True).alias("paired"))
    opens = worth("open", F.col("extra")).select("open", F.lit(True).alias("opened"))
    marked = each.join(twins, "twin", "left").join(opens, "open", "left").withColumn("own", F.col("alone") | F.col("paired").isNotNull())
    heads = {r["s"]: r["n"] for r in marked.where("own").select("s", "n").collect()}
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("s"))).alias("first")
    sums = marked.where("not own and opened").groupBy("open").agg(first, F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gain")).alias("gain")).collect()
    rest = [(r["first"]["s"], _open(_pieces(r["first"]["s"])), r["n"], r["gain"]) for r in sorted(sums, key=lambda r: r["first"])]
    return induce(dict(sorted(heads.items(), key=lambda x: (-x[1], x[0]))), rest, total)


NO_EXPRESSION = "none"


def first_expression(value: Column, expressions: list[str]) -> Column:
    """The first expression that the value fits, NO_EXPRESSION where it fits none."""
    case = F.lit(NO_EXPRESSION)
    for e in reversed(expressions):
        case = F.when(value.rlike(f"^(?:{e})$"), e).otherwise(case)
    return case


def expression_coverage(counts: DataFrame, expressions: list[str]) -> DataFrame:
    """load_id, expression, n_rows, share, other_share, change: the present values of each load that fit each expression
    (NO_EXPRESSION for those that fit none), their share of the load, that of the same expression in all other loads
    together (null where there is none) and the difference. Expressions that a load lacks have rows of 0.
    """
    by = counts.where(F.col("v").isNotNull()).groupBy("load_id", first_expression(F.col("v"), expressions).alias("expression")).agg(F.sum("n").alias("n_rows"))
    loads = counts.where(F.col("v").isNotNull()).groupBy("load_id").agg(F.sum("n").alias("total"))  # one row a load
    kinds = F.array(*[F.lit(e) for e in dict.fromkeys([*expressions, NO_EXPRESSION])])
    every = loads.select("load_id", "total", F.explode(kinds).alias("expression"))
    same = every["load_id"].eqNullSafe(by["load_id"]) & (every["expression"] == by["expression"])
    rows = every.join(by, same, "left").select(every["load_id"], every["expression"], "total", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    w = Window.partitionBy("expression")
    here, there = F.col("n_rows") / F.col("total"), F.try_divide(F.sum("n_rows").over(w) - F.col("n_rows"), F.sum("total").over(w) - F.col("total"))
    return rows.select("load_id", "expression", "n_rows", here.alias("share"), there.alias("other_share"), (here - there).alias("change"))


def load_coverage(df: DataFrame, load: str, columns: list[str], bound: int = SHAPE_BOUND) -> DataFrame:
    """column_name and expression_coverage of every column: how well each load keeps to the expressions induced from the other loads and itself."""
    out = None
    for c in columns:
        text = F.col(c).cast("string")
        counts = value_counts(df, load, F.when(present(text), text))
        part = expression_coverage(counts, [e.regex for e in column_expressions(counts, bound)]).select(F.lit(c).alias("column_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median per group: a logarithmic histogram finds the buckets of the middle ranks, whose distinct values alone are then ranked."""
    v = F.col("v")
    b = F.when(v == 0, 0).when(v > 0, 100_000 + F.floor(F.log2(v) * 64)).otherwise(-100_000 - F.floor(F.log2(-v) * 64))
    counts = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("b", b.cast("int"))
    buckets = counts.groupBy("g", "b").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g").orderBy("b")
    buckets = buckets.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = buckets.where((F.col("upto") > lo) & (F.col("upto") - F.col("n") <= hi)).select("g", "b", (F.col("upto") - F.col("n")).alias("before"), "total")
    inside = counts.join(middle, ["g", "b"]).withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("g", "b").orderBy("v")))
    at = inside.where((F.col("end") > lo) & (F.col("end") - F.col("n") <= hi))
    return at.groupBy("g").agg(((F.min("v") + F.max("v")) / 2).alias("median")).withColumnRenamed("g", group)


def load_profile(df: DataFrame, load: str, columns: list[str], bound: int = SHAPE_BOUND) -> DataFrame:
    """One row per load and column: n_rows, n_missing, n_distinct, min_value, max_value, top_value, top_rows, n_nonconforming, expressions.

    Distinct values are counted without stand-in words. min and max are those of the text order for texts.
    Nulls in the load column form a load of their own; an empty table gives an empty profile; ties of the
    heaviest value go to the smaller one.
    """
    out = None
    for c in columns:
        text = F.col(c).cast("string")
        counts = value_counts(df, load, F.when(present(text), text))
        found = [e.regex for e in column_expressions(counts, bound)]
        fits = F.lit(False)
        for e in found:
            fits = fits | F.col("v").rlike(f"^(?:{e})$")
        some = F.col("v").isNotNull()
        agg = counts.groupBy("load_id").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("n_missing"),
            F.count("v").alias("n_distinct"),
            F.min("v").alias("min_value"),
            F.max("v").alias("max_value"),
            F.min_by("v", F.when(some, F.struct(-F.col("n"), F.col("v")))).alias("top_value"),
            F.max(F.when(some, F.col("n"))).alias("top_rows"),
            F.coalesce(F.sum(F.when(some & ~fits, F.col("n"))), F.lit(0)).alias("n_nonconforming"),
        )
        agg = agg.select("load_id", F.lit(c).alias("column_name"), *agg.columns[1:], F.array(*[F.lit(e) for e in found]).cast("array<string>").alias("expressions"))
        out = agg if out is None else out.unionByName(agg)
    return out


def findings(
    df: DataFrame,
    load: str,
    amount: str,
    code: str,
    category: str,
    declared_code: str,
    valid_categories: tuple[str, ...],
    most_missing: float = 0.15,
    most_out_of_range: float = 0.08,
    highest: float = 1_000_000_000,
    median_factor: float = 4.0,
    most_unfit: float = 0.15,
    most_heavy: float = 0.2,
    most_distance: float = 0.25,
) -> DataFrame:
    """load_id, column_name, finding: the loads in which a column leaves its normal state, and how.

    null_rate, range, distribution, pattern and concentration as the parameters set their bounds. Shapes are
    induced from the data; what fits none of the declared expressions is unfit. Missing amounts are nulls and
    NaN only. A load of null load_id is judged like any other; empty tables give no finding.
    """
    code_text = F.upper(F.regexp_replace(F.col(code).cast("string"), r"[\s\-]+", ""))
    # counted once, read several times
    codes = stage_table(value_counts(df, load, F.when(present(F.col(code).cast("string")), code_text)), "codes")
    words = stage_table(value_counts(df, load, F.when(present(F.col(category).cast("string")), F.lower(F.trim(F.col(category).cast("string"))))), "words")
    a = F.col(amount).cast("double")
    filled = a.isNotNull() & ~F.isnan(a)
    money = df.groupBy(F.col(load).alias("load_id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(filled, 1)).alias("filled"), F.count(F.when(filled & ((a <= 0) | (a > highest)), 1)).alias("out"))

    def missing(counts: DataFrame) -> DataFrame:
        return counts.groupBy("load_id").agg((F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))

    def null_rate(shares: DataFrame, name: str) -> DataFrame:
        middle = shares.agg(F.expr("percentile(share, 0.5)").alias("middle"))  # one row per load
        return shares.crossJoin(F.broadcast(middle)).where(F.col("share") > F.col("middle") + most_missing).select("load_id", F.lit(name).alias("column_name"), F.lit("null_rate").alias("finding"))

    def pattern(counts: DataFrame, declared: str, name: str) -> DataFrame:
        """Values of the normal expressions (induced, and all their values as declared) conform; of the others each is checked."""
        found = [e.regex for e in column_expressions(counts)]
        fits = F.col("v").rlike(f"^(?:{declared})$")
        each = counts.where("v is not null").select("load_id", "v", "n", first_expression(F.col("v"), found).alias("expression"))
        normal = {r["expression"] for r in each.groupBy("expression").agg(F.bool_and(fits).alias("fits")).where("fits").collect()} - {NO_EXPRESSION}
        outside = ~F.col("expression").isin(*normal) if normal else F.lit(True)
        bad = each.groupBy("load_id").agg((F.sum(F.when(outside & ~fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
        return bad.where(F.col("share") > most_unfit).select("load_id", F.lit(name).alias("column_name"), F.lit("pattern").alias("finding"))

    named = lambda d, name, finding: d.select("load_id", F.lit(name).alias("column_name"), F.lit(finding).alias("finding"))
    mid = medians(df, load, amount).withColumnRenamed(load, "load_id")
    all_mid = mid.agg(F.expr("percentile(median, 0.5)").alias("middle"))
    shifted = mid.crossJoin(F.broadcast(all_mid)).where((F.col("median") > median_factor * F.col("middle")) | (F.col("median") < F.col("middle") / median_factor))
    heavy = codes.where("v is not null").groupBy("load_id").agg((F.max("n") / F.sum("n")).alias("share")).where(F.col("share") > most_heavy)
    some = words.where("v is not null")
    per_load = some.groupBy("load_id").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(f"c{i}") for i, v in enumerate(valid_categories)])
    everything = some.agg(F.sum("n").alias("all_total"), *[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(f"a{i}") for i, v in enumerate(valid_categories)])
    distance = sum(F.abs(F.col(f"c{i}") / F.col("total") - (F.col(f"a{i}") - F.col(f"c{i}")) / F.nullif(F.col("all_total") - F.col("total"), F.lit(0))) for i in range(len(valid_categories))) / 2
    moved = per_load.crossJoin(F.broadcast(everything)).where(distance > most_distance)
    parts = [
        null_rate(money.select("load_id", (1 - F.col("filled") / F.col("n")).alias("share")), amount),
        null_rate(missing(codes), code),
        null_rate(missing(words), category),
        named(money.where(F.col("out") > most_out_of_range * F.col("filled")), amount, "range"),
        named(shifted, amount, "distribution"),
        pattern(codes, declared_code, code),
        named(heavy, code, "concentration"),
        pattern(words, "|".join(re.escape(v).replace(r"\ ", " ") for v in valid_categories), category),
        named(moved, category, "distribution"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
