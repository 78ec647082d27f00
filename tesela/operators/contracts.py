"""Contracts with what is known of them: counts and shares attached to rows, lookups, filters, one-to-one joins, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or ValueError that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError with the number of blank and of repeated keys."""
    r = df.agg(F.count_if(T.blank(F.col(key).cast("string"))).alias("blank"), (F.count(key) - F.count_distinct(key)).alias("again")).collect()[0]
    if r["blank"] or r["again"]:
        raise ValueError(f"{key}: {r['blank']} blank, {r['again']} repeated")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str, complete: bool = False) -> DataFrame:
    """Inner join of two tables whose keys are filled and unique; with ``complete``, ValueError where a left row finds none."""
    require_unique(left, key)
    require_unique(right, key)
    if complete and (lost := left.join(right, key, "left_anti").count()):
        raise ValueError(f"{key}: {lost} rows without a partner")
    return left.join(right, key)


def with_row_counts(contracts: DataFrame) -> DataFrame:
    """Contracts with records_in_tender, suppliers_in_tender and buyer_procedure_records.

    Counted per key with partial aggregation and joined back, so a heavy buyer is no task of its own; blank keys
    give nulls, as do blank suppliers in the number of suppliers.
    """
    tender, who = T.or_null(F.col("source_tender_id")), T.or_null(F.upper(F.trim("supplier_name")))
    buyer, procedure = T.or_null(F.upper(F.trim("buyer_name"))), T.or_null(F.upper(F.trim("procedure")))
    rows = contracts.withColumns({"__t": tender, "__b": buyer, "__p": procedure})
    by_tender = rows.where("__t is not null").groupBy("__t").agg(F.count(F.lit(1)).alias("records_in_tender"), F.count_distinct(who).alias("suppliers_in_tender"))
    by_procedure = rows.where("__b is not null and __p is not null").groupBy("__b", "__p").agg(F.count(F.lit(1)).alias("buyer_procedure_records"))
    return rows.join(by_tender, "__t", "left").join(by_procedure, ["__b", "__p"], "left").drop("__t", "__b", "__p")


def with_pair_context(contracts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contracts with pair_count, pair_amount, buyer_total and pair_share of their buyer and supplier; null where either is blank."""
    keys = {"buyer": F.upper(F.trim("buyer_name")), "supplier": F.upper(F.trim("supplier_name"))}
    return contracts.withColumns(keys).join(pairs, ["buyer", "supplier"], "left").drop("buyer", "supplier")


def with_features(contracts: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Contracts with the first row of features per key (smallest of its columns); features never multiply rows."""
    rest = [c for c in features.columns if c != key]
    one = features.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in rest])
    return contracts.join(one, key, "left")


def lookup(contracts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per filled key: the first in the given order, and n_rows, the number it was chosen from."""
    rest = [c for c in contracts.columns if c != key]
    by = contracts.where(~T.blank(F.col(key))).groupBy(key).agg(F.min(F.struct(*order, F.struct(*rest).alias("row"))).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    return by.select(key, *[F.col(f"m.row.{c}").alias(c) for c in rest], "n_rows")


def lookup_one(contracts: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The row of one key by the same rule (a filter the scan can take over, then a top one); ValueError where there is none."""
    found = contracts.where(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"no row with {key} {value}")
    return found.orderBy(*order).limit(1)


def payload_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal every wanted value; blank and null wishes don't count."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in wanted.items() if v is not None and str(v).strip()], df)


def cascade_filter(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows in every wanted set (empty sets don't count); all rows where none would be left."""
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]).isin(*kv[1])), [(k, v) for k, v in wanted.items() if v], df)
    return df if kept.isEmpty() else kept


def cpv_lines(lines: DataFrame, prefix: str = "71", column: str = "line") -> DataFrame:
    """Raw rows that hold an eight-digit code with the prefix, before anything is parsed."""
    return lines.where(F.col(column).rlike(rf"\b{prefix}\d{{{8 - len(prefix)}}}\b"))


def award_lines(boe: DataFrame, prefix: str = "71") -> DataFrame:
    """Gazette records of awards whose first code has the prefix."""
    return boe.where((F.lower(F.trim("record_type")) == "contratación") & F.get("cpv_code_list", F.lit(0)).startswith(prefix))


def with_cpv(df: DataFrame, prefix: str = "71") -> DataFrame:
    return df.where(F.exists(F.coalesce("cpv_code_list", F.array().cast("array<string>")), lambda x: x.startswith(prefix)))


def diverse_top(df: DataFrame, distinct: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, rows that repeat a value of ``distinct`` after all that don't; rank from 1.

    Each value's best ``limit`` rows are found first, so no value is ordered as a whole in one task; nulls are no value and never repeat.
    """
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)))
    by = rows.groupBy(F.coalesce(F.col(distinct).cast("string"), F.lit("")).alias("__k")).agg(F.min(F.struct(*names)).alias("__best"))
    keyed = rows.withColumn("__k", F.coalesce(F.col(distinct).cast("string"), F.lit(""))).join(by, "__k")
    again = F.col(distinct).isNotNull() & (F.struct(*names) != F.col("__best"))
    top = keyed.withColumn("__again", again.cast("int")).orderBy("__again", *names).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("__again", *names))).drop("__k", "__best", "__again", *names)


def picked_cases(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """case_no, measure and key: for each measure in turn the row where it is greatest (ties: smallest key), rows of earlier cases left out.

    One aggregate keeps the best rows of every measure (as many as there are measures), from which the picks are made.
    """
    n = len(measures)
    top = lambda c: F.slice(F.sort_array(c), 1, n)
    pair = lambda m: F.when(F.col(m).isNotNull(), F.struct((-F.col(m)).alias("v"), F.col(key).alias("k")))
    # every part is small, as there are as many as the table has blocks of some thousand keys
    groups = max(1, df.count() // 5_000)
    parts = df.groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("g")).agg(*[top(F.collect_set(pair(m))).alias(m) for m in measures])
    one = parts.agg(*[top(F.flatten(F.collect_list(m))).alias(m) for m in measures])
    rows, taken = [], F.array().cast("array<string>")

    def free(taken: Column):
        return lambda x: x["v"].isNotNull() & ~F.array_contains(taken, x["k"].cast("string"))

    for i, m in enumerate(measures):
        pick = F.get(F.filter(F.col(m), free(taken)), F.lit(0))["k"].cast("string")
        rows.append(F.struct(F.lit(i + 1).alias("case_no"), F.lit(m).alias("measure"), pick.alias(key)))
        taken = F.array_compact(F.concat(taken, F.array(pick)))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where(F.col(key).isNotNull())


def entity_key(identifier: Column, name: Column) -> Column:
    """Upper-case identifier, else upper-case name; accents are kept, null where both are blank."""
    return F.upper(F.coalesce(T.or_null(identifier), T.or_null(name)))


def changed_sources(before: DataFrame, now: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key and state (new, gone, changed, same) of every source of two snapshots, compared null-safely."""
    a, b = before.select(key, F.struct(*compare).alias("a")), now.select(key, F.struct(*compare).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))
