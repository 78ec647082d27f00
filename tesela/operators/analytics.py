"""Analytical tables and quality figures of the contract table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T


def procedure_class(c: Column) -> Column:
    t = T.text_key(c)
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(T.blank(c), None).when(has("EMERGENCIA"), "emergencia").when(has("MENOR"), "menor").when(has("NEGOCIADO"), "negociado").when(has("RESTRINGIDO"), "restringido").when(has("ABIERTO"), "abierto").otherwise("otro")


def tolerant_date(c: Column) -> Column:
    return F.to_date(F.trim(c).try_cast("timestamp"))


def analytical_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with typed amounts and days, relative deviation, duration, main code and class of procedure."""
    pub, award = tolerant_date(F.col("publication_date")), tolerant_date(F.col("award_date"))
    days = F.date_diff(award, pub)
    e, a = F.col("estimated_value_eur"), F.col("awarded_value_eur")
    return contracts.select(
        "row_id", T.or_null(F.col("contract_key_canon")).alias("id_contrato"), T.or_null(F.col("buyer_name")).alias("organismo"), F.when(F.col("source") != "boe", T.or_null(F.col("buyer_id"))).alias("codigo_organismo"), T.or_null(F.col("supplier_name")).alias("proveedor"),
        F.upper(T.or_null(F.col("supplier_id"))).alias("nif"), T.main_cpv(F.col("cpv_codes_raw")).alias("cpv"), procedure_class(F.col("procedure")).alias("tipo_procedimiento"), e.alias("importe_estimado"), a.alias("importe_adjudicado"), F.try_divide(a - e, F.nullif(e, F.lit(0.0))).alias("desviacion"),
        F.date_format(pub, "yyyy-MM-dd").alias("fecha_publicacion"), F.date_format(award, "yyyy-MM-dd").alias("fecha_adjudicacion"), F.when(days >= 0, days).alias("dias"), F.array("source").alias("fuentes"),
    )


def suppliers(contracts: DataFrame) -> DataFrame:
    """One row per tax id and normalised name: first name, distinct contracts and buyers, amount in cents summed exactly."""
    nif, name = F.upper(F.coalesce(T.or_null(F.col("supplier_id")), F.lit(""))), T.text_key(F.coalesce("supplier_name", F.lit("")))
    some = contracts.select("row_id", nif.alias("nif"), name.alias("name_key"), "supplier_name", "contract_key_canon", T.text_key(F.col("buyer_name")).alias("buyer"), F.round(F.col("awarded_value_eur") * 100).cast("bigint").alias("cents")).where((F.col("nif") != "") | (F.col("name_key") != ""))
    return some.groupBy("nif", "name_key").agg(F.min_by("supplier_name", "row_id").alias("supplier_name"), F.count_distinct("contract_key_canon").alias("contracts"), F.count_distinct("buyer").alias("buyers"), (F.sum("cents") / F.lit(100.0)).alias("total"))


def catalog_index(catalog: DataFrame) -> DataFrame:
    """name_key, code, level and rows of the buyer catalogue: the first kind of code that a name has exactly once."""
    one = lambda c: F.when(F.count_distinct(T.or_null(F.col(c))) == 1, F.max(T.or_null(F.col(c))))
    level = F.when(F.lower("sector_location").startswith("entidades locales"), "local").when(F.lower("sector_location").startswith("comunidades"), "autonomico").otherwise("central")
    by = catalog.withColumn("level", level).groupBy(T.text_key(F.col("buyer_name")).alias("name_key"))
    return by.agg(F.coalesce(one("dir3"), one("nif"), one("platform_id")).alias("code"), F.when(F.count_distinct("level") == 1, F.max("level")).alias("level"), F.count(F.lit(1)).alias("catalog_rows"))


def enrich_buyers(contracts: DataFrame, catalog: DataFrame, bound: int = 100_000) -> DataFrame:
    """Contracts with the code and level of their buyer where theirs are blank. The index is broadcast up to the bound."""
    index = catalog_index(catalog)
    if not index.limit(bound + 1).count() > bound:
        index = F.broadcast(index)
    out = contracts.withColumn("name_key", T.text_key(F.col("buyer_name"))).join(index, "name_key", "left")
    return out.select("row_id", F.coalesce(T.or_null(F.col("buyer_id")), "code").alias("codigo_organismo"), "level", F.col("code").isNotNull().alias("in_catalog"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_missing, coverage, status: nulls and blanks of each column in one pass."""
    agg = [F.count_if(T.blank(F.col(c).cast("string"))).alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("__n"), *agg)
    long = one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])).alias("x")).select("__n", "x.*")
    ratio = F.try_divide((F.col("__n") - F.col("n_missing")), F.col("__n"))
    status = F.when(ratio.isNull(), "not_evaluable").when(ratio >= 0.9, "high").when(ratio > 0, "partial").otherwise("unavailable")
    return long.select("column_name", "n_missing", F.bround(ratio, 6).alias("coverage"), status.alias("status"))


def quality_summary(contracts: DataFrame, critical: list[str]) -> DataFrame:
    """One row: complete rows and cells, tax ids, order of the days, duplicate keys, negative amounts."""
    filled = [~T.blank(F.col(c).cast("string")) for c in critical]
    complete = filled[0]
    cells = filled[0].cast("int")
    for f in filled[1:]:
        complete, cells = complete & f, cells + f.cast("int")
    nif = F.col("supplier_id")
    pub, award = tolerant_date(F.col("publication_date")), tolerant_date(F.col("award_date"))
    both = pub.isNotNull() & award.isNotNull()
    n = F.count_if
    return contracts.agg(
        F.count(F.lit(1)).alias("n_rows"), n(complete).alias("complete_rows"), F.sum(cells).alias("complete_cells"), n(~T.blank(nif) & T.valid_tax_id(nif)).alias("tax_valid"), n(~T.blank(nif) & ~T.valid_tax_id(nif)).alias("tax_invalid"), n(T.blank(nif)).alias("tax_missing"),
        n(both).alias("comparable"), n(both & (pub <= award)).alias("coherent"), n(both & (pub > award)).alias("incoherent"), (F.count(F.lit(1)) - F.count_distinct("source", F.coalesce("contract_key_canon", F.lit("")))).alias("duplicates"), n(F.col("awarded_value_eur") < 0).alias("negative"),
    )


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def pair_context(contracts: DataFrame) -> DataFrame:
    """Per buyer and supplier: contracts, amount, the buyer's total, the share. Aggregates of aggregates, no join of rows."""
    cents = F.round(F.col("awarded_value_eur") * 100).cast("bigint")
    some = contracts.select(F.upper(F.trim("buyer_name")).alias("buyer"), F.upper(F.trim("supplier_name")).alias("supplier"), cents.alias("c")).where("buyer <> '' and supplier <> ''")
    pairs = some.groupBy("buyer", "supplier").agg(F.count(F.lit(1)).alias("pair_count"), F.sum("c").alias("pair_cents"))
    total = F.sum("pair_cents").over(Window.partitionBy("buyer"))
    return pairs.withColumn("t", total).select("buyer", "supplier", "pair_count", (F.col("pair_cents") / 100.0).alias("pair_amount"), (F.col("t") / 100.0).alias("buyer_total"), F.bround(F.try_divide("pair_cents", "t"), 6).alias("pair_share"))


def tender_counts(contracts: DataFrame) -> DataFrame:
    supplier = T.or_null(F.upper(F.trim("supplier_name")))
    return contracts.where(~T.blank(F.col("source_tender_id"))).groupBy("source_tender_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct(supplier).alias("suppliers"))


def monthly(contracts: DataFrame) -> DataFrame:
    day = tolerant_date(F.col("publication_date"))
    return contracts.where(day.isNotNull()).groupBy(F.date_format(F.date_trunc("month", day), "yyyy-MM").alias("month")).agg(F.count_distinct("contract_key_canon").alias("contracts"), F.bround(F.avg("awarded_value_eur"), 2).alias("mean_amount"))
