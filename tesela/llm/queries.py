"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.timestamps import normalise_timestamp
from tesela.llm import award_pairs, mixing, packing, reading
from tesela.llm import survivors as surv
from tesela.llm.tokens import n_tokens
from tesela.session import stage_table, table

#: Fields that survive, per table.
PLACE_FIELDS = ("contract_title", "total_amount", "award_date", "winning_party_name")
OPENTENDER_FIELDS = ("contract_title", "awarded_amount_raw", "award_date", "awarded_supplier_name")
AMOUNTS = {"total_amount", "awarded_amount_raw"}
#: buyer_catalog has a fixed number of rows; it is broadcast up to this bound, and joined by shuffle beyond it.
CATALOG_BOUND = 100_000


def filled_text(c: Column) -> Column:
    """The text, or null where it is blank or a stand-in word."""
    return F.when(~F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))).isin("", "-", "n/d", "no disponible"), c)


def _filled(df: DataFrame, names: tuple[str, ...]) -> dict[str, Column]:
    out = {}
    for n in names:
        c = F.col(n)
        if n in AMOUNTS:
            out[n] = F.when((c > 0) & ~F.isnan(c), c.cast("string"))
        elif n == "award_date":
            out[n] = F.when(F.col("__day") != "invalid", filled_text(c))
        else:
            out[n] = filled_text(c)
    return out


def _second(name: str) -> Column:
    """Second of the instant that a text denotes (fractions dropped, as in its normal form), or null."""
    return F.floor(normalise_timestamp(F.col(name))["instant_us"] / 1_000_000)


def place_versions(spark: SparkSession, sf: str) -> DataFrame:
    """place_records with __group (folder and buyer) and __newest."""
    t = table(spark, sf, "place_records").select("record_id", "contract_folder_id", "buyer_dir3", "buyer_nif", "atom_updated", *PLACE_FIELDS)
    catalog = table(spark, sf, "buyer_catalog").where("nif is not null").select(F.upper(F.trim("nif")).alias("__nif"), F.col("dir3").alias("__dir3")).dropDuplicates(["__nif"])
    if not catalog.limit(CATALOG_BOUND + 1).count() > CATALOG_BOUND:
        catalog = F.broadcast(catalog)
    t = t.withColumn("__nif", F.upper(F.trim("buyer_nif"))).join(catalog, "__nif", "left")
    folder = F.lower(F.regexp_replace("contract_folder_id", r"[^\p{L}\p{N}]", ""))
    buyer = F.coalesce(filled_text(F.trim("buyer_dir3")), F.col("__dir3"))
    key = F.when((folder != "") & filled_text(F.col("contract_folder_id")).isNotNull() & buyer.isNotNull(), F.concat_ws("|", folder, F.upper(buyer)))
    return t.withColumn("__group", key).withColumn("__newest", _second("atom_updated")).withColumn("__day", normalise_timestamp(F.col("award_date"))["kind"])


def opentender_versions(spark: SparkSession, sf: str) -> DataFrame:
    """opentender_records with __group (release id) and __newest."""
    t = table(spark, sf, "opentender_records").select("record_id", "source_record_id", "updated", *OPENTENDER_FIELDS)
    key = F.lower(F.trim("source_record_id"))
    key = F.when(filled_text(F.col("source_record_id")).isNotNull(), key)
    return t.withColumn("__group", key).withColumn("__newest", _second("updated")).withColumn("__day", normalise_timestamp(F.col("award_date"))["kind"])


def _survivors(spark: SparkSession, sf: str, weighting: str, values: bool = True) -> DataFrame:
    place, opentender = place_versions(spark, sf), opentender_versions(spark, sf)
    a = surv.survivors(place, F.col("__group"), "record_id", F.col("__newest"), _filled(place, PLACE_FIELDS), weighting, values=values)
    b = surv.survivors(opentender, F.col("__group"), "record_id", F.col("__newest"), _filled(opentender, OPENTENDER_FIELDS), weighting, values=values)
    return a.withColumn("source_table", F.lit("place_records")).unionByName(b.withColumn("source_table", F.lit("opentender_records")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _survivors(spark, sf, "rank", values=False).select("source_table", "group_id", "field_name", "donor_id")


def p1_voted(spark: SparkSession, sf: str) -> DataFrame:
    return _survivors(spark, sf, "votes").select("source_table", "group_id", "field_name", "value", "n_rows")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return award_pairs.matched(spark, sf).select("record_id_a", "record_id_b")


def p5_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return award_pairs.matched(spark, sf)


def sized_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, n_tokens, completeness (1 and the filled ones of five fields) of every document, counted once and kept in the shared folder."""
    docs = table(spark, sf, "documents")
    known = sum((F.when(filled_text(F.col(c)).isNotNull(), 1.0).otherwise(0.0) for c in ("lang", "document_type", "buyer_dir3", "contract_key_canon", "published_date")), F.lit(1.0))
    return stage_table(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), known.alias("completeness")), "sized")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(sized_documents(spark, sf), table(spark, sf, "pack_sizes"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    capacities = table(spark, sf, "pack_sizes")
    return packing.fill(packing.pack(sized_documents(spark, sf), capacities), capacities)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The odds of a document are its completeness: well described ones are drawn, and repeated, more often."""
    return mixing.mix(sized_documents(spark, sf), table(spark, sf, "source_targets"), odds="completeness")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "source_targets")
    return mixing.shares(mixing.mix(sized_documents(spark, sf), targets, odds="completeness"), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    feats = reading.features(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
    return reading.levels(feats, reading.fit(feats), least_words=20).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    feats = reading.features(docs, table(spark, sf, "reading_labels"))
    by = reading.levels(feats, reading.fit(feats)).join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    return by.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_voted, p5_found, p5_confidence, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_profile)}
SQL: dict[str, str] = {}
