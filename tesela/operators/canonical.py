"""One contract table out of three sources: mapping, keys, first and latest rows, coverage and candidate matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T

COLUMNS = (
    "contract_key_canon", "source", "source_record_id", "source_notice_id", "source_tender_id", "source_dataset", "buyer_name", "buyer_id", "supplier_name", "supplier_id",
    "contract_title", "procedure", "publication_date", "award_date", "estimated_value_eur", "awarded_value_eur", "cpv_codes_raw", "cpv_code_list", "source_file", "source_snapshot_id",
)
#: Which columns of a source supply a canonical column; constants are texts after "=".
MAPPINGS: dict[str, dict[str, str]] = {
    "boe": {"contract_key_canon": "award_id", "source_record_id": "award_id", "source_notice_id": "notice_unit_id", "source_tender_id": "file_unit_id", "source_dataset": "=boe_2014_2024", "buyer_name": "buyer_name", "buyer_id": "institution", "supplier_name": "supplier_name", "supplier_id": "=", "contract_title": "object", "procedure": "procedure", "publication_date": "publication_date", "award_date": "=", "estimated_value_eur": "estimated_value_eur", "awarded_value_eur": "awarded_value_eur"},
    "place": {"source_record_id": "source_entry_id", "source_notice_id": "source_entry_id", "source_tender_id": "contract_folder_id", "source_dataset": "source_dataset", "buyer_name": "buyer_name", "buyer_id": "buyer_dir3", "supplier_name": "winning_party_name", "supplier_id": "winning_party_nif", "contract_title": "contract_title", "procedure": "procedure_code", "publication_date": "published_date", "award_date": "award_date", "estimated_value_eur": "estimated_overall_amount", "awarded_value_eur": "total_amount"},
    "opentender": {"source_record_id": "source_record_id", "source_notice_id": "source_entry_id", "source_tender_id": "source_record_id", "source_dataset": "source_file", "buyer_name": "buyer_name", "buyer_id": "buyer_id", "supplier_name": "awarded_supplier_name", "supplier_id": "awarded_supplier_nif", "contract_title": "contract_title", "procedure": "procedure_code", "publication_date": "publication_date", "award_date": "award_date", "estimated_value_eur": "estimated_amount_raw", "awarded_value_eur": "awarded_amount_raw"},
}


def aligned(df: DataFrame, name: str, default: str | None = "") -> Column:
    """The column if there is one, else the default."""
    return F.col(name) if name in df.columns else F.lit(default)


def with_unit_ids(boe: DataFrame) -> DataFrame:
    """Gazette records with the ids of their notice, file and award line.

    A file is known by buyer and file number, an award line by notice, file, supplier, amount, object and codes
    (a null amount is written "nan"); letters and digits alone count.
    """
    key = lambda c: F.coalesce(T.unit_key(c), F.lit(""))
    notice = F.coalesce(aligned(boe, "notice_id", None), aligned(boe, "contract_id", None))
    file = T.short_hash("expediente:", 20, key(F.col("buyer_name")), key(F.col("file_number")))
    amount = F.coalesce(F.format_string("%.2f", F.col("awarded_value_eur").cast("double")), F.lit("nan"))
    amount = F.when(F.col("awarded_value_eur").isNull() | F.isnan(F.col("awarded_value_eur").cast("double")), "nan").otherwise(amount)
    award = T.short_hash("adjudicacion:", 20, key(notice), F.col("file_unit_id"), key(F.col("supplier_name")), amount, key(F.col("object")), key(F.col("cpv_codes_raw")))
    return boe.withColumn("notice_unit_id", notice).withColumn("file_unit_id", file).withColumn("award_id", award)


def contract_key(df: DataFrame, source: str) -> Column:
    """Key of a feed record: file, buyer and day; where there is no file id, the id of the entry. Blank ids are null."""
    a, b, d = {"place": ("contract_folder_id", "buyer_dir3", "published_date"), "opentender": ("source_record_id", "buyer_name", "publication_date")}[source]
    text = lambda c: T.norm_text(aligned(df, c, None).cast("string"))
    own = F.nullif(F.coalesce(text("source_entry_id"), F.lit("")), F.lit(""))
    whole = F.concat_ws("|", text(a), F.coalesce(text(b), F.lit("")), F.coalesce(T.norm_date(text(d)), F.lit("")))
    return T.joined_key(F.when(text(a).isNull(), own).otherwise(whole))


def to_canonical(df: DataFrame, source: str, snapshot: str = "") -> DataFrame:
    """The 20 canonical columns plus record_id, which orders the rows of a source. Columns that a source lacks are empty."""
    if source == "boe":
        df = with_unit_ids(df)
    out: dict[str, Column] = {"source": F.lit(source)}
    for name, c in MAPPINGS[source].items():
        out[name] = F.lit(c[1:]) if c.startswith("=") else aligned(df, c)
    if source != "boe":
        out["contract_key_canon"] = contract_key(df, source)
    for name in COLUMNS:
        if name.endswith("_eur"):
            out[name] = out[name].cast("double")
        elif name in out and name != "contract_key_canon":
            out[name] = F.coalesce(F.trim(out[name].cast("string")), F.lit(""))
    out["cpv_codes_raw"] = F.coalesce(aligned(df, "cpv_codes_raw").cast("string"), F.lit(""))
    out["cpv_code_list"] = F.to_json(F.coalesce(F.col("cpv_code_list"), F.array().cast("array<string>")))
    out["source_file"] = F.coalesce(aligned(df, "source_file").cast("string"), F.lit(""))
    out["source_snapshot_id"] = F.lit(snapshot)
    return df.select("record_id", *[out[c].alias(c) for c in COLUMNS])


def first_rows(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: an aggregate with partial merging, so a heavy key is no task of its own."""
    rest = [c for c in df.columns if c not in key]
    least = F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*rest).alias("row"))).alias("m")
    return df.groupBy(*key).agg(least).select(*key, *[F.col(f"m.row.{c}").alias(c) for c in rest])


def latest_rows(df: DataFrame, key: list[str], newest: Column, tie: str) -> DataFrame:
    """The row of each key with the greatest time (null never wins), ties to the smallest ``tie``."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(newest.isNotNull(), newest, -F.col(tie))).alias("m")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])


def key_coverage(canonical: DataFrame) -> DataFrame:
    """contract_key_canon and whether each source has it; blank keys are left out. One shuffle, no outer joins."""
    some = canonical.where(~T.blank(F.col("contract_key_canon")))
    flag = lambda s: F.bool_or(F.col("source") == s).alias(f"present_in_{s}")
    return some.groupBy("contract_key_canon").agg(*[flag(s) for s in MAPPINGS])


def coverage_summary(coverage: DataFrame) -> DataFrame:
    b, p, o = (F.col(f"present_in_{s}") for s in MAPPINGS)
    n = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    return coverage.agg(F.count(F.lit(1)).alias("universe"), n(b, "boe"), n(p, "place"), n(o, "opentender"), n(b & p, "boe_place"), n(b & o, "boe_opentender"), n(p & o, "place_opentender"), n(b & p & o, "all_sources"), n(b & ~p & ~o, "only_boe"), n(~b & p & ~o, "only_place"), n(~b & ~p & o, "only_opentender"))


STRATEGIES = (("buyer_date_title_amount", ("buyer", "day", "title", "amount"), 0, "strong"), ("buyer_title_amount", ("buyer", "title", "amount"), 1, "weak"), ("buyer_date_title", ("buyer", "day", "title"), 2, "weak"))


def matching_keys(canonical: DataFrame) -> DataFrame:
    """One row per record and strategy whose parts are all filled, out of one scan."""
    amount = F.coalesce("awarded_value_eur", "estimated_value_eur")
    base = canonical.where(~T.blank(F.col("contract_key_canon"))).select(
        "source", "record_id", "contract_key_canon", T.norm_text(F.col("buyer_name")).alias("buyer"), T.norm_date(F.col("publication_date")).alias("day"), F.substring(T.norm_text(F.col("contract_title")), 1, 120).alias("title"), F.bround(amount, 0).cast("bigint").cast("string").alias("amount")
    )
    each = [F.when(F.forall(F.array(*[F.col(p) for p in parts]), lambda x: F.coalesce(x, F.lit("")) != ""), F.struct(F.lit(name).alias("match_strategy"), F.lit(rank).alias("rank"), F.lit(kind).alias("match_class"), F.concat_ws("|", F.lit(name), *parts).alias("diagnostic_key"))) for name, parts, rank, kind in STRATEGIES]
    return base.select("source", "record_id", "contract_key_canon", F.explode(F.array_compact(F.array(*each))).alias("k")).select("source", "record_id", "contract_key_canon", "k.*")


def candidate_matches(canonical: DataFrame) -> DataFrame:
    """Pairs of keys of two sources that share a matching key but differ as keys, by their best strategy."""
    keys = matching_keys(canonical)
    a = keys.select("diagnostic_key", "match_strategy", "rank", "match_class", F.col("source").alias("source_a"), F.col("contract_key_canon").alias("key_a")).distinct()
    b = keys.select("diagnostic_key", F.col("source").alias("source_b"), F.col("contract_key_canon").alias("key_b")).distinct()
    pairs = a.join(b, "diagnostic_key").where((F.col("source_a") < F.col("source_b")) & (F.col("key_a") != F.col("key_b")))
    best = F.min(F.struct("rank", "match_strategy", "match_class")).alias("m")
    return pairs.groupBy("source_a", "source_b", "key_a", "key_b").agg(best).select("source_a", "source_b", "key_a", "key_b", "m.match_strategy", "m.match_class")


def match_components(canonical: DataFrame) -> DataFrame:
    """Per source: rows, and how many have a key, buyer, day, title and amount to match by, with their shares."""
    amount = F.coalesce("awarded_value_eur", "estimated_value_eur")
    filled = {"key": ~T.blank(F.col("contract_key_canon")), "buyer": F.coalesce(T.norm_text(F.col("buyer_name")), F.lit("")) != "", "day": F.coalesce(T.norm_date(F.col("publication_date")), F.lit("")) != "", "title": F.coalesce(T.norm_text(F.col("contract_title")), F.lit("")) != "", "amount": amount.isNotNull()}
    by = canonical.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in filled.items()])
    return by.select("*", *[F.bround(F.col(n) / F.col("n_rows"), 6).alias(f"{n}_ratio") for n in filled])


def match_counts(matches: DataFrame) -> DataFrame:
    """Candidates per pair of sources and class."""
    return matches.groupBy("source_a", "source_b", "match_class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key_a").alias("keys_a"), F.count_distinct("key_b").alias("keys_b"))


def unit_summary(boe: DataFrame) -> DataFrame:
    """Per unit (notice, file, award line): rows, ids, buyers and suppliers as written and normalised, amount."""
    units = with_unit_ids(boe)
    cents = F.round(F.col("awarded_value_eur") * 100).cast("bigint")
    key = lambda c: F.nullif(T.unit_key(F.col(c)), F.lit(""))
    one = units.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("notice_unit_id").alias("notice"), F.count_distinct("file_unit_id").alias("file"), F.count_distinct("award_id").alias("award"), F.count_distinct("buyer_name").alias("buyers_raw"), F.count_distinct(key("buyer_name")).alias("buyers"),
        F.count_distinct("supplier_name").alias("suppliers_raw"), F.count_distinct(F.nullif(key("supplier_name"), F.lit("NODISPONIBLE"))).alias("suppliers"), (F.sum(cents) / F.lit(100.0)).alias("amount"),
    )
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("unique_ids")) for u in ("notice", "file", "award")]))
    return one.select(each.alias("u"), "n_rows", "buyers_raw", "buyers", "suppliers_raw", "suppliers", "amount").select("u.*", "n_rows", "buyers_raw", "buyers", "suppliers_raw", "suppliers", "amount")
