"""Queries of the general data-preparation operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.timestamps import normalise_timestamp
from tesela.operators import column_profile as profile
from tesela.operators import packed_fields as packed
from tesela.operators import skewed_keys as skewed
from tesela.session import table
from tesela.sources import boe_lines

# fixed values: the procedures that are valid and the form of a tax identifier
PROCEDURES = ("abierto", "abierto simplificado", "restringido", "negociado sin publicidad", "negociado con publicidad", "menor")
SUPPLIER_ID = "[A-Z][0-9]{7}[A-Z0-9]|[0-9]{8}[A-Z]"
DATED = {"boe_records": ("publication_date",), "opentender_records": ("publication_date", "award_date"), "place_records": ("atom_updated",)}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "cpv_catalog")
    out = None
    for name, column, spec, words in (("boe_records", "cpv_codes_raw", packed.CODES, "cpv_code"), ("place_records", "cpv_codes_raw", packed.CODES, "cpv_code"), ("boe_records", "cpv_subjects", packed.SUBJECTS, "subject")):
        items = packed.unpack(table(spark, sf, name).select("record_id", column), column, spec, catalog.select(words), keep=("record_id",), least=2)
        part = items.select(F.lit(name).alias("source_table"), "record_id", F.lit(column).alias("field_name"), "item_pos", "item")
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    contracts = table(spark, sf, "contracts").select("load_id", "awarded_value_eur", "supplier_id", "procedure")
    return profile.findings(contracts, "load_id", "awarded_value_eur", "supplier_id", "procedure", SUPPLIER_ID, PROCEDURES)


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    contracts = table(spark, sf, "contracts").select("load_id", "awarded_value_eur", "supplier_id", "procedure")
    return profile.load_profile(contracts, "load_id", ["awarded_value_eur", "supplier_id", "procedure"])


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    contracts = table(spark, sf, "contracts").select("load_id", "awarded_value_eur", "supplier_id", "procedure")
    return profile.load_coverage(contracts, "load_id", ["awarded_value_eur", "supplier_id", "procedure"])


def p3_medians(spark: SparkSession, sf: str) -> DataFrame:
    return profile.medians(table(spark, sf, "contracts"), "load_id", "awarded_value_eur")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, columns in DATED.items():
        t = table(spark, sf, name).select("record_id", *columns)
        for c in columns:
            # a generator keeps the filter above the conversion, which so runs once for each text
            part = t.where(F.trim(c) != "").select("record_id", F.col(c).alias("__text"), F.explode(F.array(normalise_timestamp(F.col(c))["normal"])).alias("normal_form"))
            part = part.where(F.col("normal_form") != F.col("__text")).select(F.lit(name).alias("source_table"), "record_id", F.lit(c).alias("field_name"), "normal_form")
            out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "boe_lines")
    return boe_lines.rejected(lines, boe_lines.load_strict(lines))


def p6_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return boe_lines.load_strict(table(spark, sf, "boe_lines"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    buyers = skewed.heavy_keys(table(spark, sf, "contracts"), "buyer_name", "contract_key_canon", "awarded_value_eur")
    targets = skewed.heavy_keys(table(spark, sf, "graph_edges"), "target_node_id", "contract_key_canon")
    one = buyers.select(F.lit("contracts").alias("source_table"), F.lit("buyer_name").alias("field_name"), "key_value")
    return one.unionByName(targets.select(F.lit("graph_edges").alias("source_table"), F.lit("target_node_id").alias("field_name"), "key_value"))


def p7_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return skewed.per_key(table(spark, sf, "contracts"), "buyer_name", "contract_key_canon", "awarded_value_eur").drop("n_chunks")


def p7_edges(spark: SparkSession, sf: str) -> DataFrame:
    return skewed.per_key(table(spark, sf, "graph_edges"), "target_node_id", "contract_key_canon").select("key_value", "n_rows", "n_items")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_profile, p3_coverage, p3_medians, p4_found, p6_found, p6_loaded, p7_found, p7_contracts, p7_edges)}

_MISSING = "({0} is null or lower(trim({0})) in ('', '-', 'n/d', 'no disponible'))"
_WORDS = ", ".join(f"('{p}')" for p in PROCEDURES)
SQL = {
    "p3_found": f"""
with base as (
  select load_id, awarded_value_eur as amount, case when not {_MISSING.format("supplier_id")} then upper(regexp_replace(supplier_id, '[\\s\\-]+', '', 'g')) end as code,
         case when not {_MISSING.format("procedure")} then lower(trim(procedure)) end as word from contracts),
shares as (
  select load_id, unnest(['awarded_value_eur', 'supplier_id', 'procedure']) as column_name,
         unnest([avg((amount is null)::int), avg((code is null)::int), avg((word is null)::int)]) as share from base group by load_id),
middle as (select column_name, median(share) as m from shares group by 1),
med as (select load_id, median(amount) as m from base where amount is not null group by 1),
counts as (select load_id, code, count(*) as n from base where code is not null group by all),
valid(word) as (values {_WORDS}),
loads as (select load_id, count(word) as total from base group by 1),
share_of as (
  select l.load_id, v.word, (select count(*) from base b where b.load_id = l.load_id and b.word = v.word) / l.total as here,
         (select count(*) from base b where b.load_id <> l.load_id and b.word = v.word) / (select sum(total) from loads o where o.load_id <> l.load_id) as there
  from loads l, valid v)
select load_id, column_name, 'null_rate' as finding from shares join middle using (column_name) where share > m + 0.15
union all select load_id, 'awarded_value_eur', 'range' from base where amount is not null group by load_id having avg((amount <= 0 or amount > 1000000000)::int) > 0.08
union all select load_id, 'awarded_value_eur', 'distribution' from med where m > 4 * (select median(m) from med) or m < (select median(m) from med) / 4
union all select load_id, 'supplier_id', 'pattern' from base where code is not null group by load_id having avg((not regexp_full_match(code, '[A-Z][0-9]{{7}}[A-Z0-9]|[0-9]{{8}}[A-Z]'))::int) > 0.15
union all select load_id, 'supplier_id', 'concentration' from counts group by load_id having max(n) > 0.2 * sum(n)
union all select load_id, 'procedure', 'pattern' from base where word is not null group by load_id having avg((word not in (select word from valid))::int) > 0.15
union all select load_id, 'procedure', 'distribution' from share_of group by load_id having sum(abs(here - there)) / 2 > 0.25""",
    "p3_medians": "select load_id, median(awarded_value_eur) as median from contracts where awarded_value_eur is not null group by load_id",
    "p7_found": """
select 'contracts' as source_table, 'buyer_name' as field_name, buyer_name as key_value from contracts group by buyer_name having count(*) >= 0.03 * (select count(*) from contracts) and trim(buyer_name) <> ''
union all
select 'graph_edges', 'target_node_id', target_node_id from graph_edges group by target_node_id having count(*) >= 0.03 * (select count(*) from graph_edges) and trim(target_node_id) <> ''""",
    "p7_contracts": "select buyer_name as key_value, count(*) as n_rows, count(distinct contract_key_canon) as n_items, sum(cast(round(awarded_value_eur * 100) as bigint)) / 100.0 as total from contracts group by buyer_name",
    "p7_edges": "select target_node_id as key_value, count(*) as n_rows, count(distinct contract_key_canon) as n_items from graph_edges group by target_node_id",
}
