"""Queries of the engine's own operators: keys, canonical table, quality, graph, documents. Whole tables, no subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import analytics as A
from tesela.operators import canonical as C
from tesela.operators import documents as D
from tesela.operators import graph as G
from tesela.operators import reports as R
from tesela.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CRITICAL = ["buyer_name", "supplier_name", "contract_title", "publication_date", "awarded_value_eur"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contracts")


# ---- text and keys

_FOLD = "regexp_replace(strip_accents(translate({0}, 'ªº', 'ao')), '[^\\x00-\\x7F]', '', 'g')"
_TEXT_KEY = "trim(regexp_replace(upper(" + _FOLD + "), '[^A-Z0-9]+', ' ', 'g'))"
_STABLE = "coalesce(nullif(regexp_replace(regexp_replace(upper(" + _FOLD + "), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'UNKNOWN')"


@query(f"""select row_id, regexp_replace(regexp_replace(strip_accents(regexp_replace(upper(buyer_name), '\\s+', '', 'g')), '[^\\x00-\\x7F]', '', 'g'), '[^A-Z0-9\\]\\^_/\\\\]', '', 'g') as norm_text,
 {_TEXT_KEY.format('buyer_name')} as text_key, replace({_TEXT_KEY.format('buyer_name')}, ' ', '') as unit_key, {_STABLE.format("coalesce(buyer_name, '')")} as stable_key,
 substr(regexp_replace(publication_date, '\\D', '', 'g'), 1, 8) as norm_date from contracts""")
def str_keys(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("buyer_name")
    return contracts(spark, sf).select("row_id", T.norm_text(b).alias("norm_text"), T.text_key(b).alias("text_key"), T.unit_key(b).alias("unit_key"), T.stable_key(b).alias("stable_key"), T.norm_date(F.col("publication_date")).alias("norm_date"))


@query("""select record_id, cast(try_cast(replace(replace(regexp_replace(estimated_value_raw, '[^0-9,.\\-]', '', 'g'), '.', ''), ',', '.') as decimal(20,4)) as double) as estimated,
 cast(try_cast(replace(replace(regexp_replace(awarded_value_raw, '[^0-9,.\\-]', '', 'g'), '.', ''), ',', '.') as decimal(20,4)) as double) as awarded, nullif(regexp_extract(source_url, 'id=([^&#]+)', 1), '') as notice from boe_records""")
def str_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "boe_records").select("record_id", T.european_amount(F.col("estimated_value_raw")).alias("estimated"), T.european_amount(F.col("awarded_value_raw")).alias("awarded"), T.notice_id(F.col("source_url")).alias("notice"))


@query("""with x as (select row_id, cpv_codes_raw, regexp_extract_all(cpv_codes_raw, '\\b(\\d{8})\\b', 1) as c from contracts)
select row_id, array_to_string(list_filter(c, lambda v, i: list_position(c, v) = i), ',') as codes, nullif(regexp_extract(cpv_codes_raw, '(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)', 1), '') as main from x""")
def str_cpv(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("row_id", F.array_join(T.cpv_codes(F.col("cpv_codes_raw")), ",").alias("codes"), T.main_cpv(F.col("cpv_codes_raw")).alias("main"))


_NIF = "regexp_replace(upper(supplier_id), '[\\s\\-]', '', 'g')"
_VALID = f"""coalesce(case
 when regexp_full_match({_NIF}, '[0-9]{{8}}[A-Z]') then substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(try_cast(substr({_NIF}, 1, 8) as int) % 23 + 1 as int), 1) = substr({_NIF}, 9, 1)
 when regexp_full_match({_NIF}, '[XYZ][0-9]{{7}}[A-Z]') then substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(try_cast(translate(substr({_NIF}, 1, 1), 'XYZ', '012') || substr({_NIF}, 2, 7) as int) % 23 + 1 as int), 1) = substr({_NIF}, 9, 1)
 when regexp_full_match({_NIF}, '[ABCDEFGHJNPQRSUVW][0-9]{{7}}[0-9A-J]') then substr({_NIF}, 9, 1) in (cast(chk as varchar), substr('JABCDEFGHI', cast(chk + 1 as int), 1)) end, false)"""
_CHK = f"""(10 - (try_cast(substr({_NIF}, 3, 1) as int) + try_cast(substr({_NIF}, 5, 1) as int) + try_cast(substr({_NIF}, 7, 1) as int)
 + {' + '.join(f"(2 * try_cast(substr({_NIF}, {i}, 1) as int) % 10) + (2 * try_cast(substr({_NIF}, {i}, 1) as int)) // 10" for i in (2, 4, 6, 8))}) % 10) % 10"""


@query(f"select row_id, {_VALID} as is_valid from (select row_id, supplier_id, {_CHK} as chk from contracts)")
def str_tax_id(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("row_id", T.valid_tax_id(F.col("supplier_id")).alias("is_valid"))


@query(f"select row_id, 'expediente:' || substr(sha256(coalesce({_TEXT_KEY.format('buyer_name')}, '') || '|' || coalesce(source_tender_id, '')), 1, 20) as unit_id from contracts")
def str_hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("row_id", T.short_hash("expediente:", 20, T.text_key(F.col("buyer_name")), F.col("source_tender_id")).alias("unit_id"))


@query("select doc_id, case when length(t) <= 500 then t else rtrim(substr(t, 1, 497)) || '...' end as excerpt from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)")
def str_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


# ---- canonical table

def canonical(spark: SparkSession, sf: str) -> DataFrame:
    parts = [C.to_canonical(table(spark, sf, f"{s}_records"), s) for s in C.MAPPINGS]
    return reduce(DataFrame.unionByName, parts)


_NT = "regexp_replace(regexp_replace(strip_accents(regexp_replace(upper({0}), '\\s+', '', 'g')), '[^\\x00-\\x7F]', '', 'g'), '[^A-Z0-9\\]\\^_/\\\\]', '', 'g')"
_ND = "substr(regexp_replace(" + _NT + ", '\\D', '', 'g'), 1, 8)"


def _key(a: str, b: str, d: str) -> str:
    clean = lambda x: f"nullif(regexp_replace(regexp_replace({x}, '\\|{{2,}}', '|', 'g'), '^\\|+|\\|+$', '', 'g'), '')"
    return f"case when {a} is null then {clean(f"nullif({_NT.format('source_entry_id')}, '')")} else {clean(f"{_NT.format(a)} || '|' || coalesce({_NT.format(b)}, '') || '|' || coalesce({_ND.format(d)}, '')")} end"


_UNIT = "coalesce(regexp_replace(upper(" + _FOLD + "), '[^A-Z0-9]+', '', 'g'), '')"
_UNITS = f"""units as (select *, coalesce(notice_id, contract_id) as notice_unit_id, 'expediente:' || substr(sha256({_UNIT.format('buyer_name')} || '|' || {_UNIT.format('file_number')}), 1, 20) as file_unit_id from boe_records),
awards as (select *, 'adjudicacion:' || substr(sha256({_UNIT.format('notice_unit_id')} || '|' || file_unit_id || '|' || {_UNIT.format('supplier_name')} || '|' || coalesce(printf('%.2f', awarded_value_eur), 'nan') || '|' || {_UNIT.format('object')} || '|' || {_UNIT.format('cpv_codes_raw')}), 1, 20) as award_id from units)"""
_T = "trim(coalesce({0}, ''), ' ')"
_CANON = f"""{_UNITS}, canon as (
 select record_id, award_id as contract_key_canon, 'boe' as source, award_id as source_record_id, {_T.format('notice_unit_id')} as source_notice_id, file_unit_id as source_tender_id, 'boe_2014_2024' as source_dataset, {_T.format('buyer_name')} as buyer_name, {_T.format('institution')} as buyer_id, {_T.format('supplier_name')} as supplier_name, '' as supplier_id,
  {_T.format('object')} as contract_title, {_T.format('procedure')} as procedure, {_T.format('publication_date')} as publication_date, '' as award_date, estimated_value_eur, awarded_value_eur from awards
 union all select record_id, {_key('contract_folder_id', 'buyer_dir3', 'published_date')}, 'place', {_T.format('source_entry_id')}, {_T.format('source_entry_id')}, {_T.format('contract_folder_id')}, {_T.format('source_dataset')}, {_T.format('buyer_name')}, {_T.format('buyer_dir3')}, {_T.format('winning_party_name')}, {_T.format('winning_party_nif')},
  {_T.format('contract_title')}, {_T.format('procedure_code')}, {_T.format('published_date')}, {_T.format('award_date')}, estimated_overall_amount, total_amount from place_records
 union all select record_id, {_key('source_record_id', 'buyer_name', 'publication_date')}, 'opentender', {_T.format('source_record_id')}, {_T.format('source_entry_id')}, {_T.format('source_record_id')}, {_T.format('source_file')}, {_T.format('buyer_name')}, {_T.format('buyer_id')}, {_T.format('awarded_supplier_name')}, {_T.format('awarded_supplier_nif')},
  {_T.format('contract_title')}, {_T.format('procedure_code')}, {_T.format('publication_date')}, {_T.format('award_date')}, estimated_amount_raw, awarded_amount_raw from opentender_records)"""
_CANON_COLUMNS = ["record_id", "contract_key_canon", "source", "source_record_id", "source_notice_id", "source_tender_id", "source_dataset", "buyer_name", "buyer_id", "supplier_name", "supplier_id", "contract_title", "procedure", "publication_date", "award_date", "estimated_value_eur", "awarded_value_eur"]


@query(f"with {_CANON} select * from canon")
def prj_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(spark, sf).select(*_CANON_COLUMNS)


@query(f"with {_CANON} select source, contract_key_canon, record_id, supplier_name from canon where contract_key_canon is not null qualify row_number() over (partition by source, contract_key_canon order by record_id) = 1")
def win_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    some = canonical(spark, sf).where("contract_key_canon is not null").select("source", "contract_key_canon", "record_id", "supplier_name")
    return C.first_rows(some, ["source", "contract_key_canon"], ["record_id"])


@query("select contract_folder_id, record_id, loaded_at::varchar as loaded_at, status_code from place_records where contract_folder_id is not null qualify row_number() over (partition by contract_folder_id order by place_records.loaded_at desc nulls last, record_id) = 1")
def win_latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "place_records").where("contract_folder_id is not null").select("contract_folder_id", "record_id", "loaded_at", "status_code")
    return C.latest_rows(some, ["contract_folder_id"], F.col("loaded_at"), "record_id").withColumn("loaded_at", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"))


_COVER = f"with {_CANON}, cover as (select contract_key_canon, bool_or(source = 'boe') as present_in_boe, bool_or(source = 'place') as present_in_place, bool_or(source = 'opentender') as present_in_opentender from canon where contract_key_canon is not null group by 1)"


@query(f"{_COVER} select * from cover")
def jon_key_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return C.key_coverage(canonical(spark, sf))


@query(f"""{_COVER}, f as (select present_in_boe as b, present_in_place as p, present_in_opentender as o from cover) select count(*) as universe, count(*) filter (b) as boe, count(*) filter (p) as place, count(*) filter (o) as opentender, count(*) filter (b and p) as boe_place, count(*) filter (b and o) as boe_opentender,
 count(*) filter (p and o) as place_opentender, count(*) filter (b and p and o) as all_sources, count(*) filter (b and not p and not o) as only_boe, count(*) filter (not b and p and not o) as only_place, count(*) filter (not b and not p and o) as only_opentender from f""")
def agg_coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.coverage_summary(C.key_coverage(canonical(spark, sf)))


@query(f"""with {_CANON}, base as (select source, contract_key_canon as k, {_NT.format('buyer_name')} as b, substr(regexp_replace(publication_date, '\\D', '', 'g'), 1, 8) as d, substr({_NT.format('contract_title')}, 1, 120) as t,
 cast(cast(round_even(coalesce(awarded_value_eur, estimated_value_eur), 0) as bigint) as varchar) as a from canon where contract_key_canon is not null),
keys as (select distinct source, k, 'buyer_date_title_amount' as s, 0 as r, 'strong' as c, b || '|' || d || '|' || t || '|' || a as x from base where b <> '' and d <> '' and t <> '' and a is not null
 union all select distinct source, k, 'buyer_title_amount', 1, 'weak', b || '|' || t || '|' || a from base where b <> '' and t <> '' and a is not null
 union all select distinct source, k, 'buyer_date_title', 2, 'weak', b || '|' || d || '|' || t from base where b <> '' and d <> '' and t <> '')
select l.source as source_a, r.source as source_b, l.k as key_a, r.k as key_b, arg_min(l.s, l.r) as match_strategy, arg_min(l.c, l.r) as match_class from keys l join keys r on l.s = r.s and l.x = r.x and l.source < r.source and l.k <> r.k group by all""")
def jon_candidate_matches(spark: SparkSession, sf: str) -> DataFrame:
    return C.candidate_matches(canonical(spark, sf))


@query(f"with {_CANON}, c as (select distinct contract_key_canon as k, source from canon where contract_key_canon is not null) select k as contract_key_canon from c where source = 'place' except select k from c where source = 'boe'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    keys = canonical(spark, sf).where("contract_key_canon is not null").select("source", "contract_key_canon")
    side = lambda s: keys.where(F.col("source") == s).select("contract_key_canon")
    return side("place").exceptAll(side("boe")).distinct().join(side("boe"), "contract_key_canon", "left_anti")


@query("select source_record_id from contracts where source = 'boe' intersect select contract_id from boe_records")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).where("source = 'boe'").select("source_record_id").intersect(table(spark, sf, "boe_records").select("contract_id"))


# ---- analytical tables and quality

_DAY = "cast(try_cast(trim({0}) as timestamp) as date)"
_NN = "nullif(trim({0}), '')"
_CLASS = f"case when procedure is null or trim(procedure) = '' then null {''.join(f" when contains({_TEXT_KEY.format('procedure')}, '{w.upper()}') then '{w}'" for w in ('emergencia', 'menor', 'negociado', 'restringido', 'abierto'))} else 'otro' end"


@query(f"""select row_id, {_NN.format('contract_key_canon')} as id_contrato, {_NN.format('buyer_name')} as organismo, case when source <> 'boe' then {_NN.format('buyer_id')} end as codigo_organismo, {_NN.format('supplier_name')} as proveedor, upper({_NN.format('supplier_id')}) as nif,
 nullif(regexp_extract(cpv_codes_raw, '(?:^|[^0-9])([0-9]{{8}})(?:[^0-9]|$)', 1), '') as cpv, {_CLASS} as tipo_procedimiento, estimated_value_eur as importe_estimado, awarded_value_eur as importe_adjudicado, (awarded_value_eur - estimated_value_eur) / nullif(estimated_value_eur, 0) as desviacion,
 cast({_DAY.format('publication_date')} as varchar) as fecha_publicacion, cast({_DAY.format('award_date')} as varchar) as fecha_adjudicacion, case when {_DAY.format('award_date')} >= {_DAY.format('publication_date')} then date_diff('day', {_DAY.format('publication_date')}, {_DAY.format('award_date')}) end as dias from contracts""")
def prj_analytical(spark: SparkSession, sf: str) -> DataFrame:
    return A.analytical_contracts(contracts(spark, sf)).drop("fuentes")


@query(f"""with x as (select row_id, upper(coalesce({_NN.format('supplier_id')}, '')) as nif, coalesce({_TEXT_KEY.format('supplier_name')}, '') as name_key, supplier_name, contract_key_canon, {_TEXT_KEY.format('buyer_name')} as buyer, cast(round(awarded_value_eur * 100) as bigint) as cents from contracts)
select nif, name_key, arg_min(supplier_name, row_id) as supplier_name, count(distinct contract_key_canon) as contracts, count(distinct buyer) as buyers, sum(cents) / 100.0 as total from x where nif <> '' or name_key <> '' group by nif, name_key""")
def agg_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return A.suppliers(contracts(spark, sf))


_INDEX = f"""idx as (select {_TEXT_KEY.format('buyer_name')} as name_key, coalesce(case when count(distinct {_NN.format('dir3')}) = 1 then max({_NN.format('dir3')}) end, case when count(distinct {_NN.format('nif')}) = 1 then max({_NN.format('nif')}) end, case when count(distinct {_NN.format('platform_id')}) = 1 then max({_NN.format('platform_id')}) end) as code,
 case when count(distinct lv) = 1 then max(lv) end as level, count(*) as catalog_rows from (select *, case when lower(sector_location) like 'entidades locales%' then 'local' when lower(sector_location) like 'comunidades%' then 'autonomico' else 'central' end as lv from buyer_catalog) group by 1)"""


@query(f"with {_INDEX} select * from idx")
def agg_catalog_index(spark: SparkSession, sf: str) -> DataFrame:
    return A.catalog_index(table(spark, sf, "buyer_catalog"))


@query(f"with {_INDEX} select row_id, coalesce({_NN.format('buyer_id')}, code) as codigo_organismo, level, code is not null as in_catalog from contracts left join idx on {_TEXT_KEY.format('buyer_name')} = name_key")
def jon_enrich_buyers(spark: SparkSession, sf: str) -> DataFrame:
    return A.enrich_buyers(contracts(spark, sf), table(spark, sf, "buyer_catalog"))


_FIELDS = ["buyer_name", "buyer_id", "supplier_name", "supplier_id", "contract_title", "procedure", "publication_date", "award_date", "awarded_value_eur"]


@query("with m as (" + " union all ".join(f"select '{c}' as column_name, count(*) filter ({c} is null or trim({c}::varchar) = '') as n_missing, count(*) as n from contracts" for c in _FIELDS) + ") select column_name, n_missing, round_even((n - n_missing) / n, 6) as coverage, case when n_missing <= 0.1 * n then 'high' when n_missing < n then 'partial' else 'unavailable' end as status from m")
def agg_missing(spark: SparkSession, sf: str) -> DataFrame:
    return A.missing_counts(contracts(spark, sf), _FIELDS)


_OK = "({0} is not null and trim({0}::varchar) <> '')"


@query(f"""with x as (select *, {_DAY.format('publication_date')} as p, {_DAY.format('award_date')} as a, {_VALID} as ok from (select *, {_CHK} as chk from contracts))
select count(*) as n_rows, count(*) filter ({' and '.join(_OK.format(c) for c in CRITICAL)}) as complete_rows, cast(sum({' + '.join(_OK.format(c) + '::int' for c in CRITICAL)}) as bigint) as complete_cells, count(*) filter ({_OK.format('supplier_id')} and ok) as tax_valid, count(*) filter ({_OK.format('supplier_id')} and not ok) as tax_invalid,
 count(*) filter (not {_OK.format("coalesce(supplier_id, '')")}) as tax_missing, count(*) filter (p is not null and a is not null) as comparable, count(*) filter (p <= a) as coherent, count(*) filter (p > a) as incoherent, count(*) - count(distinct (source, coalesce(contract_key_canon, ''))) as duplicates, count(*) filter (awarded_value_eur < 0) as negative from x""")
def agg_quality(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality_summary(contracts(spark, sf), CRITICAL)


@query("select coalesce(procedure, '') as value, count(*) as n from contracts group by 1 order by n desc, value limit 20")
def agg_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(contracts(spark, sf), "procedure")


@query("""with x as (select upper(trim(buyer_name)) as buyer, upper(trim(supplier_name)) as supplier, count(*) as pair_count, sum(cast(round(awarded_value_eur * 100) as bigint)) as c from contracts where trim(buyer_name) <> '' and trim(supplier_name) <> '' group by 1, 2),
y as (select *, sum(c) over (partition by buyer) as t from x) select buyer, supplier, pair_count, c / 100.0 as pair_amount, t / 100.0 as buyer_total, round_even(c / nullif(t, 0), 6) + 0.0 as pair_share from y""")
def agg_pair_context(spark: SparkSession, sf: str) -> DataFrame:
    return A.pair_context(contracts(spark, sf))


@query("select source_tender_id, count(*) as records, count(distinct nullif(upper(trim(supplier_name)), '')) as suppliers from contracts where trim(source_tender_id) <> '' group by 1")
def agg_tenders(spark: SparkSession, sf: str) -> DataFrame:
    return A.tender_counts(contracts(spark, sf))


@query("select load_id, count(*) as n, min(awarded_value_eur) as min, quantile_cont(awarded_value_eur, 0.25) as q1, quantile_cont(awarded_value_eur, 0.5) as median, quantile_cont(awarded_value_eur, 0.75) as q3, max(awarded_value_eur) as max, avg(awarded_value_eur) as mean, stddev_pop(awarded_value_eur) as std from contracts where awarded_value_eur is not null group by 1")
def agg_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return R.spread(contracts(spark, sf), "awarded_value_eur", "load_id")


@query(f"with x as (select {_DAY.format('publication_date')} as d, contract_key_canon, awarded_value_eur from contracts) select strftime(d, '%Y-%m') as month, count(distinct contract_key_canon) as contracts, round_even(avg(awarded_value_eur), 2) as mean_amount from x where d is not null group by 1")
def agg_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return A.monthly(contracts(spark, sf))


@query("select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, sum(cast(round(value * 10000) as bigint)) as total from events group by 1, 2")
def agg_event_hours(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 10000).cast("bigint")).alias("total"))


# ---- graph

_CPVX = "list_distinct(list_transform(regexp_extract_all(cpv_codes_raw, '\\b\\d{8}(?:-\\d)?\\b|\\b\\d{2,7}\\b'), lambda x: split_part(x, '-', 1)))"
_EDGES = f"""base as (select *, 'contract:' || {_STABLE.format('contract_key_canon')} as c, case when trim(coalesce(buyer_id, '')) <> '' then {_STABLE.format('buyer_id')} when trim(coalesce(buyer_name, '')) <> '' then {_STABLE.format('buyer_name')} end as b, case when trim(coalesce(supplier_id, '')) <> '' then {_STABLE.format('supplier_id')} when trim(coalesce(supplier_name, '')) <> '' then {_STABLE.format('supplier_name')} end as s
 from contracts where trim(coalesce(contract_key_canon, '')) <> '' and trim(coalesce(source, '')) <> ''),
e as (select row_id, contract_key_canon, source, source_record_id, 'FROM_SOURCE' as edge_type, c as source_node_id, 'source:' || {_STABLE.format('source')} as target_node_id from base union all select row_id, contract_key_canon, source, source_record_id, 'PUBLISHED', 'buyer:' || b, c from base where b is not null
 union all select row_id, contract_key_canon, source, source_record_id, 'AWARDED_TO', c, 'supplier:' || s from base where s is not null union all select row_id, contract_key_canon, source, source_record_id, 'HAS_CPV', c, 'cpv:' || x from (select *, unnest({_CPVX}) as x from base)),
edges as (select edge_type || ':' || source_node_id || '->' || target_node_id || ':' || contract_key_canon as edge_id, source_node_id, target_node_id, edge_type, contract_key_canon, arg_min(source, row_id) as source, arg_min(source_record_id, row_id) as source_record_id from e group by all)"""
_EDGES = _EDGES.replace("group by all)", "group by edge_type, source_node_id, target_node_id, contract_key_canon)")


@query(f"with {_EDGES} select * from edges")
def gra_build_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.build_edges(contracts(spark, sf))


@query("select distinct n as node_id, split_part(n, ':', 1) as node_type from (select source_node_id as n from graph_edges union all select target_node_id from graph_edges)")
def gra_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.nodes_of(table(spark, sf, "graph_edges"))


_PAIRS = "pairs as (select least(source_node_id, target_node_id) as a, greatest(source_node_id, target_node_id) as b, count(*) as edge_count from graph_edges where source_node_id <> target_node_id group by 1, 2)"


@query(f"with {_PAIRS} select * from pairs")
def gra_simple(spark: SparkSession, sf: str) -> DataFrame:
    return G.simple(table(spark, sf, "graph_edges"))


@query(f"with {_PAIRS}, d as (select n as node_id, count(*) as neighbor_count from (select a as n from pairs union all select b from pairs) group by 1) select node_id, neighbor_count, round_even(neighbor_count / ((select count(*) from d) - 1), 10) as degree_centrality from d")
def gra_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(G.simple(table(spark, sf, "graph_edges")))


@query("select edge_type, count(*) as n, count(distinct contract_key_canon) as contracts from graph_edges group by 1")
def gra_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_edges").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contract_key_canon").alias("contracts"))


def _awards(spark: SparkSession, sf: str) -> DataFrame:
    return G.simple(table(spark, sf, "graph_edges").where("edge_type = 'AWARDED_TO'"))


@query("""with recursive p as (select distinct source_node_id as a, target_node_id as b from graph_edges where edge_type = 'AWARDED_TO' and source_node_id <> target_node_id), e as (select a as u, b as v from p union select b, a from p),
reach as (select u as n, u as r from e union select reach.n, e.v from reach join e on reach.r = e.u) select n as node_id, min(r) as component from reach group by 1""")
def gra_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the award relation (contract to supplier)."""
    return G.components(_awards(spark, sf))


@query()
def gra_components_all(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the graph of all edges."""
    return G.components(G.simple(table(spark, sf, "graph_edges")))


@query()
def gra_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph of all edges: nodes and their kinds."""
    groups = G.communities(G.simple(table(spark, sf, "graph_edges")))
    return groups.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_id").startswith("contract:")).alias("contracts"), F.count_if(F.col("node_id").startswith("buyer:")).alias("buyers"), F.count_if(F.col("node_id").startswith("supplier:")).alias("suppliers"))


@query(f"""with {_PAIRS}, m as (select count(*) as m from pairs), x as (select split_part(a, ':', 1) as ca, split_part(b, ':', 1) as cb from pairs), d as (select c, count(*) as d from (select ca as c from x union all select cb from x) group by 1), l as (select ca as c, count(*) as l from x where ca = cb group by 1)
select round_even(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 10) as modularity from d left join l using (c), m""")
def gra_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Modularity of the partition by node type."""
    edges = table(spark, sf, "graph_edges")
    return G.modularity(G.simple(edges), G.nodes_of(edges).withColumnRenamed("node_type", "community"))


@query()
def gra_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return G.betweenness(G.simple(table(spark, sf, "graph_edges")))


@query("""with b as (select target_node_id as contract, min(source_node_id) as buyer from graph_edges where edge_type = 'PUBLISHED' group by 1), o as (select source_node_id as contract, min(target_node_id) filter (edge_type = 'AWARDED_TO') as supplier, count(distinct target_node_id) filter (edge_type = 'HAS_CPV') as cpv_count from graph_edges where edge_type <> 'PUBLISHED' group by 1),
r as (select * from o left join b using (contract)), p as (select buyer, supplier, count(*) as recurrence from r where buyer is not null and supplier is not null group by 1, 2), bb as (select buyer, sum(recurrence)::bigint as awarded, count(*) as buyer_degree from p group by 1), ss as (select supplier, sum(recurrence)::bigint as supplier_contracts, count(*) as supplier_degree from p group by 1)
select contract, buyer, supplier, cpv_count, coalesce(recurrence, 0) as recurrence, round_even(recurrence / awarded, 6) as share, buyer_degree, supplier_degree, supplier_contracts, supplier is not null as has_supplier from r left join p using (buyer, supplier) left join bb using (buyer) left join ss using (supplier)""")
def gra_features(spark: SparkSession, sf: str) -> DataFrame:
    return G.contract_features(table(spark, sf, "graph_edges"))


@query("select distinct * from graph_edges where source_node_id = 'supplier:B00075960' or target_node_id = 'supplier:B00075960'")
def jon_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbourhood(table(spark, sf, "graph_edges"), "supplier:B00075960")


@query("with t as (select n as node_id from (select source_node_id as n from graph_edges union all select target_node_id from graph_edges) group by 1 order by count(*) desc, 1 limit 200) select * from graph_edges where source_node_id in (select node_id from t) and target_node_id in (select node_id from t)")
def jon_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among the 200 nodes with most edges (the limit is the feature: a view of the core)."""
    edges = table(spark, sf, "graph_edges")
    top = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(200)
    return G.subgraph(edges, top)


@query("select source_node_id as node_id, count(distinct target_node_id) as contracts from graph_edges where edge_type = 'PUBLISHED' group by 1 order by 2 desc, 1 limit 10")
def srt_top_buyers(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_entities(table(spark, sf, "graph_edges"), "PUBLISHED")


@query("select target_node_id as node_id, count(distinct source_node_id) as contracts from graph_edges where edge_type = 'AWARDED_TO' group by 1 order by 2 desc, 1 limit 10")
def srt_top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_entities(table(spark, sf, "graph_edges"), "AWARDED_TO")


# ---- documents

_CHUNKS = """chunks as (select doc_id, i as chunk_index, trim(substr(text, i * 780 + 1, 900), ' ') as text from (select doc_id, text, unnest(range((length(text) - 1) // 780 + 1))::int as i from documents where trim(text, ' ') <> '' and text is not null) where trim(substr(text, i * 780 + 1, 900), ' ') <> '')"""


@query(f"with {_CHUNKS} select doc_id, chunk_index, doc_id || ':' || chunk_index as chunk_id, text, sha256(text) as text_hash from chunks")
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunks(table(spark, sf, "documents"))


@query("select doc_id, 'doc-' || doc_id || '-' || substr(sha256(coalesce(text, '')), 1, 16) as document_id, sha256(coalesce(text, '')) as text_hash, coalesce(length(text), 0) as n_chars, text is null or trim(text, ' ') = '' as is_blank from documents")
def doc_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return D.manifest(table(spark, sf, "documents"))


@query("select doc_id, cast(i as int) as dim, ('0x' || substr(sha256(coalesce(text, '')), 2 * i + 1, 2))::int / 127.5 - 1 as value from documents, range(16) r(i)")
def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(D.hash_vector(F.col("text"))).alias("dim", "value"))


@query(f"with {_CHUNKS} select doc_id || ':' || chunk_index as chunk_id, (contains(lower(text), 'garantía')::int + contains(lower(text), 'contrato')::int + contains(lower(text), 'plazo')::int + contains(lower(text), 'obra')::int) / 4 as score from chunks where score > 0 order by score desc, chunk_id limit 5")
def doc_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return D.keyword_search(D.chunks(table(spark, sf, "documents")), "garantía contrato plazo obra")


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id, round_even(list_cosine_similarity(q::double[], embedding::double[]), 6) as cosine from q, embeddings where vec_id <> query_id)
select query_id, vec_id, row_number() over (partition by query_id order by cosine desc, vec_id)::int as rank, cosine from s qualify rank <= 5""")
def doc_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 20, against all vectors."""
    v = table(spark, sf, "embeddings")
    return D.vector_search(v, v.where("vec_id % 20 = 0"))


# ---- star-schema analytics over the general tables

@query("select l_returnflag, l_linestatus, sum(cast(round(l_quantity) as bigint)) as sum_qty, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0 as sum_price, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def olap_pricing(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("sum_qty"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("select n_name, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def olap_nation_orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0).alias("total"))
