"""Further queries of the engine's own operators: rows with their context, lookups, rankings, reports, retrieval. Whole tables, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import canonical as C
from tesela.operators import contracts as K
from tesela.operators import documents as D
from tesela.operators import graph as G
from tesela.operators import reports as R
from tesela.operators.analytics import pair_context
from tesela.queries.engine import _CANON, _CHUNKS, _EDGES, _NT, _PAIRS, _STABLE, _UNIT, _UNITS, QUERIES, SQL, canonical, contracts, query
from tesela.session import table
from tesela.sources import boe_lines

__all__ = ["QUERIES", "SQL"]
_UP = "nullif(upper(trim({0}, ' ')), '')"


# ---- canonical table and gazette units

@query(f"with {_UNITS} select record_id, notice_unit_id, file_unit_id, award_id from awards")
def str_boe_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_unit_ids(table(spark, sf, "boe_records")).select("record_id", "notice_unit_id", "file_unit_id", "award_id")


@query(f"""with {_UNITS}, one as (select count(*) as n_rows, count(distinct notice_unit_id) as notice, count(distinct file_unit_id) as file, count(distinct award_id) as award, count(distinct buyer_name) as buyers_raw, count(distinct nullif({_UNIT.format('buyer_name')}, '')) as buyers, count(distinct supplier_name) as suppliers_raw,
 count(distinct nullif(nullif({_UNIT.format('supplier_name')}, ''), 'NODISPONIBLE')) as suppliers, sum(cast(round(awarded_value_eur * 100) as bigint)) / 100.0 as amount from awards)
select unnest(['notice', 'file', 'award']) as unit, unnest([notice, file, award]) as unique_ids, n_rows, buyers_raw, buyers, suppliers_raw, suppliers, amount from one""")
def agg_boe_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.unit_summary(table(spark, sf, "boe_records"))


_PART = {"key": "contract_key_canon is not null and trim(contract_key_canon) <> ''", "buyer": f"coalesce({_NT.format('buyer_name')}, '') <> ''", "day": "regexp_replace(publication_date, '\\D', '', 'g') <> ''", "title": f"coalesce({_NT.format('contract_title')}, '') <> ''", "amount": "coalesce(awarded_value_eur, estimated_value_eur) is not null"}


@query(f"with {_CANON} select source, count(*) as n_rows, " + ", ".join(f"count(*) filter ({c}) as {n}, round_even(count(*) filter ({c}) / count(*), 6) as {n}_ratio" for n, c in _PART.items()) + " from canon group by 1")
def agg_match_components(spark: SparkSession, sf: str) -> DataFrame:
    return C.match_components(canonical(spark, sf))


@query(SQL["jon_candidate_matches"].replace("select l.source as source_a", "select source_a, source_b, match_class, count(*) as n, count(distinct key_a) as keys_a, count(distinct key_b) as keys_b from (select l.source as source_a") + ") group by 1, 2, 3")
def agg_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.match_counts(C.candidate_matches(canonical(spark, sf)))


# ---- filters and lookups

@query("select line_id, source_file from boe_lines where regexp_matches(line, '\\b71\\d{6}\\b')")
def flt_raw_cpv(spark: SparkSession, sf: str) -> DataFrame:
    return K.cpv_lines(table(spark, sf, "boe_lines")).select("line_id", "source_file")


@query("select record_id, record_type from boe_records where lower(trim(record_type)) = 'contratación' and starts_with(cpv_code_list[1], '71')")
def flt_award_lines(spark: SparkSession, sf: str) -> DataFrame:
    return K.award_lines(table(spark, sf, "boe_records")).select("record_id", "record_type")


@query("select record_id, contract_folder_id from place_records where source_kind <> 'deleted' and len(list_filter(coalesce(cpv_code_list, []), lambda x: starts_with(x, '71'))) > 0")
def flt_live_cpv(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_cpv(table(spark, sf, "place_records").where("source_kind <> 'deleted'")).select("record_id", "contract_folder_id")


@query("select contract_key_canon, source, source_record_id, contract_title, n_rows from (select *, count(*) over (partition by contract_key_canon) as n_rows, row_number() over (partition by contract_key_canon order by source nulls first, source_record_id nulls first, row_id) as r from contracts where trim(contract_key_canon) <> '') where r = 1")
def flt_first_of_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("contract_key_canon", "source", "source_record_id", "row_id", "contract_title")
    return K.lookup(rows, "contract_key_canon", ["source", "source_record_id", "row_id"]).drop("row_id")


@query("select doc_id, document_type, source from documents where source = 'pliego_tecnico' and lang = 'es'")
def flt_payload(spark: SparkSession, sf: str) -> DataFrame:
    return K.payload_filter(table(spark, sf, "documents"), source="pliego_tecnico", lang="es", contract_key_canon=" ").select("doc_id", "document_type", "source")


@query("select row_id, source, procedure from contracts where source in ('boe', 'place') and lower(procedure) in ('abierto', 'menor')")
def flt_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("row_id", "source", "procedure", F.lower("procedure").alias("p"))
    return K.cascade_filter(rows, {"source": ["boe", "place"], "p": ["abierto", "menor"], "row_id": []}).drop("p")


@query("select row_id, source from contracts")
def flt_cascade_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A choice that nothing meets shows all rows."""
    return K.cascade_filter(contracts(spark, sf), {"source": ["nowhere"]}).select("row_id", "source")


# ---- rows with their context

@query(f"""with x as (select row_id, nullif(trim(source_tender_id, ' '), '') as t, {_UP.format('supplier_name')} as w, {_UP.format('buyer_name')} as b, {_UP.format('procedure')} as p from contracts),
t as (select t, count(*) as records_in_tender, count(distinct w) as suppliers_in_tender from x where t is not null group by 1), q as (select b, p, count(*) as buyer_procedure_records from x where b is not null and p is not null group by 1, 2)
select row_id, records_in_tender, suppliers_in_tender, buyer_procedure_records from x left join t using (t) left join q using (b, p)""")
def jon_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("row_id", "source_tender_id", "supplier_name", "buyer_name", "procedure")
    return K.with_row_counts(rows).select("row_id", "records_in_tender", "suppliers_in_tender", "buyer_procedure_records")


@query("""with x as (select row_id, upper(trim(buyer_name, ' ')) as b, upper(trim(supplier_name, ' ')) as s, cast(round(awarded_value_eur * 100) as bigint) as cents from contracts), p as (select b, s, count(*) as pair_count, sum(cents) as c from x where b <> '' and s <> '' group by 1, 2), q as (select *, sum(c) over (partition by b) as t from p)
select row_id, pair_count, c / 100.0 as pair_amount, t / 100.0 as buyer_total, round_even(c / nullif(t, 0), 6) + 0.0 as pair_share from x left join q using (b, s)""")
def jon_pair_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf)
    return K.with_pair_context(rows.select("row_id", "buyer_name", "supplier_name"), pair_context(rows)).select("row_id", "pair_count", "pair_amount", "buyer_total", "pair_share")


_FEATURES = SQL["gra_features"]


@query(f"with f as ({_FEATURES}) select row_id, recurrence, share, cpv_count from contracts left join f on contract = 'contract:' || {_STABLE.format('contract_key_canon')}")
def jon_contract_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("row_id", F.concat(F.lit("contract:"), T.stable_key(F.col("contract_key_canon"))).alias("contract"))
    features = G.contract_features(table(spark, sf, "graph_edges")).select("contract", "recurrence", "share", "cpv_count")
    return K.with_features(rows, features, "contract").drop("contract")


@query(f"with {_PAIRS}, d as (select n as node_id, count(*) as neighbor_count from (select a as n from pairs union all select b from pairs) group by 1), f as ({_FEATURES}) select contract, cpv_count, has_supplier, neighbor_count from f join d on contract = node_id")
def jon_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    """Features and degrees of the contracts, each once on either side, none lost."""
    edges = table(spark, sf, "graph_edges")
    degrees = G.degrees(G.simple(edges)).withColumnRenamed("node_id", "contract")
    return K.one_to_one(G.contract_features(edges), degrees, "contract", complete=True).select("contract", "cpv_count", "has_supplier", "neighbor_count")


_LABELS = f"""{_EDGES}, names as (select 'contract:' || {_STABLE.format('contract_key_canon')} as node_id, trim(contract_key_canon, ' ') as label, row_id from base union all select 'buyer:' || b, coalesce(nullif(trim(buyer_name, ' '), ''), 'buyer:' || b), row_id from base where b is not null
 union all select 'supplier:' || s, coalesce(nullif(trim(supplier_name, ' '), ''), 'supplier:' || s), row_id from base where s is not null union all select 'source:' || {_STABLE.format('source')}, trim(source, ' '), row_id from base union all select 'cpv:' || x, x, row_id from (select row_id, unnest(list_distinct(list_transform(regexp_extract_all(cpv_codes_raw, '\\b\\d{{8}}(?:-\\d)?\\b|\\b\\d{{2,7}}\\b'), lambda x: split_part(x, '-', 1)))) as x from base)),
nodes as (select node_id, arg_min(label, row_id) as label from names group by 1)"""


@query(f"with {_LABELS} select node_id, label, case split_part(node_id, ':', 1) when 'cpv' then 'CPV' else upper(substr(node_id, 1, 1)) || split_part(substr(node_id, 2), ':', 1) end as node_type from nodes")
def gra_labelled_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.build_nodes(contracts(spark, sf)).select("node_id", "label", "node_type")


@query(f"""with {_LABELS}, p as (select distinct target_node_id as contract, source_node_id as buyer from edges where edge_type = 'PUBLISHED'), q as (select distinct source_node_id as contract, target_node_id as supplier from edges where edge_type = 'AWARDED_TO')
select contract, c.label as contract_label, buyer, b.label as buyer_label, supplier, s.label as supplier_label from p join q using (contract) left join nodes c on c.node_id = contract left join nodes b on b.node_id = buyer left join nodes s on s.node_id = supplier""")
def jon_traversal(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf)
    return G.traversal(G.build_edges(rows), G.build_nodes(rows))


# ---- graph

_COMPONENTS = "with recursive p as (select distinct source_node_id as a, target_node_id as b from graph_edges where edge_type = 'AWARDED_TO' and source_node_id <> target_node_id), e as (select a as u, b as v from p union select b, a from p), reach as (select u as n, u as r from e union select reach.n, e.v from reach join e on reach.r = e.u), comp as (select n as node_id, min(r) as component from reach group by 1)"
_GROUPS = _COMPONENTS + ", sized as (select component, row_number() over (order by count(*) desc, component) - 1 as group_id, count(*) as group_size from comp group by 1)"


@query(f"{_GROUPS} select node_id, group_id, group_size from comp join sized using (component)")
def gra_sized_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the award relation, numbered by falling size."""
    return G.sized_groups(G.components(G.simple(table(spark, sf, "graph_edges").where("edge_type = 'AWARDED_TO'"))), "component")


_TABLE = f"""{_GROUPS}, m as (select node_id, group_id from comp join sized using (component)), inside as (select x.group_id, count(*) as n from p join m x on p.a = x.node_id join m y on p.b = y.node_id where x.group_id = y.group_id group by 1), kinds as (select group_id, split_part(node_id, ':', 1) as k from m),
t as (select group_id as community_id, group_id as component_id, 1 as component_count, count(*) as node_count, count(*) filter (k = 'contract') as contract_count, count(*) filter (k = 'buyer') as buyer_count, count(*) filter (k = 'supplier') as supplier_count, count(*) filter (k = 'cpv') as cpv_count, count(*) filter (k = 'source') as source_count, coalesce(any_value(n), 0) as internal_edge_count from kinds left join inside using (group_id) group by group_id)"""


def _award_groups(spark: SparkSession, sf: str) -> DataFrame:
    pairs = G.simple(table(spark, sf, "graph_edges").where("edge_type = 'AWARDED_TO'"))
    groups = G.sized_groups(G.components(pairs), "component")
    return G.community_table(pairs, groups.select("node_id", F.col("group_id").alias("community_id")), groups.select("node_id", F.col("group_id").alias("component_id")))


@query(f"{_TABLE} select * from t")
def agg_community_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table of groups, here of the components of the award relation."""
    return _award_groups(spark, sf)


@query(f"{_TABLE} select count(*) as groups, max(node_count) as most_nodes, max(contract_count) as most_contracts from t")
def agg_largest_groups(spark: SparkSession, sf: str) -> DataFrame:
    return G.largest_groups(_award_groups(spark, sf))


@query(f"{_TABLE} select community_id, contract_count, node_count, internal_edge_count from t order by contract_count desc, node_count desc, internal_edge_count desc, community_id limit 10")
def srt_top_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _award_groups(spark, sf).select("community_id", "contract_count", "node_count", "internal_edge_count").orderBy(F.desc("contract_count"), F.desc("node_count"), F.desc("internal_edge_count"), "community_id").limit(10)


_DEGREES = f"{_PAIRS}, d as (select n as node_id, count(*) as neighbor_count from (select a as n from pairs union all select b from pairs) group by 1)"


@query(f"with {_DEGREES} select node_id, neighbor_count from d where split_part(node_id, ':', 1) = 'supplier' order by neighbor_count desc, node_id limit 10")
def srt_top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_nodes(G.degrees(G.simple(table(spark, sf, "graph_edges"))), "supplier", "degree_centrality").select("node_id", "neighbor_count")


@query(f"""with {_DEGREES}, top as (select node_id from d order by neighbor_count desc, node_id limit 50), f as (select min(source_node_id) as f from graph_edges where edge_type = 'AWARDED_TO'), near as (select source_node_id as s, target_node_id as t from graph_edges, f where source_node_id = f or target_node_id = f), chosen as (select node_id from top union select s from near union select t from near)
select distinct edge_id from graph_edges where source_node_id in (select node_id from chosen) and target_node_id in (select node_id from chosen)""")
def srt_focus_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among the 50 nodes of most neighbours and a contract with its own (the limit is the feature: a view)."""
    edges = table(spark, sf, "graph_edges")
    focus = edges.where("edge_type = 'AWARDED_TO'").agg(F.min("source_node_id")).collect()[0][0]
    return G.focus_subgraph(edges, G.degrees(G.simple(edges)), "neighbor_count", 50, focus).select("edge_id").distinct()


@query(f"{_GROUPS}, nodes as (select distinct n from (select source_node_id as n from graph_edges union all select target_node_id from graph_edges)) select (select count(*) from nodes where starts_with(n, 'contract:')) as contracts, (select count(*) from nodes) as nodes, (select count(*) from graph_edges) as edges, (select count(*) from sized) as communities, (select max(group_size) from sized) as largest")
def agg_graph_kpis(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "graph_edges")
    groups = G.components(G.simple(edges.where("edge_type = 'AWARDED_TO'"))).withColumnRenamed("component", "community")
    return G.kpis(G.nodes_of(edges), edges, groups)


@query()
def gra_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 features of the contracts; centralities by degree, groups by the components of all edges."""
    rows = contracts(spark, sf)
    edges = G.build_edges(rows)
    pairs = G.simple(edges)
    groups = G.sized_groups(G.components(pairs), "component")
    entity = G.degrees(pairs).join(groups, "node_id").select("node_id", "neighbor_count", "degree_centrality", F.lit(0.0).alias("betweenness_centrality"), F.col("group_id").alias("component_id"), F.col("group_size").alias("component_size"), F.col("group_id").alias("community_id"), F.col("group_size").alias("community_size"))
    return G.feature_table(edges, G.build_nodes(rows), entity, "1", "2024-01-01T00:00:00Z")


# ---- rankings and top rows

@query("""with k as (select row_id, coalesce(buyer_name, '') as b, buyer_name, awarded_value_eur as v from contracts where awarded_value_eur is not null), r as (select *, row_number() over (partition by b order by v desc, row_id) as i from k)
select row_number() over (order by (i > 1 and buyer_name is not null)::int, v desc, row_id) as rank, row_id, buyer_name from r order by rank limit 20""")
def win_diverse_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 greatest awards, those of a buyer that is there already after all others."""
    rows = contracts(spark, sf).where("awarded_value_eur is not null").select("row_id", "buyer_name", "awarded_value_eur")
    return K.diverse_top(rows, "buyer_name", [-F.col("awarded_value_eur"), F.col("row_id")], 20).select("rank", "row_id", "buyer_name")


@query("""with a as (select row_id from contracts where awarded_value_eur is not null order by awarded_value_eur desc, row_id limit 1), e as (select row_id from contracts where estimated_value_eur is not null and row_id not in (select row_id from a) order by estimated_value_eur desc, row_id limit 1),
d as (select row_id from contracts where resolution_days is not null and row_id not in (select row_id from a union all select row_id from e) order by resolution_days desc, row_id limit 1)
select 1 as case_no, 'awarded_value_eur' as measure, cast(row_id as varchar) as row_id from a union all select 2, 'estimated_value_eur', cast(row_id as varchar) from e union all select 3, 'resolution_days', cast(row_id as varchar) from d""")
def srt_picked_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("row_id", "awarded_value_eur", "estimated_value_eur", F.col("resolution_days").cast("double").alias("resolution_days"))
    return K.picked_cases(rows, "row_id", ["awarded_value_eur", "estimated_value_eur", "resolution_days"])


@query("select row_id, resolution_days, awarded_value_eur from contracts order by resolution_days desc nulls last, awarded_value_eur desc nulls last, buyer_name nulls first, row_id limit 50")
def srt_ranking(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("resolution_days"), F.desc_nulls_last("awarded_value_eur"), F.asc_nulls_first("buyer_name"), "row_id"]
    return contracts(spark, sf).select("row_id", "resolution_days", "awarded_value_eur", "buyer_name").orderBy(*order).limit(50).drop("buyer_name")


# ---- reports

@query("select raw_field_count, count(*) as n_rows, count(*) filter (repaired_columns) as repaired, count(*) filter (" + " or ".join(f"contains(coalesce({c}, ''), '�')" for c in ("contract_id", "notice_id", "institution", "buyer_name", "file_number", "publication_date", "record_type", "contract_nature", "object", "procedure", "region", "cpv_subjects", "cpv_codes_raw", "estimated_value_raw", "awarded_value_raw", "supplier_name", "source_url", "source_file", "parser_warning")) + ") as replaced from boe_records group by 1")
def agg_source_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.source_report(table(spark, sf, "boe_records"))


@query("with x as (select count(*) as n from boe_lines), r as (select count(*) as k from (select source_file, source_line from boe_lines except select source_file, source_line from boe_records)) select n as n_lines, k as n_rejected, round_even((n - k) / n, 6) as parsed from x, r")
def agg_parse_rate(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "boe_lines")
    return R.parse_rate(lines, boe_lines.rejected(lines, boe_lines.load_strict(lines)))


@query("select buyer_name, array_to_string(list_sort(list_distinct(list(lower(trim(source, ' '))) filter (trim(source, ' ') <> ''))), ',') as sources from contracts group by 1")
def agg_sources_of(spark: SparkSession, sf: str) -> DataFrame:
    return R.sources_of(contracts(spark, sf), "buyer_name")


@query("select case when awarded_value_eur is null then null else (awarded_value_eur >= 0)::int + (awarded_value_eur >= 15000)::int + (awarded_value_eur >= 140000)::int + (awarded_value_eur >= 5000000)::int end as band, count(*) as n from contracts group by 1")
def agg_bands(spark: SparkSession, sf: str) -> DataFrame:
    return R.bands(contracts(spark, sf), "awarded_value_eur", [0.0, 15_000.0, 140_000.0, 5_000_000.0])


@query("with x as (select count(*) as n_rows, count(*) filter (awarded_value_eur between 0 and 1000000000) as inside, count(*) filter (awarded_value_eur < 0 or awarded_value_eur > 1000000000) as outside, count(*) filter (awarded_value_eur is null) as missing from contracts) select *, round_even(inside / (inside + outside), 6) as ratio from x")
def agg_range_validity(spark: SparkSession, sf: str) -> DataFrame:
    return R.range_validity(contracts(spark, sf), "awarded_value_eur", 0.0, 1e9)


@query("with m as (select supplier_count_in_tender, round_even(avg(resolution_days), 4) as mean from contracts where resolution_days is not null and supplier_count_in_tender is not null group by 1) select *, coalesce(mean >= lag(mean) over (order by supplier_count_in_tender), true) as rises from m")
def agg_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return R.monotone(contracts(spark, sf), "supplier_count_in_tender", "resolution_days")


_CHECKS = "select source as s, case when awarded_value_eur <= 0 then 'fail' when supplier_id is null then 'warning' when award_date is null then 'n/a' else 'pass' end as state from contracts"


@query(f"with c as ({_CHECKS}) select s as source, case min(case state when 'fail' then 1 when 'warning' then 2 when 'pass' then 3 else 4 end) when 1 then 'fail' when 2 then 'warning' when 3 then 'pass' else 'n/a' end as state, count(*) as n_checks from c group by 1")
def agg_rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("awarded_value_eur") <= 0, "fail").when(F.col("supplier_id").isNull(), "warning").when(F.col("award_date").isNull(), "n/a").otherwise("pass")
    return R.rolled_up(contracts(spark, sf).select("source", state.alias("state")), "source")


@query("""with a as (select contract_key_canon as k, min(awarded_value_eur) as x from contracts where load_id <= 3 group by 1), b as (select contract_key_canon as k, min(awarded_value_eur) as y from contracts where load_id > 3 group by 1), j as (select x, y from a join b using (k))
select count(*) as n, count(*) filter (x is not distinct from y) as unchanged, round_even(avg(y - x), 4) as mean_change, round_even(avg(abs(y - x)), 4) as mean_abs_change, round_even(count(*) filter (x is not distinct from y) / nullif(count(*), 0), 6) as unchanged_ratio from j""")
def agg_compared_loads(spark: SparkSession, sf: str) -> DataFrame:
    first = lambda where: contracts(spark, sf).where(where).groupBy("contract_key_canon").agg(F.min("awarded_value_eur").alias("v"))
    return R.compared_loads(first("load_id <= 3"), first("load_id > 3"), "contract_key_canon", "v")


_KNOWN = ("Abierto", "Abierto simplificado", "Restringido", "Menor", "Emergencia")


@query(f"with k(value) as (values {', '.join(f"('{v}')" for v in _KNOWN)}), c as (select procedure as value, count(*) as n from contracts group by 1) select value, coalesce(n, 0) as n, round_even(coalesce(n, 0) / (select count(*) from contracts), 6) as ratio from k left join c using (value)")
def agg_category_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return R.category_frequency(contracts(spark, sf), "procedure", list(_KNOWN))


@query("with a as (select source_file as k, count(*) as n from boe_records group by 1), b as (select source_file as k, count(*) as n from boe_lines group by 1) select k as source_file, case when a.n is null then 'new' when b.n is null then 'gone' when a.n = b.n then 'same' else 'changed' end as state from a full join b using (k)")
def jon_changed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the gazette by their number of loaded records and of raw lines."""
    by = lambda t: table(spark, sf, t).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return K.changed_sources(by("boe_records"), by("boe_lines"), "source_file", ["n"])


# ---- texts

@query(f"select row_id, coalesce(nullif(upper(trim(coalesce(buyer_id, ''), ' ')), ''), nullif(upper(trim(coalesce(buyer_name, ''), ' ')), '')) as entity, year(try_cast(award_date as date)) as award_year from contracts")
def str_entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("row_id", K.entity_key(F.col("buyer_id"), F.col("buyer_name")).alias("entity"), F.year(F.col("award_date").try_cast("date")).alias("award_year"))


@query("select row_id, json_object('source', source, 'supplier_id', supplier_id, 'load_id', load_id)::varchar as json from contracts")
def prj_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    one = contracts(spark, sf).select("row_id", F.to_json(F.struct("source", "supplier_id", "load_id"), {"ignoreNullFields": "false"}).alias("json"))
    return one


@query("""select row_id, json_extract_string(cpv_code_list, '$[0]') as first_code, json_array_length(cpv_code_list) as n_codes from contracts where json_valid(cpv_code_list)""")
def jsn_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).select("row_id", "cpv_code_list", F.from_json("cpv_code_list", "array<string>").alias("codes")).where("codes is not null")
    return rows.select("row_id", F.get_json_object("cpv_code_list", "$[0]").alias("first_code"), F.size("codes").alias("n_codes"))


@query("select source, buyer_name from contracts union select source_system, buyer_name from opentender_records")
def set_distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("source", "buyer_name").union(table(spark, sf, "opentender_records").select("source_system", "buyer_name")).distinct()


@query("""with t as (select doc_id, lower(text) as t from documents where text is not null) select doc_id, contains(replace(t, 'sin garantía definitiva', ' '), 'garantía') as is_unsafe from t""")
def str_unsafe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", D.unsafe(F.col("text"), ["sin garantía definitiva"], ["garantía"]).alias("is_unsafe"))


@query("""with t as (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as t from documents where text is not null) select doc_id, length(case when contains(lower(t), 'no se declara fraude.') then t else trim(t || ' No se declara fraude.') end) as n from t""")
def str_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(D.cleaned_answer(F.col("text"))).alias("n"))


# ---- retrieval

_HITS = f"""{_CHUNKS}, ch as (select c.doc_id, c.doc_id || ':' || c.chunk_index as chunk_id, d.contract_key_canon, c.text from chunks c join documents d using (doc_id) where trim(d.contract_key_canon) <> ''),
cases as (select row_id as case_id, contract_key_canon, list_distinct(regexp_extract_all(lower(contract_title), '([\\p{{L}}\\p{{N}}_]+)', 1)) as terms from contracts where contract_title is not null),
scored as (select case_id, doc_id, chunk_id, len(list_filter(terms, lambda w: contains(lower(text), w))) / len(terms) as score from ch join cases using (contract_key_canon) where len(terms) > 0),
hits as (select case_id, chunk_id, doc_id, row_number() over (partition by case_id order by score desc, chunk_id) as rank, score from scored where score > 0 qualify rank <= 5)"""


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    chunked = D.chunks(docs).join(docs.select("doc_id", "contract_key_canon"), "doc_id")
    return chunked, contracts(spark, sf).where("contract_title is not null").select(F.col("row_id").alias("case_id"), "contract_key_canon", F.col("contract_title").alias("question"))


@query(f"with {_HITS} select case_id, chunk_id, doc_id, rank, round_even(score, 6) as score from hits")
def doc_case_hits(spark: SparkSession, sf: str) -> DataFrame:
    return D.case_hits(*_cases(spark, sf)).withColumn("score", F.bround("score", 6))


@query(f"with {_HITS} select case_id, count(*) as n_hits, string_agg('document_id=' || doc_id || '; chunk_id=' || chunk_id || '; contract_key_canon=' || contract_key_canon, ' | ' order by rank) as citations from hits join (select chunk_id, contract_key_canon from ch) using (chunk_id) group by 1")
def doc_evidence(spark: SparkSession, sf: str) -> DataFrame:
    chunked, cases = _cases(spark, sf)
    return D.evidence(D.case_hits(chunked, cases), chunked).select("case_id", "n_hits", "citations")


_METRICS = f"""{_HITS}, want as (select distinct c.case_id, d.doc_id from cases c join documents d using (contract_key_canon)), w as (select case_id, count(*) as n from want group by 1), g as (select h.case_id, count(*) as k, count(t.doc_id) as r, count(distinct t.doc_id) as rd from hits h left join want t using (case_id, doc_id) group by 1),
metrics as (select case_id, coalesce(k, 0) as evidence_count, round_even(coalesce(r / nullif(k, 0), 0), 6) as precision_at_k, round_even(coalesce(rd, 0) / n, 6) as recall from w left join g using (case_id))"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    chunked, cases = _cases(spark, sf)
    expected = cases.join(table(spark, sf, "documents").select("doc_id", "contract_key_canon"), "contract_key_canon").select("case_id", "doc_id")
    return D.retrieval_metrics(D.case_hits(chunked, cases), expected)


@query(f"with {_METRICS} select * from metrics")
def doc_retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query(f"with {_METRICS} select count(*) as cases, round_even(avg((evidence_count > 0)::int), 6) as evidence_ratio, round_even(avg(precision_at_k), 6) as mean_precision, round_even(avg(recall), 6) as mean_recall from metrics")
def doc_retrieval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.retrieval_summary(_metrics(spark, sf))


@query(f"with {_HITS} select case_id, 'keyword' as mode, chunk_id, rank from hits where true union all select case_id, 'none', null, null from (select distinct case_id from cases) where case_id not in (select case_id from hits)")
def doc_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No vectors of the chunks are given, so each case falls back on its words, or has no evidence."""
    chunked, cases = _cases(spark, sf)
    hits = D.case_hits(chunked, cases)
    return D.with_fallback(hits.limit(0), hits, cases).drop("score")
