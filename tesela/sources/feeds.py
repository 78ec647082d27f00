"""Feed entries and releases to the 28 and 27 record fields, as expressions over parsed structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T

_ID = "struct<ID:array<struct<_VALUE:string,_schemeName:string>>>"
_PARTY = f"struct<PartyIdentification:array<{_ID}>,PartyName:struct<Name:string>>"
#: The parts of an entry that are read; namespaces are ignored.
ENTRY = (
    "id string, link array<struct<_href:string>>, published string, updated string, "
    f"ContractFolderStatus struct<ContractFolderID:string,ContractFolderStatusCode:string,LocatedContractingParty:struct<Party:{_PARTY}>,"
    "ProcurementProject:struct<Name:string,TypeCode:string,BudgetAmount:struct<EstimatedOverallContractAmount:string,TotalAmount:string,TaxExclusiveAmount:string>,RequiredCommodityClassification:array<struct<ItemClassificationCode:string>>>,"
    "TenderingProcess:struct<ProcedureCode:string>,"
    f"TenderResult:array<struct<ResultCode:string,AwardDate:string,ReceivedTenderQuantity:string,WinningParty:{_PARTY}>>>"
)
_ORG = "struct<name:string,id:string,additionalIdentifiers:array<struct<scheme:string,id:string>>>"
_VALUE = "struct<amount:string,currency:string>"
_ITEMS = "array<struct<classification:struct<id:string>>>"
_TENDER = f"struct<title:string,procurementMethod:string,procurementMethodDetails:string,mainProcurementCategory:string,status:string,datePublished:string,items:{_ITEMS},lots:array<struct<items:{_ITEMS}>>,value:{_VALUE}>"
_RELEASE = f"id:string,ocid:string,date:string,title:string,status:string,procurementMethod:string,procurementMethodDetails:string,mainProcurementCategory:string,buyer:{_ORG},tender:{_TENDER},items:{_ITEMS},value:{_VALUE},awards:array<struct<date:string,suppliers:array<{_ORG}>,value:{_VALUE}>>"
PACKAGE = f"struct<uri:string,metaData:struct<lastModified:string,lastModifiedDate:string,publishedAt:string>,releases:array<struct<{_RELEASE}>>,{_RELEASE}>"


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _scheme(ids: Column, scheme: str) -> Column:
    """The identifier of a party under a scheme (case ignored)."""
    flat = F.flatten(F.transform(ids, lambda x: x["ID"]))
    return F.get(F.filter(flat, lambda x: F.upper(x["_schemeName"]) == scheme), 0)["_VALUE"]


def _tag(organisation: Column, scheme: str) -> Column:
    return F.get(F.filter(organisation["additionalIdentifiers"], lambda x: F.upper(x["scheme"]) == scheme), 0)["id"]


def place_records(entries: DataFrame, dataset: str) -> DataFrame:
    """28 fields of each entry; deletions keep only where they come from. XML that cannot be read gives nulls and ``parse_error``."""
    xml = F.regexp_replace(F.regexp_replace(F.col("xml"), r"<(/?)[\w\-]+:", "<$1"), r"\sxmlns(?::[\w\-]+)?=\"[^\"]*\"", "")
    e = F.from_xml(xml, ENTRY, {"mode": "PERMISSIVE", "rowTag": "entry"})
    d = entries.withColumn("e", F.when(F.col("source_kind") == "entry", e))
    f, project = F.col("e.ContractFolderStatus"), F.col("e.ContractFolderStatus.ProcurementProject")
    party, result = f["LocatedContractingParty"]["Party"], F.get(f["TenderResult"], 0)
    codes = F.array_distinct(F.filter(F.transform(project["RequiredCommodityClassification"], lambda x: F.trim(x["ItemClassificationCode"])), lambda x: x.rlike(r"^\d+$")))
    money = lambda n: T.decimal_amount(project["BudgetAmount"][n])
    t = lambda c: T.or_null(c)
    return d.select(
        F.lit(dataset).alias("source_dataset"), "source_file", "source_atom", t(F.col("e.id")).alias("source_entry_id"), "source_kind", F.get(F.col("e.link"), 0)["_href"].alias("detail_url"), t(F.col("e.updated")).alias("atom_updated"), t(F.col("e.published")).alias("published_date"),
        t(f["ContractFolderID"]).alias("contract_folder_id"), t(project["Name"]).alias("contract_title"), t(f["ContractFolderStatusCode"]).alias("status_code"), t(project["TypeCode"]).alias("contract_type_code"), t(party["PartyName"]["Name"]).alias("buyer_name"),
        _scheme(party["PartyIdentification"], "DIR3").alias("buyer_dir3"), _scheme(party["PartyIdentification"], "NIF").alias("buyer_nif"), _scheme(party["PartyIdentification"], "ID_PLATAFORMA").alias("buyer_platform_id"),
        F.array_join(codes, ", ").alias("cpv_codes_raw"), codes.alias("cpv_code_list"), F.exists(codes, lambda x: x.startswith("71")).alias("is_cpv_71"), money("EstimatedOverallContractAmount").alias("estimated_overall_amount"), money("TotalAmount").alias("total_amount"), money("TaxExclusiveAmount").alias("tax_exclusive_amount"),
        t(f["TenderingProcess"]["ProcedureCode"]).alias("procedure_code"), t(result["ResultCode"]).alias("result_code"), t(result["AwardDate"]).alias("award_date"), t(result["ReceivedTenderQuantity"]).alias("received_tender_quantity"), t(result["WinningParty"]["PartyName"]["Name"]).alias("winning_party_name"),
        _scheme(result["WinningParty"]["PartyIdentification"], "NIF").alias("winning_party_nif"), ((F.col("source_kind") == "entry") & F.col("e.id").isNull()).alias("parse_error"),
    )


def opentender_records(lines: DataFrame) -> DataFrame:
    """27 fields of the newest release of each package (or of a compiled release) and of its latest award.

    Lines that are no JSON object or hold no release are left out.
    """
    p = F.from_json("line", PACKAGE, {"mode": "PERMISSIVE"})
    d = lines.withColumn("p", p).where("p is not null")
    newest = F.get(F.array_sort(F.col("p.releases"), lambda a, b: F.when(F.coalesce(a["date"], F.lit("")) > F.coalesce(b["date"], F.lit("")), -1).when(F.coalesce(a["date"], F.lit("")) < F.coalesce(b["date"], F.lit("")), 1).otherwise(0)), 0)
    names = [x.split(":")[0] for x in ("id", "ocid", "date", "title", "status", "procurementMethod", "procurementMethodDetails", "mainProcurementCategory", "buyer", "tender", "items", "value", "awards")]
    own = F.struct(*[F.col(f"p.{n}").alias(n) for n in names])
    d = d.withColumn("r", F.when(F.size(F.coalesce("p.releases", F.array())) > 0, newest).when(F.col("p.tender").isNotNull() | F.col("p.buyer").isNotNull() | F.col("p.awards").isNotNull(), own)).where("r is not null")
    r, t = F.col("r"), F.col("r.tender")
    none = F.array().cast(_ITEMS)
    items = F.concat(F.coalesce(r["items"], none), F.coalesce(t["items"], none), F.coalesce(F.flatten(F.transform(t["lots"], lambda x: F.coalesce(x["items"], none))), none))
    codes = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x["classification"]["id"])), lambda x: x.rlike(r"^\d+$")))
    award = F.get(F.array_sort(r["awards"], lambda a, b: F.when(F.coalesce(a["date"], F.lit("")) > F.coalesce(b["date"], F.lit("")), -1).when(F.coalesce(a["date"], F.lit("")) < F.coalesce(b["date"], F.lit("")), 1).otherwise(0)), 0)
    supplier, value, meta = F.get(award["suppliers"], 0), F.coalesce(r["value"], t["value"]), F.col("p.metaData")
    ocid = _first(r["ocid"], F.col("p.ocid"), F.col("p.id"), F.col("p.uri"), F.lit("unknown"))
    return d.select(
        F.lit("opentender").alias("source_system"), "source_year", "source_file", _first(r["id"], ocid).alias("source_record_id"), _first(F.col("p.id"), F.col("p.uri"), ocid).alias("source_entry_id"), _first(F.col("p.uri"), F.col("p.id")).alias("source_url"),
        _first(r["date"], t["datePublished"], meta["publishedAt"]).alias("publication_date"), _first(meta["lastModified"], meta["lastModifiedDate"]).alias("updated"), r["buyer"]["id"].alias("buyer_id"), r["buyer"]["name"].alias("buyer_name"), _first(_tag(r["buyer"], "TAX_ID"), _tag(r["buyer"], "NIF")).alias("buyer_nif"),
        _tag(r["buyer"], "ORGANIZATION_ID").alias("buyer_organization_id"), _first(r["title"], t["title"]).alias("contract_title"), _first(r["procurementMethodDetails"], r["procurementMethod"], t["procurementMethodDetails"], t["procurementMethod"]).alias("procedure_code"), _first(r["mainProcurementCategory"], t["mainProcurementCategory"]).alias("procurement_category"),
        F.array_join(codes, ", ").alias("cpv_codes_raw"), codes.alias("cpv_code_list"), F.exists(codes, lambda x: x.startswith("71")).alias("is_cpv_71"), T.decimal_amount(value["amount"]).alias("estimated_amount_raw"), value["currency"].alias("estimated_currency"), T.decimal_amount(award["value"]["amount"]).alias("awarded_amount_raw"), award["value"]["currency"].alias("awarded_currency"),
        award["date"].alias("award_date"), supplier["name"].alias("awarded_supplier_name"), supplier["id"].alias("awarded_supplier_id"), _first(_tag(supplier, "TAX_ID"), _tag(supplier, "NIF")).alias("awarded_supplier_nif"), _first(r["status"], t["status"]).alias("status"),
    )
