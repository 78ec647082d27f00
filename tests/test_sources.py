import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tesela.operators import documents as D
from tesela.sources import archives, feeds, files
from tesela.streaming import ingest

ENTRY = """<entry><id>https://x.invalid/1</id><link href="https://x.invalid/d"/><updated>2024-01-02T00:00:00Z</updated>
<cac-place-ext:ContractFolderStatus><cbc:ContractFolderID>EXP 1</cbc:ContractFolderID><cbc-place-ext:ContractFolderStatusCode>RES</cbc-place-ext:ContractFolderStatusCode>
<cac-place-ext:LocatedContractingParty><cac:Party><cac:PartyIdentification><cbc:ID schemeName="DIR3">L01</cbc:ID></cac:PartyIdentification><cac:PartyIdentification><cbc:ID schemeName="nif">P1</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Alba</cbc:Name></cac:PartyName></cac:Party></cac-place-ext:LocatedContractingParty>
<cac:ProcurementProject><cbc:Name>Obra</cbc:Name><cbc:TypeCode>2</cbc:TypeCode><cac:BudgetAmount><cbc:EstimatedOverallContractAmount currencyID="EUR">1234.50</cbc:EstimatedOverallContractAmount><cbc:TotalAmount>99</cbc:TotalAmount></cac:BudgetAmount>
<cac:RequiredCommodityClassification><cbc:ItemClassificationCode>71300000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification><cac:RequiredCommodityClassification><cbc:ItemClassificationCode>45000000</cbc:ItemClassificationCode></cac:RequiredCommodityClassification></cac:ProcurementProject>
<cac:TenderingProcess><cbc:ProcedureCode>1</cbc:ProcedureCode></cac:TenderingProcess>
<cac:TenderResult><cbc:ResultCode>8</cbc:ResultCode><cbc:AwardDate>2024-01-01</cbc:AwardDate><cac:WinningParty><cac:PartyIdentification><cbc:ID schemeName="NIF">B2</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Norte</cbc:Name></cac:PartyName></cac:WinningParty></cac:TenderResult>
</cac-place-ext:ContractFolderStatus></entry>"""


def test_feed_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.atom", f"<feed>{ENTRY}<at:deleted-entry ref='u'/>{ENTRY.replace('EXP 1', 'EXP 2')}</feed>")
        z.writestr("readme.txt", ENTRY)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    entries = archives.zip_entries(spark, str(tmp_path / "*.zip"))
    assert {(r.source_file, r.source_kind): r.n for r in entries.groupBy("source_file", "source_kind").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a.zip", "entry"): 2, ("a.zip", "deleted"): 1, ("bad.zip", "error"): 1}
    rows = {r.contract_folder_id: r for r in feeds.place_records(entries, "licitaciones").where("source_kind = 'entry'").collect()}
    r = rows["EXP 1"]
    assert set(rows) == {"EXP 1", "EXP 2"} and len(r) == 29
    assert (r.buyer_name, r.buyer_dir3, r.buyer_nif, r.contract_title, r.estimated_overall_amount, r.total_amount, r.winning_party_name, r.winning_party_nif, r.award_date, r.status_code) == ("Alba", "L01", "P1", "Obra", 1234.5, 99.0, "Norte", "B2", "2024-01-01", "RES")
    assert r.cpv_code_list == ["71300000", "45000000"] and r.is_cpv_71 and r.detail_url == "https://x.invalid/d" and not r.parse_error


def test_release_lines(spark, tmp_path):
    package = {"uri": "u1", "metaData": {"lastModified": "2024-02-01"}, "releases": [{"id": "old", "date": "2023-01-01"}, {"id": "new", "date": "2024-01-01", "buyer": {"name": "Alba", "id": "b", "additionalIdentifiers": [{"scheme": "tax_id", "id": "P1"}]}, "tender": {"title": "Obra", "procurementMethod": "open", "items": [{"classification": {"id": "71300000"}}], "value": {"amount": "100", "currency": "EUR"}}, "awards": [{"date": "2024-01-02", "suppliers": [{"name": "A", "id": "a"}], "value": {"amount": "80"}}, {"date": "2024-01-05", "suppliers": [{"name": "B", "id": "b2"}], "value": {"amount": "90", "currency": "EUR"}}]}]}
    compiled = {"id": "c1", "ocid": "o1", "tender": {"title": "T"}, "buyer": {"name": "X"}}
    lines = [json.dumps(package), json.dumps(compiled), json.dumps({"id": "nothing"}), "{broken", ""]
    with gzip.open(tmp_path / "data-es-ocds-2024.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("data-es-ocds-2024.json", "\n".join(lines))
        z.writestr("data-es-ocds-2023.json", lines[1])
    for path in ("data-es-ocds-2024.jsonl.gz", "all.zip"):
        got = {r.source_record_id: r for r in feeds.opentender_records(archives.json_lines(spark, str(tmp_path / path), 2024)).collect()}
        assert set(got) == {"new", "c1"}
        r = got["new"]
        assert (r.awarded_supplier_name, r.awarded_amount_raw, r.estimated_amount_raw, r.award_date, r.buyer_nif, r.cpv_codes_raw, r.updated, r.source_year, r.procedure_code) == ("B", 90.0, 100.0, "2024-01-05", "P1", "71300000", "2024-02-01", 2024, "open")
        assert len(r) == 27


def test_documents_snapshots_and_sinks(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.html").write_text("<h1>Uno</h1><style>x</style>")
    (d / "b.txt").write_text("dos")
    before = files.snapshot(spark, str(d)).collect()
    docs = {r.document_type: r.text for r in files.documents(spark, str(d)).collect()}
    assert docs == {"html": "Uno", "text": "dos"}
    old = spark.createDataFrame(before)
    (d / "b.txt").write_text("tres")
    (d / "c.md").write_text("x")
    assert {r.path.rsplit("/", 1)[-1]: r.change for r in files.changed(old, files.snapshot(spark, str(d))).collect()} == {"b.txt": "modified", "c.md": "added"}
    path = str(tmp_path / "t")
    files.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), spark, path, ["k"], "t")
    files.upsert(spark.createDataFrame([(1, "c", 2), (2, "old", 0)], "k int, v string, t int"), spark, path, ["k"], "t")
    assert {r.k: r.v for r in files.current(spark, path).collect()} == {1: "c", 2: "b"}
    files.upsert(spark.createDataFrame([(3, "d", 1)], "k int, v string, t int"), spark, path, ["k"], "t")
    assert files.versions(spark, path) == [2, 3] and files.current(spark, path).count() == 3
    files.preview(spark.createDataFrame([(2, [1]), (1, [])], "k int, xs array<int>"), str(tmp_path / "p"), ["k"], 1)
    assert spark.read.csv(str(tmp_path / "p"), header=True).collect()[0].xs == "[]"
    assert files.mask_credentials("jdbc://u:secret@h/db") == "jdbc://u:***@h/db"
    assert files.parquet_columns(spark, str(tmp_path / "none"), old.schema).count() == 0


def test_chunks_and_search(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "  "), (3, None)], "doc_id long, text string")
    got = [(r.chunk_index, r.text) for r in D.chunks(docs, 5, 2).orderBy("chunk_index").collect()]
    assert got == [(0, "abcde"), (1, "defgh"), (2, "ghij"), (3, "j")]
    chunks = spark.createDataFrame([("a", "riesgo y evidencia"), ("b", "nada"), ("c", "evidencia, RIESGO")], "chunk_id string, text string")
    assert [(r.chunk_id, r.score) for r in D.keyword_search(chunks, "riesgo evidencia", 2).collect()] == [("a", 1.0), ("c", 1.0)]
    assert D.keyword_search(chunks, "!!!").count() == 0
    cases = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, [], ["x"])], "case_id int, expected array<string>, retrieved array<string>")
    assert [(r.precision, r.recall) for r in D.evaluate_retrieval(cases).orderBy("case_id").collect()] == [(0.5, 1.0), (0.0, None)]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, ts timestamp, v double"
    spark.sql("select 1L as id, timestamp'2024-01-01 00:10:00' as ts, 2D as v union all select 2L, timestamp'2024-01-01 00:20:00', 3D").write.parquet(src)
    write = lambda df, _: df.write.mode("append").parquet(out)
    for _ in range(2):
        ingest.run_available(ingest.new_files(spark, src, schema), write, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 2
    spark.sql("select 1L as id, timestamp'2024-01-01 00:30:00' as ts, 2D as v").write.mode("append").parquet(src)
    ingest.run_available(ingest.new_files(spark, src, schema), write, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 3
    agg = ingest.windowed(ingest.new_files(spark, src, schema).withColumn("k", F.lit("x")), "ts", "v", "k")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(3, 7.0)]
    seen = ingest.first_of_content(ingest.new_files(spark, src, schema), ["v"], "ts", "1 day")
    q = seen.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_graph_and_vector_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("contract:1", "Contract", "x")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("e1", "PUBLISHED")], "edge_id string, edge_type string")
    for version in (1, 2):
        files.upsert_graph(nodes.withColumn("label", F.lit(f"v{version}")), edges, spark, str(tmp_path / "g"), version)
    assert [r.label for r in files.current(spark, str(tmp_path / "g/nodes")).collect()] == ["v2"] and files.current(spark, str(tmp_path / "g/edges")).count() == 1
    with pytest.raises(ValueError, match="not accepted"):
        files.upsert_graph(nodes.withColumn("node_type", F.lit("Person")), edges, spark, str(tmp_path / "g"), 3)
    v = spark.createDataFrame([("a", [1.0, 2.0])], "c string, vector array<double>").select(files.point_id(F.col("c")).alias("point_id"), "vector")
    for version in (1, 2):
        files.upsert_vectors(v, spark, str(tmp_path / "v"), 2, version)
    assert files.current(spark, str(tmp_path / "v")).count() == 1 and len(v.collect()[0].point_id) == 36
    with pytest.raises(ValueError, match="3 numbers"):
        files.upsert_vectors(v, spark, str(tmp_path / "v"), 3, 3)


def test_reports_corpus_and_batches(spark, tmp_path):
    files.report(spark.sql("select 1 as n, 'á' as x"), str(tmp_path / "r"), "T")
    assert files.read_report(spark, str(tmp_path / "r/report.json")) == {"n": 1, "x": "á"} and "| n | 1 |" in (tmp_path / "r/report.md").read_text()
    (tmp_path / "bad.json").write_text("{")
    assert files.read_report(spark, str(tmp_path / "bad.json")) is None and files.read_report(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("uno")
    (tmp_path / "index.json").write_text('{"documents": [{"path": "a.txt", "contract_key_canon": "K"}, {"path": "b.txt", "contract_key_canon": "L"}]}')
    got = {r.relative_path: r.text for r in files.corpus(spark, str(tmp_path / "index.json"), str(tmp_path / "docs")).collect()}
    assert got == {"a.txt": "uno", "b.txt": None}
    urls = ["https://www.boe.es/diario_boe/txt.php?id=BOE-B-2020-123", "https://evil.example/x?id=BOE-B-2020-123", "https://boe.es/x?id=BOE-A-2020-1", None]
    assert [r.i for r in spark.createDataFrame([(u,) for u in urls], "u string").select(files.notice_url_id(F.col("u")).alias("i")).collect()] == ["BOE-B-2020-123", None, None, None]
    ran = []
    sources = {"docs": str(tmp_path / "docs"), "other": str(tmp_path / "missing")}
    run = lambda n, **kw: ingest.run_batch(spark, sources, str(tmp_path / "state"), ran.append, n, **kw)["status"]
    assert [run("1"), run("2"), run("3", force=True), run("4", blocking=("other",))] == ["done", "unchanged", "done", "blocked"]
    (tmp_path / "docs/a.txt").write_text("dos")
    assert run("5") == "done" and ran == [["docs"]] * 3
    files.sample(spark.createDataFrame([(2, "71000000 b"), (1, "71000000 a"), (0, "x")], "i int, line string"), "line", r"\b71\d{6}\b", 1, "i", str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["71000000 a"]
