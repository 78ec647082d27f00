"""Documents, tables and folder snapshots as sources, and the sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types_

from tesela.functions import text as T


def parquet_columns(spark: SparkSession, path: str, schema: types_.StructType) -> DataFrame:
    """The wanted columns of a Parquet table, nulls where one is missing; an empty table where there is none."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # the path check is the reader's own
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, path, document_type, text, text_hash of text, Markdown and HTML files; HTML is reduced to its text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("html", "htm"), "html").when(suffix.isin("md", "markdown"), "markdown").when(suffix == "txt", "text")
    decoded = F.decode("content", "UTF-8")
    rows = raw.withColumn("document_type", kind).where("document_type is not null").withColumn("text", F.when(F.col("document_type") == "html", T.html_text(decoded)).otherwise(decoded))
    h = F.sha2("text", 256)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select(F.concat(stem, F.lit("-"), F.substring(h, 1, 16)).alias("document_id"), "path", "document_type", "text", h.alias("text_hash"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256, modified of every file below a folder; whether something changed is a join of two of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) between two snapshots."""
    a, b = previous.select("path", F.col("sha256").alias("before")), current.select("path", F.col("sha256").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", kind.alias("change"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, ORC, JSON or CSV; arrays become JSON texts in CSV."""
    if fmt == "csv":
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (types_.ArrayType, types_.MapType, types_.StructType)) else F.col(f.name) for f in df.schema])
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def preview(df: DataFrame, path: str, order: list[str], rows: int = 200) -> None:
    """The first rows in a stated order as one CSV."""
    write_table(df.orderBy(*order).limit(rows).coalesce(1), path, "csv")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table that upsert keeps, in order."""
    system, folder = _file_system(spark, path)
    if not system.exists(folder):
        return []
    new = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit() and system.exists(new(f"{path}/{n}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished version of a table, or None where there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def upsert(df: DataFrame, spark: SparkSession, path: str, key: list[str], newest: str) -> None:
    """Keyed merge into a table: the row with the greatest ``newest`` wins (nulls never do), of equal ones the new row.

    Every merge writes a version beside the last one, which counts once its job has ended; readers see a whole
    version at any time. The two last versions are kept. Nothing is renamed, so any store that Spark writes to will do.
    """
    found = versions(spark, path)
    rows = df.withColumn("__new", F.lit(1))
    if found:
        rows = current(spark, path).withColumn("__new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*key, "__new")]
    best = F.max_by(F.struct(*rest), F.struct(F.col(newest).isNotNull(), newest, "__new")).alias("m")
    rows.groupBy(*key).agg(best).select(*key, "m.*").write.parquet(f"{path}/version={found[-1] + 1 if found else 1}")
    system, _ = _file_system(spark, path)
    for old in found[:-1]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


#: Kinds of nodes and edges that the graph store takes.
NODE_LABELS = ("Contract", "Source", "Buyer", "Supplier", "CPV")
EDGE_TYPES = ("FROM_SOURCE", "PUBLISHED", "AWARDED_TO", "HAS_CPV")


def upsert_graph(nodes: DataFrame, edges: DataFrame, spark: SparkSession, path: str, version: int) -> None:
    """Nodes by node_id and edges by edge_id into the tables below a path; ValueError for unknown kinds and blank ids."""
    for df, name, kind, known in ((nodes, "node_id", "node_type", NODE_LABELS), (edges, "edge_id", "edge_type", EDGE_TYPES)):
        bad = df.where(T.blank(F.col(name)) | F.col(kind).isNull() | ~F.col(kind).isin(*known)).select(name, kind).limit(1).collect()
        if bad:
            raise ValueError(f"not accepted: {bad[0].asDict()}")
    upsert(nodes.withColumn("version", F.lit(version)), spark, f"{path}/nodes", ["node_id"], "version")
    upsert(edges.withColumn("version", F.lit(version)), spark, f"{path}/edges", ["edge_id"], "version")


def upsert_vectors(vectors: DataFrame, spark: SparkSession, path: str, dim: int, version: int) -> None:
    """point_id, vector and payload columns into a vector table; ValueError where a vector hasn't dim numbers or the table holds others."""
    bad = vectors.where(F.coalesce(F.size("vector"), F.lit(-1)) != dim).limit(1).count()
    old = current(spark, path)
    if bad or (old is not None and old.where(F.size("vector") != dim).limit(1).count()):
        raise ValueError(f"vectors must have {dim} numbers")
    upsert(vectors.withColumn("version", F.lit(version)), spark, path, ["point_id"], "version")


def point_id(chunk_id) -> object:
    """Deterministic id of a chunk's point: the same chunk always replaces itself."""
    h = F.sha2(chunk_id, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text to any store that Spark writes to."""
    system, target = _file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_report(spark: SparkSession, path: str) -> dict | None:
    """A JSON report; None where there is none or it isn't one."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return None
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())
        got = json.loads(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def corpus(spark: SparkSession, index: str, root: str) -> DataFrame:
    """Documents that a corpus index names (an object with ``documents``: relative path and further fields), with their texts; those without a file have null texts."""
    named = spark.read.option("multiLine", "true").json(index).select(F.explode("documents").alias("d")).select("d.*").withColumnRenamed("path", "relative_path")
    found = documents(spark, root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", f"^(?:file:/*)?/*{base.lstrip('/')}/", "")
    return named.join(found.withColumn("relative_path", relative).drop("path"), "relative_path", "left")


def notice_url_id(url) -> object:
    """Id of a gazette notice whose address is one of the gazette's own pages, else null."""
    i = F.parse_url(url, F.lit("QUERY"), F.lit("id"))
    ok = F.parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & F.parse_url(url, F.lit("HOST")).rlike(r"(?i)^(www\.)?boe\.(es|example\.invalid)$") & i.rlike(r"^BOE-B-\d{4}-\d{1,9}$")
    return F.when(ok, i)


def snapshot_id(files: DataFrame) -> str:
    """Hash of the paths, sizes and contents of a snapshot in order of path; times don't count."""
    lines = files.select(F.concat_ws("|", "path", "size_bytes", "sha256").alias("x"), F.pmod(F.xxhash64("path"), F.lit(256)).alias("g"))
    parts = lines.groupBy("g").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("x"))), 256).alias("h"))
    return parts.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))), 256).alias("h")).collect()[0]["h"]


def sample(df: DataFrame, column: str, pattern: str, rows: int, order: str, path: str) -> None:
    """The first raw rows in order that fit a pattern, as lines of text (a sample is the feature)."""
    df.where(F.col(column).rlike(pattern)).orderBy(order).limit(rows).select(column).coalesce(1).write.mode("overwrite").text(path)


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    """Table replacement over JDBC; arrays become JSON texts, floating numbers and dates keep their types."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (types_.ArrayType, types_.MapType, types_.StructType)) else F.col(f.name) for f in df.schema])
    flat.write.mode("overwrite").option("truncate", "true").options(**options).jdbc(url, name)


def mask_credentials(url: str) -> str:
    import re

    return re.sub(r"(://[^:/@]+):[^@]*@", r"\1:***@", url)


def report(one_row: DataFrame, path: str, title: str) -> None:
    """A one-row aggregate as JSON and Markdown."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report needs exactly one row")
    values, spark = rows[0].asDict(recursive=True), one_row.sparkSession
    write_text(spark, f"{path}/report.json", json.dumps(values, default=str, ensure_ascii=False, indent=2))
    write_text(spark, f"{path}/report.md", f"# {title}\n\n| metric | value |\n| --- | --- |\n" + "".join(f"| {k} | {v} |\n" for k, v in values.items()))
