"""Members of ZIP and GZIP archives as rows, without unpacking to disk."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = re.compile(rb"<(?:[\w\-]+:)?entry[\s>].*?</(?:[\w\-]+:)?entry>", re.S)
_DELETED = re.compile(rb"<(?:[\w\-]+:)?deleted-entry[\s>].*?(?:</(?:[\w\-]+:)?deleted-entry>|/>)", re.S)


def _opened(uri: str) -> zipfile.ZipFile:
    """An archive of any file system that Arrow knows, read where it lies: only the directory and the members asked for."""
    system, path = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return zipfile.ZipFile(system.open_input_file(path))


def members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, member, size, error: the members of the archives whose names fit the pattern; archives that cannot be read have one row with the reason."""
    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for file in b["path"]:
                try:
                    with _opened(file) as z:
                        rows += [(file, m.filename, m.file_size, None) for m in z.infolist() if wanted.search(m.filename)]
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
                    rows.append((file, "", 0, str(e)))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "error"])

    files = spark.read.format("binaryFile").load(path).select("path")
    found = files.mapInPandas(run, "path string, member string, size bigint, error string")
    return found.repartition(8 * spark.sparkContext.defaultParallelism, "path", "member")  # each member is a row of its own


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_atom, source_kind, position, xml: the entries and deletions of the feeds in the archives.

    The members of the archives are spread over all tasks, each of which holds one member at a time. An archive
    that cannot be read gives one row of kind ``error`` with the reason.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_file", "source_atom", "source_kind", "position", "xml"]
        for b in batches:
            for file, member, error in zip(b["path"], b["member"], b["error"], strict=True):
                name = file.rsplit("/", 1)[-1]
                try:
                    if error:
                        raise OSError(error)
                    with _opened(file) as z:
                        data = z.read(member)
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
                    yield pd.DataFrame([(name, member, "error", 0, str(e))], columns=names)
                    continue
                found = sorted([("entry", *m.span()) for m in _ENTRY.finditer(data)] + [("deleted", *m.span()) for m in _DELETED.finditer(data)], key=lambda x: x[1])
                for i in range(0, len(found), 1000):
                    yield pd.DataFrame([(name, member, kind, at, data[at:end].decode("utf-8", "replace")) for kind, at, end in found[i : i + 1000]], columns=names)

    return members(spark, path, r"\.atom$").mapInPandas(run, "source_file string, source_atom string, source_kind string, position bigint, xml string")


def json_lines(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """source_file, source_year, line: lines of .jsonl, .jsonl.gz and of the members of .zip, of one year where it is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, member, error in zip(b["path"], b["member"], b["error"], strict=True):
                m = re.search(r"(\d{4})\.jsonl?$", member)
                if error or (year is not None and m and int(m[1]) != year):
                    continue
                rows: list[tuple] = []
                with _opened(file) as z, z.open(member) as f:
                    for line in f:
                        if text := line.decode("utf-8", "replace").strip():
                            rows.append((file.rsplit("/", 1)[-1], int(m[1]) if m else None, text))
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=["source_file", "source_year", "line"]).astype({"source_year": "Int32"})
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "source_year", "line"]).astype({"source_year": "Int32"})

    schema = "source_file string, source_year int, line string"
    if path.endswith(".zip"):
        return members(spark, path, r"\.jsonl?$").mapInPandas(run, schema)
    text = spark.read.text(path).where("trim(value) <> ''")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    out = text.select(name.alias("source_file"), F.nullif(F.regexp_extract(name, r"(\d{4})\.jsonl?(?:\.gz)?$", 1), F.lit("")).cast("int").alias("source_year"), F.col("value").alias("line"))
    return out if year is None else out.where(F.coalesce(F.col("source_year"), F.lit(year)) == year)
