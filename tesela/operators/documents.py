"""Chunks, hashes, deterministic vectors, keyword and vector search over documents."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T


def chunks(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, text_hash: sliding windows of characters; blank documents have none."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    step = size - overlap
    some = docs.where(~T.blank(F.col("text")))
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    rows = some.select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "start"))
    rows = rows.select("doc_id", "chunk_index", F.trim(F.substring(F.col("text"), F.col("start") + 1, F.lit(size))).alias("text")).where("text <> ''")
    return rows.select("doc_id", "chunk_index", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", F.sha2("text", 256).alias("text_hash"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, document_id (name and hash), text_hash, n_chars, blank."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-"), F.substring(h, 1, 16)).alias("document_id"), h.alias("text_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), T.blank(F.col("text")).alias("is_blank"))


def hash_vector(text: Column, dim: int = 16) -> Column:
    """Deterministic test vector: the bytes of chained SHA-256 digests, scaled to -1..1."""
    blocks, h = [], F.sha2(F.coalesce(text, F.lit("")), 256)
    for _ in range(-(-dim // 32)):
        blocks.append(h)
        h = F.sha2(F.unhex(h), 256)
    digest = F.concat(*blocks)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)


def keyword_search(chunked: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """chunk_id, score: share of the distinct words of the query that occur in the chunk; ties by chunk_id."""
    import re

    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    if not terms or limit < 1:
        return chunked.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("text")
    hits = functools.reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in terms])
    return chunked.select("chunk_id", (hits / F.lit(len(terms))).alias("score")).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.try_divide(dot, norm(a) * norm(b))


def _nearest(sent, k: int):
    """Best k of a partition for every query of a block, by a matrix product per Arrow batch."""

    def keep(q, i, c):
        order = np.lexsort((i, -c, q))
        q, i, c = q[order], i[order], c[order]
        first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, dtype=int)
        size = np.diff(np.append(first, len(q)))
        rank = np.arange(len(q)) - np.repeat(first, size)
        return q[rank < k], i[rank < k], c[rank < k]

    def run(batches):
        ids, matrix = sent.value
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for b in batches:
            some = b.filter(pc.is_valid(b.column(1)))
            if not some.num_rows or not len(ids):
                continue
            vec = some.column(0).to_numpy(zero_copy_only=False)
            v = np.stack(some.column(1).to_numpy(zero_copy_only=False)).astype(float)
            norm = np.linalg.norm(v, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                c = np.round(matrix @ v.T / norm, 6)
            c[(ids[:, None] == vec[None, :]) | ~np.isfinite(c)] = -2.0
            edge = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(ids), -1.5)
            rows, cols = np.nonzero((c >= edge[:, None]) & (c > -1.5))
            best = keep(*(np.concatenate([x, y]) for x, y in zip(best, (ids[rows], vec[cols], c[rows, cols]), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "cosine"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4_000) -> DataFrame:
    """query_id, vec_id, rank, cosine: the k nearest vectors of each query, exactly, without itself; ties by vec_id.

    The stated queries are taken in blocks of about ``block``, each of which is sent to all tasks; every partition of
    the vectors yields its best k for each, and only those are shuffled. Vectors must have one length; null ones and zeros are near nothing.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        m = np.array([r["embedding"] for r in rows], dtype=float).reshape(len(rows), -1)
        norm = np.linalg.norm(m, axis=1) if len(rows) else np.zeros(0)
        full = norm > 0
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], dtype=np.int64)[full], m[full] / norm[full, None]))
        part = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_nearest(sent, k), "query_id bigint, vec_id bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    near = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "cosine")


def evaluate_retrieval(cases: DataFrame) -> DataFrame:
    """precision and recall of retrieved against expected document ids, per case; null where nothing is expected or found."""
    both = F.size(F.array_intersect("expected", "retrieved"))
    return cases.select("case_id", F.bround(F.try_divide(both, F.nullif(F.size(F.array_distinct("retrieved")), F.lit(0))), 6).alias("precision"), F.bround(F.try_divide(both, F.nullif(F.size(F.array_distinct("expected")), F.lit(0))), 6).alias("recall"))


def search_words(c: Column) -> Column:
    """Distinct words of a question in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def case_hits(chunked: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """case_id, chunk_id, doc_id, rank, score: the k chunks of each case's contract that hold most of the words of its question.

    chunked: doc_id, chunk_id, contract_key_canon, text. cases: case_id, contract_key_canon, question. Ties go to the smaller
    chunk_id; chunks without any word and cases without words have no row. Contracts meet by their key, never all pairs.
    """
    asked = cases.select("case_id", "contract_key_canon", search_words(F.col("question")).alias("terms")).where("size(terms) > 0")
    low = F.lower("text")
    hits = F.size(F.filter("terms", lambda t: F.contains(low, t)))
    rows = chunked.where(~T.blank(F.col("contract_key_canon"))).join(asked, "contract_key_canon").select("case_id", "doc_id", "chunk_id", (hits / F.size("terms")).alias("score")).where("score > 0")
    # the best of parts first, so a contract with many chunks is not ordered in one task
    parted = rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    order = [F.desc("score"), F.col("chunk_id")]
    best = parted.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "part").orderBy(*order))).where(F.col("r") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("rank") <= k).select("case_id", "chunk_id", "doc_id", "rank", "score")


def with_fallback(first: DataFrame, second: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, mode, chunk_id, rank, score: the hits of the first search, those of the second for cases without any, and a row of mode "none" for the rest."""
    one = first.select("case_id", F.lit("vector").alias("mode"), "chunk_id", "rank", "score")
    two = second.join(first.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit("keyword").alias("mode"), "chunk_id", "rank", "score")
    found = one.unionByName(two)
    none = cases.select("case_id").join(found.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit("none").alias("mode"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(none)


def citation(document: Column, chunk: Column, contract: Column) -> Column:
    return F.concat(F.lit("document_id="), document.cast("string"), F.lit("; chunk_id="), chunk, F.lit("; contract_key_canon="), F.coalesce(contract, F.lit("")))


def evidence(hits: DataFrame, chunked: DataFrame) -> DataFrame:
    """case_id, n_hits, citations, excerpts: what each case rests on, in order of rank (a case has at most k hits)."""
    rows = hits.join(chunked.select("chunk_id", "contract_key_canon", "text"), "chunk_id").select("case_id", F.struct("rank", citation(F.col("doc_id"), F.col("chunk_id"), F.col("contract_key_canon")).alias("c"), T.excerpt(F.col("text")).alias("e")).alias("x"))
    by = rows.groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return by.select("case_id", F.size("xs").alias("n_hits"), F.array_join("xs.c", " | ").alias("citations"), F.array_join("xs.e", " | ").alias("excerpts"))


def retrieval_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, evidence_count, precision_at_k, recall of every case with expected(case_id, doc_id) documents; precision is 0 where nothing was found."""
    want = expected.distinct()
    found = hits.select("case_id", "doc_id").join(want.withColumn("right", F.lit(1)), ["case_id", "doc_id"], "left")
    got = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.count("right").alias("relevant"), F.count_distinct(F.when(F.col("right").isNotNull(), F.col("doc_id"))).alias("right_docs"))
    rows = want.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected")).join(got, "case_id", "left").na.fill(0, ["evidence_count", "relevant", "right_docs"])
    return rows.select("case_id", "evidence_count", F.bround(F.coalesce(F.try_divide("relevant", "evidence_count"), F.lit(0.0)), 6).alias("precision_at_k"), F.bround(F.col("right_docs") / F.col("n_expected"), 6).alias("recall"))


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """One row: cases, share with evidence, mean precision and recall (nulls left out)."""
    return metrics.agg(F.count(F.lit(1)).alias("cases"), F.bround(F.avg((F.col("evidence_count") > 0).cast("int")), 6).alias("evidence_ratio"), F.bround(F.avg("precision_at_k"), 6).alias("mean_precision"), F.bround(F.avg("recall"), 6).alias("mean_recall"))


#: The sentence that ends every generated answer.
BOUNDARY = "No se declara fraude."


def cleaned_answer(c: Column, boundary: str = BOUNDARY) -> Column:
    """What follows the thoughts of a model, blanks squeezed, with the boundary sentence where it lacks it."""
    t = T.squeeze(F.when(F.contains(c, F.lit("</think>")), F.regexp_replace(c, r"(?s)^.*?</think>", "")).otherwise(c))
    return F.when(F.contains(F.lower(t), F.lit(boundary.lower())), t).otherwise(F.trim(F.concat(t, F.lit(f" {boundary}"))))


def unsafe(c: Column, safe: list[str], risky: list[str]) -> Column:
    """Whether a text holds a risky phrase once the safe ones are taken out."""
    t = functools.reduce(lambda x, p: F.replace(x, F.lit(p.lower()), F.lit(" ")), safe, F.lower(c))
    return functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(p.lower())) for p in risky], F.lit(False))


def embedded(texts: DataFrame, key: str, embed, dim: int, fallback=None) -> DataFrame:
    """key, vector, model: vectors of a pluggable client, called once per Arrow batch; where it fails, those of the fallback.

    embed: list of texts to list of vectors. Without a fallback a failure is raised; a wrong size of a vector always is.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            said, model = b["text"].fillna("").tolist(), "model"
            try:
                vectors = embed(said)
            except Exception:
                if fallback is None:
                    raise
                vectors, model = fallback(said), "fallback"
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"vectors must have {dim} numbers")
            yield pd.DataFrame({key: b[key], "vector": [list(map(float, v)) for v in vectors], "model": model})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, vector array<double>, model string")
