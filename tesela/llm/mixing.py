"""A mix of sources with target shares of all tokens.

The mix is as large as the caps allow (or as asked for). In each source every document wants
min(max_repeats, c * odds) copies, with c such that the wanted tokens meet the source's share; the whole
part of the copies is certain, and the fractions are drawn by Pareto order sampling: documents are ranked by
their random odds divided by their inclusion odds, and the first are taken until the tokens that are still
due are reached. The cut in the ranking is found by repeated histograms over all documents, so no source is
ever sorted or held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Sources and targets are few; more is refused, as the targets are held by the driver.
SOURCE_BOUND = 10_000


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).limit(SOURCE_BOUND + 1).collect()
    if len(rows) > SOURCE_BOUND:
        raise ValueError(f"more than {SOURCE_BOUND} sources")
    return {r["source"]: (float(r["s"]), int(r["m"]) if r["m"] is not None else 1) for r in rows}


def mix(sized: DataFrame, targets: DataFrame, tokens: int | None = None, odds: str | None = None, seed: int = 11) -> DataFrame:
    """source, doc_id, n_tokens, copies of every document that is used at least once.

    sized: doc_id, source, n_tokens and, where named, relative odds (null or not positive: never drawn).
    Documents without tokens, of null sources or of sources without a target are not used. A source without
    documents is left out and the shares of the others are kept in proportion. Ties in the ranking are broken
    by doc_id; repeated texts are documents of their own; empty tables give an empty mix.
    """
    wanted = _targets(targets)
    w = F.col(odds).cast("double") if odds else F.lit(1.0)
    docs = sized.where("n_tokens > 0").select("source", "doc_id", "n_tokens", w.alias("w")).where("w > 0")
    names = F.create_map(*[x for s in wanted for x in (F.lit(s), F.lit(wanted[s][1]))]) if wanted else F.create_map(F.lit(""), F.lit(0))
    docs = docs.where(F.col("source").isin(*wanted)).withColumn("most", names[F.col("source")])
    have = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    wanted = {s: v for s, v in wanted.items() if have.get(s)}
    total_share = sum(v[0] for v in wanted.values())
    largest = min((v[1] * have[s] * total_share / v[0] for s, v in wanted.items()), default=0.0)
    size = min(largest, float(tokens)) if tokens is not None else largest
    due = {s: size * v[0] / total_share for s, v in wanted.items()}
    factor = _factors(docs, wanted, due, have)
    schema = "source string, doc_id bigint, n_tokens bigint, copies int"
    if not wanted:
        return sized.sparkSession.createDataFrame([], schema)
    c = F.create_map(*[x for s, f in factor.items() for x in (F.lit(s), F.lit(float(f)))])
    want = F.least(F.col("most").cast("double"), c[F.col("source")] * F.col("w"))
    # whole numbers that floating point misses by a hair are whole
    docs = docs.withColumn("want", want).withColumn("sure", F.floor(F.col("want") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("want") - F.col("sure")))
    sure = {r["source"]: r["t"] or 0 for r in docs.groupBy("source").agg(F.sum(F.col("sure") * F.col("n_tokens")).alias("t")).collect()}
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(2**53)
    ratio = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    docs = docs.withColumn("q", F.when(F.col("part") > 1e-9, ratio / (1 + ratio)))  # in (0, 1), in the order of the ratio
    rest = {s: due[s] - sure.get(s, 0) for s in due}
    cut, tie = _cuts(docs, rest)
    q_cut = F.create_map(*[x for s, v in cut.items() for x in (F.lit(s), F.lit(float(v)))])
    id_cut = F.create_map(*[x for s, v in tie.items() for x in (F.lit(s), F.lit(int(v)).cast("bigint"))])
    s = F.col("source")
    drawn = (F.col("q") < q_cut[s]) | ((F.col("q") == q_cut[s]) & (F.col("doc_id") <= id_cut[s]))
    copies = (F.col("sure") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)).cast("int")
    return docs.select("source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def _factors(docs: DataFrame, wanted: dict, due: dict, have: dict) -> dict[str, float]:
    """c of each source: capped documents give max_repeats each, the others share what is left by their odds."""
    c = {s: 0.0 for s in due}
    for _ in range(60):
        m = F.create_map(*[x for s in c for x in (F.lit(s), F.lit(c[s]))]) if c else None
        if m is None:
            return c
        full = (m[F.col("source")] * F.col("w") >= F.col("most")) & (m[F.col("source")] > 0)
        rows = docs.groupBy("source").agg(F.sum(F.when(full, F.col("most") * F.col("n_tokens")).otherwise(0)).alias("a"), F.sum(F.when(~full, F.col("w") * F.col("n_tokens")).otherwise(0.0)).alias("b")).collect()
        new = {r["source"]: max(c[r["source"]], (due[r["source"]] - r["a"]) / r["b"]) if r["b"] else c[r["source"]] for r in rows if r["source"] in c}
        if all(abs(new[s] - c[s]) <= 1e-12 * max(1.0, new[s]) for s in new):
            return new
        c = new
    return c


def _cuts(docs: DataFrame, rest: dict[str, float], few: int = 20_000) -> tuple[dict[str, float], dict[str, int]]:
    """Per source the last drawn (q, doc_id), such that the tokens up to it come nearest to what is due."""
    lo, hi, before = {s: 0.0 for s in rest}, {s: 1.0 for s in rest}, {s: 0.0 for s in rest}
    open_ = {s for s, r in rest.items() if r > 0}
    cut, tie = {s: -1.0 for s in rest}, {s: -1 for s in rest}
    while open_:  # each round leaves one bin of BINS, until it holds few documents or one value
        names = sorted(open_)
        a = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(lo[s]))])[F.col("source")]
        b = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(hi[s]))])[F.col("source")]
        inside = docs.where(F.col("source").isin(*names) & F.col("q").isNotNull()).withColumn("a", a).withColumn("b", b).where("q >= a and q < b")
        bins = inside.withColumn("i", F.least(F.lit(BINS - 1), F.floor((F.col("q") - F.col("a")) / (F.col("b") - F.col("a")) * BINS)).cast("int"))
        rows = bins.groupBy("source", "i").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("q").alias("q0"), F.max("q").alias("q1")).collect()  # at most BINS rows a source
        by: dict[str, list] = {s: [] for s in names}
        for r in rows:
            by[r["source"]].append(r)
        narrow: dict[str, tuple[float, float]] = {}
        for s in names:
            at = before[s]
            hit = None
            for r in sorted(by[s], key=lambda r: r["i"]):
                if at + r["t"] >= rest[s]:
                    hit = r
                    break
                at += r["t"]
            if hit is None:  # all that is left is drawn
                cut[s], tie[s] = (hi[s], 2**63 - 1) if hi[s] < 1 else (1.0, 2**63 - 1)
                open_.discard(s)
                continue
            before[s] = at
            if hit["n"] > few and hit["q0"] == hit["q1"]:
                cut[s], tie[s] = hit["q0"], _last_of_tie(docs, s, hit["q0"], rest[s] - at)
                open_.discard(s)
            elif hit["n"] <= few:
                narrow[s] = (hit["q0"], hit["q1"])
                open_.discard(s)
            else:
                lo[s], hi[s] = hit["q0"], _above(hit["q1"])
        for s, (q0, q1) in narrow.items():
            inside = docs.where((F.col("source") == s) & (F.col("q") >= q0) & (F.col("q") <= q1)).select("q", "doc_id", "n_tokens").orderBy("q", "doc_id").limit(few).collect()
            at = before[s]
            for r in inside:
                if abs(at + r["n_tokens"] - rest[s]) > abs(at - rest[s]):
                    break
                at += r["n_tokens"]
                cut[s], tie[s] = r["q"], r["doc_id"]
            else:
                if not inside:
                    cut[s] = q0
            if cut[s] < 0:
                cut[s], tie[s] = q0, -1
    return cut, tie


def _last_of_tie(docs: DataFrame, source: str, q: float, due: float) -> int:
    """The greatest doc_id up to which the documents of one q have at most the tokens that are due, by halving the range of ids."""
    same = docs.where((F.col("source") == source) & (F.col("q") == q))
    ends = same.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()[0]
    lo, hi = ends["lo"] - 1, ends["hi"]
    while lo < hi:
        mid = (lo + hi + 1) // 2
        t = same.where(F.col("doc_id") <= mid).agg(F.sum("n_tokens").alias("t")).collect()[0]["t"] or 0
        lo, hi = (mid, hi) if t <= due else (lo, mid - 1)
    return lo


def _above(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_docs, n_tokens (with repeats), most_copies, share: what the mix reached."""
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("n_tokens").alias("all_tokens"))
    out = targets.select("source", "target_share").join(by, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"))
