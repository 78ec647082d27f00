"""Texts into containers of fixed capacity, with little room left.

First-fit decreasing over a tournament tree of the room left in the containers, run independently in
randomised groups of documents: the number of groups follows the number of documents, so a group holds
about GROUP of them at every size. A text that exceeds the capacity is cut into full containers and one
rest, which is packed like any other text; nothing else is ever cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a group, on average.
GROUP = 10_000
_OUT = "pack_name string, doc_id bigint, piece int, first_token bigint, n_tokens bigint, container string"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (all at most capacity), larger first, ties in the order given."""
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # the most room in the containers below each node
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < s:
                at += 1
        out[i] = at - leaves
        tree[at] -= s
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            top = left if left >= right else right
            if tree[at] == top:
                break
            tree[at] = top
            at //= 2
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    name, group, capacity = pdf["pack_name"].iloc[0], pdf["g"].iloc[0], int(pdf["capacity_tokens"].iloc[0])
    pdf = pdf.sort_values("doc_id", kind="stable")
    ids, sizes = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
    full = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - full * capacity
    at = np.flatnonzero(rest > 0)
    bins = first_fit_decreasing(rest[at], capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    parts = [pd.DataFrame({"doc_id": ids[at], "piece": full[at] + 1, "first_token": full[at] * capacity, "n_tokens": rest[at], "no": bins})]
    big = np.flatnonzero(full > 0)
    if len(big):
        who = np.repeat(big, full[big])
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full[big]) - full[big], full[big])
        parts.append(pd.DataFrame({"doc_id": ids[who], "piece": piece + 1, "first_token": piece * capacity, "n_tokens": capacity, "no": used + np.arange(len(who))}))
    out = pd.concat(parts)
    out["container"] = [f"{name}-{group}-{n}" for n in out["no"]]
    out["pack_name"] = name
    return out[["pack_name", "doc_id", "piece", "first_token", "n_tokens", "container"]].astype({"piece": "int32"})


def pack(sized: DataFrame, capacities: DataFrame, group: int = GROUP, seed: int = 7) -> DataFrame:
    """pack_name, doc_id, piece (from 1), first_token (from 0), n_tokens, container.

    sized: doc_id, n_tokens. capacities: pack_name, capacity_tokens (a few rows; null or capacities under 1
    are left out). Texts without tokens (null, empty) take no room and are in no container; equal sizes are
    packed in order of doc_id; repeated texts are packed each; an empty table gives an empty result.
    """
    some = sized.where("n_tokens > 0").select("doc_id", "n_tokens")
    groups = max(1, -(-some.count() // group))
    packs = capacities.where("capacity_tokens >= 1").select("pack_name", "capacity_tokens")
    salted = some.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(groups)))
    rows = salted.join(F.broadcast(packs.limit(1000)), F.lit(True)) if packs.count() <= 1000 else salted.join(packs, F.lit(True))
    return rows.groupBy("pack_name", "g").applyInPandas(_pack, _OUT)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_name, containers, n_tokens, n_cut (texts cut), fill (share of the room that is used)."""
    by = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"))
    room = by.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("n_tokens"))
    cut = packed.where("piece = 2 or (piece = 1 and first_token > 0)").groupBy("pack_name").agg(F.countDistinct("doc_id").alias("n_cut"))
    out = room.join(cut, "pack_name", "left").join(capacities.select("pack_name", "capacity_tokens"), "pack_name")
    return out.select("pack_name", "containers", "n_tokens", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
