"""Property graph of contracts: construction, degrees, components, communities, modularity, betweenness, features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.session import cut

#: Edges up to which a task of betweenness holds the whole graph.
PACKED_EDGES = 12_000_000


def _entity(strong: Column, name: Column) -> Column:
    return F.when(~T.blank(strong), T.stable_key(strong)).when(~T.blank(name), T.stable_key(name))


def _cpv(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit(r"\b\d{8}(?:-\d)?\b|\b\d{2,7}\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit("-"), F.lit(1))))


def build_edges(contracts: DataFrame) -> DataFrame:
    """edge_id, source_node_id, target_node_id, edge_type, contract_key_canon, source, source_record_id; each edge once.

    Rows without key or source give no edge. Relations that a row lacks are left out.
    """
    some = contracts.where(~T.blank(F.col("contract_key_canon")) & ~T.blank(F.col("source")))
    c = F.concat(F.lit("contract:"), T.stable_key(F.col("contract_key_canon")))
    buyer, supplier = _entity(F.col("buyer_id"), F.col("buyer_name")), _entity(F.col("supplier_id"), F.col("supplier_name"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("edge_type"), a.alias("source_node_id"), b.alias("target_node_id"))
    fixed = F.array(
        edge("FROM_SOURCE", c, F.concat(F.lit("source:"), T.stable_key(F.col("source")))),
        F.when(buyer.isNotNull(), edge("PUBLISHED", F.concat(F.lit("buyer:"), buyer), c)),
        F.when(supplier.isNotNull(), edge("AWARDED_TO", c, F.concat(F.lit("supplier:"), supplier))),
    )
    codes = F.transform(F.coalesce(_cpv(F.col("cpv_codes_raw")), F.array().cast("array<string>")), lambda x: edge("HAS_CPV", c, F.concat(F.lit("cpv:"), x)))
    rows = some.select("row_id", "contract_key_canon", "source", "source_record_id", F.explode(F.array_compact(F.concat(fixed, codes))).alias("e"))
    rows = rows.select("row_id", "contract_key_canon", "source", "source_record_id", "e.*")
    rows = rows.withColumn("edge_id", F.concat("edge_type", F.lit(":"), "source_node_id", F.lit("->"), "target_node_id", F.lit(":"), "contract_key_canon"))
    first = F.min(F.struct("row_id", "source", "source_record_id")).alias("m")
    return rows.groupBy("edge_id", "source_node_id", "target_node_id", "edge_type", "contract_key_canon").agg(first).select("edge_id", "source_node_id", "target_node_id", "edge_type", "contract_key_canon", "m.source", "m.source_record_id")


def nodes_of(edges: DataFrame) -> DataFrame:
    """node_id and node_type of every end of an edge."""
    both = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct()
    return both.select("node_id", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("node_type"))


def simple(edges: DataFrame) -> DataFrame:
    """a < b and edge_count: the undirected graph without loops."""
    s, t = F.col("source_node_id"), F.col("target_node_id")
    return edges.where(s != t).groupBy(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).agg(F.count(F.lit(1)).alias("edge_count"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def degrees(pairs: DataFrame) -> DataFrame:
    """node_id, neighbor_count, degree_centrality."""
    d = both_ways(pairs).groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("neighbor_count"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node_id", "neighbor_count", F.bround(F.try_divide("neighbor_count", F.col("n") - 1), 10).alias("degree_centrality"))


#: Parts in which the edges of a hub meet its minimum.
SALTS = 8


def components(pairs: DataFrame) -> DataFrame:
    """node_id and component (its smallest node), by large-star and small-star rounds until nothing changes.

    Every round keeps the number of edges or lowers it, and stars are merged in a number of rounds that grows
    with the logarithm of the graph. Minima are merged before the shuffle. The edges of a hub meet its minimum
    in parts: both sides are salted by the other end of the edge, so no task holds all edges of a hub.
    """
    edges = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        large = both.where("v > u").withColumn("s", salt("v")).join(spread, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.withColumn("s", salt("v")).join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")), ["u", "s"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        # number of edges and an order-free checksum: the same once no edge has changed
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    star = edges.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    every = both_ways(pairs).select(F.col("u").alias("node_id")).distinct()
    return every.join(star, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def modularity(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row with the modularity of groups(node_id, community); null without edges."""
    m = pairs.agg(F.count(F.lit(1)).alias("m"))
    c = pairs.join(groups.select(F.col("node_id").alias("a"), F.col("community").alias("ca")), "a").join(groups.select(F.col("node_id").alias("b"), F.col("community").alias("cb")), "b")
    inside = c.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    degree = c.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    joined = degree.join(inside, "community", "left").crossJoin(F.broadcast(m))
    return joined.agg(F.bround(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 10).alias("modularity"))


def communities(pairs: DataFrame, settled: float = 0.01) -> DataFrame:
    """node_id and community by distributed local moving over several levels.

    In each round half of the nodes (by a hash that changes each round) move to the neighbouring community with
    the greatest gain in modularity; ties keep the own community. A level ends once at most the share ``settled``
    of its nodes wants to move. Then communities become the nodes of the next level, their links weighted, until
    no community joins another.
    """
    edges = cut(both_ways(pairs).withColumn("w", F.lit(1)))
    m2 = max(1, edges.count())
    whole = edges.select(F.col("u").alias("node_id"), F.col("u").alias("community")).distinct()
    level = 0
    while True:
        groups, moved = _local_moving(edges, m2, settled, 1000 * level)
        level += 1
        whole = cut(whole.join(groups.select(F.col("node_id").alias("community"), F.col("community").alias("next")), "community").select("node_id", F.col("next").alias("community")))
        if not moved:
            break
        a, b = groups.select(F.col("node_id").alias("u"), F.col("community").alias("cu")), groups.select(F.col("node_id").alias("v"), F.col("community").alias("cv"))
        edges = cut(edges.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    return whole


def _local_moving(edges: DataFrame, m2: int, settled: float, salt: int) -> tuple[DataFrame, bool]:
    degree = cut(edges.groupBy("u").agg(F.sum("w").alias("k")))
    groups = degree.select(F.col("u").alias("node_id"), F.col("u").alias("community"))
    moved, i, fewest = False, 0, None
    while True:
        i += 1
        total = groups.join(degree, groups["node_id"] == degree["u"]).groupBy("community").agg(F.sum("k").alias("tot"))
        near = edges.where("u <> v").join(groups, F.col("v") == F.col("node_id")).groupBy("u", "community").agg(F.sum("w").alias("links"))
        own = groups.select(F.col("node_id").alias("u"), F.col("community").alias("own"))
        stay = own.select("u", F.col("own").alias("community"), F.lit(0).cast("bigint").alias("links"))
        options = near.unionByName(stay).groupBy("u", "community").agg(F.sum("links").alias("links"))
        options = options.join(total, "community").join(degree, "u").join(own, "u")
        rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("links") - rest * F.col("k") / F.lit(m2), 9)
        best = options.groupBy("u", "own").agg(F.max_by("community", F.struct(gain, (F.col("community") == F.col("own")).cast("int"), F.col("community"))).alias("best"))
        goes = (F.pmod(F.xxhash64("u", F.lit(salt + i)), F.lit(2)) == 0) & (F.col("best") != F.col("own"))
        new = cut(best.select(F.col("u").alias("node_id"), F.when(goes, F.col("best")).otherwise(F.col("own")).alias("community"), goes.alias("moved"), (F.col("best") != F.col("own")).alias("wants")))
        groups = new.select("node_id", "community")
        state = new.agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"), F.count_if("wants").alias("wants")).collect()[0]
        moved = moved or bool(state["moved"])
        # nodes that trade places for ever are settled once they get no fewer over two rounds
        if state["wants"] <= settled * state["n"] or (fewest is not None and i > 3 and state["wants"] >= fewest[-2:][0]):
            break
        fewest = [*(fewest or []), state["wants"]]
    return groups, moved


def betweenness(pairs: DataFrame, pivots: int = 500, seed: int = 42, exact: int = 1000, packed_edges: int = PACKED_EDGES) -> DataFrame:
    """node_id and betweenness from the shortest paths of ``pivots`` nodes (of all nodes up to ``exact``), normalised.

    Up to ``packed_edges`` edges every task holds the numbered graph and takes a share of the pivots, one by one.
    Beyond that, breadth first for all pivots together by joins: rows number pivots times nodes, no task holds the graph.
    """
    edges = cut(both_ways(pairs).distinct())
    nodes = cut(edges.select(F.col("u").alias("node")).distinct().select("node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    n = nodes.count()
    pivots = max(pivots, n) if n <= exact else pivots
    chosen = nodes.select("node").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(pivots)
    k = min(pivots, n)
    if n < 3:
        return nodes.select(F.col("node").alias("node_id"), F.lit(0.0).alias("betweenness"))
    total = _packed_dependencies(edges, nodes, chosen, n) if edges.count() <= 2 * packed_edges else _joined_dependencies(edges, chosen)
    scale = n / k / ((n - 1) * (n - 2))
    summed = total.groupBy(F.col("node").alias("node_id")).agg((F.sum("delta") * scale).alias("b"))
    return nodes.select(F.col("node").alias("node_id")).join(summed, "node_id", "left").select("node_id", F.bround(F.coalesce("b", F.lit(0.0)), 10).alias("betweenness"))


def _packed_dependencies(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """node and delta: sums of the dependencies of shares of the chosen nodes, each share in one task that holds all edges."""
    counts = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    ids = cut(nodes.join(before, "part").select("node", (F.col("at") + F.col("before")).cast("int").alias("i")))
    sources = np.array([r["i"] for r in ids.join(chosen, "node").orderBy("i").collect()])
    ends = edges.where("u < v").join(ids.select(F.col("node").alias("u"), F.col("i").alias("a")), "u").join(ids.select(F.col("node").alias("v"), F.col("i").alias("b")), "v").select("a", "b")
    shares = min(len(sources), 64, 2 * edges.sparkSession.sparkContext.defaultParallelism)
    blocks = ends.mapInArrow(_blocks, "ends binary").select("ends", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def share(batches):
        parts, at = [], None
        for x in batches:
            for row in x.to_pylist():
                at = row["share"]
                parts.append(np.frombuffer(row["ends"], "<i4").reshape(2, -1))
        if at is None:
            return
        first, near = _adjacency(n, np.concatenate(parts, axis=1))
        parts.clear()
        total = np.zeros(n)
        for source in sources[at::shares]:
            total += _dependencies(first, near, int(source))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            k = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(k.astype("int32")), "delta": pa.array(total[k])})

    found = blocks.repartitionById(shares, F.col("share")).mapInArrow(share, "i int, delta double")
    return found.groupBy("i").agg(F.sum("delta").alias("delta")).join(ids, "i").select("node", "delta")


def _blocks(batches):
    """Each batch of edges as one text of its numbers."""
    for x in batches:
        if x.num_rows:
            ends = np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]).astype("<i4")
            yield pa.RecordBatch.from_pydict({"ends": pa.array([ends.tobytes()], pa.binary())})


def _adjacency(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of each node begin, and the neighbours."""
    u, v = np.concatenate([ends[0], ends[1]]), np.concatenate([ends[1], ends[0]])
    first = np.zeros(n + 1, "int64")
    np.cumsum(np.bincount(u, minlength=n), out=first[1:])
    return first, v[np.argsort(u, kind="stable")]


def _add_at(sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    if 8 * len(at) > len(sums):
        sums += np.bincount(at, values, len(sums))
    else:
        np.add.at(sums, at, values)


def _dependencies(first: np.ndarray, near: np.ndarray, source: int) -> np.ndarray:
    """The dependency of a source on every node (Brandes), level by level; the edges of a level are read in slices."""
    n = len(first) - 1
    depth, sigma = np.full(n, -1, "int32"), np.zeros(n)
    depth[source], sigma[source] = 0, 1.0
    front, tree = np.array([source], "int32"), []
    while len(front):
        links = []
        upto = np.cumsum(first[front + 1] - first[front])
        slice_ = max(n, 1 << 20)
        for part in np.split(front, np.searchsorted(upto, np.arange(slice_, upto[-1], slice_))):
            if not len(part):
                continue
            count = first[part + 1] - first[part]
            end = np.cumsum(count)
            v = near[np.arange(end[-1]) + np.repeat(first[part] - end + count, count)]
            new = depth[v] < 0
            links.append((np.repeat(part, count)[new], v[new]))
        tree.append([(u, v) for u, v in links if len(v)])
        for u, v in tree[-1]:
            _add_at(sigma, v, sigma[u])
            depth[v] = len(tree)
        some = sum(len(v) for _, v in tree[-1])
        if 8 * some > n:
            front = np.flatnonzero(depth == len(tree)).astype("int32")
        else:
            front = np.unique(np.concatenate([np.empty(0, "int32"), *[v for _, v in tree[-1]]]))
    delta = np.zeros(n)
    for links in reversed(tree):
        for u, v in links:
            _add_at(delta, u, sigma[u] / sigma[v] * (1 + delta[v]))
    delta[source] = 0
    return delta


def _joined_dependencies(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and delta of all chosen nodes: breadth first level by level, then dependencies back up the levels, by joins."""
    levels = [cut(chosen.select(F.col("node").alias("p"), "node", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("p", "node")
    while True:
        front = levels[-1].join(edges, F.col("node") == F.col("u")).groupBy("p", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
        front = cut(front.join(seen, ["p", "node"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("p", "node"))
    delta = levels[-1].select("p", "node", "sigma", F.lit(0.0).alias("delta"))
    parts = []
    for upper in reversed(levels[:-1]):
        parts.append(delta.select("p", "node", "delta"))
        below = delta.select("p", F.col("node").alias("w"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        up = upper.join(edges, F.col("node") == F.col("u")).join(below, (F.col("v") == F.col("w")) & (upper["p"] == below["p"])).select(upper["p"], "node", (F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("d"))
        delta = cut(upper.join(up.groupBy("p", "node").agg(F.sum("d").alias("d")), ["p", "node"], "left").select("p", "node", "sigma", F.coalesce("d", F.lit(0.0)).alias("delta")))
    total = parts[0] if parts else delta.select("p", "node", "delta")
    for x in parts[1:]:
        total = total.unionByName(x)
    return total.where("p <> node").select("node", "delta")


def contract_features(edges: DataFrame) -> DataFrame:
    """Per contract: buyer, supplier, recurrence of the pair, degrees of both, the pair's share, number of codes."""
    buyer = edges.where("edge_type = 'PUBLISHED'").groupBy(F.col("target_node_id").alias("contract")).agg(F.min("source_node_id").alias("buyer"))
    out = edges.where("edge_type <> 'PUBLISHED'").groupBy(F.col("source_node_id").alias("contract")).agg(F.min(F.when(F.col("edge_type") == "AWARDED_TO", F.col("target_node_id"))).alias("supplier"), F.count_distinct(F.when(F.col("edge_type") == "HAS_CPV", F.col("target_node_id"))).alias("cpv_count"))
    rows = out.join(buyer, "contract", "left")
    pairs = rows.where("buyer is not null and supplier is not null").groupBy("buyer", "supplier").agg(F.count(F.lit(1)).alias("recurrence"))
    by_buyer = pairs.groupBy("buyer").agg(F.sum("recurrence").alias("awarded"), F.count(F.lit(1)).alias("buyer_degree"))
    by_supplier = pairs.groupBy("supplier").agg(F.sum("recurrence").alias("supplier_contracts"), F.count(F.lit(1)).alias("supplier_degree"))
    joined = rows.join(pairs, ["buyer", "supplier"], "left").join(by_buyer, "buyer", "left").join(by_supplier, "supplier", "left")
    return joined.select("contract", "buyer", "supplier", "cpv_count", F.coalesce("recurrence", F.lit(0)).alias("recurrence"), F.bround(F.when(F.col("supplier").isNotNull(), F.try_divide("recurrence", "awarded")), 6).alias("share"), "buyer_degree", "supplier_degree", "supplier_contracts", F.col("supplier").isNotNull().alias("has_supplier"))


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """Edges at a node: two equality filters, each of which a scan can push down."""
    return edges.where(F.col("source_node_id") == node).unionByName(edges.where((F.col("target_node_id") == node) & (F.col("source_node_id") != node))).distinct()


def subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among chosen(node_id)."""
    return edges.join(chosen.select(F.col("node_id").alias("source_node_id")), "source_node_id", "left_semi").join(chosen.select(F.col("node_id").alias("target_node_id")), "target_node_id", "left_semi").select(*edges.columns)


def top_entities(edges: DataFrame, edge_type: str, limit: int = 10) -> DataFrame:
    """The buyers (PUBLISHED) or suppliers (AWARDED_TO) with most contracts; ties by name."""
    who, what = ("source_node_id", "target_node_id") if edge_type == "PUBLISHED" else ("target_node_id", "source_node_id")
    return edges.where(F.col("edge_type") == edge_type).groupBy(F.col(who).alias("node_id")).agg(F.count_distinct(what).alias("contracts")).orderBy(F.desc("contracts"), "node_id").limit(limit)


NODE_TYPES = {"contract": "Contract", "source": "Source", "buyer": "Buyer", "supplier": "Supplier", "cpv": "CPV"}


def build_nodes(contracts: DataFrame) -> DataFrame:
    """node_id, node_type, label and attributes (map of texts) of every node that build_edges connects; the row of smallest row_id names it.

    Rows without key or source give no node. Attributes: of contracts key, source, record id and title, of buyers and suppliers their id.
    """
    some = contracts.where(~T.blank(F.col("contract_key_canon")) & ~T.blank(F.col("source")))
    buyer, supplier = _entity(F.col("buyer_id"), F.col("buyer_name")), _entity(F.col("supplier_id"), F.col("supplier_name"))
    text = lambda c: T.or_null(F.col(c))

    def attributes(**named: Column) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())

    def node(kind: str, key: Column, label: Column, extra: Column) -> Column:
        node_id = F.concat(F.lit(f"{kind}:"), key)
        return F.when(key.isNotNull(), F.struct(node_id.alias("node_id"), F.lit(NODE_TYPES[kind]).alias("node_type"), F.coalesce(label, node_id).alias("label"), extra.alias("attributes")))

    none = F.create_map().cast("map<string,string>")
    codes = F.transform(F.coalesce(_cpv(F.col("cpv_codes_raw")), F.array().cast("array<string>")), lambda x: node("cpv", x, x, none))
    fixed = F.array(
        node("contract", T.stable_key(F.col("contract_key_canon")), text("contract_key_canon"), attributes(contract_key_canon=text("contract_key_canon"), source=text("source"), source_record_id=text("source_record_id"), contract_title=text("contract_title"))),
        node("source", T.stable_key(F.col("source")), text("source"), none),
        node("buyer", buyer, text("buyer_name"), attributes(buyer_id=text("buyer_id"))),
        node("supplier", supplier, text("supplier_name"), attributes(supplier_id=text("supplier_id"))),
    )
    rows = some.select("row_id", F.explode(F.array_compact(F.concat(fixed, codes))).alias("n"))
    # the order of the first row and its texts; maps can't be compared, so their JSON is
    first = F.min(F.struct("row_id", F.col("n.label").alias("label"), F.to_json("n.attributes").alias("json"))).alias("m")
    out = rows.groupBy(F.col("n.node_id").alias("node_id"), F.col("n.node_type").alias("node_type")).agg(first)
    return out.select("node_id", "node_type", F.col("m.label").alias("label"), F.from_json("m.json", "map<string,string>").alias("attributes"))


def sized_groups(groups: DataFrame, group: str) -> DataFrame:
    """node_id, group_id, group_size: groups numbered from 0 by falling size, ties by their smallest node.

    The groups are numbered by a range sort and prefix sums over its partitions, so no task holds all of them.
    """
    by = groups.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"), F.min("node_id").alias("least"))
    laid = cut(by.repartitionByRange(F.col("group_size").desc(), "least").sortWithinPartitions(F.desc("group_size"), "least").select("*", F.spark_partition_id().alias("part")).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    numbered = laid.join(before, "part").select(group, (F.col("at") + F.col("before")).alias("group_id"), "group_size")
    return groups.join(numbered, group).select("node_id", "group_id", "group_size")


def community_table(pairs: DataFrame, communities: DataFrame, components_: DataFrame) -> DataFrame:
    """Per community: its first component, components, nodes by type and edges inside. communities: node_id, community_id; components_: node_id, component_id."""
    kind = F.split_part("node_id", F.lit(":"), F.lit(1))
    nodes = communities.join(components_, "node_id", "left").groupBy("community_id").agg(
        F.min("component_id").alias("component_id"), F.count_distinct("component_id").alias("component_count"), F.count(F.lit(1)).alias("node_count"), *[F.count_if(kind == k).alias(f"{k}_count") for k in ("contract", "buyer", "supplier", "cpv", "source")]
    )
    a, b = communities.select(F.col("node_id").alias("a"), F.col("community_id").alias("ca")), communities.select(F.col("node_id").alias("b"), F.col("community_id").alias("cb"))
    inside = pairs.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community_id")).agg(F.count(F.lit(1)).alias("internal_edge_count"))
    return nodes.join(inside, "community_id", "left").withColumn("internal_edge_count", F.coalesce("internal_edge_count", F.lit(0)))


def largest_groups(table_: DataFrame) -> DataFrame:
    """One row: number of groups and the most nodes and most contracts of one."""
    return table_.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("node_count"), F.lit(0)).alias("most_nodes"), F.coalesce(F.max("contract_count"), F.lit(0)).alias("most_contracts"))


def traversal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """contract, buyer, supplier and their labels: the two steps from buyer to contract to supplier; contracts without either are left out."""
    a = edges.where("edge_type = 'PUBLISHED'").select(F.col("target_node_id").alias("contract"), F.col("source_node_id").alias("buyer")).distinct()
    b = edges.where("edge_type = 'AWARDED_TO'").select(F.col("source_node_id").alias("contract"), F.col("target_node_id").alias("supplier")).distinct()
    label = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    return a.join(b, "contract").join(label("contract"), "contract", "left").join(label("buyer"), "buyer", "left").join(label("supplier"), "supplier", "left").select("contract", "contract_label", "buyer", "buyer_label", "supplier", "supplier_label")


def feature_table(edges: DataFrame, nodes: DataFrame, entity: DataFrame, version: str, generated_at: str) -> DataFrame:
    """The 25 features of every contract node.

    nodes: build_nodes(). entity: node_id, neighbor_count, degree_centrality, betweenness_centrality, component_id,
    component_size, community_id, community_size; nodes it lacks get 0 as contracts and null as buyers and suppliers.
    """
    relations = contract_features(edges)
    own = nodes.where("node_type = 'Contract'").select(F.col("node_id").alias("contract"), F.col("attributes.contract_key_canon").alias("contract_key_canon"), F.col("attributes.source").alias("source"), F.col("attributes.source_record_id").alias("source_record_id"))

    def of(name: str, prefix: str, *columns: str) -> DataFrame:
        return entity.select(F.col("node_id").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in columns])

    measures = ("neighbor_count", "degree_centrality", "betweenness_centrality")
    rows = own.join(relations, "contract", "left").join(of("contract", "contract_", *measures, "component_id", "component_size", "community_id", "community_size"), "contract", "left").join(of("buyer", "buyer_", *measures), "buyer", "left").join(of("supplier", "supplier_", *measures), "supplier", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.select(
        "contract_key_canon", "source", "source_record_id", F.coalesce("recurrence", F.lit(0)).alias("buyer_supplier_recurrence"), F.coalesce("share", F.lit(0.0)).alias("buyer_supplier_contract_share"), "buyer_degree", "supplier_degree", F.col("supplier_contracts").alias("supplier_contracts_count"),
        zero("contract_neighbor_count", 0), zero("contract_degree_centrality", 0.0), zero("contract_betweenness_centrality", 0.0), *[F.col(f"{e}_{m}") for e in ("buyer", "supplier") for m in measures], *[F.col(f"contract_{c}").alias(c) for c in ("component_id", "component_size", "community_id", "community_size")],
        zero("cpv_count", 0), F.coalesce("has_supplier", F.lit(False)).alias("has_supplier"), F.lit(version).alias("agent3_version"), F.lit(generated_at).alias("generated_at_utc"),
    )


def top_nodes(entity: DataFrame, node_type: str, metric: str, limit: int = 10) -> DataFrame:
    """Nodes of one type by falling metric, then neighbours, then rising node_id."""
    return entity.where(F.split_part("node_id", F.lit(":"), F.lit(1)) == node_type).orderBy(F.desc(metric), F.desc("neighbor_count"), "node_id").limit(limit)


def focus_subgraph(edges: DataFrame, ranked: DataFrame, metric: str, limit: int, focus: str | None = None) -> DataFrame:
    """Edges among the ``limit`` nodes of greatest metric, to which a focus node and its neighbours are added."""
    chosen = ranked.orderBy(F.desc(metric), "node_id").limit(limit).select("node_id")
    if focus:
        near = neighbourhood(edges, focus)
        chosen = chosen.unionByName(near.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))).distinct()
    return subgraph(edges, chosen)


def kpis(nodes: DataFrame, edges: DataFrame, communities_: DataFrame) -> DataFrame:
    """One row: contracts, nodes, edges, communities and the size of the largest."""
    n = nodes.agg(F.count_if(F.split_part("node_id", F.lit(":"), F.lit(1)) == "contract").alias("contracts"), F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    sizes = communities_.groupBy("community").agg(F.count(F.lit(1)).alias("s")).agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.max("s"), F.lit(0)).alias("largest"))
    return n.crossJoin(e).crossJoin(sizes)  # one row each
