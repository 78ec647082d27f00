import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tesela.operators import graph as G


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(n)], 2))) for _ in range(m)})


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, edge_count long")


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 20), (2, 12, 30)])
def test_components(spark, seed, n, m):
    pairs = random_pairs(seed, n, m)
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    groups = defaultdict(list)
    for x in root:
        groups[find(x)].append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    assert {r.node_id: r.component for r in G.components(frame(spark, pairs)).collect()} == want


def test_a_long_chain(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    assert {r.component for r in G.components(frame(spark, pairs)).collect()} == {"c000"}


def test_betweenness(spark):
    pairs = random_pairs(3, 9, 14)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(near)
    got = {r.node_id: r.betweenness for r in G.betweenness(frame(spark, pairs), pivots=100).collect()}
    assert all(abs(got[v] - score[v] / ((n - 1) * (n - 2))) < 1e-6 for v in near)


def test_betweenness_is_exact_up_to_the_limit(spark):
    n = 9
    path = frame(spark, [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(n - 1)])
    got = {r.node_id: r.betweenness for r in G.betweenness(path, pivots=4).collect()}
    assert all(abs(got[f"c{i:03d}"] - 2 * i * (n - 1 - i) / ((n - 1) * (n - 2))) < 1e-6 for i in range(n))


def test_communities_find_two_cliques(spark):
    pairs = [*itertools.combinations([f"a{i}" for i in range(6)], 2), *itertools.combinations([f"b{i}" for i in range(6)], 2), ("a0", "b0")]
    df = frame(spark, [tuple(sorted(p)) for p in pairs])
    groups = G.communities(df, settled=0.0)
    q = G.modularity(df, groups).collect()[0].modularity
    assert q > 0.40


def test_construction(spark):
    rows = [(1, "C-1", "boe", "r1", "b1", "Buyer", "", "Norte", "71300000-1, 45"), (2, "C-1", "boe", "r9", "b1", "Buyer", "", "Norte", "71300000"), (3, "C-2", "boe", "r2", None, None, None, None, None), (4, " ", "boe", "r3", "b", "b", "s", "s", "71000000"), (5, "C-3", None, "r3", "b", "b", "s", "s", "71000000")]
    df = spark.createDataFrame(rows, "row_id long, contract_key_canon string, source string, source_record_id string, buyer_id string, buyer_name string, supplier_id string, supplier_name string, cpv_codes_raw string")
    edges = {r.edge_id: r.source_record_id for r in G.build_edges(df).collect()}
    assert edges == {"FROM_SOURCE:contract:C_1->source:BOE:C-1": "r1", "PUBLISHED:buyer:B1->contract:C_1:C-1": "r1", "AWARDED_TO:contract:C_1->supplier:NORTE:C-1": "r1", "HAS_CPV:contract:C_1->cpv:71300000:C-1": "r1", "HAS_CPV:contract:C_1->cpv:45:C-1": "r1", "FROM_SOURCE:contract:C_2->source:BOE:C-2": "r2"}
    assert G.build_edges(df.limit(0)).count() == 0


def test_components_of_all_edges_hold_all_nodes(spark, tiny):
    from tesela.queries import engine
    from tesela.session import table

    n = G.nodes_of(table(spark, tiny, "graph_edges")).count()
    assert engine.gra_components_all(spark, tiny).count() == n


def test_nodes_groups_and_features(spark):
    rows = [(1, "K1", "boe", "r1", "Obra", "B1", "Ayto", "S1", "Norte", "71000000"), (2, "K1", "boe", "r2", "Otra", "B1", "Ayuntamiento", "S1", "Norte", "71000000-8, 45"), (3, "K2", "place", None, None, None, "Ayto", None, None, None), (4, " ", "boe", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, contract_key_canon string, source string, source_record_id string, contract_title string, buyer_id string, buyer_name string, supplier_id string, supplier_name string, cpv_codes_raw string")
    nodes = {r.node_id: r for r in G.build_nodes(df).collect()}
    assert set(nodes) == {"contract:K1", "contract:K2", "source:BOE", "source:PLACE", "buyer:B1", "buyer:AYTO", "supplier:S1", "cpv:71000000", "cpv:45"}
    assert nodes["contract:K1"].attributes == {"contract_key_canon": "K1", "source": "boe", "source_record_id": "r1", "contract_title": "Obra"} and nodes["buyer:B1"].label == "Ayto" and nodes["contract:K2"].attributes == {"contract_key_canon": "K2", "source": "place"}
    edges = G.build_edges(df)
    pairs = G.simple(edges)
    groups = G.sized_groups(G.components(pairs), "component")
    got = {r.node_id: (r.group_id, r.group_size) for r in groups.collect()}
    assert got["contract:K1"] == (0, 6) and got["contract:K2"] == (1, 3)
    entity = G.degrees(pairs).join(groups, "node_id").select("node_id", "neighbor_count", "degree_centrality", F.lit(0.0).alias("betweenness_centrality"), F.col("group_id").alias("component_id"), F.col("group_size").alias("component_size"), F.col("group_id").alias("community_id"), F.col("group_size").alias("community_size"))
    table = G.feature_table(edges, G.build_nodes(df), entity, "1", "now")
    assert len(table.columns) == 25
    k1 = next(r for r in table.collect() if r.contract_key_canon == "K1")
    assert (k1.buyer_supplier_recurrence, k1.cpv_count, k1.has_supplier, k1.component_size, k1.contract_neighbor_count, k1.buyer_neighbor_count) == (1, 2, True, 6, 5, 1)


def test_a_hub_and_groups_of_equal_size(spark):
    pairs = [("h", f"n{i:03d}") for i in range(300)] + [(f"x{i}", f"y{i}") for i in range(20)]
    groups = G.sized_groups(G.components(frame(spark, pairs)), "component")
    got = {r.node_id: r.group_id for r in groups.collect()}
    assert got["h"] == 0 and [got[f"x{i}"] for i in sorted(range(20), key=str)] == list(range(1, 21))


def test_betweenness_of_a_whole_graph_per_task_is_that_of_the_joins(spark):
    pairs = frame(spark, [*random_pairs(7, 60, 150), *[(f"p{i:02d}", f"p{i + 1:02d}") for i in range(2)], *[("hub", f"q{i:03d}") for i in range(200)]])
    packed = {r.node_id: r.betweenness for r in G.betweenness(pairs, pivots=12, exact=10).collect()}
    joined = {r.node_id: r.betweenness for r in G.betweenness(pairs, pivots=12, exact=10, packed_edges=0).collect()}
    assert set(packed) == set(joined) and all(abs(packed[v] - joined[v]) < 1e-9 for v in joined) and any(joined.values())


def test_betweenness_of_many_pivots_has_no_row_per_pivot_and_node(spark, monkeypatch):
    monkeypatch.setattr(G, "_joined_dependencies", None)
    pairs = [(f"s{i % 3}", f"c{i:04d}") for i in range(3000)] + [(f"b{i % 400:03d}", f"c{i:04d}") for i in range(3000)]
    got = {r.node_id: r.betweenness for r in G.betweenness(frame(spark, pairs)).collect()}
    assert len(got) == 3403 and max(got, key=got.get) in ("s0", "s1", "s2")
