import random
from collections import defaultdict

from tesela.operators.skewed_keys import heavy_keys, key_states, numbered_states, per_key


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None, "tail%d" % rng.randint(0, 50)])
        item = rng.choice([None, "same", "i%d" % rng.randint(0, 300)])
        rows.append((key, item, rng.choice([None, float("nan"), round(rng.uniform(-5, 1000), 2)]), i))
    df = spark.createDataFrame(rows, "k string, i string, a double, n_rows long").repartition(7)
    want = defaultdict(lambda: [0, set(), 0, 0])
    for k, i, a, _ in rows:
        w = want[k]
        w[0] += 1
        w[1] |= {i} - {None}
        if a is not None and a == a:
            w[2] += round(a * 100)
            w[3] += 1
    got = {r.key_value: (r.n_rows, r.n_items, r.total) for r in per_key(df, "k", "i", "a", chunk_rows=97).collect()}
    assert got == {k: (n, len(s), c / 100 if f else None) for k, (n, s, c, f) in want.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # chunks go on from batch to batch
    try:
        for rows_of_a_chunk in (1, 20, 40, 97):
            assert {r.key_value: (r.n_rows, r.n_items, r.total) for r in per_key(df, "k", "i", "a", chunk_rows=rows_of_a_chunk).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = numbered_states(key_states(df, "k", "i", "a", chunk_rows=97)).collect()
    assert all(s.chunks == -(-s.n // 97) for s in states) and len({(s.key_value, s.part) for s in states}) == len(states)
    hot = sorted((s.first_row, s.n) for s in states if s.key_value == "hot")
    assert all(a[0] + a[1] == b[0] for a, b in zip(hot, hot[1:], strict=False)) and sum(n for _, n in hot) == want["hot"][0]
    assert {r.key_value for r in heavy_keys(df, "k", "i", share=0.03).collect()} == {k for k, w in want.items() if k and w[0] >= 0.03 * len(rows)}


def test_one_pair_repeated_and_empty(spark):
    df = spark.createDataFrame([("k", "same", 1.0)] * 1000, "k string, i string, a double")
    r = per_key(df, "k", "i", "a", chunk_rows=10).collect()
    assert len(r) == 1 and (r[0].n_rows, r[0].n_items, r[0].total) == (1000, 1, 1000.0)
    assert per_key(df.limit(0), "k", "i", "a").count() == 0
