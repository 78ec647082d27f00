import random

import numpy as np

from tesela.llm.packing import fill, first_fit_decreasing, pack


def test_tournament_tree_equals_plain_first_fit():
    rng = random.Random(1)
    for _ in range(40):
        cap = rng.randint(5, 60)
        sizes = np.array([rng.randint(1, cap) for _ in range(rng.randint(0, 80))])
        bins, want = [], np.zeros(len(sizes), dtype=int)
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, room in enumerate(bins) if room >= sizes[i]), None)
            if at is None:
                bins.append(cap)
                at = len(bins) - 1
            bins[at] -= sizes[i]
            want[i] = at
        assert (first_fit_decreasing(sizes, cap) == want).all()


def test_pack_is_a_partition_of_all_tokens(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([0, 1, 7, 50, 99, 100, 101, 250, 1000])) for i in range(400)] + [(1000, None)]
    sized = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    caps = spark.createDataFrame([("s", 100), ("l", 300), ("none", None)], "pack_name string, capacity_tokens int")
    packed = pack(sized, caps, group=64)
    rows = packed.collect()
    for name, cap in (("s", 100), ("l", 300)):
        mine, room, seen = [r for r in rows if r.pack_name == name], {}, {}
        for r in mine:
            room[r.container] = room.get(r.container, 0) + r.n_tokens
            seen.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        assert max(room.values()) <= cap
        for i, n in docs:
            parts = sorted(seen.get(i, []))
            assert sum(p[2] for p in parts) == (n or 0)
            assert n is None or n > cap or len(parts) <= 1
            assert [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))] and [p[0] for p in parts] == list(range(1, len(parts) + 1))
    rates = {r.pack_name: r for r in fill(packed, caps).collect()}
    assert rates["s"].fill > 0.9 and rates["s"].n_cut == sum((n or 0) > 100 for _, n in docs)
    assert pack(sized.limit(0), caps).count() == 0
