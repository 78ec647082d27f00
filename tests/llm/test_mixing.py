import random

import pytest

from tesela.llm.mixing import mix, shares


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "c", None, "other"], [60, 25, 5, 5, 5])[0], rng.choice([0, 10, 100, 500]), rng.choice([None, 0.5, 2.0])) for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, w double").cache()


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(docs, targets):
    m = mix(docs, targets)
    got = {r.source: r for r in shares(m, targets).collect()}
    for s, share, most in (("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 4)):
        assert abs(got[s].share - share) < 0.002 and got[s].most_copies <= most
    assert m.select("doc_id").distinct().count() == m.count() and m.where("source is null or source = 'other'").count() == 0


def test_a_limit_and_unequal_odds(docs, targets):
    m = mix(docs, targets, tokens=100_000, odds="w")
    got = {r.source: r.share for r in shares(m, targets).collect()}
    assert abs(got["a"] - 0.3) < 0.02 and abs(got["b"] - 0.5) < 0.02
    n = {r.w: r["count"] for r in m.join(docs.select("doc_id", "w"), "doc_id").groupBy("w").count().collect()}
    assert None not in n and n[2.0] > 1.5 * n[0.5]


def test_same_draw_again_and_empty(docs, targets):
    one, two = (sorted(map(tuple, mix(docs.repartition(k), targets, tokens=50_000).collect())) for k in (3, 5))
    assert one == two
    assert mix(docs.limit(0), targets).count() == 0


def test_many_equal_ranks(spark, monkeypatch):
    """Documents of one rank are told apart by their ids, however many there are."""
    from tesela.llm import mixing

    docs = spark.createDataFrame([(i, "a", 10, 0.25) for i in range(500)] + [(1000, "a", 10, 0.1)], "doc_id long, source string, n_tokens long, q double")
    cut, tie = mixing._cuts(docs, {"a": 1234.0}, few=50)
    assert cut == {"a": 0.25} and tie == {"a": 121}
