import pytest
from pyspark.sql import functions as F

from tesela.operators import contracts as K
from tesela.operators import documents as D
from tesela.operators import reports as R


def test_validation_raises(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert K.require_columns(df, ["k", "v"]) is df and K.require_unique(df, "k") is df
    with pytest.raises(ValueError, match="columns missing: x"):
        K.require_columns(df, ["k", "x"])
    with pytest.raises(ValueError, match="1 blank, 1 repeated"):
        K.require_unique(spark.createDataFrame([("a",), ("a",), (" ",)], "k string"), "k")
    with pytest.raises(ValueError, match="1 rows without a partner"):
        K.one_to_one(df, df.where("k = 'a'"), "k", complete=True)
    assert K.one_to_one(df, df.where("k = 'a'").withColumnRenamed("v", "w"), "k").count() == 1


def test_lookups(spark):
    df = spark.createDataFrame([("a", "s2", 1), ("a", "s1", 2), (None, "s", 3), ("b", None, 4)], "k string, source string, v int")
    assert {(r.k, r.source, r.n_rows) for r in K.lookup(df, "k", ["source", "v"]).collect()} == {("a", "s1", 2), ("b", None, 1)}
    assert K.lookup_one(df, "k", "a", ["source"]).collect()[0].v == 2
    with pytest.raises(ValueError, match="no row"):
        K.lookup_one(df, "k", "zz", ["source"])
    f = spark.createDataFrame([("a", 9), ("a", 7)], "k string, f int")
    assert sorted((r.v, r.f) for r in K.with_features(df, f, "k").collect() if r.k == "a") == [(1, 7), (2, 7)] and K.with_features(df, f, "k").count() == 4


def test_rankings(spark):
    df = spark.createDataFrame([(i, b, v) for i, (b, v) in enumerate([("x", 9.0), ("x", 8.0), ("y", 7.0), (None, 6.0), (None, 5.0), ("z", None)])], "i int, b string, v double")
    top = K.diverse_top(df.where("v is not null"), "b", [-F.col("v"), F.col("i")], 4).orderBy("rank").collect()
    assert [r.i for r in top] == [0, 2, 3, 4]
    assert [(r.case_no, r.i) for r in K.picked_cases(df.withColumn("w", F.col("v")), "i", ["v", "w"]).orderBy("case_no").collect()] == [(1, "0"), (2, "1")]
    assert K.picked_cases(df.limit(0), "i", ["v"]).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", None), ("h", -2.0), (None, 4.0)], "g string, v double")
    got = {r.g: (r.n, r.q1, r.median, r.q3) for r in R.spread(df, "v", "g").collect()}
    assert got == {"g": (2, 1.5, 2.0, 2.5), "h": (1, -2.0, -2.0, -2.0), None: (1, 4.0, 4.0, 4.0)}
    assert {(r.band, r.n) for r in R.bands(df, "v", [0.0, 2.0]).collect()} == {(0, 1), (1, 1), (2, 2), (None, 1)}
    checks = spark.createDataFrame([("a", "pass"), ("a", "warning"), ("b", "n/a"), ("c", "odd")], "s string, state string")
    assert {(r.s, r.state) for r in R.rolled_up(checks, "s").collect()} == {("a", "warning"), ("b", "n/a"), ("c", "fail")}
    assert R.health({"boe": True, "place": False, "x": False}, {"place"}) == [("boe", "ok"), ("place", "blocked"), ("x", "missing")]
    m = spark.createDataFrame([({"b": "1", "a": " ", "c": "x"},)], "m map<string,string>")
    assert m.select(R.used_fields(F.col("m")).alias("j")).collect()[0].j == '{"b":"1","c":"x"}'
    assert R.as_json(df.where("g = 'h'")).collect()[0].json == '{"g":"h","v":-2.0}'


def test_answers_and_embeddings(spark):
    t = spark.createDataFrame([(1, "<think>a\n b</think>  Todo   bien."), (2, "no se declara FRAUDE. Fin"), (3, None)], "i int, text string")
    assert [r.a for r in t.select(D.cleaned_answer(F.col("text")).alias("a")).collect()] == ["Todo bien. No se declara fraude.", "no se declara FRAUDE. Fin", None]
    assert [r.u for r in t.select(D.unsafe(F.lit("posible fraude, no se declara fraude"), ["no se declara fraude"], ["fraude"]).alias("u")).limit(1).collect()] == [True]

    def broken(_):
        raise OSError("no server")

    rows = D.embedded(t, "i", broken, 2, lambda texts: [[len(x), 1.0] for x in texts]).collect()
    assert {r.i: (r.vector, r.model) for r in rows}[3] == ([0.0, 1.0], "fallback")
    with pytest.raises(Exception, match="vectors must have 3 numbers"):
        D.embedded(t, "i", lambda texts: [[1.0] for _ in texts], 3).collect()
