import random
import re
import statistics

from pyspark.sql import functions as F

from tesela.operators.column_profile import column_expressions, expression_coverage, findings, induce, load_coverage, load_profile, medians, shape, value_counts

PROCEDURES = ("abierto", "menor")
FORM = "[A-Z][0-9]{7}[A-Z0-9]|[0-9]{8}[A-Z]"


def test_induced_expressions_are_short_and_cover():
    shapes = {"A9999999A": 400, "A99999999": 600, "99999999A": 100, "a9!": 1}
    found = induce(shapes)
    assert any(re.fullmatch(e.regex, "B1234567C") and re.fullmatch(e.regex, "B12345678") for e in found)
    assert any(re.fullmatch(e.regex, "12345678Z") for e in found)
    assert not any(re.fullmatch(e.regex, "a9!") for e in found)
    assert induce({}) == []


def table(spark):
    rng = random.Random(2)
    rows = []
    for load in range(1, 7):
        for i in range(200):
            amount = None if load == 2 and i < 80 or i < 10 else round(rng.uniform(10, 1000) * (10 if load == 3 else 1), 2)
            if load == 4 and 20 < i < 60:
                amount = -1.0
            nif = "x" if load == 5 and i < 60 else "B7654321A" if load == 6 and i < 60 else f"b-{rng.randint(0, 9999999):07d}{rng.randint(0, 9)}"
            rows.append((load, amount, None if i % 50 == 0 else nif, "menor" if load == 1 or i % 4 == 0 else " Abierto ", "clash"))
    return rows, spark.createDataFrame(rows, "load_id int, amount double, nif string, proc string, finding string")


def test_findings(spark):
    _, df = table(spark)
    got = {tuple(r) for r in findings(df, "load_id", "amount", "nif", "proc", FORM, PROCEDURES).collect()}
    assert got == {(2, "amount", "null_rate"), (3, "amount", "distribution"), (4, "amount", "range"), (5, "nif", "pattern"), (5, "nif", "concentration"), (6, "nif", "concentration"), (1, "proc", "distribution")}
    assert findings(df.limit(0), "load_id", "amount", "nif", "proc", FORM, PROCEDURES).count() == 0


def test_medians_match_brute_force(spark):
    rows, df = table(spark)
    want = {k: statistics.median(a for load, a, *_ in rows if load == k and a is not None) for k in range(1, 7)}
    got = {r.load_id: r["median"] for r in medians(df, "load_id", "amount").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_profile_and_coverage(spark):
    df = spark.createDataFrame([(1, "A1"), (1, "A1"), (1, None), (1, "-"), (2, "B2"), (2, "zz" * 50_000), (None, "")], "load_id int, v string")
    rows = {r.load_id: r for r in load_profile(df, "load_id", ["v"]).collect()}
    assert (rows[1].n_rows, rows[1].n_missing, rows[1].n_distinct, rows[1].top_value, rows[1].top_rows) == (4, 2, 1, "A1", 2)
    assert rows[None].n_missing == 1 and rows[None].top_value is None
    counts = value_counts(df, "load_id", F.col("v"))
    assert column_expressions(counts)
    cover = {(r.load_id, r.expression): r.n_rows for r in expression_coverage(counts, ["[A-Z][0-9]"]).collect()}
    assert cover[(1, "[A-Z][0-9]")] == 2 and cover[(2, "none")] == 1
    assert load_profile(df.limit(0), "load_id", ["v"]).count() == 0


def test_coverage_between_loads(spark):
    rows = [(1, f"B{i:07d}X") for i in range(50)] + [(2, f"B{i:07d}X") for i in range(30)] + [(2, f"{i:04d}-{i:04d}") for i in range(20)]
    got = {(r.load_id, r.expression): r for r in load_coverage(spark.createDataFrame(rows, "load_id int, v string"), "load_id", ["v"]).collect()}
    usual = next(e for n, e in got if n == 1 and got[n, e].share == 1.0)
    r = got[2, usual]
    assert (r.column_name, r.n_rows, r.share, r.other_share) == ("v", 30, 0.6, 1.0) and abs(r.change + 0.4) < 1e-9
    assert load_coverage(spark.createDataFrame([], "load_id int, v string"), "load_id", ["v"]).count() == 0


def test_expressions_of_any_number_of_shapes_are_those_of_all(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 12)))
    values = [f"{word()} {word()} {word()}" for _ in range(900)] + [f"B{rng.randint(0, 9999999):07d}{rng.choice('AZ19')}" for _ in range(60)] + [f"!{i}" + "?" * i for i in range(40)] + ["Ñandú", "a\nb"]
    counts = spark.createDataFrame([(1, v, 1 + i % 3) for i, v in enumerate(values)], "load_id int, v string, n long")
    shapes = {r.s: r.n for r in counts.groupBy(shape(F.col("v")).alias("s")).agg(F.sum("n").alias("n")).collect()}
    want = [(e.regex, e.rows, round(e.saved_bits, 6)) for e in induce(dict(sorted(shapes.items(), key=lambda x: (-x[1], x[0]))))]
    got = [(e.regex, e.rows, round(e.saved_bits, 6)) for e in column_expressions(counts, bound=20)]
    assert len(shapes) > 500 and got == want and ("[a-z]+\\ [a-z]+\\ [a-z]+", sum(1 + i % 3 for i in range(900))) in [x[:2] for x in want]
