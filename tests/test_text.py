import unicodedata

from pyspark.sql import functions as F

from tesela.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0].y


def test_fold_equals_unicode_decomposition(spark):
    letters = [chr(c) for c in range(0xA0, 0x250) if chr(c).isalpha()]
    flat = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    single = [c for c in letters if len(flat(c)) == 1]
    got = one(spark, T.ascii_fold, "|".join(single))
    assert got == "|".join(flat(c) if ord(flat(c)) < 128 else "" for c in single)


def test_keys(spark):
    assert one(spark, T.norm_text, " Áb-c 1/2 ") == "ABC1/2"
    assert one(spark, T.text_key, "Ayto. de  Ávila / Exp-01") == "AYTO DE AVILA EXP 01"
    assert one(spark, T.stable_key, " -- ") == "UNKNOWN" and one(spark, T.stable_key, None) == "UNKNOWN" and one(spark, T.stable_key, "Ñu x") == "NU_X"
    assert one(spark, T.norm_date, "2024-01-03T00:00") == "20240103"


def test_amounts_and_codes(spark):
    assert one(spark, T.european_amount, "2.179.000,50 euros") == 2179000.5
    assert one(spark, T.european_amount, "No disponible") is None and one(spark, T.european_amount, None) is None
    assert one(spark, T.decimal_amount, "1234,5 EUR") == 1234.5
    assert one(spark, T.cpv_codes, "71000000, 71300000;71000000 x123456789") == ["71000000", "71300000"]
    assert one(spark, T.main_cpv, "a 123 71300000-1") == "71300000"


def test_tax_ids(spark):
    good = ["12345678Z", "X1234567L", "B99286320", "b-99286320"]
    bad = ["12345678A", "INVALIDO", "", None, "B99286321"]
    rows = spark.createDataFrame([(v,) for v in good + bad], "x string").select(T.valid_tax_id(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [True] * 4 + [False] * 5


def test_html(spark):
    assert one(spark, T.html_text, "<p>A &amp; b</p><script>x()</script>\n<!-- c --> <b>d</b>") == "A & b d"
