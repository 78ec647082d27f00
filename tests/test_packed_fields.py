import random

import pytest

from tesela.operators.packed_fields import CODES, SUBJECTS, Reader, unpack, value_key

WORDS = ["Vigilancia de obras", "Estudios de redes, depósitos y bombeos", "Sondeos; incluye ensayos", "Planos en parques / jardines", 'Entrega "llave en mano"', "Depuradoras - fase de proyecto"]


def reader(spec=SUBJECTS, words=WORDS):
    return Reader(spec, {value_key(w): 6.0 for w in words}, 6.0 if spec is CODES else None)


@pytest.mark.parametrize("sep", ["; ", ", ", " | ", "#", "\n", " / ", " - ", ";;", "\t"])
def test_round_trip_of_all_pairs(sep):
    r = reader()
    for a in WORDS:
        for b in WORDS:
            assert r.read(a + sep + b) == [a, b]
            assert r.read((a + sep + b + sep).upper()) == [a.upper(), b.upper()]


@pytest.mark.parametrize(("a", "b"), [('"', '"'), ("'", "'"), ("«", "»")])
def test_quotes(a, b):
    r = reader()
    rng = random.Random(1)
    for _ in range(50):
        items = [rng.choice(WORDS) for _ in range(rng.randint(1, 5))]
        text = "; ".join(a + (x.replace(a, a + a) if a == b else x) + b for x in items)
        assert r.read(text) == items


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("71302910,71500830; 71167700", ["71302910", "71500830", "71167700"]), ("45014630-2/50553200-0", ["45014630", "50553200"]), ('["71167700","71024210"]', ["71167700", "71024210"]), ("CPV 71797430 - CPV 90651800", ["71797430", "90651800"]), ("712524109094613071651510", ["71252410", "90946130", "71651510"]),
        ("71797430 (principal); 71910210", ["71797430", "71910210"]), ("71500830 y 79322100", ["71500830", "79322100"]), ("71290210;;45310810;", ["71290210", "45310810"]), ("'71696610','71798830'", ["71696610", "71798830"]), (" 71167700 ", ["71167700"]), ("71500830 71500830", ["71500830", "71500830"]), ("No disponible", []), ("  ", []), (None, []),
    ],
)
def test_codes(text, items):
    assert reader(CODES, []).read(text) == items


def test_very_long_text():
    items = ["71500830"] * 3000
    assert reader(CODES, []).read(", ".join(items)) == items


def test_unpack_rows(spark):
    vocabulary = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "subject string")
    rows = [(1, f"{WORDS[0]}; {WORDS[1]}", "c"), (2, WORDS[2], "c"), (3, None, None), (4, "", None), (1, f"{WORDS[0]}; {WORDS[1]}", "c")]
    df = spark.createDataFrame(rows, "id long, packed string, item string")
    got = unpack(df, "packed", SUBJECTS, vocabulary, keep=("id",), least=2).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1, WORDS[0]), (1, 2, WORDS[1])] * 2)
    assert unpack(df.limit(0), "packed", SUBJECTS, vocabulary, keep=("id",)).count() == 0


def test_unpack_without_vocabulary(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha", "beta", "alpha", "beta", "alpha;beta", "beta|alpha"])], "id long, packed string")
    got = {(r.id, r.item_pos): r.item for r in unpack(df, "packed", SUBJECTS, None, keep=("id",), least=2).collect()}
    assert got == {(4, 1): "alpha", (4, 2): "beta", (5, 1): "beta", (5, 2): "alpha"}
