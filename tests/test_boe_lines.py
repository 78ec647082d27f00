import csv
import io
import random

import pytest

from tesela.sources.boe_lines import conforming, load_strict, reason_of, rejected, split_strict, unwrap

GOOD = ["ADMINISTRACIÓN LOCAL", "Ayuntamiento de Alba", "EXP 1/2020", "25/05/2020", "Contratación", "Servicios", "Obra de mejora", "Abierto", "Aragón", "Sondeos", "71500830, 71167700", "1.234,56 euros", "No disponible", "Norte, S.L.", "https://x.invalid/?id=BOE-B-2020-1"]


def line(fields, quote=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, quoting=quote, lineterminator="").writerow(fields)
    return out.getvalue()


def wrap(s):
    return '"' + s.replace('"', '""') + '";;;'


def test_quoted_wrapped_and_plain():
    for s in (line(GOOD), line(GOOD, csv.QUOTE_ALL), wrap(line(GOOD)), line(GOOD) + ";;"):
        assert conforming(s) == (GOOD, 15)


def test_unquoted_commas_are_repaired():
    bare = ",".join(GOOD)
    fields, n = conforming(bare)
    assert fields == GOOD and n == 18
    inst = ["ORGANISMOS, AGENCIAS Y CONSORCIOS", *GOOD[1:6], "Obra, por trámite ordinario", *GOOD[7:]]
    assert conforming(",".join(inst))[0] == inst


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (line(GOOD).replace('"71500830', '""71500830', 1), "quoting"), ('"' + line(GOOD), "quoting"), (line(GOOD).replace('"1.234,56 euros"', '"1.234,56 euros" bis'), "quoting"), (line(GOOD[:14]), "field_count"), (line([*GOOD, "ver anexo"]), "field_count"), (line([*GOOD, *GOOD]), "field_count"),
        (line([*GOOD[:5], "", "", *GOOD[5:]]), "field_count"), (line([*GOOD[:3], "31/02/2020", *GOOD[4:]]), "value"), (line([*GOOD[:3], "", *GOOD[4:]]), "value"), (line([*GOOD[:10], "varios", *GOOD[11:]]), "value"), (line([*GOOD[:11], "1234,56 euros", *GOOD[12:]]), "value"), (line([*GOOD[:14], "www"]), "value"), ("", "field_count"), (None, "field_count"),
    ],
)
def test_reasons(text, reason):
    assert conforming(text) is None and reason_of(text) == reason


def test_doubled_commas_inside_a_text():
    got = conforming(",".join(["LOCAL", *GOOD[1:6], "Plan del puente,, por trámite ordinario", *GOOD[7:9], "obras", "71500830", "1.234,56 euros", "No disponible", "Norte, S.L.", GOOD[14]]))
    assert got is not None and got[0][6] == "Plan del puente,, por trámite ordinario" and got[0][13] == "Norte, S.L." and got[1] == 19


def test_split_matches_the_csv_module():
    rng = random.Random(3)
    for _ in range(300):
        fields = ["".join(rng.choice('ab,"; ñ') for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(2, 6))]
        assert split_strict(line(fields, csv.QUOTE_ALL)) == fields
        assert split_strict(unwrap(wrap(line(["x", *fields], csv.QUOTE_ALL)))) == ["x", *fields]


def test_load_and_anti_join(spark):
    rows = [(1, "f", 1, line(GOOD), "a"), (2, "f", 2, ",".join(GOOD).replace("ó", "�"), "b"), (3, "f", 3, None, None), (4, "f", 4, line(GOOD), "a"), (5, "g", 1, "x" * 200_000, None)]
    lines = spark.createDataFrame(rows, "line_id long, source_file string, source_line int, line string, reason string")
    loaded = load_strict(lines)
    got = {r.line_id: r for r in loaded.collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].raw_field_count, got[1].repaired_columns, got[1].parser_warning) == (15, False, None)
    assert (got[2].raw_field_count, got[2].parser_warning) == (18, "reparada_desde_18_campos;caracteres_reemplazados_por_codificacion")
    assert got[1].estimated_value_eur == 1234.56 and got[1].awarded_value_eur is None and got[1].contract_id == "BOE-B-2020-1"
    assert sorted(map(tuple, rejected(lines, loaded).collect())) == [(3, "field_count"), (5, "field_count")]
    assert load_strict(lines.limit(0)).count() == 0
