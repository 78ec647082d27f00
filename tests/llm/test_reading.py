import random

import pytest

from tesela.llm.reading import features, fit, levels, segments

EASY = ["El parque abre hoy.", "Traiga pan y agua.", "La calle está lista.", "Pida la llave en casa."]
MID = ["El ayuntamiento ha aprobado el arreglo de la plaza.", "Las empresas podrán enviar ofertas hasta marzo.", "La obra durará unos seis meses."]
HARD = ["La adjudicataria asumirá la responsabilidad subsidiaria.", "Procede la convalidación del procedimiento contractual.", "Salvo que obste la cosa juzgada."]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(600):
        level = rng.choice([1, 2, 3])
        sents = [rng.choice((EASY, MID, HARD)[level - 1]) for _ in range(rng.randint(5, 12))]
        if rng.random() < 0.3:
            sents[rng.randrange(len(sents))] = rng.choice((EASY + MID + HARD))
        text = rng.choice([" ", "\n"]).join(sents)
        rows.append((i, rng.choice([text, text.upper()]), rng.choice(["es", "es", None]), "x"))
        truth[i] = level
    rows += [(1000, None, "es", None), (1001, "  ", None, None), (1002, "", "ca", None), (1003, "12 34 " * 30, "es", None)]
    labels = [(i, truth[i] if rng.random() > 0.05 else 1 + truth[i] % 3) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, reading_level string"), spark.createDataFrame(labels, "doc_id long, reading_level int"), truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    feats = features(docs.drop("reading_level"), labels)
    got = {r.doc_id: r.reading_level for r in levels(feats, fit(feats)).collect()}
    assert sum(got[i] == truth[i] for i in range(90, 600)) / 510 > 0.97
    assert set(got) == set(range(600)) | {1001, 1002, 1003}
    assert got[1003] == 2


def test_no_labels_and_empty(corpus, spark):
    docs, labels, _ = corpus
    feats = features(docs, labels.limit(0))
    assert {r.reading_level for r in levels(feats, fit(feats)).collect()} == {2}
    feats = features(docs.limit(0), labels)
    assert levels(feats, fit(feats)).count() == 0


def test_segments_read_markup_and_very_long_texts():
    assert segments("<p>Reuni&oacute;n &amp; ÁRBOL.</p>\nDos") == [["reunion", "arbol"], ["dos"]]
    assert len(segments("palabra " * 200_000)) == 1
