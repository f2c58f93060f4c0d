"""Levels of synthetic prose with known difficulty: held-out accuracy, and which texts have a level."""

import random

from corpusmill.llm import reading

WORDS = {1: "open the file and look at it then close it with a click", 2: "most projects can change the default settings in this folder when you need them", 3: "the component validates each declaration because incremental processing reduces memory consumption", 4: "idempotent transformation presupposes denotational confluence whereas canonicalisation of the lattice is undecidable"}


def text(level, rng, n=90):
    out = []
    while len(out) < n:
        source = WORDS[level] if rng.random() < 0.85 else WORDS[rng.choice([1, 2, 3, 4])]
        w = source.split()
        out += rng.sample(w, len(w))
    return "The text is about this. " + " ".join(out)


def test_held_out_levels(spark):
    rng = random.Random(3)
    truth = {i: 1 + i % 4 for i in range(160)}
    docs = spark.createDataFrame([(i, text(k, rng), "x") for i, k in truth.items()], "doc_id long, text string, level string")
    graded = [(i, 1, truth[i]) for i in range(80)] + [(0, 2, 2), (999, 1, 1), (5, 1, None), (6, 1, 9)]
    labels = spark.createDataFrame(graded, "doc_id long, annotator int, level int")
    got = {r.doc_id: r.level for r in reading.found(docs, labels).collect()}
    held = [i for i in truth if i >= 80]
    assert set(got) == set(truth) and sum(got[i] == truth[i] for i in held) >= 0.9 * len(held)
    assert reading.found(docs, labels.limit(0)).count() == 0 and reading.found(docs.limit(0), labels).count() == 0


def test_what_has_a_level():
    en = "The file is read before the table is written and then it is closed again. " * 6
    assert reading.prose_words(en)[0] == "en"
    assert reading.prose_words("Die Datei wird gelesen bevor die Tabelle geschrieben wird und dann ist sie zu. " * 6)[0] == "de"
    for no in (None, "", " \n", "fix: read file", "```\n" + en + "\n```", "| " + en.replace(". ", ". |\n| ") + " |", "Esta parte é lenta porque a fila não está pronta e você precisa de uma lista. " * 6, "for (int i = 0; i < n; i++) { total += values[i]; }\n" * 20, "Читает таблицу и пишет её снова на диск без ошибок. " * 10):
        assert reading.prose_words(no) is None
