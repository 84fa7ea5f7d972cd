"""Dictionaries of many words in texts, against literal look-ups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import dictionary, text

WORDS = [("a1", "strait", "keyword", 1), ("a2", "hormuz", "keyword", 2), ("b", "Strait", "keyword", 3), ("c", "hormuz", "alias", 4), ("d", "tel aviv", "alias", 5), ("d", "aviv", "keyword", 6), ("e", "élan", "keyword", 7), ("f", "al-sisi", "keyword", 8), ("g", "un", "alias", 9), ("h", "  ", "keyword", 10)]


def looked_up(low, words):
    """The places of words whose first occurrence stands alone."""
    out = {}
    for w in words:
        at = low.find(w)
        if w.strip() and at >= 0 and not re.match(r"[A-Za-z0-9_]", low[at - 1 : at] or " ") and not re.match(r"[A-Za-z0-9_]", low[at + len(w) : at + len(w) + 1] or " "):
            out[w] = at + 1
    return out


def entities(low, rows):
    owner = {}
    for entity, word, kind, _ in sorted(rows, key=lambda r: r[3]):
        owner[kind, word.lower()] = entity
    found = {}
    for kind in ("keyword", "alias"):
        by = {}
        for (k, word), entity in owner.items():
            if k == kind and word in (places := looked_up(low, [word])):
                by[entity] = min(places[word], by.get(entity, 10**9))
        found = by | found
    return found


@pytest.mark.parametrize("most", [50_000, 3])
def test_entities_by_keyword_and_alias(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary.candidates, "__defaults__", (most,))
    monkeypatch.setattr(dictionary.texts_with_whole_words, "__defaults__", (most,))
    texts = ["The Strait of Hormuz", "straits, strait", "Tel Aviv", "tel aviv and aviv", "Élan vital", "élan", "xélan", "Al-Sisi; UN", "unun un", "UN.", "", None, "a_strait strait", "hormuz strait hormuz", "strait" * 3, "x " * 9000 + "hormuz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    found = {(r.id, r.entity): r.position for r in text.extract_entities(df, "id", "title", spark.createDataFrame(WORDS, "entity string, word string, kind string, seq int")).collect()}
    expected = {(i, e): at for i, t in enumerate(texts) if t for e, at in entities(t.lower(), WORDS).items()}
    assert found == expected and ("a1" not in {e for _, e in found}) and (0, "c") in found


def test_ten_thousand_words(spark):
    rng = random.Random(9)

    def word():
        return "".join(rng.choices("abcdeé", k=rng.randint(2, 6)))

    words = list({f"{word()} {word()}" if i % 4 == 0 else word() for i in range(12_000)})[:10_000]
    texts = [" ".join([word() for _ in range(rng.randint(0, 40))] + rng.sample(words, 2)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title string").repartition(4)
    table = spark.createDataFrame([(w,) for w in words], "word string")
    found = dictionary.texts_with_whole_words(df, "id", "title", table)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {(i, w, at) for i, t in enumerate(texts) for w, at in looked_up(t, words).items()}
    assert {(r.id, r.word, r["at"]) for r in found.collect()} == expected
    inside = dictionary.texts_with(df, "id", "title", table)
    assert "NestedLoop" not in inside._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.word) for r in inside.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    assert dictionary.texts_with(df, "id", "title", table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3, 1000])
def test_classification_by_tables_equals_the_one_by_lists(spark, most):
    rng = random.Random(3)
    types = ["x", "y", "z"]
    words = [("".join(rng.choices("abc", k=rng.randint(1, 4))), types[rng.randrange(3)], rng.randint(1, 9)) for _ in range(40)]
    words = sorted({w: (w, t, n) for w, t, n in words}.values(), key=lambda r: types.index(r[1]))
    severity = [("ab", 2), ("c", -1), ("aab", 1), ("ca", 1)]
    rows = [(i, "".join(rng.choices("aBcdef ", k=rng.randint(0, 9))), 40 + i) for i in range(120)] + [(200, None, 50), (201, "", None), (202, "f" * 3000 + "abc", 60)]
    df = spark.createDataFrame(rows, "id long, title string, sure int")
    listed = text.classify_events(df, "title", [(t, w, n) for w, t, n in words], types, severity, F.col("sure"))
    table = spark.createDataFrame([(w, t, n, i) for i, (w, t, n) in enumerate(words)], "word string, event_type string, weight int, seq int")
    found = text.classify_by_tables(df, "id", "title", table, spark.createDataFrame(severity, "word string, weight int"), F.col("sure"), most=most)
    assert found.columns == listed.columns and sorted(found.collect()) == sorted(listed.collect())
    assert text.classify_by_tables(df, "id", "title", table.limit(0), spark.createDataFrame([], "word string, weight int"), F.col("sure")).filter("event_type = 'alert'").count() == len(rows)
