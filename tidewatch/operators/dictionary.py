"""Look-up of dictionaries of any number of words in texts: one pass a text over its units, no text meets a word that it can't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a dictionary may have to be broadcast, and names to be tested within a row; larger ones are joined by their units with a shuffle.
BOUND = 50_000
#: A run of ASCII word characters, or another character alone.
UNIT = r"[a-z0-9_]+|[^a-z0-9_\s]"
GRAM = 3


def small(df: DataFrame, most: int = BOUND) -> DataFrame:
    """df for a join that broadcasts it if it has `most` rows or fewer, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def names_of(df: DataFrame, column: str, most: int = BOUND) -> list[str] | None:
    """The distinct values of a column, None where there are more than `most`."""
    found = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def held(units: Column, names: list[str] | None) -> Column:
    """Those of an array that are names; all of them where names are too many to be tested in a row."""
    return units if names is None else F.filter(units, lambda u: u.isin(names)) if names else F.array().cast("array<string>")


def candidates(df: DataFrame, key: str, text: Column, units, words: DataFrame, unit: Column, most: int = BOUND) -> DataFrame:
    """Rows of words (word, ...) with the key and the text (_t) of each text that has the word's unit among its units: a superset of the texts that hold the word. Texts and units are null-free."""
    table = words.withColumn("_unit", unit).filter("_unit <> ''")
    names = names_of(table, "_unit", most)
    rows = df.select(key, text.alias("_t")).filter("_t is not null")
    found = F.array_distinct(held(units(F.col("_t")), names))
    if names is not None:
        return rows.select(key, "_t", F.explode(found).alias("_unit")).join(small(table, most), "_unit").drop("_unit")
    # with a large dictionary texts stay behind until their words are known
    hits = rows.select(key, F.explode(found).alias("_unit")).join(table, "_unit").drop("_unit")
    return hits.join(rows, key)


def texts_with_whole_words(df: DataFrame, key: str, text: str, words: DataFrame, most: int = BOUND) -> DataFrame:
    """Rows of words (word, ...) with key and at, for texts whose first occurrence of the word has no ASCII word character next to it, in any case.

    Where a word is found like that, its first unit is a unit of the text."""
    words = words.withColumn("word", F.lower("word"))
    first = F.regexp_extract("word", UNIT, 0)
    hits = candidates(df, key, F.lower(F.col(text)), lambda t: F.regexp_extract_all(t, F.lit(UNIT), 0), words, first, most).withColumn("at", F.instr(F.col("_t"), F.col("word")))
    before, after = F.substring(F.col("_t"), F.col("at") - 1, F.lit(1)), F.substring(F.col("_t"), F.col("at") + F.length("word"), F.lit(1))
    whole = (F.col("at") > 0) & ((F.col("at") == 1) | ~before.rlike("[a-z0-9_]")) & ~after.rlike("[a-z0-9_]")
    return hits.filter(whole).drop("_t")


def texts_with(df: DataFrame, key: str, text: str, words: DataFrame, most: int = BOUND) -> DataFrame:
    """Rows of words (word, ...) with key, for texts that hold the word anywhere, in any case of the text. Words meet the texts that have their first letters in a row."""
    n = F.least(F.lit(GRAM), F.length("word"))

    def grams(t: Column) -> Column:
        # every place of a text, by a condition that takes no letters
        return F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in range(1, GRAM + 1)))) if short else F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)

    short = not words.filter(F.length("word") < GRAM).isEmpty()
    hits = candidates(df, key, F.lower(F.col(text)), grams, words, F.substring(F.col("word"), F.lit(1), n), most)
    return hits.filter(F.contains(F.col("_t"), F.col("word"))).drop("_t")


def owned(words: DataFrame) -> DataFrame:
    """Words (entity, word, kind, seq) in lower case, each with the last entity by seq that lists it within its kind."""
    return words.groupBy(F.lower("word").alias("word"), "kind").agg(F.max_by("entity", "seq").alias("entity"))
