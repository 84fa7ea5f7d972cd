"""Small tables with copies, near copies, ties, empty, null and long texts."""

import random


def texts(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiéß", k=rng.randint(2, 8))) for _ in range(300)]

    def line(k):
        return " ".join(rng.choices(vocabulary, k=k))

    out = ["\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    passage = line(60)
    for i in range(0, n, 7):
        out[i] = f"{out[i]}\n{passage}"
    for i in range(3, n, 9):
        copy = out[i - 1].split(" ")
        copy[len(copy) // 2] = "edited"
        out[i] = " ".join(copy)
    out[5] = out[4]
    out[11] = out[4].upper()
    return [*out, None, "", " \n\t", "one two", "one two", "one\n\n\ntwo", "a " * 3000, line(4000)]


def documents(spark, rows=None):
    """The documents table, with more columns whose names clash with the operators' own."""
    rows = texts() if rows is None else rows
    table = [(i * 3, t, "en" if i % 2 else None, "src0", len(t or ""), i, "x") for i, t in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, block int, rest string")
