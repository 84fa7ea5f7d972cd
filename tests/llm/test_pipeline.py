"""The pipeline's stages, each on its own input, against plain forms."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm.common import table, written

from . import brute
from .data import documents

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "stage")
        seen[name] = (before, docs)
    rows = {n: ({r.doc_id: r for r in b.collect()}, a.collect()) for n, (b, a) in seen.items()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name][1].columns == columns

    before, after = rows["toxicity"]
    assert all(r == before[r.doc_id] for r in after) and 0 < len(after) < len(before)

    before, after = rows["line dedup"]
    assert {r.doc_id: r.text for r in after} == brute.without_repeated_lines((k, r.text) for k, r in before.items())
    assert all(r.n_chars == len(r.text) and r.source == before[r.doc_id].source for r in after)

    before, after = rows["n-gram Jaccard join"]
    stay = {k for k, (_, c) in brute.components((k, r.text) for k, r in before.items()).items() if c == k}
    assert {r.doc_id for r in after} == stay and all(r == before[r.doc_id] for r in after)

    before, after = rows["suffix-array dedup"]
    split, length = {k: brute.words(r.text) for k, r in before.items()}, corpus_pipeline.PASSAGE_WORDS
    counts = Counter(hash(tuple(w[i : i + length])) for w in split.values() for i in range(len(w) - length + 1))
    for r in after:
        w = split[r.doc_id]
        gone = {j for i in range(len(w) - length + 1) if counts[hash(tuple(w[i : i + length]))] > 1 for j in range(i, i + length)}
        assert brute.words(r.text) == [x for j, x in enumerate(w) if j not in gone] and (gone or r.text == (before[r.doc_id].text or ""))

    before, after = rows["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.values())
    assert sum(r.length for r in after) == total

    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_short_passages_of_over_fifty_words_go(spark):
    rng = random.Random(3)

    def line(k, letters):
        return " ".join("".join(rng.choices("abcdefgh", k=letters)) for _ in range(k))

    over, under = line(51, 4), line(50, 4)
    assert len(over) < 300
    own = [line(40, 7) for _ in range(12)]
    broken = over.replace(" ", "\n", 20)
    rows = [own[0] + " " + over + " " + own[1], own[2] + "\n" + broken + "\n" + own[3], own[4] + "\n" + under + "\n" + own[5], own[6] + " " + under, over, None, "", own[7] + " é\n\n" + own[8]]
    docs = written(documents(spark, rows), "docs")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[3:-1]:
        docs = written(stage(spark, docs, SF), "stage")
    found = {r.doc_id // 3: r.text for r in docs.collect()}
    expected = [own[0] + " " + own[1], own[2] + "\n" + own[3], *rows[2:4], "", "", "", rows[7]]
    assert found == dict(enumerate(expected))


def test_stages_take_nulls_empty_and_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(9)
    own = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(70)) for _ in range(6)]
    rows = [None, "", own[0], own[0], own[1] + "\ufffd", own[2] + "\n\n" + own[3], None, own[4]]
    docs = documents(spark, rows)
    docs = written(docs.unionByName(docs.filter("doc_id = 12")).withColumns({c: F.lit("clash") for c in ("row", "key", "kept", "spans", "shard", "stays")}), "docs")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
    found = sorted((r.doc_id, r.text or "") for r in docs.collect())
    # of equal texts the smaller id stays, of equal rows one; nothing else is touched
    assert found == sorted((i * 3, t or "") for i, t in enumerate(rows) if i != 3)
    assert all(r.n_chars == len(r.text or "") and r.key == "clash" for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(found)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
