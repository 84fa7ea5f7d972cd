"""Whitening, language identification and Merkle manifests against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language, merkle, queries, whitening
from tidewatch.llm.common import table

from .brute import SCHEMA
from .data import documents, texts

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, component int, n string"

# 11 whitening


def plain_whitening(rows, most=8):
    """By numpy's eigenvalues of the covariance, deviations by fractions."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in kept]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [k for k, _ in kept], n, deviations, values, values / np.trace(covariance), centred @ axes / np.sqrt(values)


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 7, "x") for k, v in rows], VECTORS).repartition(3)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(60, 12)) @ np.diag(np.geomspace(1, 0.01, 12)) + 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (70, None), (71, [None, *rows[2][1][1:]]), (72, [float("nan"), *rows[2][1][1:]]), (73, [float("inf")] * 12), (74, [1.0, 2.0]), (75, [])]
    ids, n, deviations, values, explained, whitened = plain_whitening(rows)
    found = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    assert Counter(r.vec_id for r in found) == Counter(k for k in ids for _ in range(8))
    assert Counter((r.vec_id, r.deviation) for r in found) == Counter((k, s) for k, s in zip(ids, deviations, strict=True) for _ in range(8))
    by_id = {k: row for k, row in zip(ids, whitened, strict=True)}
    signs = {}
    for r in sorted(found, key=lambda r: -abs(r.whitened)):
        other = by_id[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, 1 if r.whitened * other > 0 else -1)
        assert r.whitened == pytest.approx(sign * other, abs=1e-8) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_whitening_of_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ids, n, deviations, _, explained, whitened = plain_whitening(rows)
    found = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(found) == 8 * len(ids)
    for at, k in enumerate(ids):
        assert [found[k, c].deviation for c in range(1, 9)] == [deviations[at]] * 8
        assert [abs(found[k, c].whitened) for c in range(1, 9)] == pytest.approx(list(abs(whitened[at])), abs=1e-8)


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [None])])).collect() == []
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    flat = whitening.whiten(vectors_of(spark, [(1, [1.0, 5.0, 1.0]), (2, [2.0, 5.0, 1.0]), (3, [4.0, 5.0, 1.0])])).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_products_of_large_entries_are_exact():
    rng = random.Random(4)
    x = np.array([[rng.randint(-(2**50), 2**50) for _ in range(5)] for _ in range(40)], np.int64)
    plain = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.exact_product(x).tolist() == plain
    assert whitening.exact_squares(x[:1] * 0 + 3, 10, [1] * 5) == [5 * 29**2]
    assert whitening.exact_squares(x[:1], 1, [0] * 5) == [None]


def test_rotations_keep_small_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(9, 9)))
    values = np.geomspace(1, 1e-10, 9)
    found, axes = whitening.components((q * values) @ q.T, 9)
    assert found == pytest.approx(values, rel=1e-4) and np.abs(axes.T @ axes - np.eye(9)).max() < 1e-12
    tied, _ = whitening.components(np.diag([2.0, 2.0, 1.0]), 8)
    assert tied == pytest.approx([2, 2, 1])


# 12 languages


def cuts(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        for rest in cuts(word[k:]):
            yield (word[:k], *rest)


def test_segmentations_are_summed():
    pieces = language.Pieces.of(queries.VOCABULARY_LANGUAGES)
    names = sorted(p for p in language.ranks_of_tiktoken(queries.VOCABULARY_LANGUAGES) if language.RELEVANT.fullmatch(p))
    logs = np.append(np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.n))), -np.inf)
    at = {p: k for k, p in enumerate(names)}
    words = ["que".encode(), "ß".encode(), b"a", "señora".encode(), b"a", b"station", b"xq"]
    lattice = pieces.lattice(words)
    found, uses, plain = np.zeros(len(words)), lattice.expected(logs, np.arange(1.0, len(words) + 1)), Counter()
    found[lattice.order] = lattice.forward(logs[:, None])[lattice.ends(), 0]
    for k, word in enumerate(words):
        ways = {c: math.exp(sum(logs[at[p]] for p in c)) for c in cuts(b" " + word) if all(p in at for p in c)}
        assert found[k] == pytest.approx(math.log(sum(ways.values())))
        for way, p in ways.items():
            for piece in way:
                plain[at[piece]] += (k + 1) * p / sum(ways.values())
    assert {k: pytest.approx(uses[k]) for k in np.flatnonzero(uses)} == plain


def test_words():
    assert language.words_of("Größe, l'Été—NON 12a") == ["größe".encode(), b"l", "été".encode(), b"non", b"a"]
    assert language.words_of("123 — ½ ²!?") == [] == language.words_of("")
    assert language.words_of("x" * (language.LONGEST + 3)) == [b"x" * language.LONGEST, b"xxx"]


def test_languages_held_out(spark):
    rows = queries.op12_language(spark, SF).collect()
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    sentences = {"en": "the house and the garden with a tree", "de": "das haus und der garten mit einem baum"}
    rows = [(i, sentences[x], x, "s", 1) for i, x in enumerate(["en", "de"] * 20)]
    odd = [(100, None, "en", None, None), (101, "", "de", "s", 0), (102, "12 !?", None, "s", 0), (None, "the tree", "xx", "s", 0), (103, "der baum", None, "s", 8), (103, "der baum", None, "s", 8), (104, "und garten " * 30_000, None, "s", 8), (105, "d" * 40_000, None, "s", 8)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("clash")).repartition(3)
    found = {(r.doc_id, r.held_out): r for r in language.identify_languages(docs, queries.VOCABULARY_LANGUAGES).collect()}
    by_id = {k: r for (k, _), r in found.items()}
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by_id[103].lang_pred == by_id[104].lang_pred == "de" and by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert by_id[105].lang_pred in ("de", "en") and language.identify_languages(docs, queries.VOCABULARY_LANGUAGES).count() == len(rows) + len(odd)
    nothing = language.identify_languages(docs.filter("doc_id = 101 or doc_id = 103"), queries.VOCABULARY_LANGUAGES).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify_languages(docs.limit(0), queries.VOCABULARY_LANGUAGES).collect() == []


# 13 manifests


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs, arity, every):
    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        """The root, and for each node the (left, right) siblings on its way up."""
        ways, where = [[] for _ in nodes], [*range(len(nodes))]
        while len(nodes) > 1:
            for way, at in zip(ways, where, strict=True):
                run = at - at % arity
                way.append((nodes[run:at], nodes[at + 1 : run + arity]))
            where = [at // arity for at in where]
            nodes = [digest(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        return nodes[0], ways

    by_lang = {}
    for row in docs:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    rows = {x: sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in rows[x]]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for row, way in zip(rows[x], trees[x][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % every == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if hit and row[4] is not None else row[4]
            folded = leaf((*row[:4], text))
            for left, right in way + top:
                folded = digest(*left, folded, *right)
            out.append((row[0], leaf(row), trees[x][0], root, digest(*(s for left, right in way + top for s in left + right)), folded, folded == root))
    return out


@pytest.mark.parametrize("arity", [2, 8])
def test_manifest_equals_plain(spark, arity):
    rows = [(i * 3, f"src{i % 3}", "en" if i % 5 else None, len(t or ""), t) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, None, None, None, None), (None, None, "aé", 3, "ABC"), (-7, "", "", 0, "Été A"), (12, "src1", "en", 1, "Other")]
    rows += [(1000 + i, "s", f"l{i}", 1, "X") for i in range(arity + 1)]
    docs = spark.createDataFrame([(k, t, x, s, n, "clash", 1) for k, s, x, n, t in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int").repartition(5)
    found = merkle.merkle_manifest(docs, arity).collect()
    expected = Counter(plain_manifest(rows, arity, 3))
    assert Counter(tuple(r) for r in found) == expected
    assert {True, False} == {r.verified for r in found}


def test_manifest_of_few_rows(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert merkle.merkle_manifest(docs.limit(0)).collect() == []
    one = docs.filter("doc_id = 3").collect()[0]
    (found,) = merkle.merkle_manifest(docs.filter("doc_id = 3")).collect()
    assert tuple(found) == plain_manifest([(one.doc_id, one.source, one.lang, one.n_chars, one.text)], 8, 3)[0]
    assert found.leaf == found.root and found.proof_sha256 == hashlib.sha256(b"").hexdigest()
