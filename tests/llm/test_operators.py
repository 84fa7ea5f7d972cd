"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, compression, fingerprints, jaccard_join, line_dedup, packing, preference, queries, suffix_dedup, tokens, toxicity, warc
from tidewatch.llm.common import shared_dir

from ..oracle import same
from . import brute
from .data import documents, texts

SF = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def known():
    return {i * 3: t for i, t in enumerate(texts())}


def empty(docs):
    return docs.limit(0)


def repeated(docs):
    return docs.unionByName(docs.filter("doc_id in (0, 12)"))


def doubling(n):
    """Two letters as a doubling sequence, and its complement: their polynomial hashes modulo a power of two are equal for any base."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


# 1 fingerprints


def test_fingerprints(docs, known):
    rows = fingerprints.fingerprints(repeated(docs)).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*known, 0, 12])
    ids = sorted(known)
    for r in rows:
        text, following = known[r.doc_id] or "", known[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert (r.n_chars, r.edited_text) == (len(text), edited)
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = brute.shingles(text.lower()), brute.shingles(other.lower())
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.12)
    assert fingerprints.fingerprints(empty(docs)).count() == 0


def test_sketches_merge_and_estimate(spark):
    k = 64
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(0, 3000)), " ".join(f"w{i}" for i in range(1000, 4000)))], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, F.col("a"), "sa", k, 5), F.col("b"), "sb", k, 5)
    r = df.select(
        fingerprints.resemblance(F.col("sa"), F.col("sb"), k).alias("likeness"), fingerprints.containment(F.col("sa"), F.col("sb"), k).alias("part"),
        fingerprints.distinct_shingles(F.col("sa"), k).alias("n"), fingerprints.merge_sketches(F.col("sa"), F.col("sb"), k).alias("union"), "sa", "sb",
    ).first()
    assert r.likeness == pytest.approx(0.5, abs=0.2) and r.part == pytest.approx(0.66, abs=0.25) and r.n == pytest.approx(2996, rel=0.4)
    assert r.union == sorted(set(r.sa) | set(r.sb))[:k]
    whole = df.select(F.explode(F.array("sa", "sb")).alias("s")).agg(fingerprints.merge_all(F.col("s"), k).alias("m")).first().m
    assert whole == r.union


# 2 line dedup


def test_line_dedup(docs, known):
    rows = line_dedup.drop_repeated_runs(docs).collect()
    assert {r.doc_id: r.text for r in rows} == brute.without_repeated_lines(known.items())
    assert {r.doc_id: r.rest.rest for r in rows} == dict.fromkeys(known, "x")
    assert len(line_dedup.drop_repeated_runs(repeated(docs)).collect()) == len(known) + 2
    assert line_dedup.drop_repeated_runs(empty(docs)).count() == 0


def test_overlapping_repeats_of_one_line(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\na"), (2, None), (3, "x\na\na\na\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df).collect()} == {1: "a", 2: "", 3: "x\ny"}


def test_line_runs_of_rows_without_id_and_of_chance_neighbours(spark):
    rng = random.Random(13)
    rows = [(k, "\n".join(rng.choices("abcdef", k=rng.randint(0, 14)))) for k in range(120)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.without_repeated_lines(rows)
    df = spark.createDataFrame([(None, "p\nq\nr\ns"), (None, "x\np\nq\nr"), (3, "q\nr\ns")], "doc_id long, text string")
    assert Counter(r.text for r in line_dedup.drop_repeated_runs(df).collect()) == {"p\nq\nr\ns": 1, "x": 1, "": 1} or Counter(r.text for r in line_dedup.drop_repeated_runs(df).collect()) == {"x\np\nq\nr": 1, "s": 1, "": 1}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


# 3 quality rules


def test_quality_counts_and_bands(spark, docs, known):
    rows = {r.doc_id: r for r in compression.quality_rules(docs).collect()}
    for k, t in known.items():
        w, r = brute.words(t), rows[k]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(x) for x in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert compression.quality_rules(empty(docs)).count() == 0


def test_quality_counts_symbols_and_judges_repeated_rows_alike(spark):
    rows = [(1, "a # b * $5 % & | < > ## \n\n# #"), (1, "a # b * $5 % & | < > ## \n\n# #"), (None, "x"), (2, None)]
    got = compression.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_symbols, r.n_words, r.kept) for r in got) == {(1, 12, 13, False): 2, (None, 0, 1, False): 1, (2, 0, 0, False): 1}


def noise(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789      ", k=n))


def test_good_texts_stay_and_noise_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rng = random.Random(7)
    junk = spark.createDataFrame([(-i, noise(rng, n), "en", "s", n) for i, n in enumerate(range(700, 9000, 100), 1)], brute.SCHEMA)
    found = compression.quality_rules(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(junk)).collect()
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    held = [r.kept for r in found if r.doc_id in good and not r.base_failed]
    assert len(held) > 100 and sum(held) >= 0.99 * len(held)
    assert [r.base_failed for r in found if r.doc_id < 0] == [False] * len(range(700, 9000, 100)) and not any(r.kept for r in found if r.doc_id < 0)


def plain_verdict(text):
    """The rules said plainly: limits by straight lines through the table's middles, every chunk held against those of its length."""
    import zstandard

    def limits(n):
        at = [2 ** ((compression.PROSE_FROM + k + 0.5) / 2) for k in range(len(compression.PROSE))]
        return float(np.interp(np.log2(max(n, 1)), np.log2(at), compression.PROSE))

    pack = zstandard.ZstdCompressor(level=3).compress
    raw = (text or "").encode()
    words = brute.words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return True, False
    kept = 0.8 * limits(len(raw)) <= len(raw) / len(pack(raw)) <= 1.12 * limits(len(raw))
    chunks = [raw[i : i + 4096] for i in range(0, len(raw) - 4095, 4096)] + ([raw[-4096:]] if len(raw) > 4096 else [])
    return False, kept and all(0.8 * limits(4096) <= 4096 / len(pack(x)) <= 1.07 * limits(4096) for x in chunks)


def test_verdicts_equal_plain_rules_in_tables_of_any_size(spark):
    rng = random.Random(12)
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    words = prose[0].split()
    odd = [noise(rng, 3000), "a b c " * 900, " ".join(rng.choices(words, k=9000)), prose[1] + noise(rng, 9000), " ".join(rng.choices(["ja", "nein", "gut"], k=600)), None, "", "x" * 200_000]
    few = [*odd, *prose[:21]]
    expected = [plain_verdict(t) for t in few]
    for rows in (few[:1], few, [*few, prose[30]], [*few, *(t for t in prose * 11)][:10_000]):
        found = {r.doc_id: (r.base_failed, r.kept) for r in compression.quality_rules(documents(spark, rows)).collect()}
        assert [found[3 * i] for i in range(len(rows[: len(few)]))] == expected[: len(rows)]
    assert len({k for _, k in expected}) == 2


def test_every_byte_of_a_long_text_is_in_a_chunk():
    for n in (0, 9, 10, 11, 19, 20, 25):
        starts = compression.chunk_starts(n, 10)
        assert {b for a in starts for b in range(a, a + 10)} == set(range(n if n >= 10 else 0))


def test_junk_behind_the_chunk_grid_is_seen(spark):
    rng = random.Random(11)
    plain = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota"], k=2000))[:4096]
    rows = {r.doc_id: r for r in compression.quality_rules(documents(spark, [plain + noise(rng, 4000), plain]), max_repeat_percent=100).collect()}
    assert rows[0].chunk_low < 1.5 < rows[3].chunk_low == rows[0].chunk_high


# 4 toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lens, trans = np.array([4, 0, 1, 3]), rng.normal(size=(2, 2))
    e = rng.normal(size=lens.sum())
    at, expected, moves = 0, [], np.zeros((2, 2))
    for n in lens:
        total, one, m = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2**n if n else 0):
            y = [bits >> i & 1 for i in range(n)]
            weight = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += weight
            one += weight * np.array(y)
            for i in range(n - 1):
                m[y[i], y[i + 1]] += weight
        if n:
            expected += list(one / total)
            moves += m / total
        at += n
    for stretch in (1, 2, 3, 128):
        p, pairs = toxicity.marginals(e, lens, trans, stretch)
        assert p == pytest.approx(np.array(expected)) and pairs == pytest.approx(moves)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = rng.choices(plain, k=rng.randint(20, 80))
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile!", "Rotten", "awful,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "vile rotten awful vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = toxicity.toxicity_scores(docs, spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    text = dict(rows)
    assert all(any(x in text[r.doc_id][s.start : s.stop].lower() for x in ("vile", "rotten", "awful")) for r in held if truth[r.doc_id] for s in r.spans)
    assert toxicity.toxicity_scores(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_words_that_are_toxic_only_next_to_each_other(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)] + ["clever", "sod"]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=rng.randint(30, 60))
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(["clever", "sod"])
        # no word tells the classes apart: each has both words, only toxic texts have them side by side
        w = [x for k, x in enumerate(w) if not (k and w[k - 1] == "clever" and x == "sod")]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = ["Clever", "sod!"]
        else:
            w += ["Clever", "w1", "sod!"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    # one very long training text, early in the order, costs no other text its place
    rows += [(5000 + k, " ".join(rng.choices(plain[:300], k=300_000))) for k in range(2)]
    labels += [(5000 + k, 0) for k in range(2)]
    found = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth, text = dict(labels), dict(rows)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert any("Clever sod!" in text[r.doc_id][max(0, s.start - 10) : s.stop] for r in held for s in r.spans)


def test_toxic_rows_go_and_others_stay_whole(spark):
    rng = random.Random(5)
    rows = [(i, " ".join([*rng.choices([f"word{k}" for k in range(200)], k=40), *(["vile", "rotten"] if i % 4 == 0 else [])]), f"s{i}", i, "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, predicted string")
    left = toxicity.drop_toxic(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {r for r in rows if r[0] % 4}


# 5 preference


def test_preference_pairs(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", "x"), (3, 0, None, None), (4, 0, "user", "only")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "s"), (1, 3, "assistant", "bad"), (2, 0, "user", "x"), (2, 1, "assistant", "é"), (3, 0, "user", ""), (None, 0, "user", "z")]
    schema = "pair_id long, turn long, role string, text string"
    rows = {r.pair_id: r for r in preference.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(rows) == {1, 2, 3}
    r = rows[1]
    assert r.n_common == 2 and r.prompt == "<|user|>\nq\n<|end|>\n<|assistant|>\na\n<|end|>\n"
    assert [r.chosen_completion[s.start : s.stop] for s in r.chosen_spans] == ["good"] and [r.rejected_completion[s.start : s.stop] for s in r.rejected_spans] == ["bad"]
    assert rows[2].chosen_completion == "" and [rows[2].rejected_completion[s.start : s.stop] for s in rows[2].rejected_spans] == ["é"]
    assert rows[3].n_common == 0
    none = spark.createDataFrame([], schema)
    assert preference.preference_pairs(none, none).count() == 0


def test_replies_share_a_prompt_in_every_conversation(spark):
    rows = queries.QUERIES["op5_preference_replies"](spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert {r.pair_id for r in rows} == {r.conv_id for r in turns.filter("turn is not null and conv_id is not null").select("conv_id").distinct().collect()}
    assert any(r.n_common and r.prompt and r.chosen_completion != r.rejected_completion for r in rows)


# 6 WARC


def test_archives_round_trip_and_are_equal_byte_by_byte(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "x"), (5, "a\nb", "x"), (9, "z", "é\r\n\r\nq"), (700, "z", "x"), (10**12, "q", "é\r\n\r\nq"), (None, "lost", "x"), (4, "long", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    a, b = shared_dir(spark, "warc"), shared_dir(spark, "warc")
    first = warc.write_archives(df, a, roll_bytes=400).collect()
    assert sorted(first) == sorted(warc.write_archives(df.repartition(5), b, roll_bytes=400).collect()) and len(first) > 3
    largest = {}
    for k, _, h in rows:
        if k is not None:
            largest[h or ""] = max(k, largest.get(h or "", k))
    assert {r.page_id for r in warc.read_archives(spark, a).collect()} == {k for k, *_ in rows}
    for r in warc.read_archives(spark, a).filter("page_id is not null").collect():
        html = next(h or "" for k, _, h in rows if k == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), warc.base32_sha1(html.encode()))
        response = largest[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", largest[html]))
        assert r.body == (html.encode() if response else None)
    assert {r.record_type for r in warc.archive_round_trip(df, revisit_bytes=10**6).collect()} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_repeated_page_ids_keep_every_payload(spark):
    df = spark.createDataFrame([(5, "u", "A" * 9), (5, "u", "B" * 9), (9, "u", "A" * 9), (5, "u", "A" * 9), (9, "v", "A" * 9)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_digest[:4], r.record_type, r.refers_to, r.body and bytes(r.body)) for r in warc.archive_round_trip(df).collect())
    a, b = (warc.base32_sha1(x * 9)[:4] for x in (b"A", b"B"))
    assert got == {(5, a, "revisit", 9, None): 2, (5, b, "response", None, b"B" * 9): 1, (9, a, "response", None, b"A" * 9): 1, (9, a, "revisit", 9, None): 1}


def test_pages_without_id_are_records(spark):
    rows = [(None, "u", "A" * 9), (None, "v", "A" * 9), (None, "u", "B" * 9), (7, "u", "B" * 9), (None, None, None), (None, "w", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.body and bytes(r.body)) for r in warc.archive_round_trip(df.repartition(3)).collect())
    assert got == {
        (None, 9, "response", None, b"A" * 9): 1, (None, 9, "revisit", None, None): 1, (None, 9, "revisit", 7, None): 1, (7, 9, "response", None, b"B" * 9): 1,
        (None, 0, "response", None, b""): 1, (None, 0, "revisit", None, None): 1,
    }
    assert {r.record_type for r in warc.archive_round_trip(df, revisit_bytes=10).collect()} == {"response"}


def test_outlying_ids_and_frequent_ids_do_not_fill_a_shard(spark):
    far = spark.range(4000).select("id").unionByName(spark.createDataFrame([(10**12,), (10**18,), (-(10**18),)], "id long"))
    frequent = spark.range(1500).select(F.lit(77_777).cast("long").alias("id"))
    pages = far.unionByName(frequent).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.monotonically_increasing_id()).alias("html"))
    target = shared_dir(spark, "warc")
    files = warc.write_archives(pages, target, pages_per_shard=100).collect()
    by_shard = Counter()
    for f in files:
        by_shard[f.shard] += f.n_records
    assert sum(by_shard.values()) == 5503 and max(by_shard.values()) <= 200
    assert warc.read_archives(spark, target).select("page_id").distinct().count() == 4004


def test_archives_are_read_only_when_committed(spark):
    df = spark.createDataFrame([(k, "u", f"<p>{k}") for k in range(50)], "page_id long, url string, html string")
    target = shared_dir(spark, "warc")
    files = warc.write_archives(df, target, pages_per_shard=7)
    assert 7 <= files.count() <= 10 and warc.read_archives(spark, target).count() == 50
    fs, root = warc.store(target)
    assert not [x for x in fs.get_file_info(warc.FileSelector(root)) if x.base_name.startswith(".")]
    with pytest.raises(ValueError, match="already"):
        warc.write_archives(df, target)
    # a commit that was killed before its end leaves part of a manifest, without the mark
    fs.delete_file(f"{root}/manifest/_SUCCESS")
    with pytest.raises(ValueError, match="no committed"):
        warc.read_archives(spark, target)


# 7 suffix-array dedup


@pytest.mark.parametrize("length, gram", [(40, 13), (60, 60), (400, 128)])
def test_repeats_equal_brute_force(docs, known, length, gram):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length, gram).collect()}
    keys = sorted(known)
    for k, kept in zip(keys, brute.without_repeats([known[k] for k in keys], length), strict=True):
        assert bytes(rows[k].kept) == kept and rows[k].rest.source == "src0"
        assert rows[k].n_bytes - sum(s.stop - s.start for s in rows[k].spans) == len(kept)


def test_repeats_in_periodic_and_equal_texts(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("ab", k=300))
    rows = ["a" * 200, base, base[50:250], base[100:] + "c" + base[:100], None, "", "short", "short"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df.unionByName(df.filter("doc_id = 7")), 30, 10).collect()}
    expected = brute.without_repeats([*rows, "short"], 30)
    assert got == dict(enumerate(expected[:-1]))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("length, gram", [(12, 4), (51, 17)])
def test_repeats_of_words_equal_brute_force(docs, known, length, gram):
    counts = Counter(tuple(w[i : i + length]) for w in map(brute.words, known.values()) for i in range(len(w) - length + 1))
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length, gram, words=True).collect()}
    for k, t in known.items():
        w, raw = brute.words(t), (t or "").encode()
        gone = {j for i in range(len(w) - length + 1) if counts[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        assert brute.words(bytes(rows[k].kept).decode()) == [x for j, x in enumerate(w) if j not in gone]
        assert rows[k].n_bytes == len(raw) and (gone or bytes(rows[k].kept) == raw)
        assert rows[k].n_bytes - sum(s.stop - s.start for s in rows[k].spans) == len(rows[k].kept)


@pytest.mark.parametrize("words, length, gram, piece", [(False, 40, 13, 300), (False, 400, 128, 500), (True, 12, 4, 250), (True, 51, 17, 1000)])
def test_long_texts_in_pieces_give_what_whole_texts_give(spark, words, length, gram, piece):
    rng = random.Random(8)
    known = [t or "" for t in texts(n=12)]
    # runs across the bounds of pieces, a text within itself, white space and long words at bounds
    known += [known[-1][300:4000] + " ", "  ".join(known[:6]) + "\n\n", "x" * 900 + known[3] * 2 + "\t" * 700 + "y" * 900, "".join(rng.choices("ab ", k=5000)), "z" * 3000, "z" * 2999]
    df = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
    cut, whole = (sorted(suffix_dedup.remove_repeats(df, length, gram, words, piece=p).collect()) for p in (piece, suffix_dedup.PIECE))
    assert cut == whole and sum(len(r.spans) for r in cut)
    if not words:
        assert [bytes(r.kept) for r in cut] == brute.without_repeats(known, length)


def around_a_passage():
    """Texts around one passage, most windows of which are their own; some are met again."""
    rng = random.Random(12)

    def run(k):
        return "".join(rng.choices("abcdefgh ", k=k))

    common = run(300)
    known = [run(250) + common + run(250) for _ in range(60)]
    return [*known, *(t[100:600] + run(50) for t in known[::7]), None, "", common, known[0]]


@pytest.mark.parametrize("together", [1, 300, 16_384])
def test_windows_dealt_in_parts_equal_brute_force(spark, together):
    known = around_a_passage()
    df = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, together=together).collect()}
    assert got == dict(enumerate(brute.without_repeats(known, 400)))


def test_windows_of_a_common_passage_do_not_all_go_to_one_column():
    raw = [(t or "").encode() for t in around_a_passage()]
    blocks = [suffix_dedup.Block(raw[i::4], 400, 128, 128, 16, suffix_dedup.Buffer, suffix_dedup.PIECE) for i in range(4)]
    family = suffix_dedup.Family(128)
    for b in blocks:
        family.add(b.keys, b.twice)
    keys, ends = np.concatenate([b.keys for b in blocks]), np.cumsum([0, *(len(b.keys) for b in blocks)])

    def dealt(found):
        return [suffix_dedup.Windows(list(suffix_dedup.open_windows(b.judged(found[a:z]))), 16) for b, a, z in zip(blocks, ends[:-1], ends[1:], strict=True)]

    whole, parts = dealt(family.found()), dealt(suffix_dedup.with_bits(family.suffixes(keys), family.found(), 4))
    sizes = [sum(np.diff(w.cuts) for w in x) for x in (whole, parts)]
    assert sizes[0].sum() == sizes[1].sum() > 5000
    assert sizes[0].max() > 0.5 * sizes[0].sum() and sizes[1].max() < 0.25 * sizes[1].sum()
    # equal windows stay together
    pairs = np.unique(np.concatenate([np.stack([w.prints, w.groups]) for w in parts], 1), axis=1)
    assert len(np.unique(pairs[0])) == pairs.shape[1]


def keys_of(rng, n):
    """Keys of two bytes of suffix and one of stretch, as digests go."""
    return np.array([bytes([97 + int(a), 97 + int(b)]) + bytes([98 + int(c)]) * suffix_dedup.DIGEST for a, b, c in rng.integers(0, (6, 6, 3), (n, 3))], f"S{2 + suffix_dedup.DIGEST}")


def test_batches_are_scanned_against_the_levels_that_are_there():
    rng = np.random.default_rng(1)
    for n in (3, 30, 90):
        family, batches = suffix_dedup.Family(2), [np.unique(keys_of(rng, n)) for _ in range(7)]
        for b in batches:
            family.add(b, np.zeros(len(b), bool))
        assert [x is not None for x in family.levels] == [True, True, True]
        assert all((x[0][1:] > x[0][:-1]).all() for x in family.levels)
        every = [k for b in batches for k in b.tolist()]
        count, stretches, seen = Counter(every), {}, set()
        for k in every:
            stretches.setdefault(k[:2], set()).add(k)
        for k, found in zip(every, family.found().tolist(), strict=True):
            mixed = len(stretches[k[:2]]) > 1
            first, seen = k not in seen, seen | {k}
            assert found == (suffix_dedup.REPEATED if not first or (count[k] > 1 and not mixed) else suffix_dedup.STANDS if count[k] > 1 else suffix_dedup.OPEN if mixed else suffix_dedup.NOTHING)


def test_strings_of_one_polynomial_hash_are_told_apart(spark):
    a, b = doubling(256)
    rows = []
    for seed in range(40):
        rng = random.Random(seed)
        left, right = ("".join(rng.choices("cdefgh", k=390)) for _ in range(2))
        rows += [left + a + right, left[::-1] + b + right[::-1]]
    rows += [doubling(600)[0], doubling(600)[1].upper()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.without_repeats(rows, 400)))


# 8 packing


def test_packing(docs, known):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = packing.pack(docs, path, PATTERN, docs_per_block=20).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in known.items():
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r.length
        assert at <= 1024
    assert sum(1024 - sum(p.length for p in pieces) for pieces in by_sequence.values()) < 3 * 1024
    assert packing.pack(empty(docs), path, PATTERN).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_spacing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encoder, rng = tokens.Encoder.of(path, PATTERN), random.Random(9)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "é", "日", "12", "!", "...", "<|endoftext|>", " ", "\r", "\x1c", "🙂"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# 9 n-gram Jaccard join


def test_components_equal_brute_force(docs, known):
    rows = jaccard_join.jaccard_components(repeated(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.components(known.items())
    assert len(rows) == len(known) + 2
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0


def test_links_at_exactly_the_bound_and_among_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(124)]  # 120 shingles
    rows = [" ".join(base), " ".join(base[:100]), " ".join(base[:99])]  # 96 and 95 of 120
    other = [f"v{i}" for i in range(60)]
    for _ in range(40):
        copy = list(other)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"x{rng.random()}"
        rows.append(" ".join(copy))
    df = documents(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute.components((i * 3, t) for i, t in enumerate(rows))
    assert got[3][1] == 0


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    rows = [*doubling(512), *doubling(1024), *doubling(2048)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == {i * 3: i * 3 for i in range(len(rows))}


def test_sets_that_share_a_passage_meet_only_where_sizes_allow(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(120))
    # of each pair the shared passage is less than the bound, but for the pairs of equal own parts
    own = [" ".join(f"o{i}x{k}" for k in range(rng.randint(12, 40))) for i in range(12)]
    rows = [f"{passage} {own[i % 12]}" + (f" {own[(i + 1) % 12]}" if i > 23 else "") + f" e{i}" for i in range(36)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute.components((i * 3, t) for i, t in enumerate(rows))


def test_rows_of_one_id_and_rows_of_none(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (5, b), (9, a + " x"), (4, b + " y"), (5, a), (None, a), (None, "lone words here"), (None, None), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert got == {(5, 56, 5): 2, (5, 56, 4): 1, (9, 57, 5): 1, (4, 57, 4): 1, (None, 56, 5): 1, (None, 1, None): 1, (None, 0, None): 2}
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect())
    assert kept[4, b + " y"] == kept[5, a] == kept[None, "lone words here"] == 1 and kept[9, a + " x"] == 0


# 10 byte-level BPE


def test_encoding_and_decoding(spark, docs, known):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.ranks_of_tiktoken(path), special_tokens={})
    rng = random.Random(6)
    odd = ["".join(rng.choices([" ", "  ", "\n", "a", "the", "'s", "é", "日", "12", "!", "<|endoftext|>", "\r", "🙂"], k=rng.randint(0, 12))) for _ in range(200)]
    odd += ["a.\nb c,\n\nd", "\n a", "a\n", ".\nÀé.\nx y.\n z", "ab. c'd e\u00a0f", "Ωx λ. ª 1a a1."]
    for table, expected in ((docs, known), (documents(spark, odd), {i * 3: t for i, t in enumerate(odd)})):
        for r in bpe.encode_decode(table, path, PATTERN).collect():
            ids = library.encode_ordinary(expected[r.doc_id] or "")
            assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), np.array(ids, "<u4").tobytes(), (expected[r.doc_id] or "").encode())
    assert bpe.encode_decode(empty(docs), path, PATTERN).count() == 0
    twice = spark.createDataFrame([(None, "one two"), (None, "three"), (7, "one two"), (7, "one two"), (7, None)], "doc_id long, text string")
    got = Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.encode_decode(twice, path, PATTERN).collect())
    assert got == {(None, "one two"): 1, (None, "three"): 1, (7, "one two"): 2, (7, ""): 1}
