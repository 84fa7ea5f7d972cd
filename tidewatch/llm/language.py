"""Language identification by unigrams whose segmentations are summed out.

A language is a distribution over the pieces of a fixed public vocabulary of byte strings, in which each byte is
a piece. A text is its words (runs of letters and marks in lower case), each behind a space; the probability of a word is the
sum over all ways to cut its bytes into pieces, by the forward algorithm. Pieces cross no words, so a text's probability is the product
of its words'. The text's language is that of the largest posterior, and the posterior is its score.

Training counts the words of all training texts by language, on Spark and with counts summed before the shuffle, and
estimates the pieces by expectation maximisation over that table of distinct words: each round, every task runs
forward and backward over its words and sends the expected counts of pieces, which Spark sums. The driver sees only
these sums: languages times pieces, whatever the rows. The first round weighs all pieces of a length alike. Counts get `smoothing` each, so
that no word is impossible; prior odds are the training documents' counts.

Texts that are null or have no letter are `und` with score 0, as is every text if nothing could be learnt. Words of over `LONGEST`
bytes are cut there. Rows without doc_id are predicted (held_out is false) and not learnt from; repeated rows are judged each
on its own and count in training as often as they are there. Of equal posteriors the language that sorts first wins. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets_of, worker_cache, written
from .tokens import ranks_of_tiktoken
from .toxicity import fold

#: Bytes of a word at most; bytes of words that are cut into pieces at once; distinct words that a worker counts or remembers.
LONGEST, BYTES_AT_ONCE, WORDS_HELD = 1 << 14, 400_000, 300_000
UNDETERMINED = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
#: ASCII letters in lower case and all bytes beyond ASCII stay, what else is there parts words.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
RELEVANT = re.compile(rb" ?[a-z\x80-\xff]*")


@lru_cache(1 << 16)
def parts_words(char: str) -> bool:
    return char > "\x7f" and unicodedata.category(char)[0] not in "LM"


def words_of(text: str) -> list[bytes]:
    """The words of a text, in order; none where it has no letter."""
    text = text.lower()
    chars = set(text)
    if not any(map(str.isalpha, chars)):
        return []
    for char in filter(parts_words, chars):
        text = text.replace(char, " ")
    words = text.encode().translate(LETTERS).split()
    if len(max(words, key=len, default=b"")) > LONGEST:
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


@dataclass
class Lattice:
    """Pieces at each place of some words. Places are numbered by their distance from the word's start, then by word, longer words first,
    so that the words that reach a place are the first of all. pieces[l - 1] has the piece of length l that starts at a place, n_pieces if there is none."""

    order: np.ndarray
    lens: np.ndarray
    base: np.ndarray
    pieces: np.ndarray

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """log of the summed probability of all ways to reach each place, by column of logs (piece, language)."""
        out = np.zeros((self.base[-1], logs.shape[1]))
        for t in range(1, len(self.base) - 1):
            n = self.base[t + 1] - self.base[t]
            back = np.arange(1, min(t, len(self.pieces)) + 1)
            starts = self.base[t - back][:, None] + np.arange(n)
            x = out[starts] + logs[self.pieces[back[:, None] - 1, starts]]
            most = x.max(0)
            out[self.base[t] : self.base[t + 1]] = most + np.log(np.exp(x - most).sum(0))
        return out

    def ends(self) -> np.ndarray:
        """The last place of each word."""
        return self.base[self.lens] + np.arange(len(self.lens))

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language's logs and counts of the words."""
        ahead, reached = np.full(self.base[-1], -np.inf), self.forward(logs[:, None])[:, 0]
        ends = self.ends()
        ahead[ends] = 0.0
        uses = np.zeros(len(logs))
        whole, times = reached[ends], counts[self.order]
        for t in range(len(self.base) - 3, -1, -1):
            n = self.base[t + 2] - self.base[t + 1]  # words with a byte here
            on = np.arange(1, min(len(self.base) - 2 - t, len(self.pieces)) + 1)
            piece = self.pieces[on - 1, self.base[t] : self.base[t] + n]
            x = logs[piece] + ahead[np.minimum(self.base[t + on][:, None] + np.arange(n), self.base[-1] - 1)]
            most = x.max(0)
            share = np.exp(x - most)
            summed = share.sum(0)
            ahead[self.base[t] : self.base[t] + n] = most + np.log(summed)
            # P(a word's cut passes here) times each piece's share of the ways on
            passes = times[:n] * np.exp(reached[self.base[t] : self.base[t] + n] + most - whole[:n])
            uses += np.bincount(piece.ravel(), (share * passes).ravel(), len(logs))
        return uses


class Pieces:
    """The vocabulary's pieces that words can hold, as a table of transitions."""

    def __init__(self, path: str):
        known = sorted(p for p in ranks_of_tiktoken(path) if RELEVANT.fullmatch(p))
        self.n, self.lengths = len(known), np.array([len(p) for p in known])
        heads = {b""} | {p[:i] for p in known for i in range(1, len(p))}
        rows = {h: i for i, h in enumerate(sorted(heads))}
        used = sorted({b for p in known for b in p})
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        #: By head and byte: the row of the longer head, and the piece; -1 if there is none.
        self.longer, self.piece = (np.full((len(rows), len(used) + 1), -1, np.int32) for _ in range(2))
        for h, i in rows.items():
            if h:
                self.longer[rows[h[:-1]], self.code[h[-1]]] = i
        for k, p in enumerate(known):
            self.piece[rows[p[:-1]], self.code[p[-1]]] = k
        self.root = rows[b""]

    @classmethod
    def of(cls, path: str) -> Pieces:
        cache = worker_cache("pieces")
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def lattice(self, words: list[bytes]) -> Lattice:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-lens, kind="stable")
        starts = offsets_of(lens + 1)[:-1]
        flat = self.code[np.frombuffer(b"".join(b" %b\n" % w for w in words), np.uint8)]
        starts, lens = starts[order], lens[order]
        reach = np.searchsorted(-lens, -np.arange(int(lens[0]) + 1), side="right")  # words that reach each distance
        base = offsets_of(reach)
        distance = np.repeat(np.arange(len(reach)), reach)
        at = starts[np.arange(base[-1]) - base[distance]] + distance
        live, row, found = np.arange(base[-1]), np.full(base[-1], self.root), []
        while len(live):
            symbol = flat[at[live] + len(found)]
            piece = self.piece[row, symbol]
            found.append(np.full(base[-1], self.n, np.int32))
            found[-1][live[piece >= 0]] = piece[piece >= 0]
            row = self.longer[row, symbol]
            live, row = live[row >= 0], row[row >= 0]
        return Lattice(order, lens, base, np.array(found))


def portions(words: list[bytes]) -> list[slice]:
    """Slices of words of about BYTES_AT_ONCE bytes."""
    ends = np.cumsum([len(w) + 2 for w in words])
    cuts = np.unique(np.searchsorted(ends, np.arange(BYTES_AT_ONCE, ends[-1] + BYTES_AT_ONCE, BYTES_AT_ONCE), side="right")) if len(words) else []
    cuts = sorted({0, len(words), *(int(c) for c in cuts)})
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def training_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: counts of the words of all training documents; the empty word counts the documents."""

    def count(batches):
        held: dict[str, Counter] = {}

        def flushed():
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            langs, words, counts = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counter = held.setdefault(lang, Counter())
                counter[b""] += 1
                counter.update(words_of(text.as_py()))
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield flushed()
        yield flushed()

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Unigrams:
    """Learnt languages in order, log prior odds, and logs (piece, language) with a last row for no piece."""

    langs: list[str]
    prior: np.ndarray
    logs: np.ndarray


def fitted(docs: DataFrame, vocabulary: str, rounds: int, smoothing: float) -> Unigrams | None:
    """The languages' pieces; None where no training document has a word."""
    spark = docs.sparkSession
    words = written(training_words(docs), "words")
    # a row a language
    n_docs = {r.lang: r.n for r in words.filter(F.octet_length("word") == 0).select("lang", "n").collect()}
    langs = sorted(n_docs, key=str.encode)
    words = words.filter(F.octet_length("word") > 0)
    pieces = Pieces.of(vocabulary)
    if not langs or words.isEmpty():
        return None
    # pieces of a length share what a byte less than a longer one would cost
    logs = np.tile(np.append(-3.0 * np.ones(pieces.n) - 0.7 * pieces.lengths, -np.inf)[:, None], (1, len(langs)))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((langs, logs))

        def expect(batches, model=model):
            langs, logs = model.value
            pieces, uses = Pieces.of(vocabulary), {}
            for batch in batches:
                rows = {}
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                    rows.setdefault(lang, []).append((word, n))
                for lang, own in rows.items():
                    names, counts, k = [w for w, _ in own], np.array([n for _, n in own], np.float64), langs.index(lang)
                    for part in portions(names):
                        uses[k] = uses.get(k, 0.0) + pieces.lattice(names[part]).expected(logs[:, k], counts[part])
            for k, found in uses.items():
                at = np.flatnonzero(found[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "piece", "uses"])

        # a row for each language and piece at most
        sums = words.mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros((pieces.n, len(langs)))
        uses[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["uses"].to_numpy()
        uses += smoothing
        logs = np.vstack([np.log(uses / uses.sum(0)), np.full((1, len(langs)), -np.inf)])
    prior = np.log(np.array([n_docs[x] for x in langs], np.float64) / sum(n_docs.values()))
    return Unigrams(langs, prior, logs)


class Scorer:
    """Log probabilities of words, kept for the words seen last."""

    def __init__(self, model: Unigrams, vocabulary: str):
        self.model, self.pieces = model, Pieces.of(vocabulary)
        self.clear()

    def clear(self):
        self.ids: dict[bytes, int] = {}
        self.logs = np.zeros((1 << 12, len(self.model.langs)))

    def learn(self, words: list[bytes]) -> None:
        first = len(self.ids)
        self.ids.update(zip(words, range(first, first + len(words)), strict=True))
        while len(self.ids) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for part in portions(words):
            lattice = self.pieces.lattice(words[part])
            self.logs[first + part.start + lattice.order] = lattice.forward(self.model.logs)[lattice.ends()]

    def posteriors(self, texts: list[list[bytes]]) -> np.ndarray:
        """Of each text by language."""
        known = self.ids
        if len(known) > WORDS_HELD:
            self.clear()
            known = self.ids
        self.learn([*{w: None for words in texts for w in words if w not in known}])
        joint = np.tile(self.model.prior, (len(texts), 1))
        for row, words in zip(joint, texts, strict=True):
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                row += self.logs[np.fromiter(map(known.__getitem__, part), np.int64, len(part))].sum(0)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        return joint / joint.sum(1, keepdims=True)


def identify_languages(docs: DataFrame, vocabulary: str, rounds: int = 3, smoothing: float = 0.1, chars_at_once: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learnt = fitted(docs, vocabulary, rounds, smoothing)
    model = docs.sparkSession.sparkContext.broadcast(learnt)

    def predict(batches):
        scorer = Scorer(model.value, vocabulary) if model.value else None

        def told(texts):
            if not scorer:
                return [(UNDETERMINED, 0.0)] * len(texts)
            found = scorer.posteriors(texts)
            return [(scorer.model.langs[k], float(row[k])) if words else (UNDETERMINED, 0.0) for words, row, k in zip(texts, found, found.argmax(1).tolist(), strict=True)]

        for batch in batches:
            out, texts, held = [], [], 0
            for text in batch.column("text"):
                text = text.as_py() or ""
                texts.append(words_of(text))
                held += len(text)
                if held > chars_at_once:
                    out += told(texts)
                    texts, held = [], 0
            out += told(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], [f.split()[0] for f in PREDICTED.split(", ")])

    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, F.col("text").cast("string").alias("text")).mapInArrow(predict, PREDICTED)
