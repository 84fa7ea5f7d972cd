"""Toxicity by a linear-chain conditional random field over words.

Training takes a bounded sample of labelled documents of the training folds: at most
`per_class` of each class, chosen by hash of the id, the first `max_chars` characters of
each. Documents are labelled, words are not: words of toxic documents with a cue (a word
form, a prefix of it or a pair of neighbouring forms that toxic documents hold far oftener
than clean ones) start as toxic tokens. A two-state field over each word's form and
prefixes, those of its neighbours, pairs of forms, shape and place in the text is fitted
to the tokens by gradient ascent on their conditional likelihood; in between, the tokens of toxic
documents get new labels, the field's own marginals given that a toxic document has a
toxic word, while clean documents have none. Scoring runs the forward-backward recursion
over every whole text, side by side for the stretches of a batch's texts; a calibrated
logistic of the token marginals is the document's score, and runs of words whose marginal
is 0.5 or more are its offending spans.

Null and empty texts have no tokens and get the calibration's score for none. Rows are
scored each on its own, so repeated rows get equal scores. Labels that are null, or whose
document is missing, are not used; without any toxic or any clean label all scores are 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, offsets_of, ragged_index
from .shingles import shingle_sets

SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("n_toxic_tokens", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("marginal", T.DoubleType())]))),
    ]
)
PREFIXES = (4, 5, 6, 7)
EDGES = "#*$%&|<>.,;:!?\"'()[]{}-_"
#: Characters of texts that are scored side by side, tokens of a stretch of the recursion and of one in training.
CHARS_AT_ONCE, STRETCH, TRAINED = 1_000_000, 128, 512


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def form_of(word: str) -> str:
    return word.lower().strip(EDGES)


def features_of(word: str) -> list[str]:
    """A word's features: its letters in lower case, and the first four to seven of them."""
    form = form_of(word)
    return [f"w:{form}", *(f"p:{form[:n]}" for n in PREFIXES if len(form) >= n)] if form else []


#: Shapes of words, from the word and its form.
SHAPES = {"s:loud": lambda word, form: word.isupper() and len(word) > 1, "s:mark": lambda word, form: word[-1] in "!?", "s:bare": lambda word, form: not form}


@dataclass
class Field:
    """Two-state chain: weights of features for the toxic state, a bias, log transitions; and the calibration.

    Features of the word before are marked -, of the word after +; b: is a pair of forms; s: shape or place."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    log_trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray | None = None

    def __post_init__(self):
        # the first letters of all forms and prefixes that weigh: other words are passed by
        known = [f.lstrip("-+")[2:] for f in self.weights if f.lstrip("-+")[:2] in ("w:", "p:")]
        self.heads = {x[: PREFIXES[0]] for x in known}
        self.seconds = {f.split(" ")[1] for f in self.weights if f.startswith("b:")}

    def table(self, words: list[str]) -> np.ndarray:
        """What each word adds to its own emission, to that of the word after and of the word before, and whether it may end a pair."""
        forms, get = [w.lower().strip(EDGES) for w in words], self.weights.get
        out = np.zeros((len(words), 4))
        for name, holds in SHAPES.items():
            if weight := get(name):
                out[:, 0] += weight * np.fromiter(map(holds, words, forms), bool, len(words))
        for i in [i for i, form in enumerate(forms) if form[: PREFIXES[0]] in self.heads]:
            found = features_of(words[i])
            out[i, :3] += [sum(get(side + f, 0.0) for f in found) for side in ("", "-", "+")]
        if self.seconds:
            out[:, 3] = np.fromiter(map(self.seconds.__contains__, forms), bool, len(words))
        return out

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission of each token of some texts, end to end, and the texts' lengths."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        distinct = dict.fromkeys(chain.from_iterable(texts))
        if not distinct:
            return np.zeros(0), lens
        table = self.table(list(distinct))
        for i, w in enumerate(distinct):
            distinct[w] = i
        ids = np.fromiter(map(distinct.__getitem__, chain.from_iterable(texts)), np.int64, int(lens.sum()))
        own, after, before, second = table[ids].T
        ends = offsets_of(lens)
        first, last = ends[:-1][lens > 0], ends[1:][lens > 0] - 1
        e = self.bias + own
        e[first] += self.weights.get("s:first", 0.0)
        e[last] += self.weights.get("s:last", 0.0)
        inner = np.ones(len(e), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        e[at] += after[at - 1]
        e[at - 1] += before[at]
        if self.seconds:
            words = list(distinct)
            for t in np.flatnonzero(inner & (second > 0)).tolist():
                e[t] += self.weights.get(f"b:{form_of(words[ids[t - 1]])} {form_of(words[ids[t]])}", 0.0)
        return e, lens


def marginals(emissions: np.ndarray, lens: np.ndarray, log_trans: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and expected transition counts by kind, of concatenated sequences.

    Sequences are cut into stretches, all of which are walked side by side: first for the product of each
    stretch's steps, from which the messages at its ends follow, then for the messages within it, which
    are kept as the probability of the toxic state."""
    total = len(emissions)
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    ends = offsets_of(lens)
    parts = -(-lens // stretch)
    owner = np.repeat(np.arange(len(lens)), parts)
    number = ragged_index(np.zeros(len(lens), np.int64), parts)
    begin = ends[:-1][owner] + number * stretch
    size = np.minimum(stretch, ends[1:][owner] - begin)
    order = np.argsort(-size, kind="stable")
    alive = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max())), side="right")
    m, odds = np.exp(log_trans), np.exp(np.clip(emissions, -30, 30))
    ones = np.ones(len(size))

    # products of the steps of each stretch; a sequence's first token has no step before it
    product = np.stack([ones, 0 * ones, 0 * ones, ones])[:, order]
    for j, n in enumerate(alive.tolist()):
        o, (a, b, c, d) = odds[begin[order[:n]] + j], product[:, :n]
        if j:
            step = a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * o, c * m[0, 0] + d * m[1, 0], (c * m[0, 1] + d * m[1, 1]) * o
        else:
            head = number[order[:n]] == 0
            m00, m01, m10, m11 = (np.where(head, x, y) for x, y in ((1.0, m[0, 0]), (0.0, m[0, 1]), (0.0, m[1, 0]), (1.0, m[1, 1])))
            step = m00, m01 * o, m10, m11 * o
        product[:, :n] = np.stack(step) / (step[0] + step[1] + step[2] + step[3])
    products = np.empty_like(product)
    products[:, order] = product
    start, stop = np.full(len(size), 0.5), np.full(len(size), 0.5)
    first = offsets_of(parts)
    for k in range(1, int(parts.max())):
        at = first[:-1][parts > k] + k
        p, (a, b, c, d) = start[at - 1], products[:, at - 1]
        clean, toxic = (1 - p) * a + p * c, (1 - p) * b + p * d
        start[at] = toxic / (clean + toxic)
        at = first[1:][parts > k] - k
        q, (a, b, c, d) = stop[at], products[:, at]
        clean, toxic = a * (1 - q) + b * q, c * (1 - q) + d * q
        stop[at - 1] = toxic / (clean + toxic)

    ahead, back = np.empty(total), np.empty(total)
    p = start[order]
    for j, n in enumerate(alive.tolist()):
        at = begin[order[:n]] + j
        o, q = odds[at], p[:n]
        clean, toxic = (1 - q) * m[0, 0] + q * m[1, 0], (1 - q) * m[0, 1] + q * m[1, 1]
        if not j:
            head = number[order[:n]] == 0
            clean, toxic = np.where(head, 0.5, clean), np.where(head, 0.5, toxic)
        toxic = toxic * o
        ahead[at] = p[:n] = toxic / (clean + toxic)
    back[begin + size - 1] = stop
    for j in range(len(alive) - 2, -1, -1):
        at = begin[order[: alive[j + 1]]] + j
        b = back[at + 1]
        clean, toxic = 1 - b, b * odds[at + 1]
        from_clean, from_toxic = m[0, 0] * clean + m[0, 1] * toxic, m[1, 0] * clean + m[1, 1] * toxic
        back[at] = from_toxic / (from_clean + from_toxic)
    p = ahead * back / (ahead * back + (1 - ahead) * (1 - back))
    inner = np.ones(total, bool)
    inner[ends[1:][lens > 0] - 1] = False
    at = np.flatnonzero(inner)
    f, b, o = ahead[at], back[at + 1], odds[at + 1]
    pair = np.stack([(1 - f) * m[0, 0] * (1 - b), (1 - f) * m[0, 1] * o * b, f * m[1, 0] * (1 - b), f * m[1, 1] * o * b])
    return p, (pair / pair.sum(0)).sum(1).reshape(2, 2) if len(at) else np.zeros((2, 2))


def document_inputs(p: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """What calibration sees of each document: a constant, and its summed and largest marginals."""
    at = offsets_of(lens)
    total = np.concatenate([[0.0], np.cumsum(p)])
    total = total[at[1:]] - total[at[:-1]]
    top = np.zeros(len(lens))
    if (lens > 0).any():
        top[lens > 0] = np.maximum.reduceat(p, at[:-1][lens > 0])
    return np.stack([np.ones(len(lens)), top, np.minimum(total, 2), np.log1p(total), total / np.log(lens + 16.0)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def one_of_copies(texts: list[str], n_hashes: int = 4) -> list[int]:
    """Texts that share no smallest shingle hash, under a few hash functions, with an earlier one: copies of one text are no evidence of their own."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, own in enumerate(shingle_sets(texts)):
        keys = {(k, int(mix64(own ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min())) for k in range(n_hashes) if len(own)}
        if not keys & seen:
            keep.append(i)
        seen |= keys
    return keep


def cues(words: list[list[str]], toxic: list[int], min_documents: int, precision: float, min_evidence: float) -> list[str]:
    """Forms, prefixes and pairs of forms that toxic documents hold far oftener than clean ones; pairs only where none of the two words says so alone."""
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int64, len(ws)) for ws in words]
    names = list(vocabulary)
    classes = [[i for i, c in zip(ids, toxic, strict=True) if c == k and len(i)] for k in (0, 1)]
    in_toxic = np.unique(np.concatenate(classes[1])) if classes[1] else np.zeros(0, np.int64)
    known: dict[str, int] = {}
    for w in in_toxic.tolist():
        for f in features_of(names[w]):
            known.setdefault(f, len(known))
    owned = [[known[f] for f in features_of(w) if f in known] for w in names]
    size = np.fromiter(map(len, owned), np.int64, len(owned))
    flat, starts = np.fromiter(chain.from_iterable(owned), np.int64, int(size.sum())), offsets_of(size)[:-1]
    n_tokens = [sum(map(len, x)) for x in classes]
    base = min(max(n_tokens[1] / max(1, sum(n_tokens)), 1e-3), 0.5)
    scale = base / (1 - base)

    def sure(held: list[np.ndarray], documents: np.ndarray, evidence: float = min_evidence) -> np.ndarray:
        share = held[1] / np.maximum(held[1] + scale * held[0], 1e-9)
        return (documents >= min_documents) & (share >= precision) & (documents * np.log(np.maximum(share, 1e-9) / base) >= evidence)

    held = []
    for part in classes:
        count = np.bincount(np.concatenate(part), minlength=len(names)) if part else np.zeros(len(names), np.int64)
        held.append(np.bincount(flat, np.repeat(count, size), len(known)))
    documents = np.zeros(len(known), np.int64)
    for i in classes[1]:
        w = np.unique(i)
        documents[np.unique(flat[ragged_index(starts[w], size[w])])] += 1
    found = sure(held, documents)
    out = [f for f, ok in zip(known, found.tolist(), strict=True) if ok]

    forms: dict[str, int] = {}
    form = np.array([forms.setdefault(form_of(w), len(forms)) for w in names])
    own = np.zeros(len(forms), bool)
    own[form[np.flatnonzero(np.bincount(np.repeat(np.arange(len(names)), size), found[flat], len(names)) > 0)]] = True
    pairs = [[form[i[:-1]] * len(forms) + form[i[1:]] for i in part] for part in classes]
    each = np.concatenate([np.zeros(0, np.int64), *map(np.unique, pairs[1])])
    codes, documents = np.unique(each, return_counts=True)
    frequent = documents >= min_documents
    codes, documents = codes[frequent], documents[frequent]
    if len(codes):
        held = []
        for part in pairs:
            every = np.concatenate([np.zeros(0, np.int64), *part])
            at = np.minimum(np.searchsorted(codes, every), len(codes) - 1)
            held.append(np.bincount(at[codes[at] == every], minlength=len(codes)))
        spelled = list(forms)
        # there are far more pairs than words, and by chance alone some are in toxic documents only
        for code in codes[sure(held, documents, min_evidence + np.log(len(codes) + 1))].tolist():
            a, b = divmod(code, len(forms))
            if spelled[a] and spelled[b] and not own[a] and not own[b]:
                out.append(f"b:{spelled[a]} {spelled[b]}")
    return sorted(out)


def token_features(ws: list[str], known: dict[str, int]) -> list[list[int]]:
    """The numbers of the features of each token of a text."""
    own = [features_of(w) for w in ws]
    forms = [form_of(w) for w in ws]
    out = []
    for t, w in enumerate(ws):
        names = [*own[t], *(name for name, holds in SHAPES.items() if holds(w, forms[t]))]
        if t:
            names += [f"b:{forms[t - 1]} {forms[t]}", *(f"-{f}" for f in own[t - 1])]
        else:
            names.append("s:first")
        names += [f"+{f}" for f in own[t + 1]] if t + 1 < len(ws) else ["s:last"]
        out.append([known[f] for f in names if f in known])
    return out


def train(
    texts: list[str],
    toxic: list[int],
    min_documents: int = 4,
    precision: float = 0.8,
    min_evidence: float = 9.0,
    max_tokens: int = 400_000,
    rounds: int = 60,
    refined: tuple[int, ...] = (20, 40),
    rate: float = 0.5,
    toxic_odds: float | None = None,
) -> Field:
    """Fits the field to texts with document labels; stretches over max_tokens in all are left to the calibration."""
    keep = one_of_copies(texts)
    texts, toxic = [texts[i] for i in keep], [toxic[i] for i in keep]
    y = np.array(toxic)
    if len(y) == 0 or y.min() == y.max():
        return Field(calibration=None)
    words = [t.split() for t in texts]
    found = cues(words, toxic, min_documents, precision, min_evidence)
    sure = set(found)
    around = [f"{side}{f}" for side in "-+" for f in found if not f.startswith("b:")]
    known = {f: i for i, f in enumerate([*found, *around, *SHAPES, "s:first", "s:last"])}

    # stretches of both classes in turn, first ones first, so that the token bound takes from both and a long text costs its share
    turn = np.empty(len(y))
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) / max(1, (y == c).sum())
    stretches = sorted((n, turn[i], i) for i, ws in enumerate(words) for n in range(-(-len(ws) // TRAINED)))
    chosen, left = [], max_tokens
    for n, _, i in stretches:
        size = min(TRAINED, len(words[i]) - n * TRAINED)
        if size <= left:
            chosen.append((i, n * TRAINED, n * TRAINED + size))
            left -= size
    lens = np.array([z - a for _, a, z in chosen], np.int64)
    of_toxic = np.repeat([y[i] == 1 for i, *_ in chosen], lens)
    numbers, sizes, cue = [], [], []
    cued = [f in sure for f in known]
    for i, a, z in chosen:
        # with a word on either side, for their features
        low, high = max(0, a - 1), min(len(words[i]), z + 1)
        own = token_features(words[i][low:high], known)
        if low:
            own[0] = [f for f in own[0] if f != known["s:first"]]
        if high < len(words[i]):
            own[-1] = [f for f in own[-1] if f != known["s:last"]]
        for f in own[a - low : len(own) - (high - z)]:
            numbers += f
            sizes.append(len(f))
            cue.append(any(cued[x] for x in f))
    token, feature = np.repeat(np.arange(len(sizes)), sizes), np.array(numbers, np.int64)
    target = start = np.where(of_toxic, np.array(cue, float), 0.0)
    first = offsets_of(lens)
    inner = np.ones(len(target), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)

    def transitions(q: np.ndarray) -> np.ndarray:
        a, b = q[at], q[at + 1]
        return np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])

    seen = transitions(target)
    w, bias, trans = np.zeros(len(known)), np.log((target.sum() + 1) / (len(target) + 2)), np.zeros((2, 2))
    steps = [np.zeros_like(w), 0.0, np.zeros((2, 2))]
    for r in range(rounds):
        emissions = bias + np.bincount(token, w[feature], len(target))
        p, expected = marginals(emissions, lens, trans)
        if r in refined:
            # marginals given that a toxic text has a toxic word; words with a cue stay toxic
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), first[:-1]))
            target = np.where(of_toxic, np.maximum(start, np.minimum(1.0, p / np.repeat(np.maximum(1 - none, 1e-3), lens))), 0.0)
            seen = transitions(target)
        grads = [np.bincount(feature, (target - p)[token], len(w)) - 0.05 * w, float((target - p).sum()), seen - expected - 0.05 * trans]
        steps = [s + g * g for s, g in zip(steps, grads, strict=True)]
        w, bias, trans = (v + rate * g / np.sqrt(s + 1e-8) for v, g, s in zip((w, bias, trans), grads, steps, strict=True))
    model = Field({f: float(w[i]) for f, i in known.items() if w[i] != 0}, float(bias), trans)

    inputs = []
    for i in range(0, len(words), 256):
        emissions, own = model.emissions(words[i : i + 256])
        inputs.append(document_inputs(marginals(emissions, own, trans)[0], own))
    model.calibration = fit_logistic(np.concatenate(inputs), y)
    if toxic_odds:
        # the sample's odds of the classes give way to those of all labels
        model.calibration[0] += np.log(toxic_odds * (len(y) - y.sum()) / y.sum())
    return model


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, held_out_fold: int, max_chars: int) -> tuple[list[str], list[int], float | None]:
    """At most per_class texts of each class from the training folds, the first by hash of the id, up to max_chars characters of each; and the odds of the toxic class among all labels there."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.filter(fold(F.col("doc_id")) != held_out_fold)
    ordered = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (1, 0)]
    sample = ordered[0].unionByName(ordered[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id count once, the first by text
    own = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.substring(F.coalesce("text", F.lit("")), 1, max_chars)).alias("text"))
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "text").collect()
    n = labels.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    return [r.text for r in rows], [r.toxic for r in rows], n.toxic / (n["all"] - n.toxic) if n.toxic and n.toxic < n["all"] else None


def fitted(docs: DataFrame, labels: DataFrame, per_class: int, held_out_fold: int, max_chars: int = 20_000) -> Field:
    texts, toxic, odds = training_sample(docs, labels, per_class, held_out_fold, max_chars)
    return train(texts, toxic, toxic_odds=odds)


def score(docs: DataFrame, model: Field, threshold: float = 0.3, held_out_fold: int = 2, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_toxic_tokens, spans (code points); and the document's text and the rest of its row if they are to be carried."""

    def run(batches):
        for batch in batches:
            size = pc.cumulative_sum(pc.fill_null(pc.utf8_length(batch.column("text")), 0)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(size // CHARS_AT_ONCE)) + 1), len(size)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield scored(batch.slice(a, z - a))

    def scored(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        emissions, lens = model.emissions([t.split() for t in texts])
        p, _ = marginals(emissions, lens, model.log_trans)
        if model.calibration is None:
            scores = np.zeros(len(texts))
        else:
            scores = 1 / (1 + np.exp(-np.clip(document_inputs(p, lens) @ model.calibration, -30, 30)))
        at, spans, counts = offsets_of(lens), [], []
        hits = np.flatnonzero(p >= 0.5)
        for i, (a, b) in enumerate(zip(np.searchsorted(hits, at[:-1]), np.searchsorted(hits, at[1:]), strict=True)):
            own = hits[a:b] - at[i]
            counts.append(len(own))
            found = []
            if len(own):
                places = [m.span() for m in re.finditer(r"\S+", texts[i])]
                for stretch in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    found.append({"start": places[stretch[0]][0], "stop": places[stretch[-1]][1], "marginal": float(p[at[i] + stretch].max())})
            spans.append(found)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(counts, pa.int64()), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays([*columns, *([batch.column("text"), batch.column("row")] if carry else [])], [*SCORED.fieldNames(), *(["text", "row"] if carry else [])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []))
    return rows.mapInArrow(run, T.StructType([*SCORED.fields, *([rows.schema["text"], rows.schema["row"]] if carry else [])]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.3, held_out_fold: int = 2) -> DataFrame:
    """Fits the field to a bounded labelled sample and scores every whole text."""
    return score(docs, fitted(docs, labels, per_class, held_out_fold), threshold, held_out_fold)


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.3, held_out_fold: int = 2) -> DataFrame:
    """The rows of docs, unchanged, whose text is not predicted to be toxic."""
    return score(docs, fitted(docs, labels, per_class, held_out_fold), threshold, held_out_fold, carry=True).filter("predicted = 0").select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
