"""Toxicity by a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample: rows of labels in hash order, and bytes of their texts. A text longer
#: than what is left of the bytes is passed over, so very long texts may be missing from the sample.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 40_000_000
#: Words whose marginals are computed at once while learning; bounds memory, not the result.
CHUNK_WORDS = 200_000
#: The chain learns from longer texts in pieces of so many words, all of them; texts are scored whole.
PIECE_WORDS = 500
#: Score of every text if nothing can be learnt: no usable label, or labels of one kind only.
UNLEARNT = 0.1
#: A feature is kept if so many sampled documents hold it; the most frequent ones up to the bound.
LEAST_DOCS = 3
MAX_FEATURES = 200_000
#: Slots that bound features' numbers of documents from above before any feature is named.
SLOTS = 1 << 22
#: Words whose emissions a scorer keeps, and characters of text that it scores together.
KNOWN_WORDS = 200_000
SCORED_CHARS = 1_000_000
#: A word of a toxic document is labelled toxic if one of its features is in so many toxic documents
#: and e^LOG_ODDS times likelier there than elsewhere.
TOXIC_DOCS = 5
LOG_ODDS = 2.5
EPOCHS = 25
STEP = 0.5
#: L2 penalty of weights, for each document.
PENALTY = 1e-3

_EDGES = re.compile(r"^\W+|\W+$")
_NO_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def features(word: str) -> list[str]:
    """The word in lower case without punctuation at its ends, and its beginnings and ends."""
    core = _EDGES.sub("", word).lower()
    n = len(core)
    return ["=" + core, *["<" + core[:k] for k in range(4, min(n, 9))], *[">" + core[-k:] for k in (5, 7) if k < n]] if n else []


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Chain:
    """Emission weights of label 1 (label 0: none), transitions a[from][to] with a[0][0] = 0, and the
    weights of the document score."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    document: np.ndarray


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chains (longest first), starts of the chains, and how many are alive at each step."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(lengths) else np.empty(0, np.int64)
    most = int(lengths.max(initial=0))
    alive = len(lengths) - np.cumsum(np.bincount(lengths, minlength=most + 1))[:most]
    return order, starts, alive


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once, in log odds of label 1: P(label 1) of each word,
    and the forward and backward terms."""
    _, starts, alive = _ragged(lengths)
    r, b = np.empty_like(e), np.zeros_like(e)
    state = np.empty(0)
    for t, n in enumerate(alive):
        at = starts[:n] + t
        if t == 0:
            state = e[at]
        else:
            s = state[:n]
            state = e[at] + np.logaddexp(trans[0, 1], s + trans[1, 1]) - np.logaddexp(0.0, s + trans[1, 0])
        r[at] = state
    state = np.zeros(len(lengths))
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]  # chains that go on after t
        at = starts[:n] + t
        s = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(trans[1, 0], s + trans[1, 1]) - np.logaddexp(0.0, s + trans[0, 1])
    return 1 / (1 + np.exp(-np.clip(r + b, -500, 500))), r, b


def _document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected toxic words, their share, the two most toxic words, and the length, of each chain."""
    out = np.zeros((len(lengths), 6))
    out[:, 0] = 1
    some = np.flatnonzero(lengths)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some]
        total = np.add.reduceat(p, starts)
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.sqrt(total / lengths[some])
        out[some, 3] = np.maximum.reduceat(p, starts)
        out[some, 4] = np.log1p(np.add.reduceat((p >= 0.5).astype(float), starts))
        out[some, 5] = np.log1p(lengths[some]) / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ w)
    return w


@dataclass
class Words:
    """Documents as numbers: kinds of words in order of first sight, and each document's run of kinds."""

    kinds: list[str]
    tokens: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str]) -> Words:
        number: dict[str, int] = {}
        tokens = array("i")
        ends = array("q")
        for text in texts:
            tokens.extend([number.setdefault(w, len(number)) for w in text.split()])
            ends.append(len(tokens))
        return cls(list(number), np.array(tokens, np.int32), np.array(ends, np.int64))

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i - 1] if i else 0 : self.ends[i]]

    def chunks(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The documents in groups of some ``CHUNK_WORDS`` words: ids, word kinds, and numbers of words."""
        sizes = np.diff(self.ends, prepend=0)[docs]
        group = np.cumsum(sizes) // CHUNK_WORDS
        for part in np.split(docs, np.flatnonzero(np.diff(group)) + 1):
            held = [self.document(i) for i in part]
            yield part, np.concatenate([*held, np.empty(0, np.int32)]), np.array([len(x) for x in held], np.int64)


@dataclass
class FeatureLists:
    """Feature numbers of each kind of word, one after another."""

    names: list[str]
    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, kinds: list[str], docs: np.ndarray) -> FeatureLists:
        """``docs``: how many documents hold each kind. Only features that ``LEAST_DOCS`` documents may hold are
        named, as most features are rarer and their names would take most of the memory."""
        most, mask = array("i", bytes(4 * SLOTS)), SLOTS - 1
        for w, held in zip(kinds, docs.tolist()):
            if held:
                for f in features(w):
                    most[hash(f) & mask] += held
        number: dict[str, int] = {}
        flat, sizes = array("i"), array("i")
        for w in kinds:
            own = [f for f in features(w) if most[hash(f) & mask] >= LEAST_DOCS]
            flat.extend([number.setdefault(f, len(number)) for f in own])
            sizes.append(len(own))
        return cls(list(number), np.array(flat, np.int32), np.array(sizes, np.int64))

    def of_kinds(self, kinds: np.ndarray) -> np.ndarray:
        """Distinct features of some kinds."""
        sizes = self.sizes[kinds]
        first = (np.cumsum(self.sizes) - self.sizes)[kinds] - (np.cumsum(sizes) - sizes)
        return np.unique(self.flat[np.repeat(first, sizes) + np.arange(sizes.sum())])

    def only(self, chosen: np.ndarray) -> FeatureLists:
        """With the chosen features alone, numbered in their order."""
        new = np.full(len(self.names), -1, np.int32)
        new[chosen] = np.arange(len(chosen), dtype=np.int32)
        kept = new[self.flat] >= 0
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[kept]
        sizes = np.bincount(owner, minlength=len(self.sizes))
        return FeatureLists([self.names[i] for i in chosen], new[self.flat][kept], sizes)


def train(texts: Iterable[str], labels: Sequence[int]) -> Chain:
    """Learn from documents: two thirds give word labels and the chain, the rest the document score.
    Texts are read once and not kept.

    Words are labelled through their documents: in a toxic one, a word with a feature that is far
    likelier in toxic documents is toxic, all other words are not. Without documents of both labels
    nothing can be learnt: no word is toxic, and every text scores ``UNLEARNT``, below one half, so that
    a filter keeps all documents.
    """
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return Chain({}, -30.0, np.zeros((2, 2)), np.array([np.log(UNLEARNT / (1 - UNLEARNT)), 0, 0, 0, 0, 0]))
    words = Words.of(texts)
    docs = np.arange(len(y))
    both = min(y.sum(), (1 - y).sum()) >= 6
    fit, score = (docs[docs % 3 != 0], docs[docs % 3 == 0]) if both else (docs, docs)
    held = np.zeros(len(words.kinds), np.int64)
    for i in fit:
        held[np.unique(words.document(i))] += 1
    lists = FeatureLists.of(words.kinds, held)
    words.kinds.clear()
    every, toxic = np.zeros(len(lists.names), np.int64), np.zeros(len(lists.names), np.int64)
    for i in fit:
        own = lists.of_kinds(np.unique(words.document(i)))
        every[own] += 1
        if y[i]:
            toxic[own] += 1
    n_toxic = y[fit].sum()
    clean = every - toxic
    odds = np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((clean + 0.1) / (len(fit) - n_toxic + 0.2))
    telling = (toxic >= TOXIC_DOCS) & (odds >= LOG_ODDS)
    marked = _by_kind(lists, telling) > 0
    chosen = np.argsort(-every, kind="stable")[:MAX_FEATURES]
    lists = lists.only(chosen[every[chosen] >= LEAST_DOCS])
    weights, bias, trans = _fit(lists, words, fit, y, marked)
    known = {f: w for f, w in zip(lists.names, weights.tolist()) if abs(w) > 1e-4}
    emission = _by_kind(lists, weights) + bias
    seen = [_document_features(marginals(emission[t], n, trans)[0], n) for _, t, n in words.chunks(score)]
    return Chain(known, bias, trans, _logistic(np.concatenate(seen), y[score]))


def _by_kind(lists: FeatureLists, weights: np.ndarray) -> np.ndarray:
    """Sum of the features' weights of each kind of word."""
    return np.bincount(np.repeat(np.arange(len(lists.sizes)), lists.sizes), weights[lists.flat], len(lists.sizes))


def _fit(lists: FeatureLists, words: Words, fit: np.ndarray, y: np.ndarray, marked: np.ndarray):
    """Adaptive gradient steps on the chain's likelihood. Words share emissions, so gradients are
    summed by word first; documents go through in chunks, which add up to the same gradient."""
    size, kinds, n_docs = len(lists.names), len(lists.sizes), len(fit)
    owner = np.repeat(np.arange(kinds), lists.sizes)
    weights, bias, trans = np.zeros(size), -3.0, np.array([[0.0, -1.0], [-1.0, 0.0]])
    seen, seen_bias, seen_trans = np.full(size, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        word = _by_kind(lists, weights) + bias
        by_word, total, moves = np.zeros(kinds), 0.0, np.zeros((2, 2))
        for part, tokens, lengths in words.chunks(fit):
            truth = marked[tokens] & np.repeat(y[part] > 0, lengths)
            gap, gap_moves = _gaps(word[tokens], _pieces(lengths), trans, truth.astype(float))
            by_word += np.bincount(tokens, gap, kinds)
            total += gap.sum()
            moves += gap_moves
        g = np.bincount(lists.flat, by_word[owner], size) / n_docs + PENALTY * weights
        g_trans, g_bias = moves / n_docs, total / n_docs
        seen, seen_trans, seen_bias = seen + g * g, seen_trans + g_trans**2, seen_bias + g_bias**2
        weights -= STEP * g / np.sqrt(seen)
        trans = trans - STEP * 0.3 * g_trans / np.sqrt(seen_trans)
        trans[0, 0] = 0.0
        bias -= STEP * 0.3 * g_bias / np.sqrt(seen_bias)
    return weights, float(bias), trans


def _pieces(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the pieces of texts of the given lengths, in order."""
    n = -(-lengths // PIECE_WORDS)
    out = np.full(n.sum(), PIECE_WORDS)
    out[np.cumsum(n)[n > 0] - 1] = (lengths - (n - 1) * PIECE_WORDS)[n > 0]
    return out


def _gaps(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less true labels of each word, and of each kind of transition."""
    p, r, b = marginals(e, lengths, trans)
    inner = np.ones(len(e), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    y0, y1 = truth[at], truth[at + 1]
    after = e[at + 1] + b[at + 1]
    logs = [np.zeros(len(at)), trans[0, 1] + after, trans[1, 0] + r[at], trans[1, 1] + r[at] + after]
    top = np.maximum.reduce(logs)
    odds = [np.exp(x - top) for x in logs]
    norm = sum(odds)
    moves = np.array(
        [
            [0, (odds[1] / norm - (1 - y0) * y1).sum()],
            [(odds[2] / norm - y0 * (1 - y1)).sum(), (odds[3] / norm - y0 * y1).sum()],
        ]
    )
    return p - truth, moves


class Scorer:
    """Scores texts; keeps the emissions of words it has met."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.known: dict[str, float] = {}

    def words(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each word, and the documents' numbers of words."""
        known, weights, bias = self.known, self.chain.weights, self.chain.bias
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set().union(*docs):
            if w not in known:
                known[w] = bias + sum(weights.get(f, 0.0) for f in features(w))
        lengths = np.array([len(d) for d in docs], np.int64)
        e = np.array([known[w] for d in docs for w in d], float)
        return marginals(e, lengths, self.chain.trans)[0], lengths

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Document scores, and the character offsets of the runs of toxic words."""
        docs = [t.split() for t in texts]
        p, lengths = self.words(docs)
        x = _document_features(p, lengths) @ self.chain.document
        spans: list[list[dict]] = []
        start = 0
        for text, n in zip(texts, lengths.tolist()):
            bad = p[start : start + n] >= 0.5
            spans.append(_runs(text, bad) if bad.any() else [])
            start += n
        return 1 / (1 + np.exp(-np.clip(x, -500, 500))), spans


def _runs(text: str, bad: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    at = 0
    for i, word in enumerate(text.split()):
        begin = text.index(word, at)
        at = begin + len(word)
        if bad[i]:
            if last == i - 1:
                out[-1]["end"] = at
            else:
                out.append({"start": begin, "end": at})
            last = i
    return out


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``__id``, ``toxic`` and ``text`` of the training sample, a row for each id; None if it is empty."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    drawn = one.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS)
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    sized = met.groupBy("__id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy(F.xxhash64("__id"), "__id")
    left, ids = SAMPLE_BYTES, []
    for r in sized.collect():  # at most SAMPLE_ROWS
        if r["n"] <= left:
            left -= r["n"]
            ids.append((r["__id"],))
    if not ids:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "chosen long"))
    chosen = met.join(few, F.col("__id") == F.col("chosen")).groupBy("__id")
    return chosen.agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))


def _texts_and_labels(rows: pa.Table) -> tuple[Iterator[str], list[int]]:
    """By ids; the texts one after another."""
    order = np.argsort(rows["__id"].to_numpy())
    labels = [int(x > 0) for x in rows["toxic"].take(order).to_pylist()]
    return (text.as_py() or "" for text in map(rows["text"].__getitem__, order.tolist())), labels


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of the training sample; held-out ids are not in it.

    Null labels and ids don't count, a document with several labels is toxic if one says so, and of
    several texts of an id the greatest counts. No usable label gives an empty sample.
    """
    rows = _sampled(docs, labels)
    if rows is None:
        return [], []
    texts, toxic = _texts_and_labels(rows.toArrow())
    return list(texts), toxic


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """``train`` on ``sample``, in one task: the sample has a fixed size, and the driver gets the learnt weights only."""
    rows = _sampled(docs, labels)
    if rows is None:
        return train([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            texts, toxic = _texts_and_labels(pa.Table.from_batches(held))
            held.clear()
            chain = train(texts, toxic)
            learnt = pickle.dumps((chain.weights, chain.bias, chain.trans, chain.document))
            yield pa.RecordBatch.from_arrays([pa.array([learnt], pa.binary())], ["chain"])

    return Chain(*pickle.loads(rows.coalesce(1).mapInArrow(run, "chain binary").first()["chain"]))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_spans`` (character offsets of toxic words).

    A chain's marginals give each word's probability; their sum, share and maximum give the score.
    Every text is scored whole. Null and empty texts get the score of a text without words. Columns
    ``toxicity`` and ``toxic_spans`` are replaced, others kept; repeated rows stay.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", _NO_SPANS)])
    everywhere = docs.sparkSession.sparkContext.broadcast((chain.weights, chain.bias, chain.trans, chain.document))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Chain(*everywhere.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, spans, part, size = [], [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > SCORED_CHARS:
                    s, x = scorer.score(part)
                    scores, spans, part, size = [*scores, *s.tolist()], [*spans, *x], [], 0
            if part:
                s, x = scorer.score(part)
                scores, spans = [*scores, *s.tolist()], [*spans, *x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, arrow)], schema.names)

    return docs.mapInArrow(run, schema)
