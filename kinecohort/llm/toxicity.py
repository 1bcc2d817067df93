"""Toxic spans by a linear-chain conditional random field, and scores of documents from its marginals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import lower_words, mixed, pick, slices, utf8, word_hashes, word_places

#: Labelled rows that the field is fitted on, and bytes of their whole texts: the most of a class.
TRAIN_ROWS = 1500
TRAIN_BYTES = 8 << 20
#: Words of a chain; a longer text is several.
CHAIN = 64
#: Beginnings of words, in bytes, that are features besides the word itself.
PREFIXES = (4, 5, 6)
#: A feature is known from so many training texts on; it marks a word as toxic if it is this many times as frequent in
#: toxic texts, and the root of the log likelihood ratio is this much above what the best of as many chance features
#: would reach. Features that mark nothing are kept from COMMON_TEXTS on.
LEAST_TEXTS = 3
TOXIC_TIMES = 3.0
TOXIC_ROOT = 0.5
COMMON_TEXTS = 20
#: Words whose marginal is at least this are reported.
OFFENDING = 0.5

_LOWER, _WORD = lower_words()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, words before each text, and the features of each word (a column each; 0: none)."""
    data = _LOWER[data]
    starts, ends, texts = word_places(data, offsets, _WORD)
    columns = [word_hashes(data, starts, ends)]
    for n in PREFIXES:
        own = mixed(word_hashes(data, starts, np.minimum(starts + n, ends)) + np.uint64(n))
        columns.append(np.where(ends - starts > n, own, np.uint64(0)))
    return starts, ends, texts, np.stack(columns, axis=1)


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side.

    scores[i, t]: log odds of the word itself. Returns the probability of each word to be toxic, expected transitions
    (2 x 2), and the log of each chain's normaliser.
    """
    n, steps = scores.shape
    weight = np.exp(np.clip(scores, -30, 30))
    m = np.exp(transition)
    ahead = np.empty((steps, n, 2))
    total = np.zeros(n)
    for t in range(steps):
        a = np.ones((n, 2)) if t == 0 else ahead[t - 1] @ m
        a[:, 1] *= weight[:, t]
        norm = a.sum(axis=1)
        a /= norm[:, None]
        total += np.where(t < lengths, np.log(norm), 0)
        ahead[t] = a
    back = np.ones((n, 2))
    p = np.zeros((n, steps))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        both = ahead[t] * back
        p[:, t] = np.where(t < lengths, both[:, 1] / both.sum(axis=1), 0)
        if t:
            inside = back.copy()
            inside[:, 1] *= weight[:, t]
            joint = ahead[t - 1][:, :, None] * m[None] * inside[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[t < lengths].sum(axis=0)
            step = inside @ m.T
            step /= step.sum(axis=1, keepdims=True)
            back = np.where((t < lengths)[:, None], step, 1.0)
    return p, pairs, total


@dataclass(frozen=True)
class Field:
    """A fitted field: known features with their weights, bias and transitions, and how marginals become a score."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    document: np.ndarray  # of the figures below, and a constant

    def places(self, columns: np.ndarray) -> np.ndarray:
        """The place of each feature among the known, or their number if it is unknown."""
        at = np.searchsorted(self.known, columns)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == columns, at, len(self.known)) if len(self.known) else np.zeros_like(at)

    def score_words(self, places: np.ndarray) -> np.ndarray:
        return np.append(self.weights, 0.0)[places].sum(axis=1) + self.bias


def chains(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: the words of a text in pieces of CHAIN."""
    sizes = np.diff(texts)
    n = -(-sizes // CHAIN)
    owner = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = texts[owner] + at * CHAIN
    return first, np.minimum(CHAIN, texts[owner + 1] - first)


def probabilities(field: Field, columns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Probability of each word to be toxic.

    Chains without a known feature all look alike, so one chain of each length stands for them.
    """
    places = field.places(columns)
    scores = field.score_words(places)
    first, lengths = chains(texts)
    grid = first[:, None] + np.arange(CHAIN)
    inside = np.arange(CHAIN) < lengths[:, None]
    own = np.where(inside, np.append(scores, 0.0)[np.where(inside, grid, len(scores))], 0.0)
    out = np.empty(len(scores))
    plain = (np.where(inside, own, field.bias) == field.bias).all(axis=1)
    standard = np.full((CHAIN, CHAIN), field.bias)
    alike = marginals(standard, np.arange(1, CHAIN + 1), field.transition)[0]
    p = alike[np.maximum(lengths, 1) - 1]
    if (~plain).any():
        p[~plain] = marginals(own[~plain], lengths[~plain], field.transition)[0]
    out[grid[inside]] = p[inside]
    return out


def figures(p: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each text: greatest marginal, log of the toxic words expected, log of words found, log of all words, and 1."""
    sizes = np.diff(texts)
    full = np.flatnonzero(sizes > 0)
    out = np.zeros((len(sizes), 5))
    out[:, 4] = 1
    if len(full):
        at = texts[:-1][full]
        out[full, 0] = np.maximum.reduceat(p, at)
        out[full, 1] = np.log1p(np.add.reduceat(p, at))
        out[full, 2] = np.log1p(np.add.reduceat((p >= OFFENDING).astype(float), at))
    out[:, 3] = np.log1p(sizes) / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (q - y)) + 0.01 * len(y) / 100 * w
        bend = (x * (weight * q * (1 - q))[:, None]).T @ x + (0.01 * len(y) / 100 + 1e-9) * np.eye(len(w))
        w -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    return w


def distinct(texts: list[bytes], sketch: int = 8) -> list[int]:
    """Places of the texts without those that nearly copy an earlier one: half of a sketch of least hashes agrees, taken of
    words that follow each other (long texts of the same few words are no copies).

    Copies of one text would make its words look like marks of its class.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends, words = word_places(_LOWER[data], np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]), _WORD)
    hashes = word_hashes(_LOWER[data], starts, ends)
    follow = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    seen: dict[int, list[int]] = {}
    kept = []
    for i in range(len(texts)):
        a, b = words[i], words[i + 1]
        least = np.unique(follow[a : b - 1] if b - a > 1 else hashes[a:b])[:sketch].tolist()
        shared = Counter(j for h in least for j in seen.get(h, ()))
        if not least or (shared and 2 * max(shared.values()) >= len(least)):
            continue
        kept.append(i)
        for h in least:
            seen.setdefault(h, []).append(i)
    return kept


def _gain(part: np.ndarray, whole: np.ndarray, k: int, n: int) -> np.ndarray:
    """Log likelihood gained by the own share of toxic texts, part of whole, over the common one, k of n."""
    rest = whole - part
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(part > 0, part * np.log(part / whole * n / k), 0) + np.where(rest > 0, rest * np.log(rest / whole * n / (n - k)), 0)
    return np.maximum(own, 0)


def fit_field(texts: list[bytes], toxic: list[int], share: float, rounds: int = 60) -> Field | None:
    """A field from labelled texts; None if a class is missing. share: of toxic texts among all.

    Near copies count once. Words are labelled first: toxic are those of toxic texts with a feature (word or beginning) that toxic texts have
    far more often than others. Odd texts fit the field by its gradient, even ones how marginals become a score.
    """
    kept = distinct(texts) if texts else []
    texts, y = [texts[i] for i in kept], np.array([toxic[i] for i in kept], int)
    if len(y) < 4 or y.min() == y.max():
        return None
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    _, _, words, columns = features(data, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(words))
    # Texts of each class with a feature.
    wide = np.repeat(owner, columns.shape[1])
    flat = columns.ravel()
    order = np.lexsort((wide, flat))
    flat, wide = flat[order], wide[order]
    once = np.ones(len(flat), bool)
    once[1:] = (flat[1:] != flat[:-1]) | (wide[1:] != wide[:-1])
    once &= flat != 0
    known, at = np.unique(flat[once], return_inverse=True)
    with_ = np.bincount(at, y[wide[once]], len(known)) if len(known) else np.zeros(0)
    all_ = np.bincount(at, minlength=len(known))
    enough = all_ >= LEAST_TEXTS
    known, a, b = known[enough], with_[enough], (all_ - with_)[enough]
    n1, n0 = y.sum(), (1 - y).sum()
    times = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
    root = np.sqrt(2 * (_gain(a, a + b, n1, n1 + n0) + _gain(n1 - a, n1 + n0 - a - b, n1, n1 + n0)))
    marks = (root >= TOXIC_ROOT + np.sqrt(2 * np.log(len(known) + 1))) & (times >= TOXIC_TIMES)
    used = marks | (a + b >= COMMON_TEXTS)
    known, marks = known[used], np.append(marks[used], False)
    blank = Field(known, np.zeros(len(known)), -4.0, np.zeros((2, 2)), np.zeros(5))
    places = blank.places(columns)
    label = marks[places].any(axis=1) & (y[owner] == 1)

    odd = np.arange(len(texts)) % 2 == 1
    first, lengths = chains(words)
    mine = odd[np.searchsorted(words, first, side="right") - 1]
    first, lengths = first[mine], lengths[mine]
    grid = first[:, None] + np.arange(CHAIN)
    inside = np.arange(CHAIN) < lengths[:, None]
    grid = np.where(inside, grid, 0)
    truth = np.where(inside, label[grid], False)
    pairs_seen = np.zeros((2, 2))
    follow = inside[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            pairs_seen[i, j] = ((truth[:, :-1] == i) & (truth[:, 1:] == j) & follow).sum()
    spots = places[grid]  # chain, step, feature
    size = len(known) + 1
    seen = np.bincount(spots[inside & truth].ravel(), minlength=size)[:-1].astype(float)
    weights, bias, transition = np.zeros(len(known)), -4.0, np.zeros((2, 2))
    n = max(1, inside.sum())
    moment, square = np.zeros(len(known) + 5), np.zeros(len(known) + 5)
    for k in range(1, rounds + 1):
        scores = np.append(weights, 0.0)[spots].sum(axis=2) + bias
        p, pairs, _ = marginals(scores, lengths, transition)
        expected = np.bincount(spots[inside].ravel(), np.repeat(p[inside], spots.shape[2]), minlength=size)[:-1]
        slope = np.concatenate([seen - expected - 0.05 * weights, [truth.sum() - p[inside].sum()], (pairs_seen - pairs).ravel()]) / n
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        step = 0.3 * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-7)
        weights, bias = weights + step[:-5], bias + step[-5]
        transition = transition + step[-4:].reshape(2, 2)
        transition[0, 0] = 0.0  # the others are relative to it
    field = Field(known, weights, bias, transition, np.zeros(5))
    x = figures(probabilities(field, columns, words), words)[~odd]
    target = y[~odd]
    if target.min() == target.max():
        x, target = figures(probabilities(field, columns, words), words), y
    weight = np.where(target == 1, share / max(1e-9, target.mean()), (1 - share) / max(1e-9, 1 - target.mean()))
    return Field(known, weights, bias, transition, _logistic(x, target, weight))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from documents (doc_id, text) and their labels (doc_id, toxic); rows without either teach nothing.

    A bounded sample: of each class some TRAIN_ROWS documents by a hash of their id, whole texts. In the order of the hash, a
    text that would bring its class above TRAIN_BYTES is passed over. Of several labels of a document the greatest counts,
    of several texts the least.
    """
    marks = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (TRAIN_ROWS << 30) // n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    drawn = marks.withColumn("draw", draw).filter(F.col("draw") < below[F.col("toxic")])
    # About 2 * TRAIN_ROWS rows, whatever the size of the tables; their sizes come first, so that no more text than allowed is read.
    known = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    sizes = known.groupBy("doc_id", "draw", "toxic").agg(F.max(F.octet_length("text")).alias("size")).collect()
    room, ids = {0: TRAIN_BYTES, 1: TRAIN_BYTES}, []
    for r in sorted(sizes, key=lambda r: (r["draw"], str(r["doc_id"]))):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            ids.append(r["doc_id"])
    chosen = known.filter(F.col("doc_id").isin(ids)).groupBy("draw", "doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(chosen.collect(), key=lambda r: (r["draw"], str(r["doc_id"])))
    return fit_field([r["text"].encode() for r in rows], [r["toxic"] for r in rows], counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start and end in characters of each run of offending words) of every whole
    text.

    A null text counts as empty; an empty one has the score of a text without words. Without a field all scores are 0.
    Null ids and repeated rows are kept; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            spans: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
            scores = np.zeros(batch.num_rows)
            if field is not None:
                starts, ends, texts, columns = features(data, offsets)
                p = probabilities(field, columns, texts)
                scores = 1 / (1 + np.exp(-np.clip(figures(p, texts) @ field.document, -30, 30)))
                bad = np.flatnonzero(p >= OFFENDING)
                if len(bad):
                    chars = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                    owner = np.searchsorted(texts, bad, side="right") - 1
                    new = np.ones(len(bad), bool)
                    new[1:] = (np.diff(bad) > 1) | (owner[1:] != owner[:-1])
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(bad)) - 1
                    for i, s, e in zip(owner[heads], starts[bad[heads]], ends[bad[tails]]):
                        begin = chars[offsets[i]]
                        spans[i].append({"s": int(chars[s] - begin), "e": int(chars[e] - begin)})
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<s: long, e: long>>")
