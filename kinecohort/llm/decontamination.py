"""Passages of a benchmark in documents, through the CGK embedding of item-sized windows and bit-sampling LSH."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from kinecohort.llm.common import keep_rows, lower_words, mixed, pick, slices, utf8, word_hashes, word_places
from kinecohort.sources.shared import materialize

#: A passage matches an item if this share of the item's words is left by the edits between them.
SIMILARITY = 0.8
#: Walks of the embedding, samples of each, and places of a sample. With these, windows at the greatest distance are
#: found with a probability above 0.99 (see the tests); nearer ones more surely, equal ones always.
WALKS = 16
SAMPLES = 6
PLACES = 2
#: Words that are embedded at once, at most, since walks drift apart as edits add up. Longer items are looked for by equal
#: parts: of the edits of a match, one part has no more than its share.
EMBEDDED = 120
#: Items that are looked for in one pass over the documents.
BLOCK_ITEMS = 20_000

_LOWER, _WORD = lower_words()


def edits(length: int, similarity: float = SIMILARITY) -> int:
    """Most word edits between a passage and an item of so many words."""
    return int((1 - similarity) * length + 1e-9)


def running(a: list[int], b: list[int], free: bool = False) -> Iterator[int]:
    """Edit distances of a to the words of b so far, by rows of bits; free: to the nearest passage that ends there."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for w in b:
        same = at.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(zero | up)), up & zero
        d += bool(right & top) - bool(left & top)
        right, left = (right << 1) | (not free), left << 1
        up = (left | (full & ~(zero | right))) & full
        down = right & zero & full
        yield d


def distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two sequences."""
    if not a or not b:
        return len(a) + len(b)
    for d in running(a, b):
        pass
    return d


def nearest(item: list[int], words: list[int], most: int) -> tuple[int, int, int] | None:
    """Distance, first word and words of the nearest passage of any length, within `most` edits (fewer than the item has
    words); of equals the one that ends first, then the shortest."""
    best, end = most + 1, 0
    for j, d in enumerate(running(item, words, free=True), 1):
        if d < best:
            best, end = d, j
        if not best:
            break
    if best > most:
        return None
    back = words[max(0, end - len(item) - best) : end][::-1]
    n = next(j for j, d in enumerate(running(item[::-1], back), 1) if d == best)
    return best, end - n, n


def signatures(words: np.ndarray, length: int) -> np.ndarray:
    """Keys of windows (a row of word hashes each) for each walk and sample, for items of `length` words.

    A walk reads a window in 3 * length steps: every step puts out the word it stands on, and the word's random bit for
    this step says whether to go on to the next. After an edit, two walks fall into step again by chance, so few of
    the places put out differ. A sample takes PLACES of them, the same for all windows of the length.
    """
    n, width = len(words), words.shape[1] + 1
    padded = np.concatenate([words, np.zeros((n, 1), np.uint64)], axis=1)
    draws = [np.random.default_rng([length, walk]) for walk in range(WALKS)]
    # Walks lose each other for good at their ends, so places lie in the first two thirds.
    chosen = [np.sort(draw.integers(0, 2 * length, (SAMPLES, PLACES)), axis=1) for draw in draws]
    salts = np.array([draw.integers(1, 1 << 62) * 2 + 1 for draw in draws], np.uint64)[:, None, None]
    wanted: dict[int, list[int]] = {}
    for walk in range(WALKS):
        for step in np.unique(chosen[walk]).tolist():
            wanted.setdefault(step, []).append(walk)
    # All walks at once: 64 random bits for each word; a step takes one, and they are drawn anew after 64.
    coins = mixed(padded[None] * salts)
    rows = np.arange(n) * width
    first = rows[None] + np.arange(WALKS)[:, None] * (n * width)
    place = np.zeros((WALKS, n), np.int64)
    flat = padded.ravel()
    put: dict[tuple[int, int], np.ndarray] = {}
    for step in range(max(wanted) + 1):
        if step and step % 64 == 0:
            coins = mixed(coins * salts)
        for walk in wanted.get(step, ()):
            put[walk, step] = flat[rows + place[walk]]
        go = (coins.ravel()[first + place] >> np.uint64(step % 64)) & np.uint64(1)
        place += go.view(np.int64)
        np.minimum(place, width - 1, out=place)
    keys = np.empty((n, WALKS * SAMPLES), np.uint64)
    for walk in range(WALKS):
        for s in range(SAMPLES):
            key = np.full(n, walk * SAMPLES + s + 1, np.uint64)
            for step in chosen[walk][s].tolist():
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + put[walk, step])
            keys[:, walk * SAMPLES + s] = key
    return keys


@dataclass
class Items:
    """Items of a block, by number: their words; and their parts, whose anchors and keys windows are compared with."""

    ids: list
    words: list[np.ndarray]
    similarity: float = SIMILARITY
    part_items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    part_places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    anchor_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    anchor_parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    anchor_places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    buckets: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def words_of(text: bytes) -> np.ndarray:
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_places(data, np.array([0, len(data)]), _WORD)
    return word_hashes(data, starts, ends)


def prepare(ids: list, texts: list[bytes], similarity: float = SIMILARITY) -> Items:
    """Parts of the items, with anchors and buckets.

    Anchors of a part are its 2k + 2 rarest words (all, if it has fewer), k being the edits allowed. k edits spoil k of
    them at most, so windows without the others, on diagonals that differ by up to 2k, hold no match. This only
    spares windows that could not pass; which of the rest are compared is up to the buckets.
    """
    pairs = [(i, w) for i, w in zip(ids, map(words_of, texts)) if len(w)]
    items = Items([i for i, _ in pairs], [w for _, w in pairs], similarity)
    if not pairs:
        return items
    parts = [(i, p[0], w[p]) for i, w in enumerate(items.words) for p in np.array_split(np.arange(len(w)), -(-len(w) // EMBEDDED))]
    items.part_items, items.part_places = (np.array([p[c] for p in parts]) for c in (0, 1))
    flat = np.concatenate([np.unique(w) for _, _, w in parts])
    values, counts = np.unique(flat, return_counts=True)
    anchors: list[tuple[int, int, int]] = []
    needed, most = [], []
    by_size: dict[int, list[int]] = {}
    for i, (_, _, w) in enumerate(parts):
        k = edits(len(w), similarity)
        rarity = counts[np.searchsorted(values, w)]
        chosen = np.lexsort((np.arange(len(w)), rarity))[: 2 * k + 2]
        anchors += [(int(w[p]), i, int(p)) for p in chosen]
        needed.append(len(chosen) - k)
        most.append(k)
        by_size.setdefault(len(w), []).append(i)
    anchors.sort()
    items.anchor_words = np.array([a for a, _, _ in anchors], np.uint64)
    items.anchor_parts = np.array([i for _, i, _ in anchors])
    items.anchor_places = np.array([p for _, _, p in anchors])
    items.needed, items.most = np.array(needed), np.array(most)
    items.sizes = np.array([len(w) for _, _, w in parts])
    for size, own in by_size.items():
        keys = signatures(np.stack([parts[i][2] for i in own]), size)
        bands = np.repeat(np.array(own), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        items.buckets[size] = keys.ravel()[order], bands[order]
    return items


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to before high, and whose they are."""
    n = np.maximum(0, high - low)
    who = np.repeat(np.arange(len(n)), n)
    return low[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n), who


def windows(items: Items, hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and size of each window that has the anchors of some part of its size, in order."""
    low = np.searchsorted(items.anchor_words, hashes, side="left")
    high = np.searchsorted(items.anchor_words, hashes, side="right")
    anchor, word = _spread(low, high)
    part = items.anchor_parts[anchor]
    text = np.searchsorted(texts, word, side="right") - 1
    diagonal = word - texts[text] - items.anchor_places[anchor]
    order = np.lexsort((diagonal, part, text))
    text, part, diagonal = text[order], part[order], diagonal[order]
    k, r = items.most[part], items.needed[part]
    j = np.arange(len(text)) + r - 1
    ok = j < len(text)
    j = np.minimum(j, max(0, len(text) - 1))
    ok &= (text[j] == text) & (part[j] == part) & (diagonal[j] - diagonal <= 2 * k)
    text, part, near, far, k = text[ok], part[ok], diagonal[ok], diagonal[j[ok]], k[ok]
    size = items.sizes[part]
    # Windows may end up to k words after their text, where a passage with missing words ends.
    last = np.maximum(0, np.diff(texts)[text] - size + k)
    start, who = _spread(np.clip(far - k, 0, last), np.clip(near + k, 0, last) + 1)
    found = np.unique(np.stack([text[who], start, size[who]], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def _candidates(items: Items, hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Text, item, and from where to where in the text a passage may lie, of windows that share a key with a part."""
    text, start, size = windows(items, hashes, texts)
    lengths = np.array([len(w) for w in items.words], np.int64)
    allowed = np.array([edits(n, items.similarity) for n in lengths.tolist()], np.int64)
    out = [np.zeros((0, 4), np.int64)]
    for length in np.unique(size).tolist():
        own = np.flatnonzero(size == length)
        keys, holders = items.buckets[length]
        for a in range(0, len(own), 2048):
            rows = own[a : a + 2048]
            grid = (texts[text[rows]] + start[rows])[:, None] + np.arange(length)
            inside = grid < texts[text[rows] + 1][:, None]
            filled = np.where(inside, np.append(hashes, np.uint64(0))[np.where(inside, grid, len(hashes))], np.uint64(0))
            own_keys = signatures(filled, length)
            at, who = _spread(np.searchsorted(keys, own_keys.ravel(), "left"), np.searchsorted(keys, own_keys.ravel(), "right"))
            w, part = np.unique(np.stack([who // own_keys.shape[1], holders[at]], axis=1), axis=0).T
            t, i = text[rows[w]], items.part_items[part]
            # The part begins up to 2k of its own edits from the window, the item's edits shift it against the item.
            first = start[rows[w]] - items.part_places[part]
            slack = 2 * items.most[part] + allowed[i]
            low, high = first - slack, first + slack + lengths[i] + allowed[i]
            out.append(np.stack([t, i, np.maximum(0, low), np.minimum(high, np.diff(texts)[t])], axis=1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]


def matches(items: Items, hashes: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Text, item, distance, first word and words of the nearest passage of each pair that has one within the edits
    allowed.

    Windows have the size of the item (or of its part); a passage of another length lies around one that shares a key. So
    the item is aligned, as a whole, with the words around such windows, those that overlap being taken together.
    """
    found = _candidates(items, hashes, texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(found):
        return []
    # A stretch begins where the pair changes, or beyond all ends so far of the pair.
    pair = np.cumsum(np.append(0, np.any(found[1:, :2] != found[:-1, :2], axis=1)))
    span = int(texts[-1]) + 1
    reach = np.maximum.accumulate(pair * span + found[:, 3]) - pair * span
    heads = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (found[1:, 2] > reach[:-1])))
    for (t, i, low, _), high in zip(found[heads].tolist(), reach[np.append(heads[1:], len(found)) - 1].tolist()):
        item = items.words[i].tolist()
        had = best.get((t, i))
        most = had[0] - 1 if had else edits(len(item), items.similarity)
        words = hashes[texts[t] + low : texts[t] + high].tolist()
        if len(item) - sum(map(set(words).__contains__, item)) > most:
            continue  # each word that the stretch lacks is an edit
        new = nearest(item, words, most) if most >= 0 else None
        if new:
            best[t, i] = new[0], low + new[1], new[2]
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _search(docs: DataFrame, items: Items, item_kind: DataType) -> DataFrame:
    own_kind = to_arrow_type(item_kind)
    names = ["doc_id", "item_id", "distance", "item_words", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            data = _LOWER[data]
            starts, ends, texts = word_places(data, offsets, _WORD)
            found = matches(items, word_hashes(data, starts, ends), texts)
            if found:
                t, i, d, s, n = zip(*found)
                numbers = [pa.array(x, pa.int32()) for x in (d, [len(items.words[k]) for k in i])]
                own = pa.array([items.ids[k] for k in i], own_kind)
                yield pa.record_batch([batch.column("doc_id").take(pa.array(t)), own, *numbers, pa.array(s, pa.int64()), pa.array(n, pa.int32())], names)

    kinds = docs.schema["doc_id"].dataType.simpleString(), item_kind.simpleString()
    return docs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_words int, first_word long, n_words int")


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and benchmark item (item_id, text) that a passage of it matches: distance (word edits
    between the item and its nearest passage), item_words, first_word and n_words of that passage.

    Words are runs of ASCII letters and digits in lower case and of everything beyond ASCII. A passage, of any length,
    matches if at most (1 - similarity) of the item's words are edits: words replaced, missing or added.
    Items of fewer than five words thus match exact only; those without words, and null texts of either side,
    match nothing. Null ids and repeated rows of either side each give rows of their own. Empty tables give no rows.

    The benchmark is taken in blocks, each one a bounded index that goes to every task, with one pass over the whole
    documents. Documents are not shuffled, so no passage, however common, meets in one task.
    """
    texts = pick(docs, "doc_id", "text")
    kind = pick(benchmark, "item_id").schema["item_id"].dataType
    out = None
    for items, last in _blocks(benchmark, similarity, block):
        found = _search(texts, items, kind)
        found = found if last else materialize(found, "matches")
        out = found if out is None else out.union(found)
    return out


def _blocks(benchmark: DataFrame, similarity: float, block: int) -> Iterator[tuple[Items, bool]]:
    """The items in blocks, one at a time in memory, and whether a block is the last."""
    ids: list = []
    passages: list[bytes] = []
    for row in pick(benchmark, "item_id", "text").toLocalIterator():
        if len(ids) == block:
            yield prepare(ids, passages, similarity), False
            ids, passages = [], []
        ids.append(row["item_id"])
        passages.append((row["text"] or "").encode())
    yield prepare(ids, passages, similarity), True


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """Rows of docs, all columns, that no item matches a passage of (as `contamination` finds them)."""

    def clean(items: Items, batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = utf8(batch.column("text"))
        data = _LOWER[data]
        starts, ends, texts = word_places(data, offsets, _WORD)
        out = np.ones(batch.num_rows, bool)
        out[[t for t, *_ in matches(items, word_hashes(data, starts, ends), texts)]] = False
        return out

    for items, last in _blocks(benchmark, similarity, block):
        docs = keep_rows(docs, partial(clean, items))
        docs = docs if last else materialize(docs, "clean")
    return docs
