"""Language of a text by cross-parsing: the language whose labelled text covers it in the fewest phrases."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import held, keep_rows, learnable, pick, slices, utf8

#: Labelled text that an automaton is built from, for each language: bytes in all, characters of a row, and rows drawn.
TRAIN_BYTES = 64 << 10
TRAIN_CHARS = 2048
TRAIN_ROWS = 200
#: More labelled languages than this are an error.
MAX_LANGUAGES = 512
#: A text is parsed in pieces of this many bytes side by side; a phrase ends with its piece.
PIECE = 1024
#: Bits per byte are turned into a score with this steepness.
STEEPNESS = 6.0
UNKNOWN = "und"
#: Bits per byte, for all phrases but one, from which on a text is of no known language: as many as a byte has.
MOST_BITS = 8.0


def _classes() -> np.ndarray:
    """Bytes as they are compared: A-Z as a-z; everything else of ASCII but letters parts words."""
    same = np.arange(256, dtype=np.uint8)
    same[ord("A") : ord("Z") + 1] += 32
    for b in range(128):
        if not chr(b).isalpha():
            same[b] = 32
    return same


_SAME = _classes()


def reduced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one separator for each run of non-letters."""
    data = _SAME[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return data[keep], kept[offsets]


class Automaton:
    """Suffix automaton of a text, as a table of the next state by state and byte.

    Where no longer match exists, the entry leads on from the start with that byte. Its lowest two bits say how many phrases
    ended: the match so far, and the byte itself if the text lacks it. Reading a text through the table thus counts the
    longest matches it falls apart into.
    """

    def __init__(self, text: bytes, code: np.ndarray, symbols: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in code[np.frombuffer(text, np.uint8)].tolist():
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = clone
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = new
        table = np.zeros((len(nexts), symbols), np.int32)
        table[:] = 2  # a byte unknown even from the start, where reading goes on
        table[0] = 1
        for c, q in nexts[0].items():
            table[:, c] = 4 * q * symbols + 1
        for s, out in enumerate(nexts):
            for c, q in out.items():
                table[s, c] = 4 * q * symbols
        self.table = table.ravel()
        self.bits = math.log2(len(text) + 1)  # of a pointer into the text


@dataclass(frozen=True)
class Languages:
    """Labelled text by language, from which tasks build the automata."""

    texts: tuple[tuple[str, bytes], ...]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.texts]


def automata(model: Languages) -> tuple[np.ndarray, list[Automaton]]:
    """The code of each byte, and an automaton for each language; built once in a process."""

    def build() -> tuple[np.ndarray, list[Automaton]]:
        used = sorted({b for _, text in model.texts for b in text})
        code = np.full(256, len(used), np.uint16)  # bytes that no language has
        code[used] = range(len(used))
        return code, [Automaton(text, code, len(used) + 1) for _, text in model.texts]

    return held(("language", hashlib.sha256(repr(model.texts).encode()).hexdigest()), build)


def phrases(model: Languages, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (reduced) for each language."""
    code, machines = automata(model)
    sizes = np.diff(offsets)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[owner] + at * PIECE
    lengths = np.minimum(PIECE, offsets[owner + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    owner, starts, lengths = owner[order], starts[order], lengths[order]
    symbols = code[data]
    counts = np.zeros((len(machines), len(owner)), np.int64)
    states = np.zeros((len(machines), len(owner)), np.int64)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for j in range(longest):
        m = active[j]
        now = symbols[starts[:m] + j].astype(np.int64)
        for i, machine in enumerate(machines):
            step = machine.table[states[i, :m] + now]
            counts[i, :m] += step & 3
            states[i, :m] = step >> 2
    counts += states > 0  # the phrase that a piece ends in
    total = np.zeros((len(machines), len(sizes)))
    for i in range(len(machines)):
        total[i] = np.bincount(owner, counts[i], minlength=len(sizes))
    return total


def fit_languages(docs: DataFrame) -> Languages:
    """Labelled text by language, from columns doc_id, text and lang; rows without any of the three teach nothing.

    A bounded sample: of the rows of a language, some TRAIN_ROWS by a hash of the id (repeated rows once); of each text
    TRAIN_CHARS characters that start at a hashed place, anywhere in the whole text, and TRAIN_BYTES in all.
    """
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("draw")
    rows = pick(docs, "doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = pick(docs, "doc_id", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    counted = sizes.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counted:
        return Languages(())
    below = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1 << 30, (TRAIN_ROWS << 31) // max(1, r["n"])))])
    # The hash of the text has no part in the draw, so the place does not go with it.
    begins = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS + 1)).cast("int") + 1
    chosen = rows.select("lang", "text", drawn).filter(F.col("draw") < below[F.col("lang")])
    chosen = chosen.groupBy("lang", "draw").agg(F.min(F.substring("text", begins, F.lit(TRAIN_CHARS))).alias("text"))
    texts: dict[str, bytes] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["draw"])):
        own = texts.get(r["lang"], b"")
        if len(own) < TRAIN_BYTES:
            raw = np.frombuffer(r["text"].encode() + b" ", np.uint8)
            texts[r["lang"]] = (own + reduced(raw, np.array([0, len(raw)]))[0].tobytes())[:TRAIN_BYTES]
    return Languages(tuple(sorted((name, text) for name, text in texts.items() if text.strip())))


def _judge(model: Languages, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of its language (-1: none), the score, the bits per byte (nan: none), and whether all
    phrases but one take fewer bits than bytes alone would (one is what any text of a letter or two is)."""
    n = len(column)
    best, score, bits, known = np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
    lettered = np.asarray(pa.compute.match_substring_regex(column, r"\pL").fill_null(False), dtype=bool)
    if model.texts and lettered.any():
        data, offsets = reduced(*utf8(column))
        pointers = np.array([m.bits for m in automata(model)[1]])
        sizes = np.maximum(1, np.diff(offsets))
        rate = phrases(model, data, offsets) * pointers[:, None] / sizes
        least, at = rate.min(axis=0), rate.argmin(axis=0)
        best = np.where(lettered, at, -1)
        score = np.where(lettered, 1 / np.exp2(STEEPNESS * (least - rate)).sum(axis=0), 0.0)
        bits = np.where(lettered, least, np.nan)
        known = lettered & (least - pointers[at] / sizes < MOST_BITS)
    return best, score, bits, known


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and bits_per_byte of every whole text.

    The language whose text needs the fewest phrases, each weighed by the bits of a pointer into that text; of equals,
    the first by name. A text that is null or has no letter, or any text if nothing was learned, is `und` with score 0
    and no bits. Null ids and repeated rows are kept; an empty table gives an empty one.
    """
    names = [*model.names, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, score, bits, _ = _judge(model, batch.column("text"))
            columns = [batch.column("doc_id"), pa.array([names[b] for b in best], pa.string())]
            yield pa.record_batch([*columns, pa.array(score), pa.array(bits, mask=np.isnan(bits))], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: Languages) -> DataFrame:
    """Rows of docs, all columns, whose text is in a known language: not `und`, and described by phrases of its
    language's text in fewer bits than bytes alone would take."""
    return keep_rows(docs, lambda batch: _judge(model, batch.column("text"))[3])


def teachable(docs: DataFrame, parts: int = 3, remainder: int = 1) -> DataFrame:
    """Rows to learn from: those whose crc32(doc_id as text) leaves another remainder."""
    return pick(docs, "doc_id", "text", "lang").filter(learnable(F.col("doc_id"), parts, remainder))
