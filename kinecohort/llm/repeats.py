"""Repeated byte strings across documents: an enhanced suffix array, its common-prefix intervals, and what repeats remove.

Every maximal repeat of LENGTH bytes or more starts, at each of its places, with the same window of LENGTH bytes, and these
places have different bytes before them. So only suffixes that start with such a left-diverse window are sorted, some
percent of all. They are found through anchors: the gram of a window with the least hash, which all places of the window share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import mixed, pick, slices, utf8, word_hashes
from kinecohort.operators.order import BLOCK, HALO, POSITION, blocks, positioned
from kinecohort.sources.shared import materialize

#: Bytes of a repeat at least, and of the gram that anchors a window of so many bytes.
LENGTH = 100
GRAM = 37
#: Grams of a window; an anchor has so many bytes before it in the window, one less at most. Masks have a bit for each.
SPAN = LENGTH - GRAM + 1
#: Suffixes of one window that one task scans together; windows with more are parted by longer prefixes.
BUCKET = 50_000
#: Windows that are looked at together: few enough for a place in 16 bits, and for a processor's cache.
_WINDOWS = 1 << 15
_PLACE = np.uint64(0xFFFF)
#: Bits of the map that tells which texts need not be moved.
_BITS = 1 << 26


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one anchor, in order: text, lo and hi (first and last window), a (the anchor), gram.

    The anchor of a window is its first gram whose hash has the least upper 48 bits. Places count from the start of data.
    """
    ends = offsets[1:]
    parts = []
    for b in range(0, max(0, len(data) - LENGTH + 1), _WINDOWS):
        n = min(_WINDOWS, len(data) - LENGTH + 1 - b)
        at = np.arange(b, b + n + SPAN - 1)
        hashes = word_hashes(data, at, at + GRAM)
        # The place in the low bits: one minimum finds the least hash and the first gram that has it.
        least = (hashes & ~_PLACE) | np.arange(len(at), dtype=np.uint64)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & _PLACE).astype(np.int64)
        value = hashes[place]
        place += b
        p = np.arange(b, b + n)
        text = np.searchsorted(ends, p, side="right")
        inside = p + LENGTH <= ends[text]
        p, text, place, value = p[inside], text[inside], place[inside], value[inside]
        first = np.ones(len(p), bool)
        first[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(p)) - 1 if len(p) else begin
        parts.append((text[begin], p[begin], p[last], place[begin], value[begin]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    text, lo, hi, a, gram = (np.concatenate(x) for x in zip(*parts))
    # A run that goes on in the next part is one.
    on = np.zeros(len(a), bool)
    on[1:] = (a[1:] == a[:-1]) & (lo[1:] == hi[:-1] + 1)
    begin = np.flatnonzero(~on)
    last = np.append(begin[1:], len(a)) - 1 if len(a) else begin
    return text[begin], lo[begin], hi[last], a[begin], gram[begin]


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    named = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return named.select("doc_id", F.xxhash64(F.lit(seed), "text").alias("key"), "text")


def _maybe(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts with maybe: false only if the text's key is not among keys.

    A bitmap of the keys' lower bits, 8 MB at most whatever the size, goes to all tasks; where it fills up, more texts are
    moved than need be.
    """
    placed = keys.select(
        F.expr(f"shiftright(key & {_BITS - 1}, 15)").alias("_chunk"), F.expr("cast(key & 32767 AS int)").alias("bit")
    )
    sets = placed.groupBy("_chunk").agg(F.collect_set("bit").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(bits)))
            bit = bits.flatten().to_numpy()
            words = np.zeros((batch.num_rows, 512), np.uint64)
            np.bitwise_or.at(words, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            starts = np.arange(batch.num_rows + 1, dtype=np.int32) * 512
            lists = pa.ListArray.from_arrays(starts, pa.array(words.ravel().view(np.int64)))
            yield pa.record_batch([batch.column("_chunk"), lists], ["_chunk", "_words"])

    chunks = sets.mapInArrow(run, "_chunk long, _words array<long>")
    met = texts.join(F.broadcast(chunks), F.expr(f"shiftright(key & {_BITS - 1}, 15)") == chunks["_chunk"], "left")
    word = "_words[cast(shiftright(key, 6) & 511 AS int)]"
    is_set = F.expr(f"coalesce(shiftright({word}, cast(key & 63 AS int)) & 1 = 1, false)")
    return met.select(*texts.columns, is_set.alias("maybe"))


def _anchors(texts: DataFrame) -> DataFrame:
    """gram, left (hash of the SPAN bytes before it; of a text that starts there, of the text), key and place of every run.

    place holds the anchor's offset and how far before it the run's first and last windows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            text, lo, hi, a, gram = runs(data, offsets)
            start, key = offsets[text], batch.column("key").to_numpy()[text]
            left = word_hashes(data, np.maximum(a - SPAN, start), a)
            left = np.where(a - SPAN < start, mixed(left ^ key.view(np.uint64)), left)
            place = (a - start) << 16 | (a - lo) << 8 | (a - hi)
            columns = [gram.view(np.int64), left.view(np.int64), key, place]
            yield pa.record_batch([pa.array(c) for c in columns], ["gram", "left", "key", "place"])

    return texts.mapInArrow(run, "gram long, left long, key long, place long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """key, place, gram and diverse (other places have other bytes before it) of the anchors whose gram is at two places.

    Sorted by ranges that may split a gram, and looked through in order. A gram at the border of a range counts as diverse:
    it is in all of its ranges, since it meets a border in each, and some more of the suffixes are sorted. Within a range
    rows come by gram alone, which is a sort by one number; the few of grams at several places are put in order here.
    """
    by = ["gram", "left", "key", "place"]
    laid = anchors.repartitionByRange(*by).sortWithinPartitions("gram")

    def decide(rows: list[np.ndarray], border_first: bool, border_last: bool) -> pa.RecordBatch:
        gram = rows[0]
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(begin, len(gram)))
        several = size > 1
        several[0] |= border_first
        several[-1] |= border_last
        several = np.repeat(several, size)
        gram, left, key, place = (r[several] for r in rows)
        order = np.lexsort((place, key, left, gram))
        gram, left, key, place = gram[order], left[order], key[order], place[order]
        if not len(gram):
            return pa.record_batch([pa.array(c) for c in (key, place, gram, several[:0])], ["key", "place", "gram", "diverse"])
        new = np.ones(len(gram), bool)  # equal rows are those of equal texts
        new[1:] = (gram[1:] != gram[:-1]) | (left[1:] != left[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        gram, left, key, place = gram[new], left[new], key[new], place[new]
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(begin, len(gram)))
        diverse = left[begin] != left[begin + size - 1]
        many = size > 1
        for edge, at in ((border_first, 0), (border_last, -1)):
            if edge:
                diverse[at] = many[at] = True
        take = np.repeat(many, size)
        columns = [key[take], place[take], gram[take], np.repeat(diverse, size)[take]]
        return pa.record_batch([pa.array(c) for c in columns], ["key", "place", "gram", "diverse"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []  # rows of the last gram so far, in pieces; a task holds a bounded range
        fresh = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in by]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if waiting and (last > 0 or waiting[0][0][0] != rows[0][0]):
                whole = [np.concatenate(x) for x in zip(*waiting, [r[:last] for r in rows])]
                yield decide(whole, fresh, False)
                fresh, waiting = False, []
            elif last > 0:
                yield decide([r[:last] for r in rows], fresh, False)
                fresh = False
            waiting.append([r[last:] for r in rows])
        if waiting:
            yield decide([np.concatenate(x) for x in zip(*waiting)], fresh, True)

    return laid.mapInArrow(run, "key long, place long, gram long, diverse boolean")


_PIECE = "d long, gram long, base long, lo int, hi int, a int, bytes binary"


def _pieces(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The surroundings of each diverse anchor: from SPAN bytes before it (base; the text's start if that is nearer) to where
    the windows of the next one start to end, or else the stretch of repeated windows.

    lo and hi (first and last window of the anchor) and a count from base.
    """
    # Texts are moved once, at every size, so that plans do not change with it; those that have no marks stay where they are.
    some = _maybe(texts, marks.select(F.col("own_key").alias("key"))).filter("maybe").drop("maybe")
    met = some.join(marks.hint("merge"), (some["key"] == marks["own_key"]) & some["doc_id"].eqNullSafe(marks["first_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            marks = batch.column("marks")
            text = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(marks)))
            place, gram, diverse = (marks.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("place", "gram", "diverse"))
            a = place >> 16
            lo, hi = a - (place >> 8 & 255), a - (place & 255)
            apart = np.ones(len(a), bool)
            apart[:-1] = (lo[1:] != hi[:-1] + 1) | (text[1:] != text[:-1])
            stretch = np.flatnonzero(apart)[np.searchsorted(np.flatnonzero(apart), np.arange(len(a)))]
            own = np.flatnonzero(diverse)
            stop = hi[stretch[own]] + LENGTH
            joined = np.zeros(len(own), bool)
            joined[:-1] = stretch[own][1:] == stretch[own][:-1]
            stop[joined] = lo[own[1:][joined[:-1]]] + LENGTH
            base = np.maximum(a[own] - SPAN, 0)
            start, whole = offsets[text[own]], data.tobytes()
            cut = [whole[x:y] for x, y in zip((start + base).tolist(), (start + stop).tolist())]
            d = batch.column("d").to_numpy()[text[own]]
            columns = [d, gram[own], base, lo[own] - base, hi[own] - base, a[own] - base, cut]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    return met.select("d", "text", "marks").mapInArrow(run, _PIECE)


_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_PIECE_SCHEMA = pa.schema(
    list(zip(_NAMES, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]))
)


def common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _masks(pieces: DataFrame) -> DataFrame:
    """gram and mask: bit o is set if two places of the gram have the same o bytes before it, and others before these.

    Bytes before an anchor are sorted backwards, so that neighbours show where they part. A text's start parts from all.
    """
    before = F.expr("substring(bytes, 1, a)")
    lefts = pieces.select("gram", before.alias("before")).distinct()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = [x[::-1] for x in batch.column("before").to_pylist()]
            yield pa.record_batch([batch.column("gram"), pa.array(turned, pa.binary())], ["gram", "before"])

    ordered = blocks(lefts.mapInArrow(turn, "gram long, before binary"), ["gram", "before"], halo=1)
    dealt = ordered.repartition(BLOCK).sortWithinPartitions(BLOCK, POSITION).select("gram", "before", BLOCK, HALO)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None, b"")
        for batch in batches:
            grams, masks = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("gram", "before", BLOCK)])
            for gram, before, block in rows:
                mask = 1 << len(before) if len(before) < SPAN else 0
                if held[:2] == (gram, block):
                    mask |= 1 << common(held[2], before)
                held = gram, block, before
                grams.append(gram)
                masks.append(mask)
            made = np.array(masks, np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(grams, pa.int64()), pa.array(made)], ["gram", "mask"])

    return dealt.mapInArrow(run, "gram long, mask long").groupBy("gram").agg(F.bit_or("mask").alias("mask"))


def _cuts(lo: int, hi: int, a: int, mask: int) -> list[int]:
    """lo, and the windows up to hi that are as far before the anchor as a bit of the mask says, in order."""
    cuts = [lo]
    left = ((mask & _ALL) >> (a - hi)) & ((1 << (hi - lo)) - 1)
    while left:
        bit = left.bit_length() - 1
        cuts.append(hi - bit)
        left ^= 1 << bit
    return cuts


_ALL = (1 << 64) - 1


def _suffixes(pieces: DataFrame, masks: DataFrame) -> DataFrame:
    """Suffixes to sort, in classes of equal ones: bucket (digest of the window), whole (of window and tail), tail, d and p (the
    first place), n, low and high (least and greatest byte before; of a text's start a number of its own), size (of window and
    tail). Suffixes of one batch are summed up; the places that are not the first of their class there follow as rows with d,
    p and size only.

    Cuts are the first window of every diverse anchor's run, and those at the anchor's parting places. A tail goes on to the
    end of the next cut's window, where that suffix takes over: whatever two places share there, they share both
    cuts. So the bytes that are sorted are few however many repeats lie within each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            classes: dict[bytes, list] = {}
            ds, ps, sizes = [], [], []
            for d, base, p, q, data, left in _cut(batch):
                at, whole = base + p, digest(data[p:q])
                own = classes.get(whole)
                if own is None:
                    classes[whole] = [digest(data[p : p + LENGTH]), whole, data[p + LENGTH : q], d, at, 1, left, left, q - p]
                    continue
                own[5] += 1
                if left < own[6]:
                    own[6] = left
                elif left > own[7]:
                    own[7] = left
                # A row that is there twice has a place twice.
                if d < own[3] or (d == own[3] and at < own[4]):
                    d, own[3], at, own[4] = own[3], d, own[4], at
                elif d == own[3] and at == own[4]:
                    continue
                ds.append(d)
                ps.append(at)
                sizes.append(q - p)
            if not classes:
                continue
            columns = [pa.array(c, f.type) for c, f in zip(zip(*classes.values()), _SUFFIX_SCHEMA)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SUFFIX_SCHEMA)
            given = {"d": ds, "p": ps, "size": sizes}
            columns = [pa.array(given.get(f.name, [None] * len(ds)), f.type) for f in _SUFFIX_SCHEMA]
            yield pa.RecordBatch.from_arrays(columns, schema=_SUFFIX_SCHEMA)

    return pieces.join(masks, "gram").select(*_GIVEN).mapInArrow(run, _SUFFIX)


def _places(pieces: DataFrame, masks: DataFrame) -> DataFrame:
    """bucket (digest of the window), tail, d and p of every sorted suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = list(_cut(batch))
            columns = [
                pa.array([xxhash.xxh3_128_digest(x[p : p + LENGTH]) for _, _, p, _, x, _ in cuts], pa.binary()),
                pa.array([x[p + LENGTH : q] for _, _, p, q, x, _ in cuts], pa.binary()),
                pa.array([d for d, *_ in cuts], pa.int64()),
                pa.array([base + p for _, base, p, *_ in cuts], pa.int64()),
            ]
            yield pa.record_batch(columns, ["bucket", "tail", "d", "p"])

    return pieces.join(masks, "gram").select(*_GIVEN).mapInArrow(run, "bucket binary, tail binary, d long, p long")


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """d, base, p and q (a suffix starts and ends there, from base), bytes and left (the byte before) of every suffix."""
    for d, base, lo, hi, a, data, mask in zip(*[batch.column(c).to_pylist() for c in _GIVEN]):
        cuts = _cuts(lo, hi, a, mask)
        for p, q in zip(cuts, [*[x + LENGTH for x in cuts[1:]], len(data)]):
            yield d, base, p, q, data, data[p - 1] if p else 256 + d  # base is before lo, but at a text's start


_GIVEN = ["d", "base", "lo", "hi", "a", "bytes", "mask"]
_SUFFIX = "bucket binary, whole binary, tail binary, d long, p long, n long, low long, high long, size long"
_SUFFIX_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _SUFFIX.split(", ")])


def _parted(classes: DataFrame) -> DataFrame:
    """classes (bucket, tail, first, n, low, high, window) in buckets of up to BUCKET, or of the next two bytes' values.

    A larger bucket is parted after the prefix that all of it shares: what goes on with the same two bytes is a bucket of
    its own, and its first stands for it in the larger one, with a tail that ends there.
    """
    done = classes.limit(0)
    while True:
        sizes = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.min("tail").alias("least"), F.max("tail").alias("most"))
        large = materialize(sizes.filter(F.col("k") > BUCKET), "large", drop_shuffles=True)
        if large.isEmpty():
            return done.union(classes)

        def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [common(u, v) + 2 for u, v in zip(batch.column("least").to_pylist(), batch.column("most").to_pylist())]
                yield pa.record_batch([batch.column("bucket"), pa.array(n, pa.int32())], ["of", "depth"])

        deep = materialize(large.mapInArrow(depth, "of binary, depth int"), "depths", drop_shuffles=True)
        met = classes.join(deep, classes["bucket"] == deep["of"]).withColumn("head", F.expr("substring(tail, 1, depth)"))
        own = F.unhex(F.md5(F.concat(F.col("bucket"), F.col("head"))))
        columns = classes.columns
        below = met.select(own.alias("bucket"), *columns[1:], F.col("bucket").alias("above"), "head")
        below = materialize(below, "below", drop_shuffles=True)
        heads = below.groupBy("above", "head").agg(
            F.min("first").alias("first"),
            F.sum("n").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("window").alias("window"),
        )
        small = classes.join(deep, classes["bucket"] == deep["of"], "left_anti")
        done = done.union(small).union(heads.select(F.col("above").alias("bucket"), F.col("head").alias("tail"), *columns[2:]))
        done = materialize(done, "parted", drop_shuffles=True)
        classes = below.select(*columns)


class _Node:
    """An interval of suffixes that share `depth` bytes of their tails."""

    __slots__ = ("depth", "first", "n", "low", "high", "later")

    def __init__(self, depth: int, first: tuple | None = None, n: int = 0, low: int | None = None, high: int | None = None):
        self.depth, self.first, self.n, self.low, self.high, self.later = depth, first, n, low, high, []

    def take(self, child: _Node) -> None:
        self.n += child.n
        if self.first is None:
            self.first, self.low, self.high = child.first, child.low, child.high
            return
        self.low, self.high = min(self.low, child.low), max(self.high, child.high)
        # Whichever is not the first any more has a repeat of this length before it, and of none that is longer.
        self.later.append(max(self.first, child.first))
        self.first = min(self.first, child.first)


def intervals(rows: Iterator[tuple[bytes, bytes, tuple, int, int, int, bytes]]) -> Iterator[tuple[bytes, _Node, bytes]]:
    """The common-prefix intervals of suffixes in order (bucket, tail, first, n, low, high, window), innermost first, with
    their window and the tail of one suffix in them.

    One scan with a stack of open intervals; each closed one is taken up by the one around it.
    """
    stack: list[_Node] = []
    bucket, window, tail, node = None, b"", b"", None

    def close(depth: int) -> Iterator[tuple[bytes, _Node, bytes]]:
        nonlocal node
        while stack and stack[-1].depth > depth:
            stack[-1].take(node)
            node = stack.pop()
            yield window, node, tail
        if depth >= 0:
            if not stack or stack[-1].depth < depth:
                stack.append(_Node(depth))
            stack[-1].take(node)

    for own, text, first, n, low, high, of in rows:
        if node is not None:
            yield from close(common(tail, text) if own == bucket else -1)
        bucket, window, tail, node = own, of, text, _Node(len(text), first, n, low, high)
        if n > 1:
            yield window, node, tail
    if node is not None:
        yield from close(-1)


_GROUP = (
    "window binary, length long, n long, d long, p long, left_diverse boolean, tail binary, later array<struct<d:long,p:long>>"
)


def _scan(classes: DataFrame) -> DataFrame:
    """The intervals of every bucket: length, n places, the first one (d, p), left_diverse, and later: first places of
    parts of the interval that are not the first of the whole."""
    placed = classes.repartition("bucket").sortWithinPartitions("bucket", "tail")
    columns = ["bucket", "tail", "first", "n", "low", "high", "window"]
    later = pa.list_(pa.struct([("d", pa.int64()), ("p", pa.int64())]))
    names = [c.split()[0] for c in _GROUP.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                bucket, tail, first, *more = (batch.column(c).to_pylist() for c in columns)
                yield from ((b, t, (f["d"], f["p"]), *rest) for b, t, f, *rest in zip(bucket, tail, first, *more))

        out: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names)
            for values in out:
                values.clear()
            return made

        for window, node, tail in intervals(rows()):
            later = [{"d": d, "p": p} for d, p in node.later]
            row = window, LENGTH + node.depth, node.n, *node.first, node.low != node.high, tail[: node.depth], later
            for values, v in zip(out, row):
                values.append(v)
            if len(out[0]) >= 4096:
                yield flush()
        yield flush()

    return placed.mapInArrow(run, _GROUP)


def _numbers(texts: DataFrame) -> DataFrame:
    """key, first_id (the least id with the text; ids first, null last), copies, d (a number in that order) of each text."""
    named = texts.select("doc_id", "key", F.xxhash64("text", F.octet_length("text")).alias("check"))
    found = named.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("check").alias("check"), F.max("check").alias("other")
    )
    found = materialize(found, "texts", drop_shuffles=True)
    if not found.filter(F.col("check") != F.col("other")).isEmpty():
        raise RuntimeError("two texts have one hash; choose another seed")
    ordered = found.select("key", "first_id", "copies", F.col("first_id").isNull().cast("int").alias("none"))
    return positioned(ordered, ["none", "first_id", "key"]).select("key", "first_id", "copies", F.col(POSITION).alias("d"))


@dataclass(frozen=True)
class Repeats:
    """groups: window (digest of LENGTH bytes), length, n places, d, p (the first), left_diverse, tail (what follows the
    window), later. places: bucket (the window), tail, d, p: every sorted suffix, not written. rest: d, p and size of the
    suffixes that are equal to the end of their tails, all but the first of them. numbers: key, first_id, copies, d: equal
    texts are one, that of the least id."""

    groups: DataFrame
    places: DataFrame
    rest: DataFrame
    numbers: DataFrame


def repeat_groups(docs: DataFrame, seed: int = 0) -> Repeats:
    """Repeats of LENGTH bytes or more, with all their places.

    The occurrences of a group are the places of its window whose tail starts with the group's (`occurrences`). A group with left_diverse is maximal to the left; others go on with a group that starts before.
    Where other places join or leave a repeat, it is told in parts that share LENGTH bytes.
    """
    texts = _texts(docs, seed)
    numbers = _numbers(texts)
    found = _repeated(_anchors(texts))
    marks = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("place", "gram", "diverse"))).alias("marks"), F.max("diverse").alias("some")
    )
    named = numbers.select(F.col("key").alias("own_key"), "first_id", "d")
    marks = marks.filter("some").join(named, F.col("key") == F.col("own_key")).select("own_key", "first_id", "d", "marks")
    marks = materialize(marks, "marks", drop_shuffles=True)
    pieces = materialize(_pieces(texts, marks), "pieces", drop_shuffles=True)
    masks = materialize(_masks(pieces), "masks", drop_shuffles=True)
    suffixes = materialize(_suffixes(pieces, masks), "suffixes", drop_shuffles=True)
    own = suffixes.filter("bucket IS NOT NULL")
    # A window at one place only is no repeat.
    shared = own.groupBy("bucket").agg(F.sum("n").alias("places")).filter("places > 1").select("bucket")
    own = materialize(own.join(shared, "bucket", "left_semi"), "shared", drop_shuffles=True)
    # As many firsts as there are batches that have some of the class, not places.
    classes = own.groupBy("bucket", "whole").agg(
        F.min("tail").alias("tail"),
        F.min(F.struct("d", "p")).alias("first"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("size").alias("size"),
        F.collect_set(F.struct("d", "p")).alias("firsts"),
    )
    classes = materialize(classes, "classes", drop_shuffles=True)
    firsts = classes.filter("size(firsts) > 1").select("first", "size", F.explode("firsts").alias("at")).filter("at > first")
    rest = suffixes.filter("bucket IS NULL").select("d", "p", "size").union(firsts.select("at.d", "at.p", "size"))
    classes = classes.select("bucket", "tail", "first", "n", "low", "high", F.col("bucket").alias("window"))
    groups = materialize(_scan(_parted(classes)), "groups", drop_shuffles=True)
    return Repeats(groups, _places(pieces, masks), rest, numbers)


def occurrences(groups: DataFrame, places: DataFrame) -> DataFrame:
    """window, length, d and p of every place of every group: as many rows as there are places in groups, nested ones
    included. `remove_repeats` does without it."""
    g = groups.select("window", "length", F.col("tail").alias("head")).distinct()
    met = g.join(places.select(F.col("bucket").alias("window"), "tail", "d", "p"), "window")
    return met.filter("substring(tail, 1, length(head)) = head").select("window", "length", "d", "p")


def removable(found: Repeats) -> DataFrame:
    """d and spans (start << 32 | size) of what starts earlier too, unmerged, of every text that has any."""
    nested = found.groups.select(F.explode("later").alias("at"), F.col("length").alias("size")).select("at.d", "at.p", "size")
    packed = F.expr("shiftleft(p, 32) | size")
    return nested.union(found.rest).select("d", packed.alias("span")).groupBy("d").agg(F.collect_list("span").alias("spans"))


def without(batch: pa.RecordBatch) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans, kept_sha256 and kept of texts and their spans; of copies nothing stays, if long enough."""
    data, offsets = utf8(batch.column("text"))
    n_bytes, n = np.diff(offsets), batch.num_rows
    gone = np.asarray(batch.column("copy")).astype(bool) & (n_bytes >= LENGTH)
    spans = batch.column("spans")
    text = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(spans).fill_null(0)))
    packed = spans.flatten().to_numpy()
    packed, text = packed[~gone[text]], text[~gone[text]]
    packed, text = np.append(packed, n_bytes[gone]), np.append(text, np.flatnonzero(gone))
    order = np.lexsort((packed, text))
    packed, text = packed[order], text[order]
    start = offsets[text] + (packed >> 32)
    reach = np.maximum.accumulate(start + (packed & 0xFFFFFFFF))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    text, start, stop = text[first], start[first], reach[np.append(first[1:], len(reach))[: len(first)] - 1]
    n_removed = np.zeros(n, np.int64)
    np.add.at(n_removed, text, stop - start)
    # What is left lies between the runs; a run that ends where the next text's starts leaves nothing between.
    ends, begins = np.append(start, len(data)), np.append(0, stop)
    whole = data.tobytes()
    kept = b"".join([whole[x:y] for x, y in zip(begins.tolist(), ends.tolist())])
    places = offsets - np.append(0, np.cumsum(n_removed))
    hashes = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(places[:-1].tolist(), places[1:].tolist())]
    left = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(kept)]).cast(pa.binary())
    n_spans = np.bincount(text, minlength=n)
    return [pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(hashes, pa.string()), left]


def remove_repeats(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (bytes) of every row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a text of a smaller id, or earlier in
    its own. Null ids come last, null texts count as empty. Rows of one id with different texts are documents each, in an
    order of their own; repeated rows are one document, told once per row. An empty table gives an empty one.
    """
    found = repeat_groups(docs, seed)
    spans = removable(found).withColumnRenamed("d", "_d")
    marked = found.numbers.join(spans, F.col("d") == F.col("_d"), "left").filter("copies > 1 OR spans IS NOT NULL")
    marked = marked.select(F.col("key").alias("own_key"), "first_id", "spans")
    verdict = materialize(marked, "verdicts", drop_shuffles=True)
    texts = _maybe(_texts(docs, seed), verdict.select(F.col("own_key").alias("key")))
    some = texts.filter("maybe")
    met = some.join(verdict, some["key"] == verdict["own_key"], "left").select(
        "doc_id", "text", "spans", (F.col("own_key").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("copy")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), *without(batch)], ["doc_id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kind = texts.schema["doc_id"].dataType.simpleString()
    cut = met.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    # Texts that stay whole are not moved.
    kept, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    values = F.octet_length("text").cast("long"), none, none, F.sha2(kept, 256), kept
    return cut.union(texts.filter("NOT maybe").select("doc_id", *[v.alias(c) for v, c in zip(values, names)]))
