"""Near duplicates by SimHash, found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import pick, slices
from kinecohort.sources.shared import materialize

#: Shingles whose bits are counted together.
BLOCK = 1 << 16
#: Fingerprints in a bucket that are compared with each other; larger buckets go the other way.
BUCKET = 128
BITS = 64
#: Keys that a task makes of its fingerprints, about.
KEYS = 1 << 21
#: Links are at most this many differing bits; the two segments below rest on it.
DISTANCE = 2


def fingerprint(texts: list[bytes | None], n: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is 1 if it is set in over half of the hashes of its shingles."""
    sums = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []  # text, shingles

    def count() -> None:
        if not hashes:
            return
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([k for _, k in owners])
        rows = [i for i, _ in owners]  # a text is once in a block
        sums[rows] += np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        total[rows] += sizes
        hashes.clear()
        owners.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []  # of bytes: A-Z, and at \x20 \x09-\x0D
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - n] + 1).tolist()] if len(words) >= n else [0]
        stops = ends[n - 1 :].tolist() if len(words) >= n else [len(joined)]
        for a in range(0, len(starts), BLOCK):
            own = [digest(joined[s:e], seed) for s, e in zip(starts[a : a + BLOCK], stops[a : a + BLOCK])]
            hashes += own
            owners.append((i, len(own)))
            if len(hashes) >= BLOCK:
                count()
    count()
    return np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, content (a hash of the text) and fp (the fingerprint as a signed long) of every whole text.

    A-Z count as a-z; words are parted by ASCII white space. Fewer words than a shingle has are one shingle; a text
    without words, or null, has fingerprint 0. Null ids and repeated rows are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = fingerprint(batch.column("text").cast(pa.binary()).to_pylist(), n)
            columns = [batch.column("doc_id"), batch.column("content"), pa.array(fps.view(np.int64))]
            yield pa.record_batch(columns, ["doc_id", "content", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("content"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, content long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """Keys under which a fingerprint is indexed, for each of two segments of 32 bits.

    Two fingerprints of up to two differing bits have a segment that differs in one bit at most. So each segment is
    indexed as it is, and once per bit with that bit as a wildcard. A key holds the segment's number, the wildcard's
    place (32: none) and the bits left.
    """
    part = F.expr("shiftrightunsigned(fp, 32 * segment) & 4294967295L")
    rest = part.bitwiseAND(F.expr("CASE WHEN wildcard < 32 THEN ~shiftleft(1L, wildcard) ELSE -1L END"))
    index = F.expr("shiftleft(CAST(segment * 64 + wildcard AS BIGINT), 32)")
    placed = fps.select("fp", F.explode(F.expr("sequence(0, 1)")).alias("segment"))
    placed = placed.select("fp", "segment", F.explode(F.expr("sequence(0, 32)")).alias("wildcard"))
    return placed.select("fp", (rest + index).alias("key"))


def _forest(members: list[int]) -> list[tuple[int, int]]:
    """Links that join what links of up to DISTANCE bits join among the members; one less than members at most."""
    fps = np.array(members, np.int64).view(np.uint64)
    left = np.ones(len(fps), bool)
    links = []
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            u = front.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[u]) <= DISTANCE))
            left[near] = False
            links += [(members[u], members[v]) for v in near]
            front += near.tolist()
    return links


def _bucket_links(buckets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for members in batch.column("members").to_pylist() for x in _forest(members)]
            a, b = ([min(x) for x in links], [max(x) for x in links])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def _two_wildcards(fps: DataFrame) -> DataFrame:
    """Keys of a fingerprint with any two bits as wildcards: their places, and the other bits."""
    placed = fps.select("fp", F.explode(F.expr(f"sequence(1, {BITS - 1})")).alias("p"))
    placed = placed.select("fp", "p", F.explode(F.expr("sequence(0, p - 1)")).alias("q"))
    return placed.select("fp", "p", "q", F.expr("fp & ~(shiftleft(1L, p) | shiftleft(1L, q))").alias("rest"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a < b) between distinct fingerprints that join exactly those that links of up to two bits join.

    fps has each fingerprint once. All that share a key are counted with their least and greatest and what their bits
    come to by exclusive or, which is all that buckets of two and three members need. Buckets of up to BUCKET members are
    compared within, and a spanning forest of their links is kept. Members of larger ones are indexed by all pairs of wildcards instead: what shares such a key, four
    at most, is linked, whatever the group's size. So no pairs within a group are ever written out.
    """
    # A file of fingerprints is small, but each becomes 66 keys: dealt out by their number, so that tasks stay small.
    keyed = _variants(fps.repartition(-(-fps.count() * 66 // KEYS) or 1, "fp"))
    shared = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")
    )
    shared = materialize(shared.filter("n > 1"), "buckets")
    near = F.expr(f"bit_count(a ^ b) <= {DISTANCE}")
    third = F.expr("a ^ b ^ x")
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    one, ends = pair(F.col("a"), F.col("b")), [pair(F.col("a"), third), pair(third, F.col("b"))]
    pairs = F.when(F.col("n") == 2, F.array(one)).otherwise(F.array(one, *ends))
    few = shared.filter("n <= 3").select(F.inline(pairs).alias("a", "b")).filter(near)
    # Written, so that its own size decides how it is joined: a short list spares a shuffle of all keys.
    more = materialize(shared.filter("n > 3").select("key", "n"), "larger-buckets")
    members = keyed.join(more, "key")
    small = members.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("members"))
    large = members.filter(F.col("n") > BUCKET).select("fp").distinct()
    exact = (
        _two_wildcards(large)
        .groupBy("p", "q", "rest")
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
    )
    stars = exact.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return few.union(_bucket_links(small)).union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is linked with, over any number of links) of every node of the edges.

    Large and small stars in turn: every round hooks neighbours to the least of them, until nothing changes. Nodes of
    many links are no trouble: minima combine before the shuffle, and the join with them is one that Spark splits.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(
            down.select("u", F.col("m").alias("v"))
        )
        edges = materialize(small.distinct(), "stars")
        # Stars of one root each: no node has two parents, and no parent has one.
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(state)


def _roots(marked: DataFrame) -> DataFrame:
    """of (a fingerprint) and root (that of its group) of every fingerprint of marked."""
    fps = materialize(marked.select("fp").distinct(), "distinct")
    linked = components(links(fps))
    return fps.join(linked, fps["fp"] == linked["node"], "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    Texts whose fingerprints differ in two bits at most are linked; component_id is the least doc_id that links reach,
    the document's own included (null if all of them are null). Texts are read once; the rest works on fingerprints.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows each get a row; an empty
    table gives an empty one.
    """
    marked = materialize(fingerprints(docs, n), "fingerprints")
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("own"))
    roots = _roots(marked)
    grouped = own.join(roots, own["fp"] == roots["of"]).select("of", "own", "root")
    least = grouped.groupBy("root").agg(F.min("own").alias("component_id"))
    named = grouped.join(least, "root").select("of", "component_id")
    return marked.join(named, marked["fp"] == named["of"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, n: int = 3) -> DataFrame:
    """Rows of docs, one for each component: that of the least doc_id (of rows with the same one, of the least hash of
    the text; of repeated rows, one).

    Rows are told apart by id and text, so an id that has several texts loses only those that are near copies of
    others. Documents without an id cannot be told apart: they are kept, and stand for no others.
    """
    marked = materialize(fingerprints(docs, n).filter("doc_id IS NOT NULL"), "fingerprints")
    roots = _roots(marked)
    own = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "content")).alias("own"))
    least = own.join(roots, own["fp"] == roots["of"]).groupBy("root").agg(F.min("own").alias("kept"))
    kept = materialize(least.select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.content").alias("_kept_content")), "kept")
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, text = F.col(names[at["doc_id"]]), F.col(names[at["text"]])
    same = (own_id == F.col("_kept_id")) & (F.xxhash64(text) == F.col("_kept_content"))
    chosen = plain.join(kept, same, "left_semi").dropDuplicates([names[at["doc_id"]], names[at["text"]]])
    return chosen.unionByName(plain.filter(own_id.isNull())).toDF(*docs.columns)
