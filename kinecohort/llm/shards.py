"""Token shards in training order: a keyed permutation gives every sequence its slot, shards hold ranges of slots."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinecohort.llm.common import held, mixed, pick, slices
from kinecohort.sources.shared import fresh_path, materialize

#: Tokens of a sequence, sequences of a shard, rounds of the permutation.
SEQUENCE = 1024
SHARD = 1 << 14
ROUNDS = 6
#: Tasks that write shards, at most; beyond it, each writes several.
TASKS = 20_000
#: Bytes of ids that a task writes compressed together, at most (or one sequence), and how hard; how hard single sequences
#: are on their way to their shard.
RUN = 4 << 20
RUN_LEVEL = 9
LEVEL = 3
#: A vocabulary as a file of ranks, on every machine, and the pattern that it goes with.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The id that ends a document and fills the last sequence of a partition.
END = 50256


def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text, special strings as ordinary text."""

    def build() -> tiktoken.Encoding:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if max(ranks.values()) >= END:
            raise ValueError(f"ids up to {END - 1} are known here, so that an id ends documents and all have 16 bits")
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("ranks", path), build).encode_ordinary


def _round_keys(key: int) -> np.ndarray:
    return mixed(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _half(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each x: a Feistel network over the next even number of bits, walked on
    along its cycle until it comes back below n."""
    half = np.uint64(_half(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in _round_keys(key):
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def invert(y: np.ndarray, n: int, key: int) -> np.ndarray:
    """The sequence in each slot: the way back of `permute`, for resuming at a slot."""
    half = np.uint64(_half(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = y.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in _round_keys(key)[::-1]:
            left, right = right ^ (mixed(left + k) & mask), left
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """Where shards lie, and how a slot is found: in folder shard=slot // per_shard, record slot % per_shard."""

    path: str
    sequences: int
    length: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        """Bytes of a record: the slot (8 bytes), the token ids (2 bytes each), and a line end."""
        return 8 + 2 * self.length + 1


def _packed(docs: DataFrame, path: str, length: int) -> DataFrame:
    """Documents and sequences as tasks (pid) make them, in order: a row (pos, doc_id, n) with the tokens of each document,
    its end included, and a row (pos, k, ids) for each run of k sequences from number pos on, compressed together."""
    width = 2 * length
    most = max(1, RUN // width) * width
    kind = docs.schema["doc_id"].dataType
    none = to_arrow_type(kind)
    names = ["pid", "pos", "doc_id", "n", "k", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(path), zstandard.ZstdCompressor(RUN_LEVEL)
        pid, pos, at, rest = TaskContext.get().partitionId(), 0, 0, b""
        end = END.to_bytes(2, "little")

        def runs(joined: bytes) -> Iterator[pa.RecordBatch]:
            nonlocal at
            for i in range(0, len(joined), most):
                run = joined[i : i + most]
                k = len(run) // width
                columns = [pa.array([pid], pa.int32()), pa.array([at], pa.int64()), pa.nulls(1, none), pa.nulls(1, pa.int64())]
                yield pa.record_batch([*columns, pa.array([k], pa.int64()), pa.array([press.compress(run)], pa.binary())], names)
                at += k

        for batch in slices(batches, limit=1 << 20):
            parts = [np.array(encode(text) if text else [], "<u2").tobytes() + end for text in batch.column("text").to_pylist()]
            k = batch.num_rows
            ns = pa.array([len(part) // 2 for part in parts], pa.int64())
            columns = [pa.array([pid] * k, pa.int32()), pa.array(range(pos, pos + k), pa.int64()), batch.column("doc_id"), ns]
            yield pa.record_batch([*columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
            pos += k
            joined = b"".join([rest, *parts])
            cut = len(joined) // most * most
            rest = joined[cut:]
            yield from runs(joined[:cut])
        yield from runs(rest + end * (-len(rest) % width // 2))

    return docs.mapInArrow(run, f"pid int, pos long, doc_id {kind.simpleString()}, n long, k long, ids binary")


def _slots(runs: DataFrame, width: int, before: dict[int, int], n: int, key: int) -> DataFrame:
    """slot and ids (compressed) of every sequence of runs (pid, pos, ids). before: the first sequence of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(LEVEL)
        for batch in batches:
            for pid, pos, ids in zip(batch.column("pid").to_pylist(), batch.column("pos").to_pylist(), batch.column("ids")):
                joined = whole.decompress(ids.as_py())
                made = [press.compress(joined[i : i + width]) for i in range(0, len(joined), width)]
                slots = permute(before[pid] + pos + np.arange(len(made)), n, key)
                yield pa.record_batch([pa.array(slots), pa.array(made, pa.binary())], ["slot", "ids"])

    return runs.select("pid", "pos", "ids").mapInArrow(run, "slot long, ids binary")


def _records(dealt: DataFrame) -> DataFrame:
    """slot and record (the slot, then the ids) of each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            heads = batch.column("slot").to_numpy().astype("<i8").tobytes()
            made = [heads[8 * i : 8 * i + 8] + press.decompress(ids) for i, ids in enumerate(batch.column("ids").to_pylist())]
            yield pa.record_batch([batch.column("slot"), pa.array(made, pa.binary())], ["slot", "record"])

    return dealt.mapInArrow(run, "slot long, record binary")


def write_shards(
    docs: DataFrame, path: str = RANKS, length: int = SEQUENCE, per_shard: int = SHARD, key: int = 1
) -> tuple[Shards, DataFrame]:
    """Write the token ids of docs (doc_id, text) in training order, and tell where each document went.

    Documents follow each other, each with an end token, in the order in which a task reads them, cut into sequences of
    `length` ids; only a task's last sequence is filled up with end tokens. The sequences of all tasks are numbered, and
    slot = permute(number). Sequences are shuffled to their shards and written in order of slots, as records of one size,
    so that record r of a shard starts at r * stride, and reading can go on at any slot.

    Every text is encoded once: the sequences are written in compressed runs, with the number of the task that made them,
    then numbered, and shuffled by ranges of slots, a whole number of shards to a task. So the numbers hold whatever the
    order in which docs would be read again.

    The index has a row for each part of a document within a sequence: doc_id, part (from 0), slot, shard, record, start
    (token in the sequence), n_tokens (the end token included). Null texts count as empty: one end token. Null ids
    and repeated rows are kept; an empty table gives an empty index and no shards. Text that itself has a special token's
    string is encoded as ordinary text, so the end token ends documents only.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    packed = materialize(_packed(docs, path, length), "packed")
    made, before, sequences = packed.filter("n IS NULL"), {}, 0
    for r in sorted(made.groupBy("pid").agg(F.sum("k").alias("k")).collect(), key=lambda r: r["pid"]):  # one row per task
        before[r["pid"]] = sequences
        sequences += r["k"]
    shards = Shards(fresh_path(spark, "shards"), sequences, length, per_shard, key)
    if sequences:
        count = -(-sequences // per_shard)
        own = -(-count // TASKS)  # shards of a task
        ranges = F.floor(F.col("slot") / (per_shard * own)).cast("int")
        dealt = _slots(made, 2 * length, before, sequences, key).repartitionById(-(-count // own), ranges)
        # Bytes pass through a text file as they are; the line end is the last byte of a record.
        shard = F.floor(F.col("slot") / per_shard).cast("long").alias("shard")
        lines = _records(dealt).select(shard, F.col("record").cast("string").alias("value"), "slot")
        lines = lines.sortWithinPartitions("shard", "slot").drop("slot")
        lines.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(shards.path)
    return shards, _index(packed.filter("n IS NOT NULL"), before, shards)


def _index(counts: DataFrame, before: dict[int, int], shards: Shards) -> DataFrame:
    spark = counts.sparkSession
    length, n, key = shards.length, shards.sequences, shards.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts of the documents of a task, which come in order."""
        current, so_far, number = None, 0, 0
        for rows in batches:
            for pid, own in rows.groupby("pid", sort=True):
                if pid != current:
                    current, so_far = pid, 0
                ends = so_far + own["n"].to_numpy().cumsum()
                starts = ends - own["n"].to_numpy()
                so_far = int(ends[-1])
                first, last = starts // length, (ends - 1) // length
                many = last - first + 1
                which = np.repeat(np.arange(len(own)), many)
                part = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                sequence = first[which] + part
                begin = np.maximum(starts[which], sequence * length)
                stop = np.minimum(ends[which], (sequence + 1) * length)
                slot = permute(before[pid] + sequence, n, key)
                yield pd.DataFrame(
                    {
                        "doc_id": own["doc_id"].to_numpy()[which],
                        "part": part,
                        "slot": slot,
                        "start": begin - sequence * length,
                        "n_tokens": stop - begin,
                    }
                )

    kind = counts.schema["doc_id"].dataType.simpleString()
    # Counts only: a task of the count has as many rows as a task of the scan.
    ordered = counts.repartition("pid").sortWithinPartitions("pid", "pos").select("pid", "doc_id", "n")
    parts = ordered.mapInPandas(run, f"doc_id {kind}, part long, slot long, start long, n_tokens long")
    shard = F.floor(F.col("slot") / shards.per_shard).cast("long")
    return parts.select("doc_id", "part", "slot", shard.alias("shard"), (F.col("slot") % shards.per_shard).alias("record"), "start", "n_tokens")


def read_records(spark: SparkSession, shards: Shards, shard: int | None = None) -> DataFrame:
    """slot and ids (bytes, two each) of the records of the shards, or of one of them, as they lie on disk.

    Records of one size need no line reader: files are split at multiples of the stride. This is the one place that goes
    by Spark's reader of fixed-size records, which is an RDD.
    """
    if not shards.sequences:
        return spark.createDataFrame([], "slot long, ids binary")
    which = "*" if shard is None else str(shard)
    raw = spark.sparkContext.binaryRecords(f"{shards.path}/shard={which}", shards.stride)
    rows = raw.map(lambda r: (int.from_bytes(r[:8], "little"), bytearray(r[8:-1])))
    return spark.createDataFrame(rows, "slot long, ids binary")
