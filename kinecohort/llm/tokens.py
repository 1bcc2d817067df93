"""Token counts with whole tokens looked up directly."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import held, pick, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The vocabulary file, on every machine.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens that a process remembers; beyond it, it starts again from the whole tokens.
REMEMBERED = 400_000
#: Texts of other characters are split by the library; for these, the pattern gives the same pieces (see the tests).
_OTHER = regex.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def whole_tokens(path: str = BYTE_BPE) -> dict[str, int]:
    """Vocabulary strings that encode alone as one token, proved one by one, with their ids.

    The string must be valid text, one piece for the pre-tokenizer, and its merges must end in the token itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {c: b for b, c in byte_letters().items()}
    proved = {}
    for piece, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if _SPLIT.findall(text) == [text] and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            if [t.id for t in tokenizer.model.tokenize(piece)] == [i]:
                proved[text] = i
    return proved


class Pieces(dict):
    """What a pre-token comes to: whole tokens at once, the rest merged by the library when first met."""

    def __init__(self, whole: dict[str, object], merge: Callable[[str], object]):
        super().__init__(whole)
        self.whole, self.merge = whole, merge

    def __missing__(self, piece: str):
        if len(self) >= REMEMBERED + len(self.whole):
            self.clear()
            self.update(self.whole)
        self[piece] = value = self.merge(piece)
        return value


class Splitter:
    """A tokenizer file, and the pre-tokens of a text between its special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only added tokens that stand for their own string are known here")
        self.special = {t["content"]: t["id"] for t in added}
        strings = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._parts = regex.compile(f"({strings})") if strings else None
        letters = byte_letters()
        self._letters = [letters[b] for b in range(256)]

    def merged(self, piece: str) -> list:
        """The tokens that the library merges a piece to."""
        letters = self._letters
        return self.tokenizer.model.tokenize("".join([letters[b] for b in piece.encode()]))

    def pieces(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str]:
        """Ordinary texts at even places, special strings at odd ones."""
        return self._parts.split(text) if self._parts else [text]


class Counts:
    """Numbers of tokens, by piece."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.split = Splitter(path)
        self.pieces = Pieces(dict.fromkeys(whole, 1), lambda piece: len(self.split.merged(piece)))

    def __call__(self, text: str) -> int:
        parts = self.split.parts(text)
        return len(parts) // 2 + sum(sum(map(self.pieces.__getitem__, self.split.pieces(p))) for p in parts[::2])


def counter(path: str, whole: dict[str, int]) -> Counts:
    return held(("counts", path), lambda: Counts(path, whole))


def count_tokens(docs: DataFrame, limit: int = 1024, path: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of every whole text.

    As the library counts: no tokens are added, a special string within a text is its token. Null texts count as empty
    (0 tokens); null ids and repeated rows are kept; an empty table gives an empty one.
    """
    whole = whole_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole)
        for batch in slices(batches):
            counts = [count(t) if t else 0 for t in batch.column("text").to_pylist()]
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
