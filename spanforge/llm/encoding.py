"""Problem 7: the whole corpus as token ids of a public byte-level BPE vocabulary.

The vocabulary's ranks are serialised as a sentencepiece BPE model: every token becomes a piece with its bytes mapped to
printable characters and its negative rank as score, normalisation is the identity, so merging by best score is merging
by rank.  Texts are cut into pre-tokens by the vocabulary's pattern; a worker encodes each distinct pre-token of a batch
once and keeps it in a bounded table.

Defined results: empty and null texts give an empty list; marker strings such as the end-of-text mark are ordinary text;
texts of any length are encoded whole; repeated rows come out as often as they occur; other columns are not touched.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanforge.common import ship, table

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabularies on the driver; the file in use is sent to the workers
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the vocabulary's pre-token pattern, a fixed value
TABLE_SIZE = 200_000  # pre-tokens kept by a worker


@lru_cache(1)
def byte_chars() -> str:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(free)) for b in range(256))


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def bpe_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the unknown piece, which no text can give, follows them."""
    chars = byte_chars()
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    out = [_field(1, _field(1, "".join(chars[b] for b in tok).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _field(3, 1)) for tok, rank in pieces]
    out.append(_field(1, _field(1, b"<unk>") + _field(3, 2)))
    unk = len(pieces)
    trainer = _field(3, 2) + _field(4, unk + 1) + _field(40, unk) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(ranks))
        self.chars = byte_chars()
        self.back = {rank: tok for tok, rank in ranks.items()}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > TABLE_SIZE:
            self.known.clear()
        known = self.known
        new = list({p for c in cuts for p in c if p not in known})
        if new:
            known.update(zip(new, self.model.encode([p.encode().decode("latin-1").translate(self.chars) for p in new], out_type=int, num_threads=1)))
        return [list(chain.from_iterable([known[p] for p in c])) for c in cuts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.back[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


_AT_WORKER: dict[tuple[str, str], Codec] = {}


def shipped(spark: SparkSession, path: str, pattern: str):
    """The codec on a worker, from the bytes of the file as the driver reads it (a vocabulary of fixed size)."""
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def get() -> Codec:
        if (path, pattern) not in _AT_WORKER:
            _AT_WORKER[(path, pattern)] = Codec(parse_ranks(data.value), pattern)
        return _AT_WORKER[(path, pattern)]

    return get


def encode(docs: DataFrame, id_col: str, text_col: str, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(id, ids) of each row."""
    ship(docs.sparkSession)
    get = shipped(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in batches:
            for at in range(0, b.num_rows, 512):  # a slice bounds what is held at once
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(id, n, slot): tokens of each row; slot numbers the rows of a partition in order, which spreads equal ids."""
    ship(docs.sparkSession)
    get = shipped(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, base, seen = get(), TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n = [len(x) for x in c.encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(range(base + seen, base + seen + len(n)), pa.int64())], names=[id_col, "n", "slot"])
                seen += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n long, slot long")


def decode(ids: DataFrame, id_col: str, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(id, text) of rows (id, ids)."""
    ship(ids.sparkSession)
    get = shipped(ids.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def p7_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again from their ids; null texts come back empty."""
    return decode(p7_ids(spark, sf_dir), "doc_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
