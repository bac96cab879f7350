"""Byte-level BPE by a global shuffle of distinct words.

Documents are cut into pre-tokens by the vocabulary's pattern. A task gathers its documents in
batches of about ``BATCH_TOKENS`` pre-tokens or ``BATCH_CHARS`` characters (one longer document makes a
batch of its own); a batch keeps its documents as positions into its own distinct pre-tokens. Those
are dealt by hash to parts and shuffled by part, so that each distinct one is merged once; the ids go
back to every batch that asked, where documents are reassembled by position. The number of parts grows
with the root of the input, as distinct words grow more slowly than texts, and blocks of them stay large.

Pre-tokens travel in compressed blocks, one a batch and part: a row a pre-token would move several
times the input. No key is hot, as a pre-token occurs once a batch at most. Batches are written
before they are used twice, as their numbers are drawn at random.

Decoding joins the token-byte table. It has one entry a token of the vocabulary, whatever the input
(about 50 thousand, under 1 MB), and is broadcast with it: ids are its row numbers, so the join is a
lookup by position in every task. Executors never open the vocabulary's path: only the driver reads it.

Defined results: nulls are read as empty texts; an empty text has no ids. Rows with the same id or
text, and rows without an id, each give a row. An empty table gives no rows. Of a very long text a
task holds the characters and four bytes a pre-token. Only the id and text columns are read,
whatever others there are; decode() keeps all columns but the ids and replaces one called decoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, staged

BATCH_TOKENS, BATCH_CHARS = 1_000_000, 8_000_000
#: Parts for the words of up to PART_BYTES of text, and for larger inputs as many more as the root says.
WORD_PARTS, PART_BYTES = 256, 32 << 30
#: Texts longer than this are cut match by match rather than all at once.
LONG_TEXT = 1_000_000
#: Rows of an Arrow batch, and rows decoded together.
ROWS = 1000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes, for every task."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@functools.lru_cache(maxsize=2)
def _merger(data: bytes) -> Callable[[str], list[int]]:
    """A pre-token's ids. Its pattern takes any text whole, so that nothing is cut again."""
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=parse_ranks(data), special_tokens={}).encode_ordinary


class Pieces:
    """A table of byte strings by row number, and what rows of it make one behind the other."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(x) for x in pieces], dtype=np.int64)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, rows: np.ndarray) -> bytes:
        return _gather(self.lengths[rows], self.starts[rows], self.flat).tobytes()


@functools.lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> Pieces:
    """The token-byte table, by id."""
    by_id = {rank: token for token, rank in parse_ranks(data).items()}
    return Pieces([by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)])


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> Pieces:
    return Pieces([b"%d," % i for i in range(n)])


def _press(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as four byte planes, compressed: small numbers leave the upper planes empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpress(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


PACKED = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("data", pa.binary()), ("parts", pa.binary())])


def _pack(pattern: str, batch_tokens: int, batch_chars: int, parts: int):
    """Documents to batches: one row with all documents' positions, and one a part with its words.

    A word's position is its rank by frequency in the batch. ``parts`` has each position's part; in a
    part, words are in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        ids: list = []
        docs: list[np.ndarray] = []
        seen: dict[str, int] = {}
        tokens = chars = 0

        def places(text: str) -> np.ndarray:
            if len(text) <= LONG_TEXT:
                pieces = compiled.findall(text)
                return np.fromiter((seen.setdefault(x, len(seen)) for x in pieces), dtype=np.uint32, count=len(pieces))
            return np.fromiter((seen.setdefault(m[0], len(seen)) for m in compiled.finditer(text)), dtype=np.uint32)

        def flush() -> pa.RecordBatch:
            met = np.concatenate(docs)
            by_rank = np.argsort(-np.bincount(met, minlength=len(seen)), kind="stable")
            position = np.empty(len(seen), dtype=np.int64)
            position[by_rank] = np.arange(len(seen))
            words = [x.encode() for x in seen]
            words = [words[i] for i in by_rank]
            part = np.array([zlib.crc32(x) % parts for x in words], dtype=np.int64)
            order = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(starts))
            sizes, data = [_press(np.array([len(x) for x in docs]))], [_press(position[met])]
            for k in used:
                own = [words[i] for i in order[starts[k] : starts[k + 1]]]
                sizes.append(_press(np.array([len(x) for x in own])))
                data.append(zstandard.ZstdCompressor(level=1).compress(b"".join(own)))
            number = random.SystemRandom().getrandbits(62)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (len(used) + 1), pa.int64()),
                    pa.array([None, *used.tolist()], pa.int32()),
                    pa.array([ids, *[None] * len(used)], pa.list_(pa.int64())),
                    pa.array(sizes, pa.binary()),
                    pa.array(data, pa.binary()),
                    pa.array([_press(part), *[None] * len(used)], pa.binary()),
                ],
                schema=PACKED,
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                docs.append(places(text))
                ids.append(doc)
                tokens += len(docs[-1])
                chars += len(text)
                if tokens >= batch_tokens or chars >= batch_chars:
                    yield flush()
                    ids, docs, seen, tokens, chars = [], [], {}, 0, 0
        if docs:
            yield flush()

    return run


def _merge(vocabulary: Broadcast):
    """Each distinct word of a part is merged once, however many batches ask for it. Rows come sorted by
    part, so only one part's words are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _merger(vocabulary.value)
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            sizes, data = [], []
            for part, lengths, joined in zip(batch.column("part").to_pylist(), batch.column("sizes"), batch.column("data"), strict=True):
                if part != last:
                    last, known = part, {}
                text, at, found = zstandard.ZstdDecompressor().decompress(joined.as_py()), 0, []
                for n in _unpress(lengths.as_py()).tolist():
                    word = text[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = merge(word.decode())
                    found.append(ids)
                sizes.append(_press(np.array([len(x) for x in found])))
                data.append(_press(np.array([i for x in found for i in x])))
            columns = [batch.column("batch"), batch.column("part"), pa.array(sizes, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "part", "sizes", "data"])

    return run


def _gather(lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _documents(docs: pa.Table, words: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of each document of a batch, by position from its words' ids."""
    merged = {p: (_unpress(n), _unpress(x)) for p, n, x in zip(*(words.column(c).to_pylist() for c in ("part", "sizes", "data")), strict=True)}
    # A batch has one row of documents; its words were dealt to parts in order of position.
    part = _unpress(docs.column("parts")[0].as_py())
    order = np.argsort(part, kind="stable")
    lengths, starts, flat = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(0, np.int32)
    if len(part):
        every = [merged[p] for p in np.unique(part).tolist()]
        n = np.concatenate([x for x, _ in every]).astype(np.int64)
        lengths[order], starts[order] = n, np.cumsum(n) - n
        flat = np.concatenate([x for _, x in every]).astype(np.int32)
    for ids, sizes, data in zip(*(docs.column(c).to_pylist() for c in ("ids", "sizes", "data")), strict=True):
        codes, end = _unpress(data), 0
        for name, size in zip(ids, _unpress(sizes).tolist(), strict=True):
            own = codes[end : end + size]
            end += size
            yield name, _gather(lengths[own], starts[own], flat)


def _with_ids(docs: pa.Table, words: pa.Table) -> pa.Table:
    names, out = [], []
    for name, ids in _documents(docs, words):
        names.append(name)
        out.append(ids)
    ends = np.cumsum([0, *(len(x) for x in out)])
    values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
    return pa.table({"id": pa.array(names, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32()), values)})


def _with_digests(vocabulary: Broadcast):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        table = _token_bytes(vocabulary.value)
        decimals = _decimals(len(table.lengths))
        rows = []
        for name, ids in _documents(docs, words):
            written, decoded = decimals.joined(ids)[:-1], table.joined(ids)
            rows.append((name, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _parts(df: DataFrame, text_col: str) -> int:
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(WORD_PARTS * max(1.0, total / PART_BYTES) ** 0.5)


def _encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: Broadcast, pattern: str, batch_tokens: int, parts: int | None, finish, schema: str) -> DataFrame:
    """``finish`` of each batch of documents and its merged words."""
    parts = parts or _parts(df, text_col)
    name = "batch bigint, part int, ids array<bigint>, sizes binary, data binary, parts binary"
    with arrow_rows(df.sparkSession, ROWS):
        packed = staged(df.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_pack(pattern, batch_tokens, BATCH_CHARS, parts), name), bucket_by="batch")
    words = packed.where("part IS NOT NULL").select("batch", "part", "sizes", "data")
    merged = words.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(vocabulary), "batch bigint, part int, sizes binary, data binary")
    docs = packed.where("part IS NULL").select("batch", "ids", "sizes", "data", "parts")
    return docs.groupBy("batch").cogroup(merged.groupBy("batch")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, parts: int | None = None) -> DataFrame:
    """Every row's token ids: (id_col, ids array<int>), one row a row of ``df``."""
    return _encoded(df, id_col, text_col, shipped(df.sparkSession, path), pattern, batch_tokens, parts, _with_ids, "id bigint, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` without its ids, and with the bytes that they stand for: ``decoded`` binary. Null ids stand for none."""
    rest = [c for c in df.columns if c not in (ids_col, "decoded")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields] + ["decoded binary"])
    vocabulary = shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(vocabulary.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = [table.joined(row.values.to_numpy()) if row.is_valid else b"" for row in batch.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(out, pa.binary())], names=[*rest, "decoded"])

    return df.select(*rest, ids_col).mapInArrow(run, schema)


def digest(df: DataFrame, path: str, pattern: str, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): whole texts encoded, their ids decoded. The task that
    reassembles a batch has its ids, and digests them and the bytes that it joins them with, a document at a time."""
    vocabulary = shipped(df.sparkSession, path)
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(df, "doc_id", "text", vocabulary, pattern, batch_tokens, None, _with_digests(vocabulary), schema)
