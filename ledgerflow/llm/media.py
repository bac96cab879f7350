"""Telephony audio columns: WAV files with mu-law, A-law or IMA ADPCM samples.

Companded samples are expanded by a table of 256 entries. ADPCM blocks start from their own header,
so numpy decodes all blocks of a batch of files side by side, one nibble step at a time. Decoded
audio is resampled by whole or rational factors and stored as 16-bit PCM: as WAV files (``expand``), or
without loss in less room (``pack_pcm``, which the query uses): every second sample as a code or a change, and
how far the samples between are from their neighbours' middle where resampling left any that are.
digest() writes both files to the shared folder and takes its columns from what it reads back.

Defined results: a null or empty payload gives a file of one unit of padding (see ``pad``); a file that is
not one of ours raises ValueError; equal texts give equal files, and rows that repeat an id or text each
give a row; an empty table gives none. A very long text is a file of its own batch: a task holds some
twenty times its bytes. store() and digest() read the id and text columns only; expand() keeps the others
and replaces those called as its own. There is no shuffle: a row depends on itself only.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, staged

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
NAMES = {PCM: "pcm16", ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima-adpcm"}
#: Payload bytes in an ADPCM block, behind its header of four bytes.
BLOCK = 288
UNIT = 576
STEP_LIMIT = 88


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


def _adpcm_steps() -> np.ndarray:
    # The step sizes of the IMA ADPCM format.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


# The index changes of the IMA ADPCM format.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
_MULAW, _ALAW, _STEPS = _mulaw_table(), _alaw_table(), _adpcm_steps()


def _adpcm_changes() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and nibble: the change of the predictor, and the next step index."""
    index, nibble = np.meshgrid(np.arange(STEP_LIMIT + 1), np.arange(16), indexing="ij")
    step = _STEPS[index]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -change, change).astype(np.int32), np.clip(index + _INDEX[nibble], 0, STEP_LIMIT).astype(np.int32)


_CHANGE, _NEXT = (x.ravel() for x in _adpcm_changes())


def pad(data: bytes, unit: int = UNIT, fill: int = 255) -> bytes:
    """``data`` up to a positive multiple of ``unit``."""
    return data + bytes([fill]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_wav(payload: bytes, codec: int, rate: int = 8000) -> bytes:
    """A WAV file whose samples are the payload's bytes (ADPCM: its nibbles, in blocks of BLOCK bytes)."""
    if codec == ADPCM:
        if len(payload) % BLOCK:
            raise ValueError(f"an ADPCM payload is a multiple of {BLOCK} bytes")
        blocks = np.zeros((len(payload) // BLOCK, BLOCK + 4), dtype=np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
        data, align, bits, extra = blocks.tobytes(), BLOCK + 4, 4, struct.pack("<HH", 2, 2 * BLOCK + 1)
        per_second = rate * align // (2 * BLOCK + 1)
    else:
        width = 2 if codec == PCM else 1
        data, align, bits, extra, per_second = payload, width, 8 * width, b"" if codec == PCM else struct.pack("<H", 0), rate * width
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_second, align, bits) + extra
    odd = b"\0" * (len(data) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, data) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if codec not in NAMES or at + 8 + size > len(media):
                raise ValueError("unknown codec, or the data are cut short")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(codec: int, data: bytes) -> bytes:
    """What write_wav() was given."""
    if codec != ADPCM:
        return data
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, BLOCK + 4)[:, 4:].tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """All blocks at once: (blocks, BLOCK + 4) bytes to (blocks, 2 * BLOCK + 1) samples."""
    out = np.empty((2 * BLOCK + 1, len(blocks)), dtype=np.int16)
    head = blocks[:, :4]
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), STEP_LIMIT)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK):
        for half, nibble in enumerate((columns[k] & 15, columns[k] >> 4)):
            at = (index << 4) | nibble
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            index = _NEXT[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def decode(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (codec, data); the ADPCM blocks of all files are decoded together."""
    out: list = [None] * len(files)
    adpcm = [i for i, (codec, _) in enumerate(files) if codec == ADPCM]
    if adpcm:
        parts = [np.frombuffer(files[i][1], dtype=np.uint8).reshape(-1, BLOCK + 4) for i in adpcm]
        samples = decode_adpcm(np.concatenate(parts))
        for i, end, part in zip(adpcm, np.cumsum([len(x) for x in parts]), parts, strict=True):
            out[i] = samples[end - len(part) : end].ravel()
    for i, (codec, data) in enumerate(files):
        if codec == PCM:
            out[i] = np.frombuffer(data, dtype="<i2")
        elif codec in (MULAW, ALAW):
            out[i] = (_MULAW if codec == MULAW else _ALAW)[np.frombuffer(data, dtype=np.uint8)]
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between neighbours, in whole numbers; the last sample is held."""
    if not len(samples) or rate == to:
        return samples
    shared = math.gcd(rate, to)
    up, down = to // shared, rate // shared
    n = -(-len(samples) * up // down)
    if (up, down) == (2, 1):
        out = np.empty(n, dtype=np.int16)
        out[::2] = samples
        after = np.append(samples[1:], samples[-1:]).astype(np.int32)
        out[1::2] = (samples + after) >> 1
        return out
    position = np.arange(n, dtype=np.int64) * down
    left, part = position // up, position % up
    right = np.minimum(left + 1, len(samples) - 1)
    return ((samples[left].astype(np.int64) * (up - part) + samples[right].astype(np.int64) * part) // up).astype(np.int16)


def _codes(table: np.ndarray) -> np.ndarray:
    """For each 16-bit sample: a code that ``table`` expands to it, -1 if there is none."""
    out = np.full(1 << 16, -1, dtype=np.int16)
    out[table.view(np.uint16)] = np.arange(len(table))
    return out


_CODES = {MULAW: _codes(_MULAW), ALAW: _codes(_ALAW)}
#: The head of packed PCM: its mark, the form of the even samples, whether the odd ones follow, rate, sample count.
_PACKED = "<4sBBIQ"
#: A form beside PCM (as they are), MULAW and ALAW (codes of a companding table): changes.
CHANGES = 2


def pack_pcm(samples: np.ndarray, rate: int) -> bytes:
    """16-bit samples without loss: those at even places as codes of a companding table if it has them all, else as they
    are or their changes, whichever take fewer values; then, unless all are 0, what the others differ from the middle
    of their neighbours. All sums are modulo 2**16."""
    even, odd = samples[::2].astype("<i2"), samples[1::2].astype("<i2")
    for form, table in _CODES.items():
        codes = table[even.view(np.uint16)]
        if (codes >= 0).all():
            body = codes.astype(np.uint8)
            break
    else:
        changes = np.diff(even, prepend=np.zeros(1, "<i2"))
        form, body = (CHANGES, changes) if len(np.unique(changes)) < len(np.unique(even)) else (PCM, even)
    rest = odd - _middle(even)[: len(odd)]
    follows = bool(rest.any())
    return struct.pack(_PACKED, b"RPCM", form, follows, rate, len(samples)) + body.tobytes() + rest.tobytes() * follows


def unpack_pcm(packed: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) that pack_pcm() was given."""
    head = struct.calcsize(_PACKED)
    if len(packed) < head or packed[:4] != b"RPCM":
        raise ValueError("not packed PCM")
    _, form, follows, rate, n = struct.unpack_from(_PACKED, packed)
    evens = n - n // 2
    at = head + evens * (1 if form in _CODES else 2)
    if len(packed) != at + 2 * (n // 2) * follows:
        raise ValueError("the samples are cut short")
    if form in _CODES:
        even = (_MULAW if form == MULAW else _ALAW)[np.frombuffer(packed, np.uint8, evens, head)]
    else:
        even = np.frombuffer(packed, "<i2", evens, head)
        even = np.cumsum(even, dtype=np.int16) if form == CHANGES else even
    out = np.empty(n, dtype=np.int16)
    out[::2] = even
    out[1::2] = _middle(even)[: n // 2]
    if follows:
        out[1::2] += np.frombuffer(packed, "<i2", offset=at)
    return rate, out


def _middle(even: np.ndarray) -> np.ndarray:
    return ((even.astype(np.int32) + np.append(even[1:], even[-1:]).astype(np.int32)) >> 1).astype("<i2")


def features(samples: np.ndarray, codec: int, rate: int) -> str:
    """Codec, rate, sample count, root mean square, peak and sign changes, in whole numbers."""
    wide = samples.astype(np.int32)
    energy = int(np.dot(samples.astype(np.float64), samples.astype(np.float64)))
    peak = int(np.abs(wide).max()) if len(wide) else 0
    turns = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"codec={NAMES[codec]};rate={rate};samples={len(samples)};rms={math.isqrt(energy // max(1, len(samples)))};peak={peak};sign_changes={turns}"


#: Files decoded together; a longer file is decoded alone.
TOGETHER = 4_000_000


def _codec_for(payload: bytes, codecs: tuple[int, ...]) -> int:
    """By content, so that equal texts are stored alike."""
    return codecs[zlib.crc32(payload) % len(codecs)]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours of about TOGETHER bytes in all."""
    begin = size = 0
    for end, n in enumerate(sizes, 1):
        size += n
        if size >= TOGETHER or end == len(sizes):
            yield begin, end
            begin, size = end, 0


def store(df: DataFrame, id_col: str = "doc_id", bytes_col: str = "text", codecs: tuple[int, ...] = (MULAW, ALAW, ADPCM), rate: int = 8000, to_rate: int | None = None) -> DataFrame:
    """(id_col, n_bytes, media): each row's bytes, padded, as the samples of a WAV file; with ``to_rate`` also its
    audio, expanded from that file and resampled, as ``packed`` PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in _groups([len(x.as_buffer() or b"") for x in whole.column(1)]):
                batch = whole.slice(begin, end - begin)
                sizes, media = [], []
                for value in batch.column(1):
                    data = value.as_py() or b""
                    payload = pad(data)
                    sizes.append(len(data))
                    media.append(write_wav(payload, _codec_for(payload, codecs), rate))
                columns = {id_col: batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())}
                if to_rate:
                    files = [read_wav(x) for x in media]
                    audio = decode([(codec, data) for codec, _, data in files])
                    columns["packed"] = pa.array([pack_pcm(resample(x, rate, to_rate), to_rate) for x in audio], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.select(F.col(id_col).cast("bigint"), F.col(bytes_col).cast("binary")).mapInArrow(run, f"{id_col} bigint, n_bytes bigint, media binary" + ", packed binary" * bool(to_rate))


def payload_facts(media: bytes, codec: int, data: bytes) -> tuple[int, str, int, int, str]:
    """What FACTS lists of a file."""
    payload = payload_of(codec, data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()


FACTS = ["payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def expand(df: DataFrame, to_rate: int = 16000, media_col: str = "media", keep_pcm: bool = True) -> DataFrame:
    """``df`` with payload facts, a feature string and (keep_pcm) a PCM file of the resampled audio."""
    fields = FACTS + ["pcm binary"] * keep_pcm
    rest = [c for c in df.columns if c != media_col and c not in {f.split()[0] for f in fields}]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields] + fields)

    def group(media: list[bytes]) -> list[tuple]:
        files = [read_wav(x) for x in media]
        out = []
        for whole, (codec, rate, data), samples in zip(media, files, decode([(c, d) for c, _, d in files]), strict=True):
            audio = resample(samples, rate, to_rate)
            row = (*payload_facts(whole, codec, data), features(audio, codec, to_rate))
            out.append((*row, write_wav(audio.astype("<i2").tobytes(), PCM, to_rate)) if keep_pcm else row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.num_columns - 1)
            for begin, end in _groups([len(x.as_buffer()) for x in media]):
                made = list(zip(*group([x.as_py() for x in media[begin:end]]), strict=True))
                kept = [batch.column(i)[begin:end] for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(x, kind) for x, kind in zip(made, [*_KINDS, pa.binary()], strict=False)], names=rest + [f.split()[0] for f in fields])

    return df.select(*rest, media_col).mapInArrow(run, schema)


#: How the stored files are written. Snappy, the default, takes about twice the room; larger pages hold more texts to
#: refer to, smaller row groups bound what a writer holds.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": "4194304", "parquet.block.size": "67108864", "parquet.enable.dictionary": "false"}
#: Rows of an Arrow batch.
ROWS = 500


def stored(df: DataFrame, to_rate: int = 16000) -> DataFrame:
    """The telephony files and their resampled audio, as written to the shared folder and read back."""
    with arrow_rows(df.sparkSession, ROWS):
        return staged(store(df, to_rate=to_rate), **STORED)


def measured(files: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, FACTS) from stored files: the payload from the telephony file, the features from its PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, packed in zip(batch.column("media"), batch.column("packed"), strict=True):
                whole = media.as_py()
                codec, _, data = read_wav(whole)
                rate, samples = unpack_pcm(packed.as_py())
                rows.append((*payload_facts(whole, codec, data), features(samples, codec, rate)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FACTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True))], names=["doc_id", "n_bytes", *(f.split()[0] for f in FACTS)])

    return files.mapInArrow(run, ", ".join(["doc_id bigint", "n_bytes bigint", *FACTS]))


def digest(df: DataFrame) -> DataFrame:
    """Each text's bytes through a stored file and back, with features of the stored PCM."""
    return measured(stored(df))
