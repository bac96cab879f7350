"""JSON texts as bytes and back, by a codec's name: ``msgpack`` is MessagePack, any other name, or none, is JSON itself."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# First bytes of MessagePack's values, and the lengths or formats of what follows.
_INTEGERS = ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q"), (0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q"))
_FLOATS = ((0xCA, "f"), (0xCB, "d"))
_STRINGS, _BYTES, _LISTS, _MAPS = ((0xD9, "B"), (0xDA, "H"), (0xDB, "I")), ((0xC4, "B"), (0xC5, "H"), (0xC6, "I")), ((0xDC, "H"), (0xDD, "I")), ((0xDE, "H"), (0xDF, "I"))
_NIL, _FALSE, _TRUE = 0xC0, 0xC2, 0xC3


def _fits(value: int, kinds: tuple) -> bytes:
    """The shortest form of a whole number or a length."""
    for first, form in kinds:
        try:
            return bytes([first]) + struct.pack(f">{form}", value)
        except struct.error:
            continue
    raise ValueError(f"{value} is too large for MessagePack")


def pack(value: object) -> bytes:
    if value is None:
        return bytes([_NIL])
    if isinstance(value, bool):
        return bytes([_TRUE if value else _FALSE])
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack("b" if value < 0 else "B", value)
        return _fits(value, _INTEGERS[:4] if value > 0 else _INTEGERS[4:])
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else _fits(len(raw), _STRINGS)) + raw
    short, kinds = (0x80, _MAPS) if isinstance(value, dict) else (0x90, _LISTS)
    head = bytes([short | len(value)]) if len(value) < 16 else _fits(len(value), kinds)
    return head + b"".join(pack(k) + pack(v) for k, v in value.items()) if isinstance(value, dict) else head + b"".join(map(pack, value))


def unpack(data: bytes) -> object:
    """The value of whole bytes; ValueError if they aren't one value."""

    def number(at: int, form: str) -> tuple[int | float, int]:
        return struct.unpack_from(f">{form}", data, at)[0], at + struct.calcsize(form)

    def text(at: int, n: int) -> tuple[str, int]:
        if at + n > len(data):
            raise ValueError("cut short")
        return data[at : at + n].decode(), at + n

    def some(at: int, n: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            x, at = value(at)
            out.append(x)
        return out, at

    def pairs(at: int, n: int) -> tuple[dict, int]:
        flat, at = some(at, 2 * n)
        return dict(zip(flat[::2], flat[1::2], strict=True)), at

    def value(at: int) -> tuple[object, int]:
        first, at = data[at], at + 1
        if first < 0x80 or first >= 0xE0:
            return (first if first < 0x80 else first - 256), at
        if first < 0xC0:
            return pairs(at, first & 15) if first < 0x90 else some(at, first & 15) if first < 0xA0 else text(at, first & 31)
        if first in (_NIL, _FALSE, _TRUE):
            return {_NIL: None, _FALSE: False, _TRUE: True}[first], at
        for kinds, read in ((_INTEGERS + _FLOATS, None), (_STRINGS + _BYTES, text), (_LISTS, some), (_MAPS, pairs)):
            if form := dict(kinds).get(first):
                n, at = number(at, form)
                return (n, at) if read is None else read(at, n)
        raise ValueError(f"no value begins with {first:#x}")

    try:
        out, end = value(0)
    except (IndexError, struct.error) as e:
        raise ValueError("cut short") from e
    if end != len(data):
        raise ValueError("more than one value")
    return out


@pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else pack(json.loads(t)))


@pandas_udf(T.StringType())
def _unpacked(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else json.dumps(unpack(b), ensure_ascii=False, separators=(",", ":")))


def name_of(codec: str | None) -> str:
    """The codec that is used for a name."""
    return "msgpack" if codec == "msgpack" else "json"


def encoded(text: Column, codec: str | None) -> Column:
    """JSON text as bytes."""
    return _packed(text) if name_of(codec) == "msgpack" else F.encode(text, "UTF-8")


def decoded(data: Column, codec: str | None) -> Column:
    """Bytes as JSON text; MessagePack gives it without spaces."""
    return _unpacked(data) if name_of(codec) == "msgpack" else F.decode(data, "UTF-8")
