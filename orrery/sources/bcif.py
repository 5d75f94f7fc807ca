"""Binary mmCIF: a MessagePack document whose columns are encoded arrays.

Only what a coordinate table needs is decoded: the columns of one category, with their
masks. Both formats are public: MessagePack, and the BinaryCIF specification.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Element types of byte arrays.
TYPES = {1: "<i1", 2: "<i2", 3: "<i4", 4: "<u1", 5: "<u2", 6: "<u4", 32: "<f4", 33: "<f8"}
#: First byte of sized values, the format of what follows, and what that is.
_SIZED = {
    0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xCA: (">f", "number"), 0xCB: (">d", "number"), 0xCC: (">B", "number"), 0xCD: (">H", "number"), 0xCE: (">I", "number"),
    0xCF: (">Q", "number"), 0xD0: (">b", "number"), 0xD1: (">h", "number"), 0xD2: (">i", "number"), 0xD3: (">q", "number"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"),
    0xDC: (">H", "array"), 0xDD: (">I", "array"), 0xDE: (">H", "map"), 0xDF: (">I", "map"),
}


def unpacked(raw: bytes):
    """The value of a MessagePack document; a broken one is a ValueError."""
    try:
        return _value(raw, 0)[0]
    except (struct.error, IndexError) as e:
        raise ValueError("not a MessagePack document") from e


def _value(raw: bytes, at: int):
    first = raw[at]
    at += 1
    if first < 0x80:
        return first, at
    if first >= 0xE0:
        return first - 0x100, at
    if first < 0x90:
        return _held(raw, at, "map", first & 0x0F)
    if first < 0xA0:
        return _held(raw, at, "array", first & 0x0F)
    if first < 0xC0:
        return _held(raw, at, "str", first & 0x1F)
    if first in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[first], at
    if first not in _SIZED:
        raise ValueError(f"unknown MessagePack type {first:#x}")
    form, kind = _SIZED[first]
    (n,) = struct.unpack_from(form, raw, at)
    at += struct.calcsize(form)
    return (n, at) if kind == "number" else _held(raw, at, kind, n)


def _held(raw: bytes, at: int, kind: str, n: int):
    if kind in ("str", "bin"):
        if at + n > len(raw):
            raise ValueError("the document ends within a value")
        part = raw[at : at + n]
        return (part.decode("utf-8", "replace") if kind == "str" else part), at + n
    out = []
    for _ in range(n * (2 if kind == "map" else 1)):
        v, at = _value(raw, at)
        out.append(v)
    return (dict(zip(out[::2], out[1::2], strict=True)) if kind == "map" else out), at


def _unpacked_integers(x: np.ndarray, e: dict) -> np.ndarray:
    """Values that don't fit are sums of limits and a rest."""
    high = (1 << (8 * e["byteCount"])) - 1 if e["isUnsigned"] else (1 << (8 * e["byteCount"] - 1)) - 1
    x = x.astype(np.int64)
    more = x == high
    if not e["isUnsigned"]:
        more |= x == -high - 1
    # a value ends where no limit stands
    number = np.concatenate(([0], np.cumsum(~more)[:-1])) if len(x) else x
    return np.bincount(number, x, e["srcSize"])[: e["srcSize"]].astype(np.int64) if len(x) else x


def decoded(data, encodings: list[dict]):
    """The values of an encoded array: its encodings undone from the last to the first."""
    for e in reversed(encodings):
        kind = e["kind"]
        if kind == "ByteArray":
            data = np.frombuffer(data, TYPES[e["type"]])
        elif kind == "FixedPoint":
            data = data / e["factor"]
        elif kind == "IntervalQuantization":
            data = e["min"] + data * ((e["max"] - e["min"]) / (e["numSteps"] - 1))
        elif kind == "RunLength":
            data = np.repeat(data[::2], data[1::2])
        elif kind == "Delta":
            data = np.cumsum(data.astype(np.int64)) + e["origin"]
        elif kind == "IntegerPacking":
            data = _unpacked_integers(data, e)
        elif kind == "StringArray":
            places = decoded(e["offsets"], e["offsetEncoding"])
            words = [e["stringData"][a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            data = np.array([words[k] if k >= 0 else "" for k in decoded(data, e["dataEncoding"])], object)
        else:
            raise ValueError(f"unknown encoding {kind}")
    return data


def rows(raw: bytes, category: str = "_atom_site") -> Iterator[dict]:
    """The rows of a category of the first block that has it, as name -> value; what is masked is left out."""
    for block in unpacked(raw).get("dataBlocks", []):
        for c in block["categories"]:
            if c["name"] == category:
                columns = {}
                for col in c["columns"]:
                    values = decoded(col["data"]["data"], col["data"]["encoding"]).tolist()
                    if col.get("mask"):
                        gone = decoded(col["mask"]["data"], col["mask"]["encoding"]).tolist()
                        values = [None if m else v for v, m in zip(values, gone, strict=True)]
                    columns[col["name"]] = values
                for n in range(c["rowCount"]):
                    yield {k: v[n] for k, v in columns.items() if v[n] is not None}
                return
