"""Byte codecs and hashes. Lengths and plain fields are built-in expressions; checksums and hashes run on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reflected CRC-32C polynomial; the hash's multipliers; the filter's two seeds.
CRC32C_POLYNOMIAL = 0x82F63B78
MURMUR_C1, MURMUR_C2 = 0xCC9E2D51, 0x1B873593
BLOOM_SEEDS = (0xBC9F1D34, 0xEF017832)


def varint_length(value: Column, most: int = 9) -> Column:
    """Bytes of a number in groups of seven bits, of which a positive long has nine at most; null for null and for negative ones."""
    out = F.lit(most)
    for n in range(most - 1, 0, -1):
        out = F.when(value < F.lit(1 << (7 * n)), n).otherwise(out)
    return F.when(value >= 0, out)


def varint_hex(value: Column, most: int = 5) -> Column:
    """The bytes themselves, in hexadecimal digits, of numbers that need at most ``most`` of them."""
    length = varint_length(value)
    parts = []
    for i in range(most):
        seven = F.shiftright(value.cast("long"), 7 * i).bitwiseAND(127)
        parts.append(F.when(length > i + 1, F.lpad(F.hex(seven.bitwiseOR(128)), 2, "0")).when(length == i + 1, F.lpad(F.hex(seven), 2, "0")).otherwise(""))
    return F.when(length <= most, F.concat(*parts))


def unvarint_hex(digits: Column, most: int = 10) -> Column:
    """The struct (value, bytes) of the number that hexadecimal digits begin with; null when it doesn't end within them or has
    more than ``most`` bytes. Of ten bytes the value is as a long holds it."""
    byte = lambda i: F.conv(F.nullif(F.substring(digits, 2 * i + 1, F.lit(2)), F.lit("")), 16, 10).cast("long")
    every = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), byte)
    length = F.array_position(F.transform(every, lambda b: F.coalesce(b < 128, F.lit(False))), True).cast("int")
    value = F.aggregate(F.reverse(F.slice(every, 1, length)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 7).bitwiseOR(b.bitwiseAND(127)))
    return F.when(length > 0, F.struct(value.alias("value"), length.alias("bytes")))


def fixed_hex(value: Column, size: int) -> Column:
    """A number's ``size`` bytes, least first, in hexadecimal digits; negative numbers in two's complement."""
    big = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*(F.substring(big, 15 - 2 * i, 2) for i in range(size)))


def unfix_hex(digits: Column, size: int) -> Column:
    """The number of ``fixed_hex``, for sizes up to 7 bytes."""
    return F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))), 16, 10).cast("long")


def pointer_hex(file_id: Column, offset: Column, size: Column) -> Column:
    """The sixteen bytes of a pointer."""
    return F.concat(fixed_hex(file_id, 4), fixed_hex(offset, 8), fixed_hex(size, 4))


def pointer_of(digits: Column) -> Column:
    """The struct of a pointer's bytes; offsets are below 2**56."""
    part = lambda at, size: unfix_hex(F.substring(digits, 2 * at + 1, 2 * size), size)
    return F.struct(part(0, 4).alias("file_id"), part(4, 7).alias("offset"), part(12, 4).alias("value_size"))


def prefixed_hex(text: Column) -> Column:
    """A string's bytes after their number as a varint."""
    return F.concat(varint_hex(F.octet_length(text)), F.hex(F.encode(text, "UTF-8")))


def unprefixed_hex(digits: Column) -> Column:
    """The struct (text, rest) of digits that begin with a string after its length; null when they end before it does."""
    head = unvarint_hex(digits, 5)
    begin, size = (2 * head["bytes"] + 1).cast("int"), (2 * head["value"]).cast("int")
    text = F.decode(F.unhex(F.substring(digits, begin, size)), "UTF-8")
    whole = F.length(digits) >= 2 * head["bytes"] + 2 * head["value"]
    return F.when(whole, F.struct(text.alias("text"), F.substring(digits, begin + size, F.length(digits)).alias("rest")))


def status_text(code: Column, message: Column) -> Column:
    """``OK``, or the code and, when there is one, its message."""
    return F.when(code == "OK", "OK").when(F.coalesce(message, F.lit("")) == "", code).otherwise(F.concat(code, F.lit(": "), message))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1)
    return table


_TABLE = _crc_table()


#: Bytes of the pieces in which long values are summed up side by side.
_PIECE = 256


def _raw(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The checksum's register after each of the pieces, from ``begin`` on, all pieces a byte at a time."""
    crc = begin.copy()
    order = np.argsort(-lengths, kind="stable")
    counts = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), "right")
    for i, n in enumerate(counts.tolist()):
        at = order[:n]
        crc[at] = _TABLE[(crc[at] ^ flat[starts[at] + i]) & 0xFF] ^ (crc[at] >> np.uint32(8))
    return crc


def _shifts() -> np.ndarray:
    """For each byte of the register and its value what ``_PIECE`` zero bytes make of it."""
    zeros = np.zeros(_PIECE, np.uint8)
    every = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    at = np.zeros(len(every), np.int64)
    return _raw(zeros, at, at + _PIECE, every).reshape(4, 256)


_SHIFT = _shifts()


def crc32c(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value. Values are cut into pieces, which are summed up side by side and put together again."""
    lengths = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(values), np.uint8)
    starts = np.cumsum(lengths) - lengths
    head, pieces = lengths % _PIECE, lengths // _PIECE
    crc = _raw(flat, starts, head, np.full(len(values), 0xFFFFFFFF, np.uint32))
    first = np.cumsum(pieces) - pieces
    of = np.repeat(np.arange(len(values)), pieces)
    at = starts[of] + head[of] + _PIECE * (np.arange(len(of)) - first[of])
    parts = _raw(flat, at, np.full(len(of), _PIECE, np.int64), np.zeros(len(of), np.uint32))
    left = np.flatnonzero(pieces)
    for i in range(int(pieces.max(initial=0))):
        left = left[pieces[left] > i]
        c = crc[left]
        crc[left] = _SHIFT[0][c & 0xFF] ^ _SHIFT[1][(c >> 8) & 0xFF] ^ _SHIFT[2][(c >> 16) & 0xFF] ^ _SHIFT[3][c >> 24] ^ parts[first[left] + i]
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def murmur3(values: list[bytes], seed: int) -> np.ndarray:
    """The 32-bit x86 variant of MurmurHash3 of each value, all values a block at a time."""
    with np.errstate(over="ignore"):
        u = np.uint32
        lengths = np.array([len(v) for v in values], np.int64)
        width = int((lengths.max(initial=0) + 4) // 4 * 4)
        padded = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<u4").reshape(len(values), width // 4)
        h = np.full(len(values), seed, u)

        def scrambled(k: np.ndarray) -> np.ndarray:
            k = k * u(MURMUR_C1)
            return ((k << u(15)) | (k >> u(17))) * u(MURMUR_C2)

        for i in range(width // 4):
            whole = lengths >= 4 * (i + 1)
            mixed = h ^ scrambled(padded[:, i])
            mixed = ((mixed << u(13)) | (mixed >> u(19))) * u(5) + u(0xE6546B64)
            tail = (lengths > 4 * i) & ~whole
            h = np.where(whole, mixed, np.where(tail, h ^ scrambled(padded[:, i]), h))
        h ^= lengths.astype(u)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).astype(np.int64)


def _over(values: pd.Series, f) -> pd.Series:
    there = values.notna()
    out = pd.Series(pd.array([pd.NA] * len(values), "Int64"), index=values.index)
    if there.any():
        found = [v.encode() if isinstance(v, str) else bytes(v) for v in values[there]]
        out[there] = f(found)
    return out


@F.pandas_udf(T.LongType())
def crc32c_of(values: pd.Series) -> pd.Series:
    """CRC-32C of a string's or binary's bytes; null for null."""
    return _over(values, crc32c)


@F.pandas_udf(T.LongType())
def bloom_h1(values: pd.Series) -> pd.Series:
    return _over(values, lambda v: murmur3(v, BLOOM_SEEDS[0]))


@F.pandas_udf(T.LongType())
def bloom_h2(values: pd.Series) -> pd.Series:
    return _over(values, lambda v: murmur3(v, BLOOM_SEEDS[1]))


def bloom_hashes(bits_per_key: int = 10) -> int:
    """Hashes of a filter: bits times ln 2, rounded down, from 1 to 30."""
    return max(1, min(30, int(bits_per_key * 0.69314718056)))


def bloom_bits(entries: Column, bits_per_key: int = 10) -> Column:
    """Bits of a filter of so many keys: at least 64, whole bytes."""
    return F.ceil(F.greatest(F.lit(64).cast("long"), entries.cast("long") * bits_per_key) / 8).cast("long") * 8


def bloom_positions(h1: Column, h2: Column, bits: Column, hashes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i.cast("long") * h2, bits))


def value_record_bytes(vtype: Column, key: Column, value: Column) -> Column:
    """What a value-log record's checksum covers: kind, key length, key, value length and value."""
    number = lambda c, size: F.unhex(fixed_hex(c, size))
    return F.concat(number(vtype, 1), number(F.octet_length(key), 4), F.encode(key, "UTF-8"), number(F.octet_length(value), 4), F.encode(value, "UTF-8"))


def record_hex(length: Column, vtype: Column, seq: Column, key: Column, pointer: list[Column]) -> Column:
    """What a log record's checksum covers, in hexadecimal digits: length, kind, sequence number, key length, key and a put's pointer."""
    head = F.concat(fixed_hex(length, 4), fixed_hex(vtype, 1), fixed_hex(seq, 8), fixed_hex(F.octet_length(key), 4), F.hex(F.encode(key, "UTF-8")))
    file_id, offset, size = pointer
    return F.when(vtype == 1, F.concat(head, fixed_hex(file_id, 4), fixed_hex(offset, 8), fixed_hex(size, 4))).otherwise(head)
