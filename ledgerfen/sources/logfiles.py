"""Log files in their byte format, as Spark data sources: ``kvwal`` and ``kvvlog``.

A record is a checksum, its kind and lengths, little-endian, and its bytes. Reading stops at the first record of a file that is
cut off or whose checksum is wrong, as recovery does; small files share a partition. Files are read and written through the operating
system, so on a cluster the path must be a mounted shared folder; paths of other file systems are refused.

Keys and values are texts; with the option ``bytes`` set to true they are binary, as they stand in the files. Without it, bytes
that are no text are an error, as two keys must never become one.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.codecs import crc32c
from .commits import give_name

WAL_SCHEMA = "wal_id bigint, rec_no bigint, vtype int, seq bigint, key string, file_id bigint, offset bigint, value_size bigint"
VLOG_SCHEMA = "file_id bigint, offset bigint, rec_size bigint, crc bigint, vtype int, key string, value string"


def file_name(kind: str, number: int) -> str:
    """``wal_00001.log`` or ``vlog_00001.dat``; numbers of more digits keep them all."""
    return f"wal_{number:05d}.log" if kind == "wal" else f"vlog_{number:05d}.dat"


def file_number(name: str) -> int | None:
    m = re.fullmatch(r"wal_(\d{5,})\.log|vlog_(\d{5,})\.dat", name)
    return int(m[1] or m[2]) if m else None


#: Bytes of records whose checksums are worked out at once, about.
_TOGETHER = 4 << 20


def _right(data: bytes, bounds: Iterator[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The (begin, end) of records, many at a time, up to the first whose checksum is wrong."""
    part: list[tuple[int, int]] = []
    size = 0

    def good() -> list[tuple[int, int]]:
        sums = crc32c([data[a + 4 : b] for a, b in part]).tolist()
        for i, ((a, _), found) in enumerate(zip(part, sums)):
            if found != struct.unpack_from("<I", data, a)[0]:
                return part[:i]
        return part

    for bound in bounds:
        part.append(bound)
        size += bound[1] - bound[0]
        if size >= _TOGETHER:
            found = good()
            yield found
            if len(found) < len(part):
                return
            part, size = [], 0
    if part:
        yield good()


def _summed(rests: list[bytes]) -> bytes:
    """Records, each after the checksum of all that follows it."""
    sums = crc32c(rests).tolist()
    return b"".join(x for crc, rest in zip(sums, rests) for x in (struct.pack("<I", crc), rest))


def _wal_rest(vtype: int, seq: int, key: bytes, pointer: tuple[int, int, int] | None) -> bytes:
    """A put's body ends with its pointer; a delete has none."""
    body = struct.pack("<BQI", vtype, seq, len(key)) + key
    if vtype == 1:
        body += struct.pack("<IQI", *pointer)
    return struct.pack("<I", len(body)) + body


def wal_record(vtype: int, seq: int, key: bytes, pointer: tuple[int, int, int] | None) -> bytes:
    return _summed([_wal_rest(vtype, seq, key, pointer)])


def _wal_bounds(data: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at + 21 <= len(data):
        length, vtype, _, k = struct.unpack_from("<IBQI", data, at + 4)
        end = at + 8 + length
        if end > len(data) or length != 13 + k + (16 if vtype == 1 else 0):
            return
        yield at, end
        at = end


def _wal_rows(data: bytes) -> Iterator[list[tuple]]:
    for part in _right(data, _wal_bounds(data)):
        rows = []
        for a, b in part:
            vtype, seq, k = struct.unpack_from("<BQI", data, a + 8)
            pointer = struct.unpack_from("<IQI", data, a + 21 + k) if vtype == 1 else (None, None, None)
            rows.append((vtype, seq, data[a + 21 : a + 21 + k], pointer))
        yield rows


def read_wal(data: bytes) -> Iterator[tuple]:
    """(vtype, seq, key, pointer) of the records before the first bad one."""
    for rows in _wal_rows(data):
        yield from rows


def _vlog_rest(vtype: int, key: bytes, value: bytes) -> bytes:
    return struct.pack("<BI", vtype, len(key)) + key + struct.pack("<I", len(value)) + value


def vlog_record(vtype: int, key: bytes, value: bytes) -> bytes:
    return _summed([_vlog_rest(vtype, key, value)])


def _vlog_bounds(data: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at + 13 <= len(data):
        (k,) = struct.unpack_from("<I", data, at + 5)
        if at + 13 + k > len(data):
            return
        end = at + 13 + k + struct.unpack_from("<I", data, at + 9 + k)[0]
        if end > len(data):
            return
        yield at, end
        at = end


def _vlog_rows(data: bytes) -> Iterator[list[tuple]]:
    for part in _right(data, _vlog_bounds(data)):
        rows = []
        for a, b in part:
            crc, vtype, k = struct.unpack_from("<IBI", data, a)
            rows.append((a, b - a, crc, vtype, data[a + 9 : a + 9 + k], data[a + 13 + k : b]))
        yield rows


def read_vlog(data: bytes) -> Iterator[tuple]:
    """(offset, rec_size, crc, vtype, key, value) of the records before the first bad one."""
    for rows in _vlog_rows(data):
        yield from rows


def _local(path: str) -> str:
    scheme = urlparse(path).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"log files are read and written through the operating system, which has no {scheme}: paths")
    return unquote(urlparse(path).path) if scheme else path


#: Bytes of files that a partition of a scan has, about; a file is never split.
_PART_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, as_bytes: bool) -> None:
        self.kind, self.path, self.as_bytes = kind, _local(path), as_bytes

    def partitions(self) -> list[_Files]:
        prefix = "wal_" if self.kind == "wal" else "vlog_"
        names = sorted(x for x in os.listdir(self.path) if x.startswith(prefix) and file_number(x) is not None)
        parts, size = [[]], 0
        for x in names:
            at = os.path.join(self.path, x)
            if size >= _PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append((at, file_number(x)))
            size += os.path.getsize(at)
        return [_Files(p) for p in parts]

    def _texts(self, values: list[bytes]) -> pa.Array:
        if self.as_bytes:
            return pa.array(values, pa.binary())
        try:
            return pa.array([v.decode() for v in values], pa.string())
        except UnicodeDecodeError as e:
            raise ValueError("there are bytes that are no text; read with the option bytes set to true") from e

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        for path, number in part.files:
            yield from self._batches(path, number)

    def _batches(self, path: str, own: int) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            data = f.read()  # a file is bounded by the size at which logs are rotated
        number = lambda values, kind=pa.int64(): pa.array(values, kind)
        before = 0
        for rows in (_wal_rows if self.kind == "wal" else _vlog_rows)(data):
            if not rows:
                continue
            cols = list(zip(*rows))
            first = number([own] * len(rows))
            if self.kind == "wal":
                places = [number(range(before + 1, before + len(rows) + 1)), number(cols[0], pa.int32()), number(cols[1]), self._texts(cols[2])]
                arrays = [first, *places, *(number([p[i] for p in cols[3]]) for i in range(3))]
                names = [x.split()[0] for x in WAL_SCHEMA.split(", ")]
            else:
                arrays = [first, number(cols[0]), number(cols[1]), number(cols[2]), number(cols[3], pa.int32()), self._texts(cols[4]), self._texts(cols[5])]
                names = [x.split()[0] for x in VLOG_SCHEMA.split(", ")]
            before += len(rows)
            yield pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class _Writer(DataSourceWriter):
    """Tasks write files beside; they take their names when all tasks are done, and none of them that a file has already."""

    def __init__(self, kind: str, path: str, overwrite: bool) -> None:
        self.kind, self.path, self.overwrite = kind, _local(path), overwrite

    def write(self, rows) -> WriterCommitMessage:
        """Rows must come sorted by file and place within each task, all rows of a file in the same task."""
        os.makedirs(self.path, exist_ok=True)
        out, number, files = None, None, []
        waiting: list[bytes] = []
        size = 0
        coded = lambda v: v.encode() if isinstance(v, str) else bytes(v)
        for row in rows:
            r = row.asDict()
            now = r["wal_id"] if self.kind == "wal" else r["file_id"]
            if now != number:
                self._close(out, waiting)
                waiting, size = [], 0
                number, tmp = now, os.path.join(self.path, f".{file_name(self.kind, now)}.{uuid.uuid4().hex}")
                files.append((number, tmp))
                out = open(tmp, "wb")  # noqa: SIM115
            key = coded(r["key"])
            if self.kind == "wal":
                waiting.append(_wal_rest(r["vtype"], r["seq"], key, (r["file_id"], r["offset"], r["value_size"]) if r["vtype"] == 1 else None))
            else:
                waiting.append(_vlog_rest(r["vtype"], key, coded(r["value"])))
            size += len(waiting[-1])
            if size >= _TOGETHER:
                out.write(_summed(waiting))
                waiting, size = [], 0
        self._close(out, waiting)
        return _Written(files)

    @staticmethod
    def _close(out, waiting: list[bytes]) -> None:
        if out:
            out.write(_summed(waiting))
            out.flush()
            os.fsync(out.fileno())
            out.close()

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        numbers = [n for n, _ in files]
        done = []
        try:
            if len(set(numbers)) < len(numbers):
                raise ValueError("the rows of a file came in several tasks, or not together")
            if self.overwrite and os.path.isdir(self.path):
                kind = "wal_" if self.kind == "wal" else "vlog_"
                for old in [x for x in os.listdir(self.path) if x.startswith(kind) and file_number(x) is not None]:
                    os.unlink(os.path.join(self.path, old))
            for n, tmp in files:
                name = os.path.join(self.path, file_name(self.kind, n))
                give_name(tmp, name)  # fails when there is such a file
                done.append(name)
        except Exception:
            for name in done:
                os.unlink(name)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            for _, tmp in m.files if m else ():
                if os.path.exists(tmp):
                    os.unlink(tmp)


def _as_bytes(options: dict) -> bool:
    return options.get("bytes", "false").lower() == "true"


def _schema(text: str, as_bytes: bool) -> str:
    return text.replace(" string", " binary") if as_bytes else text


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return _schema(WAL_SCHEMA, _as_bytes(self.options))

    def reader(self, schema) -> _Reader:
        return _Reader("wal", self.options["path"], _as_bytes(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer("wal", self.options["path"], overwrite)


class VlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvvlog"

    def schema(self) -> str:
        return _schema(VLOG_SCHEMA, _as_bytes(self.options))

    def reader(self, schema) -> _Reader:
        return _Reader("vlog", self.options["path"], _as_bytes(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer("vlog", self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalSource)
    spark.dataSource.register(VlogSource)
