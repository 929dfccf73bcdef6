"""Media columns: payloads stored as 8-bit samples, and the sniffing that finds, checks and carves media in any bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_slices

UNIT = 64
RATE = 8000
#: Magic bytes, the type they claim, and where in the medium they stand.
SIGNATURES = ((b"RIFF", "audio/wav", 0), (b"\x89PNG\r\n\x1a\n", "image/png", 0), (b"GIF87a", "image/gif", 0), (b"GIF89a", "image/gif", 0), (b"\xff\xd8\xff", "image/jpeg", 0), (b"BM", "image/bmp", 0), (b"%PDF-", "application/pdf", 0), (b"fLaC", "audio/flac", 0), (b"PK\x03\x04", "application/zip", 0))


@dataclass(frozen=True)
class Medium:
    kind: str
    start: int
    end: int


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while i + 8 <= end:
        name, n = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        seen.add(name)
        i += 8 + n + n % 2
    return end if i == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, i)[0], b[i + 4 : i + 8]
        if first and (name != b"IHDR" or n != 13) or i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return at + size if header in (12, 40, 52, 56, 108, 124) and planes == 1 and 14 + header <= start <= size <= len(b) - at else 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1
        if b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
        elif b[i] == 0x21:
            i += 2
        else:
            return 0
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return 0
        i += 2 + n
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 if end >= 0 else 0
    return 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _flac(b: bytes, at: int) -> int:
    return len(b) if len(b) >= at + 42 and b[at + 4] & 127 == 0 and b[at + 5 : at + 8] == b"\x00\x00\x22" else 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note if at + start + size == end and end + 22 + note <= len(b) and b[at + start : at + start + 4] == b"PK\x01\x02" else 0


CHECKS = {"audio/wav": _wav, "image/png": _png, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "audio/flac": _flac, "application/zip": _zip}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, offset in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, offset))
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> list[Medium]:
    """Media in data, in order, none inside another: Aho-Corasick finds the magic bytes, a validator of the format confirms structure and length."""
    out: list[Medium] = []
    for last, (n, kind, offset) in _automaton().iter((data or b"").decode("latin-1")):
        start = last - n + 1 - offset
        if start >= (out[-1].end if out else 0) and (end := CHECKS[kind](data, start)):
            out.append(Medium(kind, start, end))
    return out


def identify(data: bytes | None, declared: str | None = None) -> str:
    """The type of data: of the medium that fills it from byte 0, whatever was declared; else the declared type, if no validator refutes it."""
    media = sniff(data)
    if media and media[0].start == 0:
        return media[0].kind
    return "application/octet-stream" if declared is None or declared in CHECKS else declared


def carve(data: bytes | None) -> list[tuple[str, bytes]]:
    return [(m.kind, data[m.start : m.end]) for m in sniff(data)]


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT) if raw else bytes(UNIT)


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples; the format's lengths hold up to 4 GB."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(wav: bytes) -> tuple[int, bytes]:
    """(rate, samples) by walking the chunks of a checked WAV."""
    i, rate = 12, 0
    while True:
        name, n = wav[i : i + 4], struct.unpack_from("<I", wav, i + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", wav, i + 12)[0]
        if name == b"data":
            return rate, wav[i + 8 : i + 8 + n]
        i += 8 + n + n % 2


def feature(kind: str, rate: int, payload: bytes) -> str:
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{kind};rate={rate};samples={len(x)};peak={int(x.max())};sum={total};energy={square};crossings={cross}"


def _media(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts = batch.columns
    stored = [to_wav(pad((t or "").encode())) for t in texts.to_pylist()]
    return pa.RecordBatch.from_arrays([ids, pa.array(stored, pa.binary()), pa.array(["application/octet-stream"] * len(stored))], ["doc_id", "media", "declared"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a media column: (doc_id, media, declared), the UTF-8 bytes padded to a positive multiple of 64 as samples of a WAV file.

    A null text is an empty one (64 zero samples); null ids and repeated rows are kept; an empty table gives none; other columns are ignored."""
    rows = id_text(docs, id_col, text_col)
    return map_slices(rows, _media, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary, declared string")


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, n_bytes = batch.column(0), batch.column(1)
    out = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
    for data, declared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        if (kind := identify(data, declared)) != "audio/wav":
            raise ValueError(f"a stored medium reads as {kind}")
        rate, payload = samples(data)
        for name, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(kind, rate, payload)), strict=True):
            out[name].append(value)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([ids, n_bytes, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", "n_bytes", *out])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, sniff, read back and digest in one pass over the rows; columns as store_texts, then the digests. Same handling of nulls, repeats and empty tables."""
    rows = id_text(docs, id_col, text_col)

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, media, declared = _media(batch).columns
        size = pa.array([len((t or "").encode()) for t in batch.column(1).to_pylist()], pa.int64())
        return _read(pa.RecordBatch.from_arrays([ids, size, media, declared], ["doc_id", "n_bytes", "media", "declared"]))

    return map_slices(rows, both, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
