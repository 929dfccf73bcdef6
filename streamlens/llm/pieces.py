"""SentencePiece encoding that keeps, for each piece, the bytes of the source text it came from.

The text is normalised by longest prefix through the model's compiled character map (a double-array trie over UTF-8 with a pool
of replacements), recording for every normalised byte the source byte it stems from. The library segments; each piece is then
projected through that record to source bytes.
"""

from __future__ import annotations

import struct
from array import array
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_slices

SPACE = "▁"


def fields(message: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a serialized protocol buffer's top-level fields."""
    out: list[tuple[int, int | bytes]] = []
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(message):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            out.append((key >> 3, message[i : i + n]))
            i += n
    return out


class CharMap:
    """The compiled character map: 4 bytes with the trie's size, the trie's 32-bit units, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units, self.pool = array("I", blob[4 : 4 + min(size, len(blob) - 4) // 4 * 4]), blob[4 + size :]
        #: The bytes that a key can begin with.
        self.first = np.array([bool(self.units) and self._child(b) for b in range(256)])

    def _child(self, byte: int) -> bool:
        node = ((self.units[0] >> 10) << ((self.units[0] & 512) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that data has at `at`."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if node >= len(self.units):
                break
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[start:].split(b"\0", 1)[0]
        return found


class Normalizer:
    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, extra_spaces: bool = False, escape: bool = True) -> None:
        """extra_spaces: runs of spaces become one and those at the ends go. escape: a space becomes U+2581."""
        self.map, self.dummy_prefix, self.extra_spaces, self.space = CharMap(blob), dummy_prefix, extra_spaces, SPACE.encode() if escape else b" "

    @classmethod
    def of_model(cls, model: bytes) -> Normalizer:
        spec = dict(fields(next((v for k, v in fields(model) if k == 3), b"")))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(bytes after the character map, source byte of each): at each character the longest key there is replaced, else it stays."""
        data = np.frombuffer(raw, np.uint8)
        begins = (data & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(begins, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        out, sources, done = [], [], 0
        for i in np.flatnonzero(self.map.first[data] & begins).tolist():  # only here can a key begin
            if i >= done and (hit := self.map.longest(raw, i)):
                value = np.frombuffer(hit[1], np.uint8)
                out += [data[done:i], value]
                sources += [source[done:i], np.full(len(value), i)]
                done = i + hit[0]
        return (np.concatenate([*out, data[done:]]), np.concatenate([*sources, source[done:]])) if out else (data, source)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for their end, the source byte it stems from."""
        raw = text.encode()
        value, source = self._mapped(raw)
        end, start = len(raw), 0
        if self.extra_spaces:
            blank = value == 32
            stays = ~blank | np.concatenate([[False], ~blank[:-1]])  # of a run of spaces the first, and none at the start
            if not len(value) or blank.all():
                return b"", np.array([end])
            value, source = value[stays], source[stays]
            start = int(source[0])
        if not raw:
            return b"", np.array([end])
        if self.dummy_prefix:
            value, source = np.concatenate([np.array([32], np.uint8), value]), np.concatenate([[start], source])
        blank = value == 32
        width = np.where(blank, len(self.space), 1)
        at = np.cumsum(width) - width
        out, source = np.repeat(value, width), np.repeat(source, width)
        for k, byte in enumerate(self.space):
            out[at[blank] + k] = byte
        out = out.tobytes()
        while self.extra_spaces and out.endswith(self.space):
            cut = len(out) - len(self.space)
            end, out, source = int(source[cut]), out[:cut], source[:cut]
        return out, np.concatenate([source, [end]])


class Encoder:
    """Ids exactly as the library's, with begin and end ids, and each piece's end in source bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.normalizer = Normalizer.of_model(f.read())
        pieces = [self.library.id_to_piece(i) for i in range(len(self.library))]
        # Bytes of the normalised text that a piece stands for; an unknown one's are in what the library tells of the text.
        self.width = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)

    def span_ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The ends, in source bytes, of the pieces' spans: each piece's normalised bytes are looked up in the record of their sources.
        A span starts where the one before ends; of the bytes of one character the last covers it."""
        norm, source = self.normalizer(text)
        width = self.width[ids]
        unknown = np.flatnonzero(ids == self.library.unk_id())
        if len(unknown):
            told = self.library.encode(text, return_type="proto").pieces  # without the begin id
            width[unknown] = [len(told[k - 1].piece.encode()) for k in unknown.tolist()]
        return source[np.minimum(np.cumsum(width), len(norm))]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids = self.library.encode(text, add_bos=True, add_eos=True)
        return ids, self.span_ends(text, np.array(ids)).tolist()

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes, str]]:
        """Of each text the ids and the span ends as little-endian unsigned 32-bit integers, and decode(ids)."""
        out, all_ids = [], self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, ids, decoded in zip(texts, all_ids, self.library.decode(all_ids, num_threads=1), strict=True):
            raw = np.array(ids, "<u4")
            out.append((raw.tobytes(), self.span_ends(text, raw).astype("<u4").tobytes(), decoded))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def unpack(packed: bytes) -> list[int]:
    return array("I", packed).tolist()


def span_of(ends: list[int], byte: int) -> int:
    """The piece that covers a source byte."""
    return bisect_right(ends, byte)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, span_ends, decoded) for every whole text; ids and span_ends are packed little-endian 32-bit integers (`unpack`).

    Piece k covers source bytes span_ends[k-1] to span_ends[k]; begin and end ids cover none, and of the byte pieces of one
    character the last covers it. A null text is an empty one (begin and end ids only); null ids and repeated rows are kept;
    an empty table gives none; other columns are ignored. model is a path that every executor can read."""
    rows = id_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(model).packed([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.string())],
            ["doc_id", "n_tokens", "ids", "span_ends", "decoded"],
        )

    return map_slices(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, span_ends binary, decoded string")
