"""Packing documents into as few fixed-length token sequences as bin completion finds."""

from __future__ import annotations

import json
import logging
import zlib
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, map_slices, shared_table

_LOG = logging.getLogger(__name__)
SEQUENCE = 2048
END_ID = 0
#: Nodes that the search may open after the first descent; the incumbent stands when they are spent.
SEARCH_NODES = 400
#: Completions tried at a node.
BRANCHES = 4
#: Pieces of one length are numbered in this many independent groups at least, and in more when there are over a million a group.
RANK_GROUPS = 256


@cache
def tokenizer(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of a tokenizers JSON file, add_special_tokens=False.

    A byte-level vocabulary whose ids follow its merges is handed to tiktoken, which gives the same ids several times faster;
    texts with an added token's string, and other vocabularies, go to tokenizers itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in special}
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
    if not byte_level or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return plain
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={bytes(of_char[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def ids(texts: list[str]) -> list[list[int]]:
        return [plain([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return ids


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and its end id, cut from the end into pieces of
    `sequence` tokens, so that only the first piece may be shorter. A null text is empty: its end id alone."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, start, length, crc, held = [], [], [], [], [], []
        for k, ids in enumerate(tokenizer(path)([t or "" for t in batch.column(1).to_pylist()])):
            raw = array("I", [*ids, END_ID]).tobytes()
            n, a, p = len(raw) // 4, 0, 0
            b = n % sequence or sequence
            while a < n:
                cut = raw[4 * a : 4 * b]
                for to, value in zip((at, piece, start, length, crc), (k, p, a, b - a, zlib.crc32(cut)), strict=True):
                    to.append(value)
                if keep_ids:
                    held.append(cut)
                a, b, p = b, b + sequence, p + 1
        columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_slices(rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def lower_bound(counts: np.ndarray, sequence: int) -> int:
    """Fewest sequences by waste: for each threshold k, lengths over sequence - k stand alone and waste what no length >= k fills."""
    lengths = np.arange(len(counts))
    best = -(-int((lengths * counts).sum()) // sequence)
    for k in range(1, sequence // 2 + 1):
        if counts[k] == 0:
            continue
        high, mid, low = counts[sequence - k + 1 :].sum(), slice(sequence // 2 + 1, sequence - k + 1), slice(k, sequence // 2 + 1)
        free = int((counts[mid] * (sequence - lengths[mid])).sum())
        extra = -(-(int((counts[low] * lengths[low]).sum()) - free) // sequence)
        best = max(best, int(high + counts[mid].sum()) + max(0, extra))
    return best


def _best_fit(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit around the largest length, over the histogram: the largest length that still fits is added, and the filling repeated as often as counts allow."""
    counts, out = counts.copy(), []
    have = [int(x) for x in np.flatnonzero(counts)]
    while have:
        filling, room, used = [], sequence, {}
        i = len(have) - 1
        while i >= 0 and room >= have[0]:
            x = have[i]
            n = min(room // x, int(counts[x])) if x <= room else 0
            if n:
                filling += [x] * n
                used[x] = n
                room -= n * x
            i -= 1
        times = min(int(counts[x]) // n for x, n in used.items())
        out.append((tuple(filling), times))
        for x, n in used.items():
            counts[x] -= n * times
        have = [x for x in have if counts[x]]
    return out


def _fits_into(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether first fit packs the lengths of small into those of large as bins: then large dominates small."""
    room = sorted(large)
    for x in sorted(small, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            return False
        room[k] -= x
        room.sort()
    return True


def completions(counts: np.ndarray, room: int, slack: int, branches: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated sets of lengths that fill room but for at most slack, the fullest first: single lengths, pairs, then a largest-first length completed by a pair."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not have.size:
        return [()] if room <= slack else []
    found: list[tuple[int, ...]] = []

    def pairs(left: int, first: tuple[int, ...]) -> None:
        a = have[(have <= left)]
        if not a.size:
            return
        k = np.searchsorted(have, left - a, side="right") - 1
        b = np.where(k >= 0, have[np.maximum(k, 0)], 0)
        b = np.where(b > a, 0, b)
        waste = left - a - b
        for i in np.lexsort((-a, waste))[: 2 * branches]:
            got = (*first, int(a[i])) + ((int(b[i]),) if b[i] else ())
            need = {x: got.count(x) for x in got}
            if waste[i] <= slack and all(counts[x] >= n for x, n in need.items()):
                found.append(tuple(sorted(got, reverse=True)))

    pairs(room, ())
    if not any(sum(f) == room for f in found):
        for x in have[::-1][:64]:
            pairs(room - int(x), (int(x),))
            if sum(1 for f in found if sum(f) == room) >= branches:
                break
    if not any(sum(f) == room for f in found):  # many small lengths: largest first, over the counts
        got, left = [], room
        for x in have[::-1]:
            n = min(left // int(x), int(counts[x]))
            got += [int(x)] * n
            left -= n * int(x)
        if left <= slack:
            found.append(tuple(got))
    out: list[tuple[int, ...]] = []
    for f in sorted(set(found), key=lambda f: (room - sum(f), len(f))):
        if not any(_fits_into(f, g) for g in out):
            out.append(f)
        if len(out) == branches:
            break
    return out


def bin_completion(histogram: dict[int, int], sequence: int = SEQUENCE, nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all of histogram (length -> count).

    Branch and bound by bin completion: the largest length left is joined by an undominated set of lengths, the filling is
    repeated as often as the counts allow, and a branch is dropped once its waste exceeds what a solution better than the
    incumbent may waste. The incumbent starts as best fit; a solution at the lower bound ends the search. Work depends on the
    number of distinct lengths, not on the number of documents. The log tells how many sequences the result has over the lower bound."""
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= sequence:
            raise ValueError(f"length {length} outside 1..{sequence}")
        counts[length] += n
    if not counts.any():
        return []
    best = _best_fit(counts, sequence)
    best_n, least = sum(n for _, n in best), lower_bound(counts, sequence)
    total = int((np.arange(sequence + 1) * counts).sum())
    opened, first = 0, True
    stack = [(counts, None, 0, 0)]  # counts left, chain of fillings, sequences so far, waste so far
    while stack and best_n > least and (first or opened < nodes):
        left, chain, made, waste = stack.pop()
        opened += not first
        spare = (best_n - 1) * sequence - total - waste
        if spare < 0:
            continue
        largest = np.flatnonzero(left)
        if not largest.size:
            first = False
            if made < best_n:
                best, best_n = [], made
                while chain:
                    best.append(chain[0])
                    chain = chain[1]
            continue
        x = int(largest[-1])
        left = left.copy()
        left[x] -= 1
        options = completions(left, sequence - x, spare)
        left[x] += 1
        if not options:
            first = False
        for rest in reversed(options):
            filling = (x, *rest)
            need = {y: filling.count(y) for y in filling}
            empty = sequence - sum(filling)
            times = min(int(left[y]) // n for y, n in need.items())
            if empty:
                times = min(times, spare // empty) or 1
            after = left.copy()
            for y, n in need.items():
                after[y] -= n * times
            stack.append((after, ((filling, times), chain), made + times, waste + empty * times))
    _LOG.warning("packing: %d sequences, lower bound %d, %d over it, %d nodes opened", best_n, least, best_n - least, opened)
    return best


def assign(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times: pass a written table.

    Only the histogram of lengths (at most `sequence` rows) reaches the driver. Each piece gets a number among those of its
    length: pieces are numbered in groups of (length, hash of the id), and groups' counts are prefix-summed, so that one
    frequent length is spread over many tasks. The number selects the filling, its repetition and the place in it."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = bin_completion(histogram, sequence)
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for filling, times in plan:
        offset = 0
        for x in filling:
            by_length.setdefault(x, []).append((times, base, offset))
            offset += x
        base += times
    keys, bases, offsets = [], [], []
    for x, slots in sorted(by_length.items()):
        n = 0
        for times, first, offset in slots:
            keys.append(x << 48 | n)
            bases.append(first - n)
            offsets.append(offset)
            n += times
    # At most a few rows for each distinct length and filling: bounded by the sequence length, not by the data.
    key, seq, off = np.array(keys, np.int64), np.array(bases, np.int64), np.array(offsets, np.int64)

    groups = max(RANK_GROUPS, sum(histogram.values()) // 1_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, length << 48 | rank, side="right") - 1
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq[k] + rank), pa.array(off[k])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Documents longer than a sequence are cut into whole sequences and a shorter first piece; all first pieces are packed together.
    A null text is empty and takes one place (its end id); null ids and repeated rows are packed one by one; an empty table
    gives no rows; other columns are ignored. path is a tokenizers JSON file that every executor can read."""
    return assign(shared_table(token_pieces(docs, path, sequence, keep_ids, id_col, text_col), "pieces"), sequence)
