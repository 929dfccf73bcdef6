"""Near-duplicate passages by compact windows.

Each of HASHES hash functions ranks a text's word shingles. The Cartesian tree over these ranks groups all of its subsequences by
their min-hash: node c with the maximal interval [l, r] in which nothing is less stands for every subsequence of [l, r] that holds c.
Nodes with an interval of a passage's length or more are the compact windows. Windows of one min-hash are compared, every two of
different documents whose intervals have room for a passage, on the shingles (32 bits of their hashes) of REACH places to each side:
a passage is grown around the common shingle and verified. A longer one is found as several, each by its own windows, of which equal
ones are put together again. Left out are only pairs that cannot add to the result: those with too few shingles in common around the
min-hash, and sources that have no word of a window beyond the passages found for it and are linked to its document already, by other
passages of this min-hash. Documents with equal texts are one: the one with the least id is compared, the others are reported whole.
Min-hashes of many windows are dealt out as pairs of chunks.
"""

from __future__ import annotations

import math
import re
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, id_text, map_slices, shared_table, split_by_ids
from .components import connected

WIDTH = 5
#: Words of the shortest passage, and the shingles it has.
PASSAGE = 50
SIMILARITY = 0.8
HASHES = 3
#: Shingles to either side of a common one that two windows are compared on: a passage's length and more.
REACH, SLACK = 64, 8
#: Equal places of a window nearer than this to the one before share its row: their passages lie within REACH of it.
NEAR_PLACES = 16
#: Windows of one min-hash that one task compares; more are dealt out as pairs of chunks of this size.
CHUNK = 16_384
#: Min-hashes seen FREQUENT times or more in one of SAMPLE documents are salted, MOST_FREQUENT at most: any other has fewer than
#: about one in MOST_FREQUENT of all windows.
FREQUENT, SAMPLE, MOST_FREQUENT = 8, 64, 65_536
_SALTS = 64
#: Cells of a table of rows by shingles, beyond which lists are kept instead: the same sums, less memory.
_DENSE = 16_000_000
#: Cells of the tables of rows by rows, and rows by places, that are held at a time.
_CELLS, _ROWS = 1_000_000, 4096
#: Rows of a min-hash, all of whose pairs are tested at once; of more rows, those that the best one's failure leaves.
_FEW = 64
#: Fewer pairs than this are looked at one by one.
_MANY = 8
#: Passages that are handed on at a time.
OUT_ROWS = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MASK = 0xFFFFFFFF
#: Further than any place of a row.
_FAR = 1 << 20


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h ^ np.uint64((seed + 1) * 0xD1B54A32D192ED03 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: A number for every byte at each of a word's first places, A-Z as a-z: their sum is the word's hash, if it is no longer than that.
_PLACES = 32
_SUMMANDS = mixed(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64), 17).reshape(_PLACES, 256)
_SUMMANDS[:, ord("A") : ord("Z") + 1] = _SUMMANDS[:, ord("a") : ord("z") + 1]
_SUMMANDS = _SUMMANDS.ravel()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at a time; more only where a word goes on.
_BYTES = 1 << 15
#: Places whose windows are looked for at a time.
_PLACES_AT = 1 << 15


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, A-Z lower-cased; how many words each text has)."""
    import xxhash

    raw = b"\n".join([*texts, b""])
    whole, starts, values, at = np.frombuffer(raw, np.uint8), [], [], 0
    while at < len(raw):
        end = min(at + _BYTES, len(raw))
        while not (stops := _SPACE[whole[at:end]]).any():  # the last byte of all is white space
            end = min(2 * end - at, len(raw))
        end = at + len(stops) - int(stops[::-1].argmax())  # whole words
        part, stops = whole[at:end], stops[: end - at]
        # A byte is a word's first if white space or nothing is before it; each part ends with white space.
        gap = np.flatnonzero(stops)
        before = np.concatenate([[-1], gap[:-1]])
        size = gap - before - 1
        word = size > 0
        first, size = before[word] + 1, size[word]
        letters = np.flatnonzero(~stops)
        place = letters - np.repeat(first, size)
        h = _SUMMANDS.take(np.minimum(place, _PLACES - 1) << 8 | part[letters])
        if len(first):
            h = np.add.reduceat(h, np.cumsum(size) - size)
            for k in np.flatnonzero(size > _PLACES).tolist():
                h[k] = xxhash.xxh64_intdigest(raw[at + first[k] : at + first[k] + size[k]].lower())
            starts.append(first + at)
            values.append(h)
        at = end
    ends = np.cumsum([len(t) + 1 for t in texts])
    until = np.concatenate(starts).searchsorted(ends) if starts else np.zeros(len(texts), np.int64)
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.diff(until, prepend=0)


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingle that begins at every word of all texts, never zero but where the text ends before it; words of each text)."""
    w, n = word_hashes(texts)
    h, size = np.zeros(len(w), np.uint64), len(w) - width + 1
    if size > 0:
        with np.errstate(over="ignore"):
            for k in range(width):
                h[:size] *= np.uint64(0x9E3779B97F4A7C15)
                h[:size] += w[k : size + k]
        h[h == 0] = 1
    ends = np.cumsum(n)
    for k in range(1, width):
        h[np.maximum(ends - k, ends - n)[n > 0]] = 0
    return h, n


def _sliding(h: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every n neighbours."""
    width = 1
    while 2 * width <= n:
        h, width = least(h[:-width], h[width:]), 2 * width
    return least(h[: len(h) - n + width], h[n - width :]) if n > width else h


def compact_windows(h: np.ndarray, least: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes with intervals of `least` or more, in order of c, l and r at most `reach` from c. Equal
    least values of an interval are nodes of that interval each. A value of zero is in no interval: it parts texts laid end to end."""
    if len(h) < least:
        return (np.zeros(0, np.int64),) * 3
    lows = _sliding(h, least, np.minimum)
    # c is a node if it is the least of some `least` neighbours: the greatest of the least values around it is its own.
    pad = np.zeros(least - 1, h.dtype)
    c = np.flatnonzero((_sliding(np.concatenate([pad, lows, pad]), least, np.maximum) == h) & (h > 0))
    reach = len(h) if reach is None else reach
    side = min(reach, len(h))
    wide = np.concatenate([np.zeros(side, h.dtype), h, np.zeros(side, h.dtype)])
    l, r = c.copy(), c.copy()  # noqa: E741
    step = max(_PLACES_AT, side)
    for begin in range(0, len(h), step):
        here = slice(*c.searchsorted([begin, begin + step]))
        if here.start == here.stop:
            continue
        # The least of every 1, 2, 4... neighbours: an interval grows by the largest of these that hold nothing less than its node.
        lows = [wide[begin : begin + step + 2 * side]]
        while 2 << len(lows) - 1 <= side:
            w = 1 << len(lows) - 1
            lows.append(np.minimum(lows[-1][:-w], lows[-1][w:]))
        node, own = c[here] - begin + side, h[c[here]]
        left, right = node.copy(), node + 1
        for k in range(len(lows) - 1, -1, -1):
            w = 1 << k
            more = (left - w >= node - side) & (lows[k][np.maximum(left - w, 0)] >= own)
            left -= w * more
            more = (right + w <= node + 1 + side) & (lows[k][np.minimum(right, len(lows[k]) - 1)] >= own)
            right += w * more
        l[here], r[here] = left + (begin - side), right + (begin - side - 1)
    return np.maximum(l, 0), c, np.minimum(r, len(h) - 1)


def spread(c: np.ndarray, value: np.ndarray, gap: int) -> np.ndarray:
    """Which places c (ascending) stay if, of those with equal value, any nearer than gap to the last one that stayed goes."""
    stays, last = np.ones(len(c), bool), {}
    by = value.argsort()
    again = value[by[1:]] == value[by[:-1]]
    if not again.any():
        return stays
    some = np.zeros(len(c), bool)  # only places whose value another one has
    some[by[1:][again]] = some[by[:-1][again]] = True
    for k, at, v in zip(np.flatnonzero(some).tolist(), c[some].tolist(), value[some].tolist(), strict=True):
        if at - last.get(v, at - gap) < gap:
            stays[k] = False
        else:
            last[v] = at
    return stays


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def windows(docs: DataFrame, hashes: int = HASHES, width: int = WIDTH, passage: int = PASSAGE, reach: int = REACH, frequent: np.ndarray | None = None) -> DataFrame:
    """(v, doc_id, at, span, salt) of docs (doc_id, text, mark): the min-hash; mark and position c in one long; c - l and r - c, at most
    `reach`, in another; and a number from 1 on that deals out the windows of min-hashes among `frequent` (ascending), 0 for others."""
    least = passage - width + 1
    if reach < least + NEAR_PLACES or reach > _MASK >> 16:
        raise ValueError(f"reach is to be from {least + NEAR_PLACES} to {_MASK >> 16}")
    held = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if frequent is None else frequent)  # MOST_FREQUENT numbers at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined, n = shingle_hashes(_texts(batch.column(1)), width)
        first, apart = np.cumsum(n) - n, joined == 0
        marks = batch.column(2).to_numpy()
        v, who, at, span = [], [], [], []
        for f in range(hashes):
            h = mixed(joined, f)
            h[apart] = 0
            l, c, r = compact_windows(h, least, reach)  # noqa: E741
            of = np.searchsorted(first, c, side="right") - 1
            stays = spread(c, h[c] ^ mixed(of.astype(np.uint64), 7), NEAR_PLACES)
            l, c, r, of = l[stays], c[stays], r[stays], of[stays]  # noqa: E741
            v.append(h[c].view(np.int64))
            who.append(of)
            at.append(marks[of] << 32 | (c - first[of]))
            span.append((c - l) << 16 | (r - c))
        v, who, at, span = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (v, who, at, span))
        hot = held.value
        salt = np.zeros(len(v), np.int64)
        if len(hot) and len(v):
            known = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
            salt[known] = 1 + (at[known] >> 32) % _SALTS
        return pa.RecordBatch.from_arrays([pa.array(v), batch.column(0).take(pa.array(who)), pa.array(at), pa.array(span), pa.array(salt)], ["v", "doc_id", "at", "span", "salt"])

    return map_slices(docs.select("doc_id", "text", "mark"), run, "v long, doc_id long, at long, span long, salt long")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for (_, t), x in zip(fields, zip(*rows, strict=True), strict=True)], [n for n, _ in fields])


def frequent_hashes(docs: DataFrame, **how) -> np.ndarray:
    """The min-hashes, ascending, that the windows of one in SAMPLE documents show to be frequent: MOST_FREQUENT at most reach the driver."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SAMPLE)) == 0)
    counted = windows(some, **how).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r["v"] for r in counted.orderBy(F.desc("n"), "v").limit(MOST_FREQUENT).collect()], np.int64))


def shared_windows(docs: DataFrame, firsts: DataFrame, **how) -> DataFrame:
    """(doc_id, mark, seeds) of the documents among firsts (doc_id, mark) with windows whose min-hash another text has too; a seed is
    (v, at, span, chunks). A frequent min-hash has such a text for certain; the others are grouped by it."""
    from pyspark.sql import Window as W

    group, mark = W.partitionBy("v", "salt"), F.shiftright("at", 32)
    found = windows(docs, frequent=frequent_hashes(docs, **how), **how).withColumns({"low": F.min(mark).over(group), "high": F.max(mark).over(group)})
    found = found.filter("salt > 0 or low < high").select("v", "doc_id", mark.alias("mark"), F.col("at").bitwiseAND(F.lit(_MASK)).alias("at"), "span")
    found = shared_table(found.join(firsts, ["doc_id", "mark"], "left_semi"), "live-windows")
    many = found.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("v", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    many = shared_table(many, "many-windows")
    if many.limit(MOST_FREQUENT + 1).count() <= MOST_FREQUENT:  # sent whole only within this size; else joined by a shuffle
        many = F.broadcast(many)
    dealt = found.join(many, "v", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # Seeds of a document: as many as it has windows.
    return dealt.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("v", "at", "span", "chunks")).alias("seeds"))


def _repeated(base: np.ndarray) -> np.ndarray | None:
    """Which shingles of a text it has at another place too; None if all differ."""
    by = base.argsort()
    again = base[by[1:]] == base[by[:-1]]
    if not again.any():
        return None
    out = np.zeros(len(base), bool)
    out[by[1:][again]] = out[by[:-1][again]] = True
    return out


_ONE = [(0, 0, 0)]


def _dealt(doc: int, chunks: int) -> list[tuple[int, int, int]]:
    """(block_a, block_b, chunk): the pairs of chunks that a document's row is in, so that every two rows meet."""
    if chunks < 2:
        return _ONE
    own = int(mixed(np.array([doc & 0xFFFFFFFFFFFFFFFF], np.uint64), 99)[0] % np.uint64(chunks))
    return [(min(own, k), max(own, k), own) for k in range(chunks)]


def _search(hit: np.ndarray, low: np.ndarray, high: np.ndarray, i: int, similarity: float, least: int, any_: bool) -> list[tuple[int, int, int, int]]:
    """Intervals (s, e, t, f) from the start to the end of runs of hits on either side of i, most hits less a quarter of the misses first; t and f from the
    least and greatest place of the hits between. Those that fall short of the similarity are left out, unless any_."""
    wide = np.zeros(len(hit) + 2, bool)
    wide[1:-1] = hit
    turns = (wide[1:] != wide[:-1]).nonzero()[0]
    starts, stops = turns[::2], turns[1::2] - 1
    k = int(starts.searchsorted(i, "right")) - 1
    starts, stops = starts[: k + 1], stops[k:]
    # low and high are cumulative outwards from i; runs are few, so lists are faster than tables
    total = hit.cumsum()
    left = list(zip(starts.tolist(), low[starts].tolist(), high[starts].tolist(), (total[starts] - 1).tolist(), strict=True))
    right = list(zip((stops + 1).tolist(), low[stops].tolist(), high[stops].tolist(), total[stops].tolist(), strict=True))
    less, found = (1 - similarity) / similarity, []
    for s, low_, high_, before in left:
        for e, low__, high__, until in right:
            t, f, h, n = min(low_, low__), max(high_, high__) + 1, until - before, e - s
            if any_ or h >= similarity * (max(n, least) + max(f - t, least) - h) - 1e-9:
                found.append((less * (n - h) - h, s, e, t, f))
    return [x[1:] for x in sorted(found)]


def _stretched(s: int, e: int, n: int, least: int) -> tuple[int, int]:
    """[s, e) of n made `least` long, to the right first."""
    e = min(n, max(e, s + least))
    return max(0, min(s, e - least)), e


def _placed(a: np.ndarray, order: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which shingles of a another text has, where it has them), from the other text's order and sorted shingles."""
    k = sorted_.searchsorted(a)
    return sorted_.take(k, mode="clip") == a, order.take(k, mode="clip")


def _in_order(a: np.ndarray, b: np.ndarray, hit: np.ndarray, place: np.ndarray, i: int, similarity: float, least: int):
    """grown for texts without repeated shingles, whose common shingles stand in the same order; False if they do not."""
    at = hit.nonzero()[0]
    there = place[at]
    if (there[1:] <= there[:-1]).any():
        return False
    # Both steps are 1 or more: a run goes on where both are 1.
    both = at + there
    cuts = (both[1:] - both[:-1] != 2).nonzero()[0].tolist()
    at, there = at.tolist(), there.tolist()
    first = [0, *(x + 1 for x in cuts)]
    last = [*first[1:], len(at)]
    s, t = [at[x] for x in first], [there[x] for x in first]
    e, f = [at[x - 1] + 1 for x in last], [there[x - 1] + 1 for x in last]
    k = bisect_right(s, i) - 1
    found = []
    for p in range(k + 1):
        a_, b_, c_ = s[p], t[p], first[p]
        for q in range(k, len(s)):
            n, m, h = e[q] - a_, f[q] - b_, last[q] - c_
            if h >= similarity * ((n if n > least else least) + (m if m > least else least) - h) - 1e-9:
                found.append(((n - h) * (1 - similarity) / similarity - h, p, q))
    for _, p, q in sorted(found):
        n, m, h = e[q] - s[p], f[q] - t[p], last[q] - first[p]
        if min(n, m) >= least:
            return s[p], e[q], t[p], f[q], h / (n + m - h)
        own, other = _stretched(s[p], e[q], len(a), least), _stretched(t[p], f[q], len(b), least)
        x, y = set(a[slice(*own)].tolist()), set(b[slice(*other)].tolist())
        both = len(x & y)
        if both >= similarity * (len(x) + len(y) - both):
            return *own, *other, both / (len(x) + len(y) - both)
    return None


class _Ordered:
    """What is asked of a row's shingles again and again: their places in order of them, these in order, and whether none repeats."""

    def __init__(self, body: np.ndarray) -> None:
        self.by = body.argsort(kind="stable")
        self.sorted = body[self.by]
        self.once = not (self.sorted[1:] == self.sorted[:-1]).any()
        self._body, self._list, self._ranks = body, None, None

    @property
    def list(self) -> list[int]:
        if self._list is None:
            self._list = self._body.tolist()
        return self._list

    @property
    def ranks(self) -> np.ndarray:
        """Of the shingles in order: where their equals begin and their own place, in one ascending number."""
        if self._ranks is None:
            self._ranks = self.sorted.searchsorted(self.sorted) * len(self.sorted) + self.by
        return self._ranks


def grown(a: np.ndarray, b: np.ndarray, i: int, j: int, similarity: float, least: int, of_a: _Ordered | None = None, of_b: _Ordered | None = None) -> tuple[int, int, int, int, float] | None:
    """The passages of a and b (shingle hashes) around the equal places i and j, of `least` or more: (start, end, start, end, Jaccard), ends
    exclusive; None if no interval around them is similar. Of the similar ones, that with the most hits (shingles the other side has) less
    a quarter of the misses is taken: first with hits in the same order on both sides, then in any order."""
    if i >= len(a) or j >= len(b) or a[i] != b[j] or len(a) < least or len(b) < least:
        return None
    of_a, of_b = of_a or _Ordered(a), of_b or _Ordered(b)
    order, size = of_b.by, len(b)
    left, right = of_b.sorted.searchsorted(a), of_b.sorted.searchsorted(a, "right")
    hit = right > left
    # Of equal shingles, the one nearest to the diagonal: the first of them from there on, or the one before it.
    diagonal = np.arange(j - i, j - i + len(a))
    spot = of_b.ranks.searchsorted(left * size + np.minimum(np.maximum(diagonal, 0), size - 1))
    last = np.maximum(right - 1, left)
    lower, upper = order[np.minimum(np.maximum(spot - 1, left), last) % size], order[np.minimum(np.maximum(spot, left), last) % size]
    place = np.where(np.abs(lower - diagonal) <= np.abs(upper - diagonal), lower, upper)
    place[~hit] = j
    place[i] = j
    ordered = hit.copy()
    ordered[:i] &= place[:i] < j
    ordered[i + 1 :] &= place[i + 1 :] > j
    for some in (ordered, hit):
        at_place = np.where(some, place, j)
        low, high = np.empty_like(place), np.empty_like(place)
        for out, best in ((low, np.minimum), (high, np.maximum)):
            best.accumulate(at_place[i::-1], out=out[i::-1])
            best.accumulate(at_place[i:], out=out[i:])
        for s, e, t, f in _search(some, low, high, i, similarity, least, not (of_a.once and of_b.once)):
            s, e = _stretched(s, e, len(a), least)
            t, f = _stretched(t, f, size, least)
            x, y = set(of_a.list[s:e]), set(of_b.list[t:f])
            both = len(x & y)
            index = both / (len(x) + len(y) - both)
            if index >= similarity:
                return s, e, t, f, index
        if (some == hit).all():
            break
    return None


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]


_BODY = "v long, block_a int, block_b int, chunk int, doc_id long, mark long, lo long, places binary, body binary"


def _fewest(body: np.ndarray, least: int) -> int:
    """The fewest distinct shingles of `least` or more neighbours."""
    by = body.argsort(kind="stable")
    again = np.flatnonzero(body[by[1:]] == body[by[:-1]])
    late, early = by[again + 1], by[again]
    near = late - early < least
    # A shingle counts less in every run of neighbours that holds it and the one before it.
    less = np.zeros(len(body) + 1, np.int64)
    np.add.at(less, np.maximum(late[near] - least + 1, 0), 1)
    np.add.at(less, early[near] + 1, -1)
    return least - int(np.cumsum(less)[: len(body) - least + 1].max())


def _parts(live: list[tuple], bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(number of a shingle that two rows or more hold, else -1, of all bodies end to end; the cells row * shingles + number; distinct
    shingles a row; the table of rows by shingles, None if that is too large)."""
    n, sizes = len(bodies), np.array([len(b) for b in bodies])
    # Shingles in order, and of equal ones by place: so each shingle's rows are in order too.
    packed = np.concatenate(bodies).astype(np.uint64) << np.uint64(32) | np.arange(sizes.sum(), dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64(_MASK)).astype(np.int64)
    packed >>= np.uint64(32)
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    number = np.cumsum(new) - 1
    ids = np.empty_like(number)
    ids[at] = number
    holders = np.repeat(np.arange(n), sizes)[at]
    new[1:] |= holders[1:] != holders[:-1]  # each shingle once a row
    of, holders = number[new], holders[new]
    distinct = np.bincount(holders, minlength=n)
    common = np.bincount(of) > 1
    number = np.where(common, np.cumsum(common) - 1, -1)
    kept, k = common[of], int(common.sum())
    of, holders = number[of[kept]], holders[kept]
    table = None
    if n * (k + 1) <= _DENSE:
        table = np.zeros((n, k + 1), np.float32)  # the last column stays empty
        table[holders, of] = 1
    return number[ids], of * n + holders, distinct, table


class _Bound:
    """Whether a row of distinct shingles can have a similar passage around place c with each of several rows, given which of its
    shingles they have (a table of 0 and 1): of an interval of n shingles, h of them hits, similarity * n are to be hits, since the
    union has n at least, and (1 + 1 / similarity) * h is to be n + least at least, since the other side has `least`."""

    def __init__(self, hit: np.ndarray, c: int, least: int, similarity: float) -> None:
        self.c, self.least, self.length = c, least, hit.shape[1]
        total = np.zeros((len(hit), self.length + 1), np.float32)
        np.cumsum(hit, axis=1, out=total[:, 1:])
        n = np.arange(self.length + 1, dtype=np.float32)
        self.sums = []
        for a, b, floor in ((1.0, similarity, 0.0), (1 + 1 / similarity, 1.0, least)):
            x = total * np.float32(a)
            x -= n * np.float32(b)
            # The least sum up to each place that an interval with c may start at.
            self.sums.append((x, np.minimum.accumulate(x[:, : c + 1], axis=1), floor - 1e-3))

    def some(self, rest: np.ndarray | None = None) -> np.ndarray:
        """For each row whether there may be such an interval, with one of the places of rest at least."""
        c, least, ok = self.c, self.least, None
        if rest is None or rest[c]:
            ways = [(c, c)]
        else:
            left, right = rest[:c].nonzero()[0], rest[c:].nonzero()[0]
            ways = ([(int(left[-1]), c)] if len(left) else []) + ([(c, c + int(right[0]))] if len(right) else [])
        for s, e in ways:  # the interval starts at s or before it and holds e
            begin, end = max(e + 1, least), self.length + 1
            if begin < end:
                # Up to `until` an interval that stops there starts `least` before that at the latest, then at s.
                until, good = min(max(begin, s + least), end), True
                for x, lows, floor in self.sums:
                    best = (x[:, begin:until] - lows[:, begin - least : until - least]).max(1, initial=-np.inf)
                    if until < end:
                        best = np.maximum(best, x[:, until:].max(1) - lows[:, s])
                    good &= best >= floor
                ok = good if ok is None else ok | good
        return np.zeros(len(self.sums[0][0]), bool) if ok is None else ok


class _Spans:
    """The passages that _in_order finds, for many pairs of rows at once. Rows have one place c each and no shingle twice; numbered gives
    their shingles' numbers in a table of rows with c above each other; from before a row's c to `after` from it on there are shingles."""

    def __init__(self, numbered: np.ndarray, before: np.ndarray, after: np.ndarray, numbers: int, least: int, similarity: float) -> None:
        self.numbered, self.before, self.after, self.least, self.similarity = numbered, before, after, least, similarity
        self.ahead, self.none = int(before.max()), np.int16(np.iinfo(np.int16).max)
        rows, self.width = numbered.shape
        # Where each row has each shingle, from its c on. The last number is for shingles that no other row has.
        self.place = np.full((rows, numbers + 1), self.none, np.int16)
        self.place[np.arange(rows)[:, None], numbered] = np.arange(self.width, dtype=np.int16) - np.int16(self.ahead)
        self.place[:, numbers] = self.none

    def __call__(self, of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """(start, end) in rows `of`, from c on, of the passage that each has with the row `to`; equal if none, and everything where that is
        to be looked at pair by pair: common shingles in another order, or a passage that is similar by a hair only."""
        step = max(1, _CELLS // self.width)
        return np.concatenate([np.zeros((2, 0), np.int64), *(self._some(of[at : at + step], to[at : at + step]) for at in range(0, len(of), step))], axis=1)

    def _some(self, of: np.ndarray, to: np.ndarray) -> np.ndarray:
        c, out = self.ahead, np.array([[-_FAR], [_FAR]]).repeat(len(of), 1)
        there = self.place[to[:, None], self.numbered[of]]
        hit = there != self.none
        # Of the hits in order, each is beyond those before it.
        top = np.maximum.accumulate(np.where(hit, there, -self.none), axis=1)
        in_order = ~(hit[:, 1:] & (there[:, 1:] <= top[:, :-1])).any(1) & (there[:, c] == 0)
        some = in_order.nonzero()[0]
        if not len(some):
            return out
        if len(some) < len(of):
            there, hit = there[some], hit[some]
        goes_on = hit[:, 1:] & hit[:, :-1] & (there[:, 1:] - there[:, :-1] == 1)
        start, stop = hit[:, : c + 1].copy(), hit[:, c:].copy()
        start[:, 1:] &= ~goes_on[:, :c]
        stop[:, :-1] &= ~goes_on[:, c:]
        until = np.cumsum(hit, axis=1, dtype=np.int16)
        sides = []
        for runs, by, beyond in ((start, 0, 0), (stop, c, 1)):
            row, at = runs.nonzero()
            at += by
            many = np.bincount(row, minlength=len(some))
            sides.append((many, np.arange(len(row)) - (np.cumsum(many) - many)[row], row, np.stack([at + beyond, there[row, at].astype(np.int64) + beyond, until[row, at].astype(np.int64) - 1 + beyond])))
        # Rows of many runs by themselves, so that the table of runs by runs stays small.
        most = np.maximum(sides[0][0], sides[1][0])
        for low, high in ((0, 4), (4, 12), (12, self.width)):
            these = ((most > low) & (most <= high)).nonzero()[0]
            step = max(1, _CELLS // (high * high))
            for k in range(0, len(these), step):
                self._best(of, some, these[k : k + step], sides, out)
        return out

    def _best(self, of: np.ndarray, some: np.ndarray, these: np.ndarray, sides: list[tuple], out: np.ndarray) -> None:
        least, similarity, rank = self.least, self.similarity, np.full(len(some), -1)
        rank[these] = np.arange(len(these))
        ends = []
        for many, nth, row, values in sides:
            table = np.full((3, len(these), int(many[these].max())), np.nan)
            own = rank[row] >= 0
            table[:, rank[row[own]], nth[own]] = values[:, own]
            ends.append(table)
        n, m, h = ends[1][:, :, None, :] - ends[0][:, :, :, None]
        both = np.maximum(n, least) + np.maximum(m, least)
        ok = h >= similarity * (both - h) - 1e-9
        score = np.where(ok, (n - h) * (1 - similarity) / similarity - h, np.inf).reshape(len(these), -1)
        k, every = score.argmin(1), np.arange(len(these))
        p, q = np.divmod(k, ends[1].shape[2])
        s, e = ends[0][0][every, p] - self.ahead, ends[1][0][every, q] - self.ahead
        row = of[some[these]]
        long_ = np.minimum(n[every, p, q], m[every, p, q]) >= least
        sure = long_ | (h[every, p, q] > similarity * (both[every, p, q] - h[every, p, q]) + 1e-6)
        # As _stretched does.
        f = np.where(long_, e, np.minimum(self.after[row], np.maximum(e, s + least)))
        s = np.where(long_, s, np.maximum(-self.before[row], np.minimum(s, f - least)))
        none = np.isinf(score[every, k])
        at = some[these]
        out[0, at] = np.where(none, 0, np.where(sure, s, -_FAR))
        out[1, at] = np.where(none, 0, np.where(sure, f, _FAR))


def compared(rows: list[tuple], least: int, width: int, similarity: float, links: bool = True) -> list[tuple]:
    """Passages between windows of one min-hash, rows (chunk, doc_id, mark, lo, places, body) in order of doc_id. Each row is compared with
    every row of an earlier document that could add words to what was found for it and, if links, with every one that it is not yet
    linked to, be it by others: so that passages link all documents that similar ones do. With two chunks, with those of the other one.

    A row whose whole text an earlier one has is reported with that one alone, and is no other row's source: the earlier one is."""
    out: list[tuple] = []
    across = len({r[0] for r in rows}) > 1
    first: dict[tuple[bytes, bytes], tuple] = {}
    alike: dict[tuple, list[int]] = {}  # the places lo of a document's equal rows: one of them is compared
    live, twins = [], []
    for r in rows:
        held = first.setdefault((r[5], r[4]), r)
        if held[1] == r[1]:
            los = alike.setdefault((r[1], r[2], r[5], r[4]), [])
            if not los:
                live.append(r)
            los.append(r[3])
            continue
        twins.append((held[1], r[1]))
        if not across or held[0] != r[0]:
            n = len(r[5]) // 4 + width - 1
            out.append((r[1], r[2], r[3], r[3] + n, held[1], held[3], held[3] + n, 1.0))
    if len(live) < 2:
        return out
    bodies = [np.frombuffer(r[5], np.uint32) for r in live]
    places = [list(struct.iter_unpack("<3i", r[4])) for r in live]
    orders: dict[int, _Ordered] = {}
    fewest: dict[int, int] = {}

    def order(k: int) -> _Ordered:
        got = orders.get(k)
        if got is None:
            got = orders[k] = _Ordered(bodies[k])
        return got

    def few(k: int) -> int:
        if k not in fewest:
            fewest[k] = least if order(k).once else _fewest(bodies[k], least)
        return fewest[k]

    def need(k: int) -> int:
        """The fewest distinct shingles that a passage of row k shares with a similar one."""
        return max(1, math.ceil(similarity * few(k) - 1e-9))

    def periodic(k: int) -> set[int] | None:
        """The shingles of a row all of whose passages have them all."""
        if order(k).once or len(whole := set(order(k).list)) != few(k):
            return None
        return whole

    def pair(i: int, j: int, rest: np.ndarray, link: bool, enough: bool = False) -> bool:
        """Adds the passages of row i that row j has and that have words among rest or, if link, any one; whether there was any. Whether
        they share enough shingles for one is looked at here unless it is known."""
        a, b, r, s, new = bodies[i], bodies[j], live[i], live[j], False

        def add(got: tuple) -> bool:
            """Whether a passage is one of those; it is added then."""
            if not link and not rest[got[0] : got[1]].any():
                return False
            out.extend((r[1], r[2], lo + got[0], lo + got[1] + width - 1, s[1], s[3] + got[2], s[3] + got[3] + width - 1, got[4]) for lo in alike[r[1], r[2], r[5], r[4]])
            rest[got[0] : got[1]] = False
            return True

        roomy = [(p, q) for p in places[i] for q in places[j] if min(p[1], q[1]) + min(p[2], q[2]) + 1 >= least]
        for (c, _, _), (d, _, _) in roomy:  # most passages are equal: these need no search
            got = _equal_run(a, b, c, d, least)
            if got and add(got):
                new, link = True, False
        if not roomy or not link and not any(rest[c - left : c + right + 1].any() for c, left, right in places[i]):
            return new
        mine, its = order(i), order(j)
        hit, place = _placed(a, its.by, its.sorted)
        if not enough and (np.count_nonzero(hit) if mine.once else len(set(a[hit].tolist()))) < max(need(i), need(j)):
            return new
        once = mine.once and its.once
        x, y = (None, None) if once else (periodic(i), periodic(j))
        misses = 0 if once else len(set(a[hit].tolist())) * (1 - similarity) / similarity + 1e-9  # that a passage can have
        for (c, left, right), (d, _, _) in roomy:
            if not link and not (rest[c - left : c + right + 1] & hit[c - left : c + right + 1]).any():
                continue
            if x and y:  # whatever the interval, its shingles are these
                index = len(x & y) / len(x | y)
                if index < similarity:
                    return new
                got = 0, len(a), 0, len(b), index
            else:
                got = _in_order(a, b, hit, place, c, similarity, least) if once and place[c] == d else False
                if got is False:
                    if not once and not link and not rest[c] and all(len(set(a[k][~hit[k]].tolist())) > misses for k in _up_to(rest, c)):
                        continue
                    got = grown(a, b, c, d, similarity, least, mine, its)
            if got and add(got):
                new, link = True, False
        return new

    if len(live) == 2:
        if live[0][1] < live[1][1] and not (across and live[0][0] == live[1][0]):
            pair(1, 0, np.ones(len(bodies[1]), bool), links)
        return out
    ids, cells, distinct, table = _parts(live, bodies)
    n, ends = len(live), np.cumsum([len(b) for b in bodies])
    of, holders = np.divmod(cells, n)
    starts = np.searchsorted(of, np.arange(of[-1] + 2)) if len(of) else np.zeros(1, np.int64)
    chunk, doc = (np.array([r[k] for r in live]) for k in (0, 1))
    before, after = (np.array([max(x[k] for x in p) for p in places]) for k in (1, 2))
    needs = np.array([need(k) if distinct[k] < len(bodies[k]) else max(1, math.ceil(similarity * least - 1e-9)) for k in range(n)])

    def shared(some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of some shingles each of rows has."""
        if table is not None:
            return table[np.ix_(rows, some)].sum(1)
        return np.bincount(np.concatenate([holders[starts[k] : starts[k + 1]] for k in some.tolist()]), minlength=n)[rows] if len(some) else np.zeros(len(rows))

    # Documents that passages link have one number; those of equal rows are linked already.
    group = np.unique(doc, return_inverse=True)[1]
    if links and twins:
        at = dict(zip(doc.tolist(), range(n), strict=True))
        for x, y in twins:
            if x in at and y in at and group[at[x]] != group[at[y]]:
                group[group == group[at[y]]] = group[at[x]]
    everyone = np.arange(n)
    single = (distinct == [len(b) for b in bodies]) & np.array([len(p) == 1 for p in places])
    at_ = np.array([p[0][0] for p in places])
    if table is not None:
        # The rows' shingles with places c above each other; a last column of the table is for those that no other row has.
        sizes = ends - np.concatenate([[0], ends[:-1]])
        ahead, width_ = int(at_.max()), int((sizes - at_).max())
        laid = np.full((n, ahead + width_), table.shape[1] - 1, np.int32)
        row = np.repeat(everyone, [len(b) for b in bodies])
        laid[row, np.arange(len(ids)) - (ends - [len(b) for b in bodies])[row] - at_[row] + ahead] = ids
    spans_: list[_Spans] = []

    def spans(of: np.ndarray, to: np.ndarray) -> np.ndarray:
        if not spans_:
            spans_.append(_Spans(np.where(single[:, None], laid, np.int32(table.shape[1] - 1)), at_, sizes - at_, table.shape[1] - 1, least, similarity))
        return spans_[0](of, to)

    until = doc.searchsorted(doc).tolist()  # the earlier documents' rows
    step = max(1, _CELLS // n)
    for begin in range(0, n, step):
        gains = table[begin : begin + step] @ table.T if table is not None else None
        early = None
        if table is not None and _MANY < n <= _FEW:
            of_, to = np.nonzero(gains >= np.maximum(needs, needs[begin : begin + step, None]))
            of_ += begin
            ask = (doc[to] < doc[of_]) & single[of_] & single[to]
            if np.count_nonzero(ask) > 2 * n:  # many a row: all are looked at together
                of_, to = of_[ask], to[ask]
                early = np.array([-_FAR, _FAR])[:, None, None].repeat(len(gains), 1).repeat(n, 2)
                early[:, of_ - begin, to] = spans(of_, to)
        for i in range(begin, min(n, begin + step)):
            own = ids[ends[i] - len(bodies[i]) : ends[i]]
            gain = gains[i - begin] if gains is not None else shared(np.unique(own[own >= 0]), everyone)
            # Rows are in order of doc_id.
            js = (gain[: until[i]] >= np.maximum(needs[: until[i]], needs[i])).nonzero()[0]
            js = js[np.minimum(before[js], before[i]) + np.minimum(after[js], after[i]) + 1 >= least]
            if across:
                js = js[chunk[js] != chunk[i]]
            if not len(js):
                continue
            gain = gain[js]
            # The places that passages with each row lie between, as far as known.
            between = np.array([[-_FAR], [_FAR]]).repeat(len(js), 1) if early is None else early[:, i - begin, js]
            open_ = between[0] < between[1]
            if not open_.any():
                continue
            rest, sifted = np.ones(len(own), bool), False
            within = np.zeros(len(own), bool)  # words beyond the windows' intervals have other min-hashes
            for c, left, right in places[i]:
                within[c - left : c + right + 1] = True
            while open_.any():
                k = int(np.where(open_, gain, -1).argmax())
                j, open_[k] = int(js[k]), False
                if pair(i, j, rest, links and bool(group[i] != group[j]), True):
                    if links and group[i] != group[j]:
                        group[group == group[j]] = group[i]
                    stays, sifted = group[js] != group[i] if links else np.zeros(len(js), bool), False
                    if (rest & within).any():
                        some = own[rest & within]
                        gain = shared(np.unique(some[some >= 0]), js)
                        stays |= gain > 0
                    left_out = np.concatenate([[0], rest.cumsum()])
                    s, e = (between + at_[i]).clip(0, len(own))
                    stays &= left_out[s] < left_out[e]
                    if links:
                        stays |= group[js] != group[i]
                    open_ &= stays
                elif not sifted and table is not None and single[i]:
                    sifted = True  # the best one fails: most others do, and are told by the bounds
                    left = (open_ & (between[1] == _FAR)).nonzero()[0]
                    for at in range(0, len(left), _ROWS):
                        part = left[at : at + _ROWS]
                        to = js[part]
                        bound = _Bound(table[to[:, None], own], int(at_[i]), least, similarity)
                        ok = bound.some(rest & within)
                        if links and not rest.all():
                            ok |= bound.some() & (group[to] != group[i])
                        open_[part] = ok
                    left = left[open_[left] & single[js[left]]]
                    if len(left) >= _MANY:
                        between[:, left] = spans(np.full(len(left), i), js[left])
                        s, e = (between[:, left] + at_[i]).clip(0, len(own))
                        left_out = np.concatenate([[0], rest.cumsum()])
                        ok = left_out[s] < left_out[e]
                        if links:
                            ok |= (group[js[left]] != group[i]) & (between[0, left] < between[1, left])
                        open_[left] = ok
    return out


def _up_to(rest: np.ndarray, c: int) -> list[slice]:
    """From place c to the nearest one of rest on either side."""
    left, right = rest[:c].nonzero()[0], rest[c:].nonzero()[0]
    return ([slice(int(left[-1]), c + 1)] if len(left) else []) + ([slice(c, c + int(right[0]) + 1)] if len(right) else [])


def _equal_run(a: np.ndarray, b: np.ndarray, i: int, j: int, least: int) -> tuple[int, int, int, int, float] | None:
    """The run of equal shingles around the equal places i and j, if it is of `least` or more."""
    x, y = min(i, j), min(len(a) - i, len(b) - j)
    off = (a[i - x : i + y] != b[j - x : j + y]).nonzero()[0]
    k = int(off.searchsorted(x)) if len(off) else 0
    s, e = (int(off[k - 1]) + 1 if k else 0), (int(off[k]) if k < len(off) else x + y)
    if not s <= x < e or e - s < least:
        return None
    return i - x + s, i - x + e, j - x + s, j - x + e, 1.0


_PASSAGE = "doc_id long, mark long, start long, end long, source_id long, source_start long, source_end long, similarity double"


def _blocks(least: int, width: int, similarity: float, links: bool):
    """Rows of _BODY sorted by (v, block_a, block_b, doc_id, lo) -> passages; holds one block at a time. Most blocks have a few rows and
    passages, so passages are handed on some OUT_ROWS at a time: a batch costs as much as the comparison of a small block."""

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if n == "similarity" else pa.int64()) for n, x in zip(_names(_PASSAGE), zip(*found, strict=True), strict=True)], _names(_PASSAGE))

    def run(batches):
        key, held, found = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for v, a, b, *r in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                    if (v, a, b) != key:
                        if len(held) > 1 and held[0][1] != held[-1][1]:
                            found += compared(held, least, width, similarity, links)
                        key, held = (v, a, b), []
                        if len(found) >= OUT_ROWS:
                            yield batch_of(found)
                            found = []
                    held.append(tuple(r))
        if len(held) > 1 and held[0][1] != held[-1][1]:
            found += compared(held, least, width, similarity, links)
        if found:
            yield batch_of(found)

    return run


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, source_start, source_end, similarity) of a document and a source, in order. Equal passages that overlap, at one
    distance from the source, become one, which is equal too; of the others those inside another go."""
    kept: list[list] = []
    at: dict[int, list] = {}
    for s in sorted(s for s in spans if s[4] == 1.0 and s[1] - s[0] == s[3] - s[2]):
        k = at.get(s[2] - s[0])
        if k and s[0] <= k[1]:
            k[1], k[3] = max(k[1], s[1]), max(k[3], s[3])
        else:
            at[s[2] - s[0]] = list(s)
            kept.append(at[s[2] - s[0]])
    out: list[tuple] = []
    rest = [s for s in spans if s[4] < 1.0 or s[1] - s[0] != s[3] - s[2]]
    for s in sorted([*map(tuple, kept), *rest], key=lambda s: (s[0], -s[1], -s[4], s[2])):
        if not out or s[1] > out[-1][1]:
            out.append(s)
    return out


def _spans(rows: DataFrame, hashes: int, width: int, passage: int, similarity: float, reach: int, links: bool) -> DataFrame:
    """passages of rows (doc_id, text, mark), with the mark of the document's text, without components. Unless links, only those that a
    document's words are found by."""
    least = passage - width + 1
    texts = rows.select("doc_id", "mark", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.octet_length("text").alias("bytes"))
    texts = shared_table(texts.filter(F.col("bytes") >= 2 * passage - 1), "texts")
    # Equal texts: a hash, a checksum and the length agree. Only the least id of each is compared with other texts.
    classes = shared_table(texts.groupBy("h", "crc", "bytes").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("mark").alias("mark")), "classes")
    firsts = classes.select(F.col("first").alias("doc_id"), "mark").distinct()
    copies = texts.join(classes.filter("first < last").select("h", "crc", "bytes", "first"), ["h", "crc", "bytes"]).filter(F.col("doc_id") > F.col("first"))
    copies = shared_table(copies.select("doc_id", "mark", "first").distinct(), "copies")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(t.encode().split()) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "mark", "n"])

    whole = map_slices(split_by_ids(rows, "doc_id", copies.select("doc_id"))[0].select("doc_id", "mark", "text"), counted, "doc_id long, mark long, n long")
    copies = whole.filter(F.col("n") >= passage).distinct().join(copies, ["doc_id", "mark"])
    copies = copies.select("doc_id", "mark", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("first").alias("source_id"), F.lit(0).cast("long").alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("similarity"))

    seeds = shared_table(shared_windows(rows, firsts, hashes=hashes, width=width, passage=passage, reach=reach), "seeds")
    involved, _ = split_by_ids(rows, "doc_id", seeds.select("doc_id"))
    own = seeds.join(involved.select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"]), ["doc_id", "mark"]).select("doc_id", "mark", "seeds", "text")

    def bodies(batches):
        out = []
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            hashed, words = shingle_hashes(_texts(batch.column(3)), width)
            ends, docs, marks = np.cumsum(words).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seeds, fields = batch.column(2), [f.to_numpy() for f in batch.column(2).flatten().flatten()]
            cuts = np.cumsum([0, *seeds.value_lengths().to_pylist()]).tolist()
            for k, (doc, mark) in enumerate(zip(docs, marks, strict=True)):
                base = hashed[ends[k] - int(words[k]) : max(ends[k] - width + 1, ends[k] - int(words[k]))]
                raw, again = base.astype("<u4").tobytes(), _repeated(base)  # the low 32 bits
                # A min-hash, place and span once, in order, so that a rerun gives the same rows.
                for v, c, around, chunks in sorted(set(zip(*(f[cuts[k] : cuts[k + 1]].tolist() for f in fields), strict=True))):
                    left, right = c - (around >> 16), c + (around & 0xFFFF)
                    lo, spots = max(0, left - SLACK), (c,)
                    if again is not None and again[c]:  # equal places from NEAR_PLACES on have windows of their own
                        same = np.flatnonzero(base[c : min(right + 1, c + NEAR_PLACES)] == base[c]) + c
                        spots = same[spread(same, base[same], SLACK)].tolist()
                    spots = b"".join([struct.pack("<3i", x - lo, x - left, right - x) for x in spots])
                    for a, b, part in _dealt(doc, chunks) if chunks > 1 else _ONE:
                        out.append((v, a, b, part, doc, mark, lo, spots, raw[4 * lo : 4 * (right + SLACK + 1)]))
                    if len(out) >= SLICE_ROWS:
                        yield _batch(out, _BODY)
                        out = []
        if out:
            yield _batch(out, _BODY)

    dealt = own.mapInArrow(bodies, _BODY).repartition("v", "block_a", "block_b").sortWithinPartitions("v", "block_a", "block_b", "doc_id", "lo")
    # Spans of a pair: as many as a document has windows.
    span = F.struct("start", "end", "source_start", "source_end", "similarity")
    by_pair = dealt.mapInArrow(_blocks(least, width, similarity, links), _PASSAGE).groupBy("doc_id", "mark", "source_id").agg(F.collect_set(span).alias("spans"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, column = [], batch.column(3)
        spans = list(zip(*(f.to_numpy().tolist() for f in column.flatten().flatten()), strict=True))
        ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
        for doc, mark, source, begin, end in zip(*(c.to_pylist() for c in batch.columns[:3]), [0, *ends[:-1]], ends, strict=True):
            out += [(doc, mark, *s[:2], source, *s[2:]) for s in _joined(spans[begin:end])]
        return _batch(out, _PASSAGE) if out else None

    return map_slices(by_pair, joined, _PASSAGE).union(copies.select(*_names(_PASSAGE)))


def _mark(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).bitwiseAND(F.lit(0x7FFFFFFF))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id is not null and text is not null")
    return rows.withColumn("mark", _mark(F.col("text")))


def passages(docs: DataFrame, hashes: int = HASHES, width: int = WIDTH, passage: int = PASSAGE, similarity: float = SIMILARITY, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, source_id, source_start, source_end, similarity, component_id): words [start, end) of a document whose word
    shingles have at least this Jaccard similarity with words of an earlier document (a smaller doc_id), both of `passage` words or more.
    A passage of more than about `reach` words may be reported as several that overlap; equal ones are put together.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A passage is reported with one earlier document that has it,
    with others where these have more of the words around it, and with any that no other row links the document to: so component_id,
    the least id that similar passages lead to from either document, is what all pairs would give, and no link between different texts
    is lost. Ids must be integers; rows with a null id or text, and rows that share their id, are not compared with each other; texts
    shorter than a passage have none; an empty table gives none; other columns are ignored."""
    found = shared_table(_spans(_marked(docs, id_col, text_col), hashes, width, passage, similarity, reach, True).drop("mark"), "passages")
    return found.join(connected(found.select("doc_id", "source_id")).toDF("doc_id", "component_id"), "doc_id")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans [start, end), each with the white space after it."""
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, done = [], 0
    for start, end in sorted(spans):
        a, b = at[min(start, len(at) - 1)], at[min(end, len(at) - 1)]
        if b > done:
            out.append(raw[done : max(a, done)])
            done = b
    return b"".join([*out, raw[done:]]).decode()


def cut_repeats(docs: DataFrame, hashes: int = HASHES, width: int = WIDTH, passage: int = PASSAGE, similarity: float = SIMILARITY, reach: int = REACH) -> DataFrame:
    """docs, columns unchanged, with every passage that an earlier document has cut out of the text, and n_chars set anew where there is one.

    The earliest document keeps the passage. Rows keep their place even if no word is left; rows with null ids or texts stay as they are.
    Rows that share an id are each cut by what their own text repeats; repeated rows are cut alike; an empty table gives none."""
    found = _spans(_marked(docs, "doc_id", "text"), hashes, width, passage, similarity, reach, False)
    spans = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # as many as a document has windows
    spans = shared_table(spans.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "spans"), "spans")

    @F.pandas_udf("string")
    def cleaned(texts, spans):
        import pandas as pd

        return pd.Series([without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    # The input's columns travel as one, so that none of their names can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    touched, others = split_by_ids(rows, "id", spans.select("id"))
    touched = touched.select("row", F.col("id").alias("own"), _mark(F.col("row.text")).alias("mark"))
    joined = touched.join(spans, (touched["own"] == spans["id"]) & (touched["mark"] == spans["of"]), "left")
    same, changed = joined.filter("spans is null").select("row.*"), joined.filter("spans is not null")
    columns = []
    for f in docs.schema.fields:
        if f.name == "text":
            columns.append(F.col("cut").cast(f.dataType).alias("text"))
        elif f.name == "n_chars":
            columns.append(F.length("cut").cast(f.dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{f.name}`"))
    changed = changed.withColumn("cut", cleaned(F.col("row.text").cast("string"), F.col("spans"))).select(*columns)
    return changed.union(same).union(others.select("row.*"))
