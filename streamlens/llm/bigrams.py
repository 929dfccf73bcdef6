"""The language model over all bigrams: a restaurant for every previous word, in which every word is a dish of its own.

The context restaurants share a parent that serves every word, with a uniform base over all words and one unknown. Tables are seated
by `seat`, sweep after sweep, as in `fit_contexts` on the full table of contexts and words. Nothing is pooled: `lookup`, `contexts` and
`dishes` only say which words and cells are broadcast; the rest of the same model is dealt out by hash. A cell is

- of two words of the lookup: dealt by both words, so that no frequent word gathers in one task;
- of one or two other words: dealt by the other word (of two, by the dish), of which there are at most as many as of the last in the lookup.

Tokens travel as compressed blocks, one a chunk of documents and bucket; buckets grow in number with the input, not in size. What is
known of the other words (customers, tables of every kept sweep) is dealt to the same buckets. A cell that occurs once has one table in
every sweep, so only those that occur twice or more are seated, and only their words' tables change. In scoring, tokens of the `contexts`
by `dishes` most frequent cells are looked up at once, so the commonest bigrams never travel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_ROWS, hash_bucket, id_text, shared_table
from .language_model import BURN_IN, END, FOLDS, HELD_OUT, LOOKUP, STRENGTH, SWEEPS, Codes, discount, frequent, raw_texts, seat, unigrams, word_hash
from .substrings import word_hashes

#: Keys of words outside the lookup have this bit and the lower bits of their hash; those of the lookup are ranks of CODE_BITS bits.
OTHER = 1 << 62
#: Upper bits of a hash by which a word of the lookup is found at once; those that an earlier one keeps from its place are searched for.
SPOT_BITS = 20
CODE_BITS, DOC_BITS, BUCKET_BITS = 17, 14, 15
#: Cells that are broadcast for scoring.
CONTEXTS, DISHES = 256, 8192
#: Tokens of a chunk of documents, and of a bucket.
CHUNK, BUCKET = 1_000_000, 2_000_000
KEPT = SWEEPS - BURN_IN
#: Words of the lookup whose tables are added up together.
PART = 8192
#: Cells whose probabilities are worked out at a time: what they need of every kept sweep is held for these alone.
CELLS = 65_536


class Keys(Codes):
    """Keys of words: ranks in the lookup, or hashes."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.keys(np.array([word_hash(w) for w in words], np.int64).view(np.uint64))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of words by their hashes."""
        if self.of is None:
            self.of = self._spots()
        spots, own, late, codes = self.of
        out = ((h & np.uint64(OTHER - 1)) | np.uint64(OTHER)).view(np.int64)
        if len(own):
            code = spots.take((h >> np.uint64(64 - SPOT_BITS)).astype(np.int64))
            same = own.take(code, mode="clip") == h
            same &= code >= 0
            np.copyto(out, code, where=same)
            rest = np.flatnonzero((code >= 0) & ~same)
            if len(late) and len(rest):
                at = np.minimum(late.searchsorted(h[rest]), len(late) - 1)
                hit = late[at] == h[rest]
                out[rest[hit]] = codes[at[hit]]
        return out

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all texts' words, each text's end after them; how many each text has)."""
        h, n = word_hashes(texts)
        out, ends = np.empty(len(h) + len(n), np.int64), np.cumsum(n + 1) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word], out[ends] = self.keys(h), self([END])[0]
        return out, n + 1

    def _spots(self) -> tuple[np.ndarray, ...]:
        own = self.hashes.view(np.uint64)
        spot, spots = (own >> np.uint64(64 - SPOT_BITS)).astype(np.int64), np.full(1 << SPOT_BITS, -1, np.int32)
        spots[spot[::-1]] = np.arange(len(own) - 1, -1, -1, dtype=np.int32)
        late = np.flatnonzero(spots[spot] != np.arange(len(own)))
        late = late[own[late].argsort()]
        return spots, own, own[late], late


def other_key(h: Column) -> Column:
    return h.bitwiseAND(F.lit(OTHER - 1)).bitwiseOR(F.lit(OTHER))


def encode(*arrays: np.ndarray) -> bytes:
    """Arrays of one length and 8-byte items, compressed byte by byte of the items."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8).T.tobytes() for a in arrays)
    return struct.pack("<qq", len(arrays), len(arrays[0])) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def decode(data: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<qq", data)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[16:], decompressed_size=8 * k * n, asbytes=True), np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(raw[i].T).reshape(-1).view(np.int64) for i in range(k)]


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=0)


def pair_bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (pair.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((z >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def key_bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper bits of the hash: in order of the keys."""
    return ((x >> 30) & 0xFFFFFFFF) * buckets >> 32


def key_bucket_column(x: Column, buckets: int) -> Column:
    return F.shiftright(F.shiftright(x, 30).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(buckets).cast("long"), 32).cast("int")


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal rows of sorted columns begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def in_order(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The order of rows by first, then the others; most are told apart by first, a hash, so only the rest is sorted by more."""
    order = first.argsort()
    x = first[order]
    tied = np.zeros(len(x), bool)
    tied[1:] = x[1:] == x[:-1]
    tied[:-1] |= tied[1:]
    some = order[tied]
    order[tied] = some[np.lexsort((*(a[some] for a in rest[::-1]), first[some]))]
    return order


def chunks(batches: Iterator[pa.RecordBatch], keys: Keys, start: int) -> Iterator[tuple]:
    """(ids, held out, lengths, document of each token, previous words, words) of batches (doc_id, text, held_out), some CHUNK tokens at a time."""
    ids, held, rows, sizes, tokens = [], [], [], [], 0

    def flush():
        size = np.concatenate(sizes)
        w = np.concatenate(rows)
        u = np.concatenate([[start], w[:-1]])
        u[np.cumsum(size)[:-1]] = start
        return pa.chunked_array(ids).combine_chunks(), np.array(held, bool), size, np.repeat(np.arange(len(size), dtype=np.int32), size), u, w

    for batch in batches:
        for at, texts in enumerate(raw_texts(batch)):
            part = batch.slice(at * SLICE_ROWS, SLICE_ROWS)
            w, size = keys.of_texts(texts)
            rows.append(w)
            sizes.append(size)
            tokens += len(w)
            ids.append(part.column(0))
            held += part.column(2).to_pylist()
            if tokens > CHUNK or len(held) + SLICE_ROWS > 1 << (DOC_BITS - 1):
                yield flush()
                ids, held, rows, sizes, tokens = [], [], [], [], 0
    if rows:
        yield flush()


def sides(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word that deals a cell out, the cell's other word; below zero, as -1 - dish, where the first one is the context)."""
    by_dish = w >= OTHER
    return np.where(by_dish, w, u), np.where(by_dish, u, -1 - w)


def parted(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its rows) of a sorted column."""
    at = [*runs(bucket).tolist(), len(bucket)]
    return ((int(bucket[a]), slice(a, b)) for a, b in zip(at, at[1:], strict=False))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(value of the first column, its rows) of sorted batches."""
    now, held = None, []
    for batch in batches:
        first = batch.column(0).to_numpy()
        for value, rows in parted(first):
            if value != now and held:
                yield now, held
                held = []
            now = value
            held.append(batch.slice(rows.start, rows.stop - rows.start))
    if held:
        yield now, held


def cell_keys(hashes: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same for a cell whichever of its words are in the lookup."""
    name = lambda x: np.where(x < OTHER, hashes[np.where(x < OTHER, x, 0)], x) if len(hashes) else x
    with np.errstate(over="ignore"):
        return name(u) * np.int64(0x5851F42D4C957F2D) + name(w)


@dataclass
class Model:
    """What all tasks know: sizes, discounts, the lookup's customers and tables, and the parent's totals of each sweep."""

    hashes: np.ndarray  # of the lookup's words, as keys of other words are
    often: np.ndarray
    d: float
    n: int  # words and the unknown one
    sweeps: list[tuple[float, float, float, float]] = field(default_factory=list)  # discount, weights of a new table before and after, customers
    per: list[np.ndarray] = field(default_factory=list)  # tables of a context: before the first sweep, after each
    parent: list[np.ndarray] = field(default_factory=list)

    def parents(self, sent: np.ndarray, x: np.ndarray, sweep: int) -> np.ndarray:
        """The parent's probabilities, after a sweep, of words to which it has sent so many customers."""
        d0, before, after, total = self.sweeps[sweep]
        sent = sent.astype(np.int64)
        return (np.maximum(sent - d0 * seat(sent, np.full(len(sent), before), d0, x, sweep), 0) + after) / total

    def seated(self, c: np.ndarray, per: np.ndarray, parent: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
        return seat(c, (STRENGTH + self.d * per) * parent, self.d, key, sweep)

    def chance(self, c: np.ndarray, customers: np.ndarray, per: list[np.ndarray], parent: list[np.ndarray], key: np.ndarray) -> np.ndarray:
        """log10 of the probability of cells (count c, customers of the context), averaged over the kept sweeps, by the tables of contexts
        and the parent's probabilities before the first of them and after each."""
        total, more = np.zeros(len(c)), np.flatnonzero(c > 1)
        for s in range(KEPT):
            t = np.minimum(c, 1).astype(np.float64)
            t[more] = self.seated(c[more], per[s][more], parent[s][more], key[more], BURN_IN + s)
            total += c - self.d * t + (STRENGTH + self.d * per[s + 1]) * parent[s + 1]
        return np.log10(total / KEPT / (STRENGTH + customers))


def tally(rows: DataFrame, sent, start: int, buckets: int, cells: tuple[int, int]) -> DataFrame:
    """(kind, u, w, c, data) of the training rows of rows (doc_id, text, held_out): 0, cells that occur twice or more, with a word outside the
    lookup; 1, (a word, its cells that occur once as context, and as dish); 2, cells of two words outside the lookup, those of held-out rows
    too with c = 0; 3, cells among the most frequent contexts and dishes; 4, blocks of the lookup's cells that occur twice or more, and in c
    how many of them occur twice."""

    def deal(batches):
        for _, held, _, doc, u, w in chunks(batches, sent.value, start):
            train = ~held[doc]
            both = (u < OTHER) & (w < OTHER)
            pair = (u[both & train] << CODE_BITS) | w[both & train]
            found, n = np.unique((pair_bucket(pair, buckets) << 2 * CODE_BITS) | pair, return_counts=True)
            pair = found & ((1 << 2 * CODE_BITS) - 1)
            out = [(2 * b, encode(deltas(pair[at]), n[at].astype(np.int64))) for b, at in parted(found >> 2 * CODE_BITS)]
            rest = ~both & (train | ((u >= OTHER) & (w >= OTHER)))
            x, y = sides(u[rest], w[rest])
            order = in_order(x, y)
            x, y, n = x[order], y[order], train[rest][order].astype(np.int64)
            at = runs(x, y)
            if len(at):
                x, y, n = x[at], y[at], np.add.reduceat(n, at)
                out += [(2 * b + 1, encode(deltas(x[at]), y[at], n[at])) for b, at in parted(key_bucket(x, buckets))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["b", "data"])

    columns = ["kind", "u", "w", "c", "data"]

    def rows_of(kind, u, w, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.astype(np.int64)), pa.array(w.astype(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], columns)

    def count(batches):
        size = len(sent.value.hashes)
        once = np.zeros((2, size), np.int64)  # cells that occur once, by context and by dish
        for b, parts in grouped(batches):
            blocks = [decode(x) for part in parts for x in part.column(1).to_pylist()]
            if b % 2 == 0:
                pair, back = np.unique(np.concatenate([np.cumsum(p) for p, _ in blocks]), return_inverse=True)
                c = np.bincount(back, np.concatenate([n for _, n in blocks])).astype(np.int64)
                u, w = pair >> CODE_BITS, pair & ((1 << CODE_BITS) - 1)
                one = c == 1
                once[0] += np.bincount(u[one], minlength=size)
                once[1] += np.bincount(w[one], minlength=size)
                hot, more = (u < cells[0]) & (w < cells[1]) & (c > 0), c > 1
                yield rows_of(3, u[hot], w[hot], c[hot])
                block = (encode(deltas(pair[more]), c[more]) if more.any() else None, int((c == 2).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([4], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block[1]]), pa.array([block[0]], pa.binary())], columns)
                continue
            x, y, n = (np.concatenate(a) for a in zip(*((np.cumsum(x), y, n) for x, y, n in blocks), strict=True))
            order = in_order(x, y)
            x, y, n = x[order], y[order], n[order]
            at = runs(x, y)
            x, y, c = x[at], y[at], np.add.reduceat(n, at)
            u, w = np.where(y < 0, x, y), np.where(y < 0, -1 - y, x)
            two = y >= OTHER
            yield rows_of(2, u[two], w[two], c[two])
            yield rows_of(0, u[c > 1], w[c > 1], c[c > 1])
            u, w = u[c == 1], w[c == 1]
            for k, a in enumerate((u, w)):
                once[k] += np.bincount(a[a < OTHER], minlength=size)
                a, m = np.unique(a[a >= OTHER], return_counts=True)
                yield rows_of(1, a, m * (k == 0), m * (k == 1))
        code = np.flatnonzero(once.any(0))
        yield rows_of(1, code, once[0][code], once[1][code])

    return rows.mapInArrow(deal, "b int, data binary").repartition("b").sortWithinPartitions("b").mapInArrow(count, "kind int, u long, w long, c long, data binary")


def fit(found: DataFrame, hashes: np.ndarray, often: np.ndarray, n: int) -> tuple[Model, DataFrame, DataFrame]:
    """(model, once, state) of the table of `tally`: the lookup's tables in the model; (x, as_context, as_dish), the cells of every word that
    occur once; and (x, per, sent), before the first sweep and after each, of the other words whose tables change."""
    spark, size = found.sparkSession, len(hashes)
    once = shared_table(found.filter("kind = 1").groupBy(F.col("u").alias("x")).agg(F.sum("w").alias("as_context"), F.sum("c").alias("as_dish")), "once")
    ones = int(once.agg(F.sum("as_context")).first()[0] or 0)
    twos = found.agg(F.count_if((F.col("kind") == 0) & (F.col("c") == 2)), F.sum(F.when(F.col("kind") == 4, F.col("c")))).first()
    model = Model(hashes, often, discount(ones, twos[0] + int(twos[1] or 0)), n)
    inner = shared_table(found.filter("kind = 4 and data is not null").select("data"), "inner")
    outer = shared_table(found.filter("kind = 0").select("u", "w", "c"), "outer")

    single = np.zeros((2, size))
    some = once.filter(F.col("x") < OTHER).toPandas()
    single[:, some["x"].to_numpy(np.int64)] = some["as_context"], some["as_dish"]

    def added(batches):
        for k, parts in grouped(batches):
            total = sum(np.frombuffer(x, np.float64) for part in parts for x in part.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    def sums(seated: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """Tables (x, per, sent) of all words from the tables of tasks; those of the lookup gathered, a fixed number of numbers."""
        table, out = shared_table(seated, "tables"), single.copy()
        for r in table.filter("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(added, "part int, data binary").collect():
            out[:, r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(r["data"]).reshape(2, -1)
        return table.filter("part < 0").groupBy("x").agg(F.sum("per").alias("per"), F.sum("sent").alias("sent")), out

    def gathered(tables):
        """Tables of the lookup's words as rows, PART words each."""
        parts = [np.ascontiguousarray(tables[:, at : at + PART]) for at in range(0, size, PART)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *(pa.nulls(k, t) for t in (pa.int64(), pa.float64(), pa.float64())), pa.array([x.tobytes() for x in parts], pa.binary())], columns)

    def seat_inner(spot, sweep: int):
        def run(batches):
            m, per, parent = spot.value
            tables = np.zeros((2, size))
            for b in batches:
                for block in b.column(0).to_pylist():
                    pair, c = decode(block)
                    pair = np.cumsum(pair)
                    u, w = pair >> CODE_BITS, pair & ((1 << CODE_BITS) - 1)
                    t = m.seated(c, per[u], parent[w], cell_keys(m.hashes, u, w), sweep) if sweep >= 0 else np.ones(len(c))
                    tables += np.bincount(u, t, size), np.bincount(w, t, size)
            yield from gathered(tables)

        return run

    def seat_outer(spot, sweep: int):
        def run(batches):
            m, per_of, parent_of = spot.value
            tables = np.zeros((2, size))
            for b in batches:
                u, w, c, at_u, at_w = (b.column(i).to_numpy() for i in range(5))
                mine = [u < OTHER, w < OTHER]
                if sweep < 0:
                    t = np.ones(len(c))
                else:
                    per, parent = at_u.copy(), np.full(len(c), 1 / m.n)
                    per[mine[0]], parent[mine[1]] = per_of[u[mine[0]]], parent_of[w[mine[1]]]
                    if sweep:
                        parent[~mine[1]] = m.parents(at_w[~mine[1]], w[~mine[1]], sweep - 1)
                    t = m.seated(c, per, parent, cell_keys(m.hashes, u, w), sweep)
                for k, a in enumerate((u, w)):
                    tables[k] += np.bincount(a[mine[k]], t[mine[k]], size)
                    a, back = np.unique(a[~mine[k]], return_inverse=True)
                    s = np.bincount(back, t[~mine[k]], len(a)).astype(np.float64)  # without rows numpy counts in integers
                    none = pa.nulls(len(a), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, np.int32)), pa.array(a, pa.int64()), pa.array(s * (k == 0)), pa.array(s * (k == 1)), none], columns)
            yield from gathered(tables)

        return run

    def seated(near: DataFrame, sweep: int) -> tuple[DataFrame, np.ndarray]:
        known = Model(hashes, often, model.d, n, model.sweeps)
        spot = spark.sparkContext.broadcast((known, model.per[-1] if model.per else None, model.parent[-1] if model.parent else None))
        out = sums(inner.mapInArrow(seat_inner(spot, sweep), schema).unionAll(near.mapInArrow(seat_outer(spot, sweep), schema)))
        spot.destroy()
        return out

    columns = ["part", "x", "per", "sent", "data"]
    schema = "part int, x long, per double, sent double, data binary"
    table, tables = seated(outer.select("*", F.lit(0.0).alias("at_u"), F.lit(0.0).alias("at_w")), -1)
    state = table.join(once, "x", "left").select("x", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("as_context", "as_dish")), "per", "sent")
    state = shared_table(state.select("x", "as_context", "as_dish", F.array(F.col("as_context") + F.col("per")).alias("per"), F.array(F.col("as_dish") + F.col("sent")).alias("sent")), "state")
    # Words whose every cell occurs once send the same customers in all sweeps; one that sends one has one table.
    steady = once.filter(F.col("x") >= OTHER).join(state.select("x"), "x", "left_anti").select("x", F.col("as_dish").cast("double").alias("sent"))
    s_ones, s_twos, s_sum = (int(v or 0) for v in steady.agg(F.count_if(F.col("sent") == 1), F.count_if(F.col("sent") == 2), F.sum("sent")).first())
    steady = shared_table(steady.filter("sent > 1"), "steady")
    model.per.append(tables[0])
    model.parent.append(np.full(size, 1 / n))

    root = 0.0
    for sweep in range(SWEEPS):
        last = state.select("x", F.element_at("per", -1).alias("per"), F.element_at("sent", -1).alias("sent"))
        # Words of the lookup have no row to meet; hashes of the cells spread theirs.
        spread = lambda c: F.when(F.col(c) >= OTHER, F.col(c)).otherwise(-1 - F.abs(F.hash("u", "w")).cast("long"))
        near = outer.withColumns({"by_u": spread("u"), "by_w": spread("w")})
        near = near.join(last.select(F.col("x").alias("by_u"), F.col("per").alias("at_u")), "by_u", "left").join(last.select(F.col("x").alias("by_w"), F.col("sent").alias("at_w")), "by_w", "left")
        near = near.select("u", "w", "c", F.coalesce("at_u", F.lit(0.0)).alias("at_u"), F.coalesce("at_w", F.lit(0.0)).alias("at_w"))
        table, tables = seated(near, sweep)
        more = table.select("x", F.col("per").alias("p"), F.col("sent").alias("s"))
        state = state.join(more, "x", "left").select(
            "x", "as_context", "as_dish", F.concat("per", F.array(F.col("as_context") + F.coalesce("p", F.lit(0.0)))).alias("per"), F.concat("sent", F.array(F.col("as_dish") + F.coalesce("s", F.lit(0.0)))).alias("sent")
        )
        totals, latest = Observation(), F.element_at("sent", -1)
        state = shared_table(state.observe(totals, F.count_if(latest == 1).alias("ones"), F.count_if(latest == 2).alias("twos"), F.sum(latest).alias("sum")), "state")
        now = state.select("x", latest.alias("sent"))
        ones, twos, total = (int(totals.get.get(k) or 0) for k in ("ones", "twos", "sum"))
        d0 = discount(ones + s_ones + int((tables[1] == 1).sum()), twos + s_twos + int((tables[1] == 2).sum()))
        before = (STRENGTH + d0 * root) / n

        def root_tables(batches, d0=d0, before=before, sweep=sweep):
            for b in batches:
                c = b.column(1).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([float(seat(c, np.full(len(c), before), d0, b.column(0).to_numpy(), sweep).sum())])], ["t"])

        root = float(now.unionAll(steady).mapInArrow(root_tables, "t double").agg(F.sum("t")).first()[0] or 0.0) + s_ones
        root += float(seat(tables[1].astype(np.int64), np.full(size, before), d0, hashes, sweep).sum())
        model.sweeps.append((d0, before, (STRENGTH + d0 * root) / n, STRENGTH + total + s_sum + tables[1].sum()))
        model.per.append(tables[0])
        model.parent.append(model.parents(tables[1], hashes, sweep))
    kept = lambda c: F.slice(c, BURN_IN + 1, KEPT + 1).alias(c)
    return model, once, state.select("x", kept("per"), kept("sent"))


def score(docs: DataFrame, contexts: int = CONTEXTS, dishes: int = DISHES, lookup: int = LOOKUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, as `language_model.score` states; what is
    broadcast does not change them but for rounding."""
    if not 0 <= lookup <= 1 << CODE_BITS:
        raise ValueError(f"lookup <= {1 << CODE_BITS} is needed")
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("held_out", hash_bucket(FOLDS) == HELD_OUT)
    counts = shared_table(unigrams(rows.filter(~F.col("held_out")).select("doc_id", "text")), "unigrams")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = frequent(counts, lookup).toPandas().sort_values(["c", "h"], ascending=[False, True])
    raw, often = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    coder = Keys(raw)
    start = int(coder([END])[0])
    sent = spark.sparkContext.broadcast(coder)
    buckets = min(n // BUCKET + 1, 1 << BUCKET_BITS)
    found = shared_table(tally(rows, sent, start, buckets, (contexts, dishes)), "bigrams")
    model, once, state = fit(found, (raw & (OTHER - 1)) | OTHER, often, v + 1)

    # The commonest cells, at most contexts x dishes, and the lookup's words.
    wide, high = min(contexts, len(raw)), min(dishes, len(raw))
    table = np.zeros((wide, high), np.int64)
    for part in found.filter("kind = 3").select(F.col("u").cast("int"), F.col("w").cast("int"), "c").toArrow().to_batches():
        table[part.column(0), part.column(1)] = part.column(2)
    common = np.zeros((wide, high), np.float32)
    for at in range(0, wide, 16):
        u, w = (x.ravel() for x in np.mgrid[at : min(at + 16, wide), 0:high])
        per, parent = [p[u] for p in model.per[BURN_IN:]], [p[w] for p in model.parent[BURN_IN:]]
        common[at : at + 16] = model.chance(table[u, w], often[u], per, parent, cell_keys(model.hashes, u, w)).reshape(-1, high)
    del table, top
    base = np.log10((often + 0.1) / (n + 0.1 * (v + 1)))
    known = spark.sparkContext.broadcast((model, base, common))

    # Customers and tables of the words outside the lookup, for their own bucket and for those of the cells of two such words.
    edge = F.broadcast(spark.createDataFrame([(int(h),) for h in raw], "h long"))  # at most `lookup` rows
    words = counts.join(edge, "h", "left_anti").select(other_key(F.col("h")).alias("x"), "c").join(once, "x", "left").join(state, "x", "left")
    words = shared_table(words, "words")
    needed = found.filter("kind = 2").select(key_bucket_column(F.col("w"), buckets).alias("to"), F.col("u").alias("x")).distinct()
    own = words.withColumn("to", key_bucket_column(F.col("x"), buckets))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"b int, chunk long, data binary, x long, c long, as_context long, as_dish long, per array<double>, sent array<double>, doc_id {kind}, held_out boolean, n_known long, base double, model double"
    names = "b chunk data x c as_context as_dish per sent doc_id held_out n_known base model".split()
    fields = spark.createDataFrame([], schema).schema.fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def nulls(size, **columns):
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(size, t)).cast(t) for name, t in zip(names, kinds, strict=True)], names)

    def deal(batches):
        model, base, common = known.value
        task, serial = TaskContext.get().partitionId(), 0
        for ids, held, size, doc, u, w in chunks(batches, sent.value, start):
            chunk, serial, docs = (task << 32) + serial, serial + 1, len(size)
            mine = w < OTHER
            hot = (u < wide) & (w < high)
            first = [np.bincount(doc[mine], minlength=docs), np.bincount(doc[mine], base[w[mine]], docs), np.bincount(doc[hot], common[u[hot], w[hot]], docs)]
            yield nulls(
                docs, b=pa.array(np.full(docs, 2 * (chunk % buckets), np.int32)), chunk=pa.array(np.full(docs, chunk)), x=pa.array(np.arange(docs)), c=pa.array(size), doc_id=ids,
                held_out=pa.array(held), n_known=pa.array(first[0]), base=pa.array(first[1]), model=pa.array(first[2]),
            )
            both, who = (u < OTHER) & mine & ~hot, (doc << 1 | held[doc]).astype(np.int64)
            pair = (u[both] << CODE_BITS) | w[both]
            at, n = np.unique((pair_bucket(pair, buckets) << (2 * CODE_BITS + DOC_BITS)) | pair << DOC_BITS | who[both], return_counts=True)
            pair, whose = (at >> DOC_BITS) & ((1 << 2 * CODE_BITS) - 1), at & ((1 << DOC_BITS) - 1)
            out = [(2 * b, encode(deltas(pair[k]), whose[k], n[k].astype(np.int64))) for b, k in parted(at >> (2 * CODE_BITS + DOC_BITS))]
            rest = ~mine | (u >= OTHER)
            x, y = sides(u[rest], w[rest])
            order = in_order(x, y, who[rest])
            x, y, whose = x[order], y[order], who[rest][order]
            at = runs(x, y, whose)
            n = np.diff(at, append=len(x))
            x, y, whose = x[at], y[at], whose[at]
            out += [(2 * b + 1, encode(deltas(x[k]), y[k], whose[k], n[k])) for b, k in parted(key_bucket(x, buckets))]
            if out:
                yield nulls(len(out), b=pa.array([b for b, _ in out], pa.int32()), chunk=pa.array(np.full(len(out), chunk)), data=pa.array([x for _, x in out], pa.binary()))

    def meet(batches):
        model, _, _ = known.value
        for b, parts in grouped(batches):
            serials, sizes, read, facts = [], [], [], []
            for part in parts:
                got = part.column(names.index("data")).is_valid().to_numpy(zero_copy_only=False)
                serials += part.column(1).filter(pa.array(got)).to_pylist()
                for data in part.column(2).filter(pa.array(got)).to_pylist():
                    x, *y, who, times = decode(data)
                    sizes.append(len(x))
                    read.append((np.cumsum(x), *y, who.astype(np.int16), times.astype(np.int32)))
                docs = part.column(names.index("held_out")).is_valid()
                yield part.filter(docs)
                facts.append(part.filter(pa.array(~got & ~docs.to_numpy(zero_copy_only=False))))
            if not read:
                continue
            first, *second, who, times = (np.concatenate(a) for a in zip(*read, strict=True))
            del read
            train = np.where(who & 1, 0, times)
            if b % 2 == 0:
                pair, back = np.unique(first, return_inverse=True)
                del first
                c = np.bincount(back, train).astype(np.int64)
                values = [np.empty(len(pair))]
                for at in range(0, len(pair), CELLS):
                    some = slice(at, at + CELLS)
                    u, w = pair[some] >> CODE_BITS, pair[some] & ((1 << CODE_BITS) - 1)
                    values[0][some] = model.chance(c[some], model.often[u], [p[u] for p in model.per[BURN_IN:]], [p[w] for p in model.parent[BURN_IN:]], cell_keys(model.hashes, u, w))
            else:
                order = in_order(first, second[0])
                x, y = first[order], second[0][order]
                del first, second
                at = runs(x, y)
                back = np.empty(len(x), np.int64)
                back[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(x)))
                x, y, c = x[at], y[at], np.add.reduceat(train[order], at, dtype=np.int64)
                del order
                learned = learn(facts)
                values = [np.empty(len(x)) for _ in range(3)]
                for at in range(0, len(x), CELLS):
                    some = slice(at, at + CELLS)
                    for value, part in zip(values, likely(model, x[some], y[some], c[some], *learned), strict=True):
                        value[some] = part
            out, end = [], 0
            for size in sizes:
                at = slice(end, end + size)
                end, doc = at.stop, who[at] >> 1
                row = np.flatnonzero(np.bincount(doc))
                total = [np.bincount(doc, x[back[at]] * times[at])[row] for x in values] + [np.zeros(len(row))] * (3 - len(values))
                total[0] = total[0].astype(np.float32).astype(np.float64)
                out.append(encode(deltas(row), *(x.view(np.int64) for x in total)))
            yield nulls(len(out), b=pa.array(np.full(len(out), b, np.int32)), chunk=pa.array(serials, pa.int64()), data=pa.array(out, pa.binary()))

    def likely(model, x, y, c, word, cx, per_x, sent_x):
        """Of cells with a word outside the lookup (as `sides` has them, counts c): the logarithm of the probability, whether the dish is a known
        word outside the lookup, and the base's logarithm for a dish outside it; word and what follows are of `learn`."""
        u, w = np.where(y < 0, x, y), np.where(y < 0, -1 - y, x)

        def spots(a):
            """(cells whose word is outside the lookup and known, their rows in word)."""
            at = np.minimum(np.searchsorted(word, a), max(len(word) - 1, 0))
            hit = (word[at] == a) & (a >= OTHER) if len(word) else np.zeros(len(a), bool)
            return hit, at[hit]

        customers, per = np.zeros(len(u)), np.zeros((KEPT + 1, len(u)))
        mine, (hit, row) = u < OTHER, spots(u)
        customers[mine], customers[hit] = model.often[u[mine]], cx[row]
        for k in range(KEPT + 1):
            per[k][mine], per[k][hit] = model.per[BURN_IN + k][u[mine]], per_x[k][row]
        mine, (hit, row) = w < OTHER, spots(w)
        often, customers_w = np.zeros(len(u)), np.zeros((KEPT + 1, len(u)))
        often[hit] = cx[row]
        parent = []
        for k in range(KEPT + 1):
            customers_w[k][hit] = sent_x[k][row]
            q = np.zeros(len(u))
            q[mine] = model.parent[BURN_IN + k][w[mine]]
            q[~mine] = model.parents(customers_w[k][~mine], w[~mine], BURN_IN + k - 1)
            parent.append(q)
        value = model.chance(c, customers, per, parent, cell_keys(model.hashes, u, w))
        return value, often > 0, np.where(mine, 0.0, np.log10((often + 0.1) / (n + 0.1 * (v + 1))))

    def learn(facts):
        """Of the words outside the lookup: keys in order, customers, and tables as context and as dish of the kept sweeps."""
        t = pa.Table.from_batches(facts)
        x = t.column("x").to_numpy().astype(np.int64)
        x, first = np.unique(x, return_index=True)
        t = t.take(pa.array(first))
        out = []
        for steady, changing in (("as_context", "per"), ("as_dish", "sent")):
            value = np.repeat(t.column(steady).fill_null(0).to_numpy().astype(np.float64)[None, :], KEPT + 1, 0)
            column = t.column(changing).combine_chunks()
            has = column.is_valid().to_numpy(zero_copy_only=False)
            value[:, has] = column.drop_null().flatten().to_numpy().reshape(-1, KEPT + 1).T
            out.append(value)
        return x, t.column("c").to_numpy().astype(np.int64), *out

    def gather(batches):
        for _, parts in grouped(batches):
            t = pa.Table.from_batches(parts)
            data = t.column("data").drop_null().to_pylist()
            t = t.filter(t.column("held_out").is_valid())
            x = t.column("x").to_numpy()
            add = np.zeros((3, int(x.max()) + 1))
            for block in data:
                at, *values = decode(block)
                add[:, np.cumsum(at)] += [a.view(np.float64) for a in values]
            cast = lambda name, k: t.column(name).to_numpy() + add[k][x]
            size = np.full(len(x), n)
            yield from pa.table(
                [t.column("doc_id"), t.column("held_out"), t.column("c"), pa.array(cast("n_known", 1).astype(np.int64)), pa.array(size), pa.array(cast("base", 2)), pa.array(cast("model", 0))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).to_batches()

    dealt = rows.mapInArrow(deal, schema)
    more = own.unionByName(needed.join(words, "x")).withColumnRenamed("to", "b").withColumn("b", 2 * F.col("b") + 1)
    for f in fields:
        if f.name not in more.columns:
            more = more.withColumn(f.name, F.lit(None).cast(f.dataType))
    dealt = dealt.unionAll(more.select(*(F.col(f.name).cast(f.dataType) for f in fields)))
    met = dealt.repartition("b").sortWithinPartitions("b").mapInArrow(meet, schema)
    met = met.select("chunk", *(c for c in names if c not in ("chunk", "b"))).repartition("chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
