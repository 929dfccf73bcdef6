"""SimHash near-duplicates by pivot distance tables.

Two fingerprints within k bits differ by at most k in their distance to any reference. The references are a base r, r with one
bit flipped (one for each bit), and PIVOTS random ones; every fingerprint's distances to all of them are computed once, as its row of
the table. Candidates come from the table: two rows within k differ from each other, relative to the base's column, in the columns of
at most k flipped references, so of BLOCKS groups of these columns at least BLOCKS - k are equal, and equality on such a choice of
groups is the join (no pair is lost). A candidate is discarded if any of the base's and random columns differs by more than k, and the
survivors are verified bit by bit.

A choice that more than BUCKET fingerprints share is a full one: its members meet at points instead of pair by pair. Within two bits
means that some fingerprint is within one bit of both, so each member is dealt to the 65 points around it, and at every point all are
linked to one. The links' components are the same whatever BUCKET is; it bounds the pairs of a choice.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_slices, shared_table
from .components import connected

BITS = 64
NEAR = 2
BLOCKS = 5
PIVOTS = 8
#: Candidates of a bucket with more members are found by shared neighbours instead of pair by pair: same links, linear work.
BUCKET = 16
_RANDOM = random.Random(42)
BASE = _RANDOM.getrandbits(64)
REFERENCES = [_RANDOM.getrandbits(64) for _ in range(PIVOTS)]
EDGES_OF_BLOCKS = [round(k * BITS / BLOCKS) for k in range(BLOCKS + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(words: list[bytes], width: int) -> int:
    """SimHash over the XXH64 (seed 42) of word shingles, repeats included; fewer words than width make one shingle, none gives zero."""
    import xxhash

    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): fp is the fingerprint as a signed long, mark a hash of the text, never null. Words are runs of bytes other
    than ASCII white space, A-Z lower-cased."""
    rows = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # bytes.lower and bytes.split know ASCII only: A-Z, and 0x20 and 0x09 to 0x0D.
        got = [signed(fingerprint((t or "").encode().lower().split(), width)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.int64())], ["doc_id", "mark", "fp"])

    return map_slices(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, fp long")


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(signed(b))))


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps (fp) with their rows of the table: `flipped`, the distances to the base with each bit flipped, and `pivots`, those to the base
    and to the random references, seven bits each in one long."""
    packed = F.lit(0).cast("long")
    for k, ref in enumerate((BASE, *REFERENCES)):
        packed = packed.bitwiseOR(F.shiftleft(distance(F.col("fp"), ref).cast("long"), 7 * k))
    references = F.array(*(F.lit(signed(BASE ^ (1 << k))) for k in range(BITS)))
    return fps.withColumns({"pivots": packed, "flipped": F.transform(references, lambda ref: distance(F.col("fp"), ref))})


def coordinates(pivots: Column, flipped: Column) -> Column:
    """The flipped references' columns relative to the base's, one bit each: whether the distance to that reference is the lesser."""
    base = pivots.bitwiseAND(F.lit(127)).cast("int")
    bits = F.transform(flipped, lambda d, k: F.when(d < base, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _coordinate_gap(a: str, b: str) -> Column:
    part = lambda c, k: F.shiftrightunsigned(F.col(c), 7 * k).bitwiseAND(F.lit(127))
    return F.greatest(*(F.abs(part(a, k) - part(b, k)) for k in range(PIVOTS + 1)))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints fps (fp) whose components are those of all pairs within NEAR bits."""
    keys = []
    for n, kept in enumerate(combinations(range(BLOCKS), BLOCKS - NEAR)):
        mask = sum((1 << EDGES_OF_BLOCKS[b + 1]) - (1 << EDGES_OF_BLOCKS[b]) for b in kept)
        keys.append(F.struct(F.lit(n).alias("choice"), F.col("at").bitwiseAND(F.lit(signed(mask))).alias("key")))
    table = shared_table(pivot_table(fps).select("fp", "pivots", coordinates(F.col("pivots"), F.col("flipped")).alias("at")), "pivot-table")
    rows = table.select("fp", "pivots", F.explode(F.array(*keys)).alias("k")).select("fp", "pivots", "k.choice", "k.key")
    buckets = shared_table(rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = shared_table(rows.join(buckets, ["choice", "key"]), "candidates")

    few = shared.filter(F.col("n") <= BUCKET)
    pairs = few.select("choice", "key", F.col("fp").alias("a"), F.col("pivots").alias("pa")).join(few.select("choice", "key", F.col("fp").alias("b"), F.col("pivots").alias("pb")), ["choice", "key"])
    near = pairs.filter((F.col("a") < F.col("b")) & (_coordinate_gap("pa", "pb") <= NEAR) & (distance(F.col("a"), F.col("b")) <= NEAR)).select("a", "b")

    # Within 2 bits means: some fingerprint is within 1 bit of both. So those of full buckets meet at the points around them.
    full = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << k))) for k in range(BITS)))
    points = shared_table(full.select("fp", F.explode(around).alias("point")), "points")
    heads = shared_table(points.groupBy("point").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head <> last").select("point", "head"), "heads")
    met = points.join(heads, "point").filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return near.union(met).distinct()


def _named(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, fp, component, component_id) of every row; component is a fingerprint of the group."""
    own = shared_table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = shared_table(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = shared_table(connected(links(classes.select("fp"))), "components")
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    named = shared_table(named, "named")
    least = shared_table(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-ids")
    class_ids = shared_table(named.join(least, "component").select("fp", "component", "component_id"), "class-ids")
    return own.join(class_ids, "fp").select("doc_id", "mark", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id among documents reachable by links of at most NEAR bits.

    Copies share a fingerprint and are linked once, by it. A null or empty text has fingerprint zero and is linked like any
    other; a null doc_id is never a component's name unless all its ids are null; repeated rows are kept; an empty table gives
    none; other columns are ignored."""
    return _named(docs, width, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs, columns unchanged, with one row of each group of near-duplicates: the one with the least doc_id and, of several texts of
    that id in the group, the one whose text has the least hash; of repeated rows, one.

    Texts of one id that are no near-duplicates are groups of their own, so each stays. Rows without an id stay: nothing names their
    group. An empty table gives none. Texts travel once, on the exchange by id and hash of the text; no name of a column can clash."""
    from pyspark.sql import Window as W

    found = _named(docs, width, "doc_id", "text").filter(F.col("doc_id") == F.col("component_id"))
    kept = shared_table(found.groupBy("component").agg(F.first("doc_id").alias("id"), F.min("mark").alias("of")).select("id", "of"), "kept")
    # The input's columns travel as one, so that none of their names can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    named = rows.filter("own is not null").join(kept, (F.col("own") == F.col("id")) & (F.col("mark") == F.col("of")))
    order = [F.to_json(c) if "map<" in f.dataType.simpleString() else c for f in docs.schema.fields if f.name != "text" for c in [F.col(f"row.`{f.name}`")]]
    named = named.withColumn("k", F.row_number().over(W.partitionBy("own", "mark").orderBy(*order))).filter("k = 1")
    return named.select("row.*").union(rows.filter("own is null").select("row.*"))
