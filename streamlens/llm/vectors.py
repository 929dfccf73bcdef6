"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance 2 - 2c. Rotated (a fixed random orthogonal matrix spreads the energy)
and split into BLOCKS blocks, such a pair is within its proportional share of that budget in at least one block. Each block is
range-joined on a grid over its first two coordinates, as wide as the block's radius, where a vector visits the neighbouring cells
that its ball touches. Candidates of every block are verified with exact cosines of the given vectors; a pair counts in the
first block that finds it. Cells exchange sums and spanning edges, never pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .components import connected

COSINE = 0.95
BLOCKS = 4
#: Most vectors of a cell that one task compares with as many others; larger cells are dealt out as pairs of such chunks.
CHUNK = 16_384
#: Rows of a distance matrix, and candidate pairs, at a time.
_ROWS, _PAIRS = 128, 100_000
#: The grid's half neighbourhood: each two neighbouring cells meet once.
_STEPS = ((1, 0), (-1, 1), (0, 1), (1, 1))


@cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(42).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def spans(d: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = np.linspace(0, d, min(blocks, d) + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def budgets(d: int, cosine: float) -> list[float]:
    """Each block's squared radius: its share of dimensions of 2 - 2c, and a hair against rounding."""
    return [(2 - 2 * cosine) * (b - a) / d + 1e-9 for a, b in spans(d)]


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def cells(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """rows (node, m, embedding) once for each block and grid cell of its length's grid: home, or guest in a cell that the ball touches."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                piece = whole.slice(at, 1024)
                lengths = np.array([len(x) for x in piece.column("embedding")])
                for d in np.unique(lengths).tolist():
                    yield from placed(piece.take(pa.array(np.flatnonzero(lengths == d))), d)

    def placed(batch: pa.RecordBatch, d: int):
        turned = units(_matrix(batch.column("embedding"))) @ rotation(d)
        for k, ((a, b), r) in enumerate(zip(spans(d), [float(np.sqrt(r)) for r in budgets(d, cosine)], strict=True)):
            x = turned[:, a : min(b, a + 2)]
            if x.shape[1] == 1:
                x = np.hstack([x, np.zeros_like(x)])
            cell = np.floor(x / r).astype(np.int64)
            within = x - cell * r
            for home, (dx, dy) in ((True, (0, 0)), *((False, s) for s in _STEPS)):
                gap = [np.zeros(len(x)) if s == 0 else (r - w if s > 0 else w) for s, w in ((dx, within[:, 0]), (dy, within[:, 1]))]
                pick = np.flatnonzero(gap[0] ** 2 + gap[1] ** 2 <= r * r * (1 + 1e-9))
                n = len(pick)
                part = batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell[pick, 0] + dx), pa.array(cell[pick, 1] + dy), pa.array(np.full(n, home)), part.column("node"), part.column("m"), part.column("embedding")],
                    ["d", "block", "cx", "cy", "home", "node", "m", "embedding"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("node", "m", "embedding").mapInArrow(run, f"d int, block int, cx long, cy long, home boolean, node long, m long, embedding {kind}")


def _compare(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Nodes, the copies linked to each, and spanning edges, of one pair of chunks: left x right, and left x left if the chunks are one."""
    d, block, same = table.column("d")[0].as_py(), table.column("block")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
    node, m = table.column("node").to_numpy(), table.column("m").to_numpy()
    left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    x = units(_matrix(table.column("embedding").combine_chunks()))
    turned = x @ rotation(d)
    bounds, budget = spans(d), budgets(d, cosine)
    a, b = bounds[block]
    rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
    count, parent = np.zeros(len(node), np.int64), np.arange(len(node))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def verify(p: np.ndarray, q: np.ndarray) -> None:
        for at in range(0, len(p), _PAIRS):
            u, v = p[at : at + _PAIRS], q[at : at + _PAIRS]
            ok = (x[u] * x[v]).sum(1) >= cosine
            u, v = u[ok], v[ok]
            apart = lambda k: ((turned[u, bounds[k][0] : bounds[k][1]] - turned[v, bounds[k][0] : bounds[k][1]]) ** 2).sum(1) > budget[k]  # noqa: B023, E731
            own = ~apart(block)
            for k in range(block):
                own &= apart(k)
            u, v = u[own], v[own]
            np.add.at(count, u, m[v])
            np.add.at(count, v, m[u])
            for s, t in zip(u.tolist(), v.tolist(), strict=True):
                s, t = root(s), root(t)
                if s != t:
                    parent[max(s, t)] = min(s, t)

    norm = (turned[:, a:b] ** 2).sum(1)
    for at in range(0, len(rows), _ROWS):
        r = rows[at : at + _ROWS]
        for others, inner in ((cols, False), (rows[at:], True)) if same else ((cols, False),):
            if len(others):
                near = norm[r][:, None] + norm[others][None] - 2 * turned[r, a:b] @ turned[others, a:b].T <= budget[block] + 1e-7
                p, q = np.nonzero(near)
                if inner:
                    p, q = p[p < q], q[p < q]
                verify(r[p], others[q])
    top = [root(k) for k in range(len(node))]
    return node, count, [(int(node[k]), int(node[t])) for k, t in enumerate(top) if k != t]


def links(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, n_links, a, b) parts: rows with n_links to be summed by node, and rows with a spanning edge a - b."""
    placed = cells(rows, cosine)
    key = ["d", "block", "cx", "cy"]
    full = placed.groupBy(*key).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    full = shared_table(full.select(*key, F.ceil(F.greatest("h", "g") / CHUNK).cast("int").alias("k")).filter("k > 1"), "full-cells")
    dealt = placed.join(full, key, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    lefts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    rights = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(False).alias("left")))
    tasks = F.when(F.col("home"), F.concat(lefts, F.filter(rights, lambda t: t["i"] < t["j"]))).otherwise(rights)
    dealt = dealt.select(*key, "node", "m", "embedding", F.explode(tasks).alias("t")).select(*key, "t.*", "node", "m", "embedding")

    def run(table: pa.Table) -> pa.Table:
        node, count, edges = _compare(table, cosine)
        linked = np.flatnonzero(count)
        none = pa.nulls(len(linked), pa.int64())
        first = pa.table([pa.array(node[linked]), pa.array(count[linked]), none, none], ["node", "n_links", "a", "b"])
        blank = pa.nulls(len(edges), pa.int64())
        return pa.concat_tables([first, pa.table([blank, blank, pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["node", "n_links", "a", "b"])])

    return dealt.groupBy(*key, "i", "j").applyInArrow(run, "node long, n_links long, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; others link with those of their
    length. Cosines are of the components as given, floats or doubles, in double precision. Equal vectors are compared once, as a class with a count. A null id links and counts but names no component unless
    all its ids are null; repeated rows are rows of their own; an empty table gives none; other columns are ignored."""
    from pyspark.sql.types import ArrayType, FloatType

    given = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    v = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("embedding"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h", F.when(F.col("usable"), F.xxhash64("embedding")))
    alone = v.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = v.filter("usable").groupBy("h", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    classes = shared_table(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    parts = shared_table(links(classes, cosine), "vector-links")
    counts = parts.filter("node is not null").groupBy("node").agg(F.sum("n_links").alias("n"))
    found = shared_table(connected(parts.filter("a is not null").select("a", "b")), "vector-components")
    named = classes.select("node", "h", "embedding", "m", "least").join(found, "node", "left").join(counts, "node", "left")
    named = shared_table(named.withColumn("component", F.coalesce("component", "node")), "vector-named")
    least = shared_table(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-least")
    told = shared_table(named.join(least, "component").select("h", "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "vector-told")
    linked = v.filter("usable").join(told, ["h", "embedding"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.union(alone)
