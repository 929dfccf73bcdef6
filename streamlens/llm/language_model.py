"""A hierarchical Pitman-Yor language model whose scores cover an open vocabulary of any size.

`score` learns from all bigrams (bigrams.py) unless it is asked for a smaller model, which is what follows and what is in this file.

Unigram counts of all training tokens are kept for every word. The most frequent ALPHABET words are dishes of their own, all other
words together are one more dish. A restaurant for each of CONTEXTS contexts (the most frequent previous words, and one for all
others) serves these dishes; the context restaurants share a parent whose base is uniform. What the shared dish stands for is drawn
from a further restaurant over all remaining words and one unknown word, with a uniform base. Seating arrangements (how many tables
serve each dish) are sampled by Gibbs sweeps, and predictive probabilities are averaged over the sweeps after the burn-in.

Tables that are broadcast have a fixed size (contexts x alphabet, and LOOKUP words); every other word is joined by a shuffle on its
hash. No such word can be hot: the hot ones are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, hash_bucket, id_text, map_slices, shared_table
from .substrings import _PLACES, _SUMMANDS, word_hashes

FOLDS, HELD_OUT = 10, 0
ALPHABET = 8192
CONTEXTS = 256
LOOKUP = 131_072
SWEEPS, BURN_IN = 6, 2
STRENGTH = 1.0
#: Customers of a dish are seated in steps of one LEAP-th of those seated already.
LEAP = 16
#: A word cache's most entries, tokens counted at a time, and the most words counted before they are handed on.
_CACHE, _TOKENS, _FLUSH = 100_000, 1_000_000, 1_000_000
END = b""  # no word is empty


def word_hash(word: bytes) -> int:
    """As `word_hashes` has it, signed; the end has one of its own."""
    import xxhash

    h = sum(int(_SUMMANDS[k << 8 | b]) for k, b in enumerate(word)) % 2**64 if 0 < len(word) <= _PLACES else xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str | None) -> list[bytes]:
    """Words and the end: bytes.lower and bytes.split know ASCII only."""
    return [*(text or "").encode().lower().split(), END]


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, few of them as Python strings at a time."""
    for part in raw_texts(batch):
        yield from (t.decode() for t in part)


def raw_texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The texts of a batch in UTF-8, null ones empty, SLICE_ROWS at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield [t or b"" for t in batch.column(1).slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()]


def unigrams(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word, known by its 64-bit hash, occurs in docs (doc_id, text). Counted per task before the shuffle."""

    def run(batches):
        words, times, fresh, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        end = np.int64(word_hash(END))

        def merged():
            h, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (words[:0], times[:0])
            h, n = np.concatenate([words, h]), np.concatenate([times, n])
            order = h.argsort()
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            return (h[at], np.add.reduceat(n, at)) if len(h) else (h, n)

        for batch in batches:
            for part in raw_texts(batch):
                h = word_hashes(part)[0].view(np.int64)
                fresh += [h, np.full(len(part), end)]
                tokens += len(h) + len(part)
                if tokens > _TOKENS:
                    (words, times), fresh, tokens = merged(), [], 0
                    if len(words) > _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], ["h", "c"])
                        words, times = words[:0], times[:0]
        words, times = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], ["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of counts (h, c) above a count that leaves `most` of them at most. The count comes from a histogram in eighths of powers
    of two, a few hundred rows, so nothing is sorted and no task gathers candidates."""
    step = F.floor(8 * F.log2("c")).alias("step")
    left, least = most, None
    for r in sorted(counts.groupBy(step).count().collect(), key=lambda r: -r["step"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)


class Codes:
    """Ranks of words among the most frequent (hashes, in order of rank); -1 for others. Only the hashes are sent to executors."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.of, self.known = hashes, None, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, learn = self.known, self._learn
        return np.fromiter((known[w] if w in known else learn(w) for w in words), np.int64, len(words))

    def _learn(self, word: bytes) -> int:
        if self.of is None:
            self.of = {h: k for k, h in enumerate(self.hashes.tolist())}
        code = self.of.get(word_hash(word), -1)
        if len(self.known) < _CACHE:
            self.known[word] = code
        return code

    def __getstate__(self):
        return {"hashes": self.hashes, "of": None, "known": {}}


def dishes(codes: np.ndarray, start: int, alphabet: int = ALPHABET, contexts: int = CONTEXTS) -> tuple[np.ndarray, np.ndarray]:
    """(context, dish) of each token; start is the code of the end, after which a text begins."""
    dish = np.where((codes >= 0) & (codes < alphabet), codes, alphabet)
    before = np.concatenate([[start], codes[:-1]])
    return np.where((before >= 0) & (before < contexts - 1), before, contexts - 1), dish


def uniforms(h: np.ndarray, step: int) -> np.ndarray:
    """A uniform number for each hash and step, the same wherever it is drawn."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((step * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The binomial quantile of each uniform number u: its distribution function summed up to u, or from the normal one where n * p is
    over 100 and the sum would underflow or be long."""
    out = np.zeros(len(n))
    wide = np.minimum(n * p, n * (1 - p)) > 100
    if wide.any():
        z = np.clip(u[wide], 1e-12, 1 - 1e-12)
        r = np.sqrt(-2 * np.log(np.minimum(z, 1 - z)))
        normal = r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r**3)
        spread = np.sqrt(n[wide] * p[wide] * (1 - p[wide]))
        out[wide] = np.clip(np.rint(n[wide] * p[wide] + np.where(z < 0.5, -normal, normal) * spread), 0, n[wide])
    live = np.flatnonzero(~wide)
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)[live]
    mass, m, v = (1 - q) ** n[live], n[live], np.where(flip, 1 - u, u)[live]
    total, k = mass.copy(), 0
    while live.size:
        more = (total < v) & (k < m)
        done = live[~more]
        out[done] = np.where(flip[done], n[done] - k, k)
        live, mass, total, m, v, q = live[more], mass[more], total[more], m[more], v[more], q[more]
        mass = mass * (m - k) / (k + 1) * q / (1 - q)
        total, k = total + mass, k + 1
    return out


def seat(c: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables that c customers of a dish take when all are seated anew: the next one opens a table with weight `new`, else joins with
    weight (seated - d * tables). The next LEAP-th part of those seated, one at least, come at a time with the weights held: of them a
    binomial number open tables. So an only customer, and any of the first 2 * LEAP, is seated by itself."""
    t = np.minimum(c, 1).astype(np.float64)
    live, seated, step = np.flatnonzero(c > 1), 1, 0
    while live.size:
        leap = np.minimum(max(1, seated // LEAP), c[live] - seated).astype(np.float64)
        t[live] += binomial(leap, new[live] / (new[live] + seated - d * t[live]), uniforms(key[live], sweep * 1009 + step))
        seated += max(1, seated // LEAP)
        step += 1
        live = live[c[live] > seated]
    return t


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


@dataclass
class Rest:
    """The restaurant of words outside the alphabet: its customers, types, discount, and tables after each kept sweep."""

    customers: int
    types: int
    d: float
    tables: list[tuple[int, float, float]]  # (sweep, tables the sweep was seated with, tables it left)

    def probability(self, c: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Averaged predictive probability of words with counts c (0: the unknown word) and hashes h."""
        total = np.zeros(len(c))
        for sweep, before, after in self.tables:
            t = seat(c, np.full(len(c), (STRENGTH + self.d * before) / (self.types + 1)), self.d, h, sweep)
            total += (np.maximum(c - self.d * t, 0) + (STRENGTH + self.d * after) / (self.types + 1)) / (STRENGTH + self.customers)
        return total / len(self.tables)


def fit_rest(rest: DataFrame) -> Rest:
    """Gibbs sweeps over rest (h, c); each is one pass that returns only the number of tables."""
    one = rest.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    customers, types = int(one[0] or 0), int(one[1])
    d, now, kept = discount(one[2], one[3]), float(types), []
    for sweep in range(SWEEPS):
        before = now

        def run(batches, before=before, sweep=sweep):
            for b in batches:
                c, h = b.column(1).to_numpy(), b.column(0).to_numpy()
                t = seat(c, np.full(len(c), (STRENGTH + d * before) / (types + 1)), d, h, sweep)
                yield pa.RecordBatch.from_arrays([pa.array([float(t.sum())])], ["t"])

        now = float(rest.select("h", "c").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0) if types else 0.0
        if sweep >= BURN_IN:
            kept.append((sweep, before, now))
    return Rest(customers, types, d, kept)


def fit_contexts(counts: np.ndarray) -> np.ndarray:
    """Averaged predictive probabilities (contexts x dishes) of context restaurants with these counts and one shared parent."""
    contexts, n = counts.shape
    k, a = (x.astype(np.int32) for x in np.nonzero(counts))
    c = counts[k, a]
    key = (k.astype(np.int64) << 32) + a
    d1 = discount(int((c == 1).sum()), int((c == 2).sum()))
    tables = np.ones(len(c))
    parent, own = np.full(n, 1 / n), np.arange(n, dtype=np.int64) + (1 << 60)
    root_tables, totals, out = np.zeros(n), counts.sum(1), np.zeros((contexts, n))
    for sweep in range(SWEEPS):
        per = np.bincount(k, tables, contexts)
        tables = seat(c, (STRENGTH + d1 * per[k]) * parent[a], d1, key, sweep)
        per = np.bincount(k, tables, contexts)
        sent = np.bincount(a, tables, n)
        d0 = discount(int((sent == 1).sum()), int((sent == 2).sum()))
        root_tables = seat(sent.astype(np.int64), np.full(n, (STRENGTH + d0 * root_tables.sum()) / n), d0, own, sweep)
        parent = (np.maximum(sent - d0 * root_tables, 0) + (STRENGTH + d0 * root_tables.sum()) / n) / (STRENGTH + sent.sum())
        if sweep >= BURN_IN:
            out += ((STRENGTH + d1 * per) / (STRENGTH + totals))[:, None] * parent
            out[k, a] += (c - d1 * tables) / (STRENGTH + totals[k])  # each cell occurs once
    return out / (SWEEPS - BURN_IN)


def score(docs: DataFrame, alphabet: int | None = None, contexts: int | None = None, lookup: int = LOOKUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns from rows that are not held out.

    Every previous word has a restaurant with every word as a dish (bigrams.py), unless alphabet or contexts is given: then the smaller
    model of this file, which pools the words and contexts beyond these numbers (the other number is ALPHABET or CONTEXTS).

    Logarithms are to base 10. A null text is empty: its end alone is scored. A null id counts as the empty text when folds are dealt;
    repeated rows are learned from and scored one by one; with nothing to learn from every token is the unknown word, with
    probability 1; an empty table gives none; other columns are ignored."""
    if alphabet is None and contexts is None:
        from . import bigrams

        return bigrams.score(docs, lookup=lookup, id_col=id_col, text_col=text_col)
    alphabet, contexts = alphabet or ALPHABET, contexts or CONTEXTS
    if not 1 <= contexts - 1 <= alphabet <= lookup:
        raise ValueError("contexts - 1 <= alphabet <= lookup is needed")
    rows = id_text(docs, id_col, text_col).withColumn("held_out", hash_bucket(FOLDS) == HELD_OUT)
    training = rows.filter(~F.col("held_out")).select("doc_id", "text")
    counts = shared_table(unigrams(training), "unigrams")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = int(total[0] or 0), int(total[1])
    top = frequent(counts, lookup).toPandas().sort_values(["c", "h"], ascending=[False, True])
    hashes, often = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    coder = Codes(hashes)
    start = int(next(iter(np.flatnonzero(hashes == word_hash(END))), -1))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(coder)

    def pairs(batches):
        table = np.zeros(contexts * (alphabet + 1), np.int64)
        for batch in batches:
            for text in texts_of(batch):
                k, a = dishes(sent.value(words_of(text)), start, alphabet, contexts)
                np.add.at(table, k * (alphabet + 1) + a, 1)
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(table[cell])], ["cell", "n"])

    # At most contexts x dishes rows; written first, so that the driver gets plain small rows a partition at a time.
    seen = shared_table(training.mapInArrow(pairs, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs").toPandas()
    table = np.zeros(contexts * (alphabet + 1), np.int64)
    table[seen["cell"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    used = min(alphabet, len(hashes))
    table = table.reshape(contexts, alphabet + 1)[:, [*range(used), alphabet]]
    chance = np.full((contexts, alphabet + 1), -np.inf, np.float32)
    chance[:, [*range(used), alphabet]] = np.log10(fit_contexts(table))
    del seen, table, top

    edge = spark.createDataFrame([(int(h),) for h in hashes[:used]], "h long")
    rest = fit_rest(counts.join(F.broadcast(edge), "h", "left_anti").select("h", "c"))  # at most `alphabet` rows are broadcast
    base = np.log10((often + 0.1) / (n + 0.1 * (v + 1)))
    inner = np.zeros(len(hashes))
    inner[used:] = np.log10(rest.probability(often[used:], hashes[used:]))
    model = spark.sparkContext.broadcast((chance, base, inner))

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, (chance, base, inner) = sent.value, model.value
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base": [], "model": [], "rare_h": [], "rare_n": []}
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            codes = coder(words)
            known = codes[codes >= 0]
            k, a = dishes(codes, start, alphabet, contexts)
            h, times = np.unique(np.fromiter((word_hash(words[i]) for i in np.flatnonzero(codes < 0)), np.int64), return_counts=True)
            for name, value in zip(out, (len(words), len(known), float(base[known].sum()), float(chance[k, a].sum(dtype=np.float64) + inner[known].sum()), h, times), strict=True):
                out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))], ["doc_id", "held_out", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_slices(rows.select("doc_id", "text", "held_out"), parts, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, rare_h array<long>, rare_n array<long>")
    scored = shared_table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")

    def chances(batches):
        for b in batches:
            p = rest.probability(b.column(1).to_numpy(), b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.log10(p))], ["h", "c", "p"])

    likely = counts.select("h", "c").mapInArrow(chances, "h long, c long, p double")
    new_base, new_model = float(np.log10(0.1 / (n + 0.1 * (v + 1)))), float(np.log10(rest.probability(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]))
    rare = scored.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("row", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("times"))
    met = rare.join(likely, "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.coalesce(F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1))), F.lit(new_base))).alias("base_rest"),
        F.sum(F.col("times") * F.coalesce("p", F.lit(new_model))).alias("model_rest"),
    )
    return scored.drop("rare_h", "rare_n").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("model_rest", F.lit(0.0))).alias("score"),
    )
