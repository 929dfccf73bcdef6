"""op9_language_model: every previous word has a restaurant of its own, in which every word is a dish."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark import TaskContext

from streamlens.llm import bigrams, language_model

held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0


def brute(train: list[list[bytes]]):
    """Probability of a word after another: the whole table of contexts and words, seated on the spot."""
    words = sorted({w for ws in train for w in ws})
    place, key = {w: k for k, w in enumerate(words)}, np.array([language_model.word_hash(w) & (bigrams.OTHER - 1) | bigrams.OTHER for w in words])
    count = Counter((place[u], place[w]) for ws in train for u, w in zip([language_model.END, *ws], ws, strict=False))
    u, w = np.array(sorted(count)).T
    c, size, n = np.array([count[k] for k in zip(u, w, strict=True)]), len(words), len(words) + 1
    own, d = bigrams.cell_keys(np.zeros(0, np.int64), key[u], key[w]), language_model.discount((c == 1).sum(), (c == 2).sum())
    t, parent, root, s, total = np.ones(len(c)), np.full(n, 1 / n), np.zeros(n), language_model.STRENGTH, np.zeros((size, n))
    customers = np.bincount(u, c, size)
    for sweep in range(language_model.SWEEPS):
        t = language_model.seat(c, (s + d * np.bincount(u, t, size)[u]) * parent[w], d, own, sweep)
        sent = np.bincount(w, t, n)
        d0 = language_model.discount((sent == 1).sum(), (sent == 2).sum())
        root = language_model.seat(sent.astype(np.int64), np.full(n, (s + d0 * root.sum()) / n), d0, np.append(key, 0), sweep)
        parent = (np.maximum(sent - d0 * root, 0) + (s + d0 * root.sum()) / n) / (s + sent.sum())
        if sweep >= language_model.BURN_IN:
            total += (s + d * np.bincount(u, t, size))[:, None] * parent / (s + customers)[:, None]
            total[u, w] += (c - d * t) / (s + customers[u])
    return lambda a, b: total[place[a], place.get(b, size)] / (language_model.SWEEPS - language_model.BURN_IN), words


def test_every_context_has_its_own_restaurant(spark):
    # 400 words, more than the 256 contexts there were, each mostly followed by one other; some words occur once.
    rng = random.Random(3)
    follow = rng.sample(range(400), 400)
    texts = []
    for i in range(260):
        w, out = rng.randrange(400), []
        for _ in range(40):
            out.append(f"W{w}" if rng.random() < 0.97 else f"once{i}x{len(out)}")
            w = follow[w] if rng.random() < 0.8 else min(399, int(rng.paretovariate(0.4)))
        texts.append((i, " ".join(out)))
    out = next(i for i in range(300, 400) if held(i))
    texts += [(298, None), (299, ""), (out, "never-seen W1 never-seen never-seen"), (out, "W5 never-seen")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tokens = [(i, language_model.words_of(t)) for i, t in texts]
    chance, words = brute([ws for i, ws in tokens if not held(i)])
    known = {u for i, ws in tokens if not held(i) for u in ws}
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in language_model.score(df).collect())
    # A word not seen in training has no customers: what follows it comes from the parent, as it does in the unknown context.
    scored = {(i, len(ws)): sum(np.log10(chance(u, w)) for u, w in zip([language_model.END, *ws], ws, strict=False)) for i, ws in tokens if known.issuperset([language_model.END, *ws[:-1]])}
    assert len(scored) > 200 and any(held(i) for i, _ in scored)
    assert all(abs(s - scored[i, n]) < 1e-3 for i, n, s in got if (i, n) in scored)
    # What is broadcast is a matter of speed alone.
    for spread in ({"lookup": 30, "contexts": 3, "dishes": 8}, {"lookup": 0}, {"contexts": 1, "dishes": 1}):
        other = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in bigrams.score(df, **spread).collect())
        assert np.allclose([r[2] for r in got], [r[2] for r in other], atol=1e-3) and [r[:2] for r in got] == [r[:2] for r in other]
    for u in (language_model.END, words[1], words[-1]):
        assert abs(sum(chance(u, w) for w in [*words, b"never-seen"]) - 1) < 1e-9


def test_buckets_and_chunks_do_not_change_scores(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    got = sorted(tuple(r) for r in bigrams.score(df).collect())
    monkeypatch.setattr(bigrams, "BUCKET", 700)
    again = sorted(tuple(r) for r in bigrams.score(df.repartition(7), lookup=500).collect())
    assert [r[:5] for r in got] == [r[:5] for r in again] and np.allclose([r[5:] for r in got], [r[5:] for r in again], atol=1e-2)


def test_blocks_come_back():
    a, b = np.array([3, 9, 1 << 62]), np.array([-1, 0, 2])
    first, second = bigrams.decode(bigrams.encode(bigrams.deltas(a), b))
    assert (np.cumsum(first) == a).all() and (second == b).all()


class Few(bigrams.Model):
    def chance(self, c, *rest):
        assert TaskContext.get() is None or len(c) <= 50, "a task holds what all sweeps know of too many cells"
        return super().chance(c, *rest)


def test_cells_of_a_bucket_are_worked_out_a_few_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(400, int(rng.paretovariate(0.6)))}" for _ in range(30))) for i in range(60)], "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in bigrams.score(docs, contexts=4, dishes=4, lookup=32).collect()}
    monkeypatch.setattr(bigrams, "CELLS", 50, raising=False)
    monkeypatch.setattr(bigrams, "Model", Few)
    got = {r["doc_id"]: r for r in bigrams.score(docs, contexts=4, dishes=4, lookup=32).collect()}
    assert got == whole


def test_keys_of_texts_are_those_of_their_words(monkeypatch):
    monkeypatch.setattr(bigrams, "SPOT_BITS", 3)  # most words of the lookup share their place
    texts = ["Aa b aA", None, "", " \t", "w" * 40 + " É B\x0bc", " ".join(f"x{k} X{k % 7}" for k in range(300))]
    words = [language_model.words_of(t) for t in texts]
    common = [w for w, _ in Counter(w for ws in words for w in ws).most_common(40)]
    hashes = np.array([language_model.word_hash(w) for w in common])
    for some in (hashes, hashes[:0]):
        got, sizes = bigrams.Keys(some).of_texts([(t or "").encode() for t in texts])
        rank = {h: k for k, h in enumerate(some.tolist())}
        want = [rank.get(h, h & (bigrams.OTHER - 1) | bigrams.OTHER) for h in (language_model.word_hash(w) for ws in words for w in ws)]
        assert got.tolist() == want and sizes.tolist() == [len(ws) for ws in words]


def test_words_are_counted_together(spark, monkeypatch):
    monkeypatch.setattr(language_model, "_TOKENS", 20)
    monkeypatch.setattr(language_model, "_FLUSH", 30)
    texts = [(i, None if i % 9 == 0 else " ".join(f"A{k % (i + 1)}" for k in range(i))) for i in range(40)]
    want = Counter(language_model.word_hash(w) for _, t in texts for w in language_model.words_of(t))
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert {r["h"]: r["c"] for r in language_model.unigrams(rows).collect()} == want
    assert not language_model.unigrams(rows.limit(0)).collect()


def test_order_of_rows():
    rng = np.random.default_rng(16)
    for most in (3, 200, 1 << 40):
        a, b, c = rng.integers(0, most, (3, 500))
        got = bigrams.in_order(a, b, c)
        assert sorted(got.tolist()) == list(range(500)) and all((x[got] == x[np.lexsort((c, b, a))]).all() for x in (a, b, c))
    assert len(bigrams.in_order(a[:0], b[:0])) == 0
