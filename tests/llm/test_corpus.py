"""The corpus operators against brute force, on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens.llm import common, components, language_model, media, packing, pieces, quality, sharding, simhash, substrings, toxicity, vectors
from streamlens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, node long, fp string, `rank` int"


def brute_components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(rng.randint(5, 160)) for _ in range(40)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k % 5]) for k in range(30)]  # copies
    out += [(200 + k, base[7] + " " + words[k]) for k in range(25)]  # near copies
    passage = line(70)
    out += [(300 + k, line(30) + "\n" + passage + " " + line(20)) for k in range(12)]  # a passage that many share
    out += [(400, ""), (401, None), (402, "   \n\t "), (403, "One"), (404, "ONE"), (405, line(9000)), (406, "be " * 700), (None, "no id"), (None, None), (3, base[3]), (3, base[3])]
    out += [(407, "🤗 ñandú x\r\n▁ <s> |endoftext|"), (408, passage.upper())]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", "y", 3, "z", 1) for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)


def test_sharding(docs, empty, texts):
    rows = sharding.shard_by_bytes(docs).collect()
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == key((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in part) - total / 16) <= largest for part in by.values())
    assert sharding.shard_by_bytes(empty).count() == 0
    plan = sharding.shard_by_bytes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_of_one_id(spark):
    rows = sharding.shard_by_bytes(spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))).collect()
    assert Counter(r["shard"] for r in rows).most_common()[0][1] <= 64 and len({(r["shard"], r["slot"]) for r in rows}) == 1000


def test_media_round_trip(docs, empty, texts):
    stored = media.store_texts(docs).collect()
    assert len(stored) == len(texts) and all(media.identify(bytes(r["media"]), r["declared"]) == "audio/wav" for r in stored)
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    got = media.media_digests(docs).collect()
    assert key(tuple(r[:5]) for r in got) == key(want) and all(r["media_bytes"] == r["payload_bytes"] + 44 and len(r["media_sha256"]) == 64 for r in got)
    assert media.media_digests(empty).count() == 0


def test_sniffing():
    wav = media.to_wav(b"\x01" * 64)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"data\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n9\n%%EOF"
    local = b"PK\x03\x04" + bytes(26)
    zipped = local + b"PK\x01\x02" + bytes(42) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46, 30, 0)
    flac = b"fLaC\x00\x00\x00\x22" + bytes(34)
    kinds = {"audio/wav": wav, "image/png": png, "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf, "application/zip": zipped, "audio/flac": flac}
    for kind, data in kinds.items():
        assert media.identify(data, "text/plain") == kind
        assert media.identify(data[:-3] if kind != "audio/flac" else data[:20], kind) == "application/octet-stream"  # refuted
    mixed = b"junk RIFF BM GIF89a " + png + b"\xff\xd8\xff" + wav + b"%PDF-"
    assert [(k, d) for k, d in media.carve(mixed)] == [("image/png", png), ("audio/wav", wav)]
    assert media.identify(b"hello", "text/plain") == "text/plain" and media.sniff(None) == [] and media.identify(png[:-5] + b"\0" + png[-4:], None) == "application/octet-stream"
    assert media.identify(media.to_wav(png + bytes(60))) == "audio/wav" and len(media.sniff(media.to_wav(png))) == 1


def check_packing(rows, ids_of, texts, sequence):
    want = Counter()
    for i, t in texts:
        ids = [*ids_of(t or ""), 0]
        first = len(ids) % sequence or sequence
        for k, a in enumerate([0, *range(first, len(ids), sequence)]):
            cut = ids[a : first + k * sequence]
            want[i, k, a, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= sequence
    return len(places)


@pytest.mark.parametrize("sequence", [32, 2048])
def test_packing(docs, empty, texts, sequence):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ids_of = lambda t: own.encode(t, add_special_tokens=False).ids
    rows = packing.pack(docs, path, sequence).collect()
    n = check_packing(rows, ids_of, texts, sequence)
    assert n <= math.ceil(sum(r["length"] for r in rows) / sequence) * 1.02 + 1
    assert packing.pack(empty, path, sequence).count() == 0
    kept = packing.pack(docs, path, sequence, keep_ids=True).filter("doc_id = 0").collect()
    assert [x for r in sorted(kept, key=lambda r: r["piece"]) for x in struct.unpack(f"<{r['length']}I", r["ids"])] == [*ids_of(texts[0][1]), 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_is_the_library(name):
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(tokenizer_path(name)), random.Random(1)
    odd = ["", " ", "a<|endoftext|>b", "  x \n\n y\t", "é日本🤗 1234 don't I'LL", "   x", *("".join(rng.choice("ab é\n\t'sRE日🤗.,12 ") for _ in range(40)) for _ in range(200))]
    assert packing.tokenizer(tokenizer_path(name))(odd) == [e.ids for e in own.encode_batch(odd, add_special_tokens=False)]


def test_bin_completion_is_optimal_on_small_cases():
    from functools import lru_cache

    def fewest(items, size):
        @lru_cache(None)
        def go(left, room):
            if not left:
                return 0
            best = 10**9
            for k in range(len(left)):
                if k and left[k] == left[k - 1]:
                    continue
                rest = left[:k] + left[k + 1 :]
                best = min(best, go(rest, room - left[k]) if left[k] <= room else 1 + go(rest, size - left[k]))
            return best

        return 1 + go(tuple(sorted(items, reverse=True)), size)

    rng = random.Random(3)
    for _ in range(40):
        size = rng.choice((10, 17, 30))
        items = [rng.randint(1, size) for _ in range(rng.randint(1, 8))]
        plan = packing.bin_completion(Counter(items), size)
        assert Counter(x for f, n in plan for x in f * n) == Counter(items) and all(sum(f) <= size for f, _ in plan)
        assert sum(n for _, n in plan) == fewest(items, size)
    assert packing.bin_completion({}) == [] and packing.bin_completion({2048: 10**9, 1: 2048 * 10**6}, 2048)[0] == ((2048,), 10**9)
    with pytest.raises(ValueError):
        packing.bin_completion({0: 1})


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(900, k) for k in range(901, 950)] + [(5, 5), (None, 3), (4, None)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root = brute_components(1000, real)
    assert got == {x: root[x] for e in real for x in e}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(t):
    import xxhash

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [16, 1])
def test_simhash(docs, empty, texts, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    got = simhash.near_duplicates(docs).collect()
    f = [fingerprint(t) for _, t in texts]
    root = brute_components(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    assert key((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == key((i, f[k], least.get(root[k])) for k, (i, _) in enumerate(texts))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("bucket", [16, 1])
def test_links_of_dense_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    f = [0, 1, 3, 2**64 - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        f += [x] + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for _ in range(9)]
    f = list(dict.fromkeys(f))
    edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in f], "fp long"))
    at = {simhash.signed(x): k for k, x in enumerate(f)}
    pairs = [(at[r["a"]], at[r["b"]]) for r in edges.collect()]
    assert all((f[a] ^ f[b]).bit_count() <= 2 for a, b in pairs)
    assert brute_components(len(f), pairs) == brute_components(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        line = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        poor, toxic = k % 4 == 0, k % 5 == 0
        if toxic:
            line[rng.randrange(len(line))] = rng.choice(("idiot", "Scum!", "blargen" + rng.choice("xyz")))
        text = " ".join(line)
        rows.append((k, " ".join(w.upper() + "!!" for w in line) if poor and k % 8 else " ".join(x for x in line[:10] for _ in range(9)) if poor else text))
        toxic = toxic and not (poor and not k % 8)
        labels.append((k, int(not poor), int(toxic)))
    rows += [(1000, ""), (1001, None), (None, "some words here"), (3, rows[3][1])]
    labels += [(1001, 1, 0), (None, 0, 1), (2000, 1, 1), (3, 1, None), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, labels), {i: (q, t) for i, q, t in labels[:400]}


@pytest.mark.parametrize(("part", "column", "folds", "held", "threshold"), [(quality, 0, 5, 0, 0.3), (toxicity, 1, 3, 1, 0.7)])
def test_classifiers(spark, empty, labelled, part, column, folds, held, threshold):
    docs, labels, truth = labelled
    got = part.score(docs, part.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    tested = [(r["score"] >= threshold) == truth[r["doc_id"]][column] for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % folds == held]
    assert len(tested) > 50 and sum(tested) / len(tested) > 0.95
    # Labels of the held-out fold change nothing.
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    other = labels.withColumns({c: F.when(fold == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert key((r["doc_id"], r["score"]) for r in part.score(docs, part.learn(docs, other)).collect()) == key((r["doc_id"], r["score"]) for r in got)
    none = part.learn(docs, labels_of(spark, []))
    assert part.score(docs, none).count() == docs.count() and part.score(empty, none).count() == 0


def test_filters_keep_columns(spark, docs, labelled):
    _, labels, _ = labelled
    for out in (quality.keep_good(docs, labels), toxicity.keep_clean(docs, labels)):
        assert out.schema == docs.schema and 0 < out.count() <= docs.count()


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 9, 40):
        for values in (10**6, 3):
            h, least = rng.integers(0, values, n).astype(np.uint64), 4
            found = list(zip(*(x.tolist() for x in substrings.compact_windows(h + np.uint64(1), least)), strict=True))
            assert all(r - l + 1 >= least and l <= c <= r and h[c] == h[l : r + 1].min() for l, c, r in found)
            for i in range(n):
                for j in range(i + least - 1, n):
                    assert any(l <= i and j <= r and h[c] == h[i : j + 1].min() for l, c, r in found)
    long = np.ones(3000, np.uint64)
    l, c, r = substrings.compact_windows(long, 46)  # every equal place is a node of the one interval
    assert set(l.tolist()) == {0} and set(r.tolist()) == {2999} and c.tolist() == list(range(3000))
    l, c, r = substrings.compact_windows(long, 46, 64)
    assert (c - l).max() == (r - c).max() == 64 and substrings.spread(c, long, 16).sum() == -(-3000 // 16)


@pytest.mark.parametrize("frequent", [20, 1])
def test_passages(docs, empty, texts, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "SAMPLE", 1 if frequent == 1 else 64)
    monkeypatch.setattr(substrings, "CHUNK", 4 if frequent == 1 else 16_384)
    words = {i: (t or "").encode().lower().split() for i, t in texts if i is not None}
    got = substrings.passages(docs).collect()
    spans = {}
    for r in got:
        a, b = (set(substrings._shingles(words[r[i]][r[s] : r[e]], 5)) for i, s, e in (("doc_id", "start", "end"), ("source_id", "source_start", "source_end")))
        assert r["source_id"] < r["doc_id"] and min(r["end"] - r["start"], r["source_end"] - r["source_start"]) >= 50
        assert abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    first, need = {}, set()
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - 49):
            at = first.setdefault(tuple(w[k : k + 50]), i)
            if at != i:
                need.add(i)
                # Links go to the earliest document; where a later one shares some words more, the span may end those words earlier.
                assert max(min(e, k + 50) - max(s, k) for s, e in spans[i]) >= 40
    assert need <= spans.keys() and not spans.keys() & {400, 401, 402, 403, 404, 405, 406, 407}
    assert substrings.passages(empty).count() == 0


def test_cutting_repeats(docs, texts):
    cut = substrings.cut_repeats(docs)
    assert cut.schema.names == docs.schema.names and cut.count() == len(texts)
    after = [(r["doc_id"], r["text"]) for r in cut.collect()]
    windows = Counter(w for w in (tuple((t or "").encode().lower().split()[k : k + 50]) for i, t in after if i != 3 for k in range(len((t or "").split()) - 49)) if len(set(w)) > 2)
    assert max(windows.values()) == 1
    kept = dict(after)
    assert kept[300] == dict(texts)[300] and kept[401] is None and kept[405] == dict(texts)[405]
    assert substrings.without("a b  c\nd e", [(1, 3)]) == "a d e" and substrings.without("a b", [(0, 2)]) == "" and substrings.without("a b c d", [(0, 2), (1, 3)]) == "d"


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16)).astype(np.float32)
    near = [base[k % 6] + 0.02 * rng.standard_normal(16).astype(np.float32) for k in range(80)]
    edge = [base[10] + s * rng.standard_normal(16).astype(np.float32) for s in np.linspace(0.02, 0.3, 30)]
    x = [*base, *near, *edge, *base[:3], *base[:3], 3 * base[4]]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0]), (905, [float("inf")] * 16), (906, [])]
    df = spark.createDataFrame([(i, v, 0, 5, 6) for i, v in rows + bad], "vec_id long, embedding array<float>, label int, node long, block int")
    u = np.array(x, np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    links = u @ u.T >= 0.95
    root = brute_components(len(x), [(a, b) for a in range(len(x)) for b in range(a) if links[a, b]])
    want = {k: (int(links[k].sum()) - 1, root[k], root[k] == k) for k in range(len(x))} | {i: (0, i, True) for i, _ in bad}
    for chunk in (4096, 16):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        assert {r["vec_id"]: tuple(r[1:]) for r in vectors.near_duplicates(df).collect()} == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0 and vectors.near_duplicates(df.filter("vec_id >= 900")).count() == 7
    twice = vectors.near_duplicates(df.filter("vec_id < 2").union(df.filter("vec_id < 1"))).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in twice) == [(0, 1), (0, 1), (1, 0)]


def test_language_model(spark, docs, empty, texts):
    small = {"alphabet": 40, "contexts": 8, "lookup": 60}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = [(i, language_model.words_of(t)) for i, t in texts]
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    got = language_model.score(docs, **small).collect()
    want = [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(map(base, ws)), 4)) for i, ws in words]
    assert key((*r[:5], round(r["base_score"], 4)) for r in got) == key(want) and all(r["score"] <= 0 for r in got)
    assert key(tuple(r[:5]) for r in language_model.score(docs).collect()) == key(w[:5] for w in want)
    assert language_model.score(empty).count() == 0
    lost = language_model.score(spark.createDataFrame([(i, "x y") for i in range(2000) if held(i)], "doc_id long, text string")).first()
    assert (lost["n_known"], lost["train_tokens"], lost["score"], lost["base_score"]) == (0, 0, 0.0, 0.0)


def test_language_model_is_a_distribution(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    train = [(i, " ".join(vocabulary[min(59, int(rng.paretovariate(0.7)))] for _ in range(30))) for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    seen = sorted({w for _, t in train for w in t.split()})
    held = [i for i in range(100_000, 103_000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(seen) + 1]
    probes = list(zip(held, ["" if k == 0 else seen[k - 1] for k in range(len(seen) + 1)], strict=False))
    probes.append((next(i for i in range(200_000, 201_000) if zlib.crc32(str(i).encode()) % 10 == 0), "never-seen"))
    df = spark.createDataFrame(train + probes, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(df, alphabet=12, contexts=5, lookup=20).collect()}
    # Brute force: contexts counted here, seated by the operator's own restaurants, scored token by token.
    tokens = {i: language_model.words_of(t) for i, t in train + probes}
    c = Counter(w for i, _ in train for w in tokens[i])
    rank = sorted(c, key=lambda w: (-c[w], language_model.word_hash(w)))
    steps = lambda n: math.floor(8 * math.log2(n))
    top = [w for w in rank if steps(c[w]) > steps(c[rank[20]])] if len(rank) > 20 else rank
    used = min(12, len(top))
    dish = {w: k for k, w in enumerate(top[:used])}
    place = {w: k for k, w in enumerate(top) if k < 4}
    table = np.zeros((5, used + 1), np.int64)
    for i, _ in train:
        for u, w in zip([language_model.END, *tokens[i]], tokens[i], strict=False):
            table[place.get(u, 4), dish.get(w, used)] += 1
    chance = np.log10(language_model.fit_contexts(table))
    rare = [w for w in c if w not in dish]
    rest = language_model.fit_rest(spark.createDataFrame([(language_model.word_hash(w), c[w]) for w in rare], "h long, c long"))
    inner = lambda w: math.log10(rest.probability(np.array([c[w]]), np.array([language_model.word_hash(w) if w in c else 0]))[0])
    one = lambda u, w: chance[place.get(u, 4), dish.get(w, used)] + (0 if w in dish else inner(w))
    for i, ws in tokens.items():
        assert abs(got[i] - sum(one(u, w) for u, w in zip([language_model.END, *ws], ws, strict=False))) < 1e-3
    # Over the whole vocabulary and the unknown word the probabilities of what follows any word sum to 1.
    for u in [language_model.END, *rank[:6], rank[-1]]:
        assert abs(sum(10 ** one(u, w) for w in [*c, b"never-seen"]) - 1) < 1e-6
    counts = np.array([[5, 0, 2, 9], [0, 0, 0, 0], [100, 1, 1, 0]])
    assert np.allclose(language_model.fit_contexts(counts).sum(1), 1)
    c, h = np.array([3, 1, 1, 1, 2, 40]), np.arange(6, dtype=np.int64) * 7919
    rest = language_model.fit_rest(spark.createDataFrame(list(zip(h.tolist(), c.tolist(), strict=True)), "h long, c long"))
    total = rest.probability(c, h).sum() + rest.probability(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    assert abs(total - 1) < 1e-9


def test_seating():
    c = np.array([0, 1, 2, 50, 10_000, 10**9])
    t = language_model.seat(c, np.full(6, 0.5), 0.6, np.zeros(6, np.int64), 1)  # one key: the larger ones carry on where the smaller stop
    assert (t <= c).all() and t[0] == 0 and t[1] == 1 and (np.diff(t[2:]) >= 0).all()
    many = language_model.seat(np.full(20_000, 2), np.full(20_000, 0.4), 0.6, np.arange(20_000), 3)
    assert abs((many - 1).mean() - 0.4 / (0.4 + 1 - 0.6)) < 0.02
    # Against customers seated one by one, in the mean and the spread of tables.
    rng = np.random.default_rng(2)
    for c, new, d in ((200, 3.0, 0.7), (2000, 0.8, 0.5)):
        t = np.ones(2000)
        for k in range(1, c):
            t += rng.random(2000) < new / (new + k - d * t)
        got = language_model.seat(np.full(2000, c), np.full(2000, new), d, np.arange(2000), 5)
        assert abs(got.mean() - t.mean()) < 0.05 * t.mean() + 0.1 and abs(got.std() - t.std()) < 0.1 * t.std() + 0.1
    u = (np.arange(4000) + 0.5) / 4000
    for n, p in ((7, 0.3), (40, 0.9), (5000, 0.001), (5000, 0.4)):
        drawn = language_model.binomial(np.full(4000, n), np.full(4000, p), u)
        assert (np.diff(drawn) >= 0).all() and abs(drawn.mean() - n * p) < 0.02 * n * p + 0.02 and abs(drawn.var() - n * p * (1 - p)) < 0.05 * n * p * (1 - p) + 0.05


def test_sentencepiece(docs, empty, texts):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = pieces.encode(docs, model).collect()
    want = []
    for i, t in texts:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), ids, sp.decode(ids)))
    assert key((r["doc_id"], r["n_tokens"], pieces.unpack(bytes(r["ids"])), r["decoded"]) for r in got) == key(want)
    assert pieces.encode(empty, model).count() == 0
    for r in got:
        assert len(r["span_ends"]) == len(r["ids"])
    e = pieces.encoder(model)
    for _, t in texts[:60]:
        ids, ends = e.encode(t or "")
        raw = (t or "").encode()
        assert ends[-1] == len(raw) and ends == sorted(ends)
        for i, a, b in zip(ids, [0, *ends], ends, strict=False):
            if not sp.is_byte(i) and not sp.is_control(i) and i != sp.unk_id() and "▁" not in (t or ""):
                assert sp.id_to_piece(i).replace("▁", " ").strip(" ") == raw[a:b].decode().strip(" ")


def double_array(keys):
    """A double-array trie over byte keys in the layout of the compiled character map, by first fit; values are offsets."""
    tree = {}
    for k, value in keys.items():
        node = tree
        for b in k:
            node = node.setdefault(b, {})
        node[None] = value
    units, used, bases = {0: 0}, {0}, set()

    def place(at, node):
        labels = [0 if b is None else b for b in node]
        base = 1
        while base in bases or any((base ^ b) in used for b in labels) or base == at or (at ^ base) >= 1 << 21:
            base += 1
        bases.add(base)
        used.update(base ^ b for b in labels)
        units[at] = units.get(at, 0) | (at ^ base) << 10 | (None in node) << 8
        for b, child in node.items():
            if b is None:
                units[base] = 0x80000000 | child
            else:
                units[base ^ b] = b
        for b, child in node.items():
            if b is not None:
                place(base ^ b, child)

    place(0, tree)
    return [units.get(k, 0x7FFFFFFF & 0xFF) for k in range((max(units) | 255) + 1)]


def test_character_map():
    rules = {"ﬁ": "fi", "①": "1", "é": "é", "éx": "EX", "​": "", " ": " ", "K": "k"}
    pool, at = b"", {}
    for k, v in rules.items():
        at[k.encode()] = len(pool)
        pool += v.encode() + b"\0"
    units = double_array(at)
    blob = struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + pool
    n = pieces.Normalizer(blob, dummy_prefix=False, escape=False)
    out, source = n("aﬁéxéK​①z")
    assert out.decode() == "afiEXék1z"
    raw = "aﬁéxéK​①z".encode()
    assert source[0] == 0 and source[1] == source[2] == 1 and source[3] == source[4] == 4 and source[-1] == len(raw) and source[-2] == len(raw) - 1
    trimmed, source = pieces.Normalizer(blob, extra_spaces=True)("  a   b ")
    assert trimmed.decode() == "▁a▁b" and source[-1] == len("  a \u00a0 b".encode()) and source[3] == 2
    assert pieces.Normalizer(blob, extra_spaces=True)("   ")[0] == b"" and pieces.Normalizer()("a b")[0].decode() == "▁a▁b"


def test_shared_folder(spark, docs):
    at = common.scratch(spark)
    assert at == common.scratch(spark) and common.shared_table(docs.select("doc_id"), "x").count() == docs.count()
