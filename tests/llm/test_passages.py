"""op6_passages: every document that holds a passage of an earlier one is reported, whatever else shares its min-hashes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from streamlens.llm import substrings


class Words:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def __call__(self, n):
        return [f"w{self.rng.getrandbits(40):x}" for _ in range(n)]


def index(a, b):
    a, b = (set(substrings._shingles([w.encode() for w in x], 5)) for x in (a, b))
    return len(a & b) / len(a | b)


def covered(spark, texts, need):
    """How many of need {doc_id: (start, end)} have at least 9 of 10 words of that span in reported passages."""
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(4)
    seen = {}
    for r in substrings.passages(docs).collect():
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8
        a, b = dict(texts)[r["doc_id"]][r["start"] : r["end"]], dict(texts)[r["source_id"]][r["source_start"] : r["source_end"]]
        assert min(len(a), len(b)) >= 50 and abs(index(a, b) - r["similarity"]) < 1e-9
        seen.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return sum(len(seen.get(i, set()) & set(range(s, e))) >= 0.9 * (e - s) for i, (s, e) in need.items())


def changed(words, at):
    return [*words[:at], "changed" + str(at) + words[at], *words[at + 1 :]]


def test_near_copies_that_are_similar_to_one_later_document_only(spark):
    new, texts, need = Words(1), [], {}
    for g in range(12):
        base = new(60)
        # The base is second: the first document's copy is similar to it but not to the other copies.
        for k, words in enumerate([changed(base, 6), base, *(changed(base, at) for at in range(10, 54, 4))]):
            i = 100 * g + k
            texts.append((i, new(30) + words + new(30)))
            if k:
                need[i] = (30, 90)
    assert covered(spark, texts, need) >= 0.97 * len(need)


@pytest.mark.parametrize("frequent", [20, 1])
def test_passages_of_frequent_lines(spark, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "SAMPLE", 64 if frequent == 20 else 4)
    monkeypatch.setattr(substrings, "CHUNK", 16_384 if frequent == 20 else 16)
    new = Words(2)
    stock = [new(12) for _ in range(8)]
    pick = random.Random(3)
    texts = [(i, [w for _ in range(3) for w in new(20) + pick.choice(stock)]) for i in range(240)]
    need = {}
    for p in range(12):
        passage = [w for line in pick.sample(stock, 5) for w in line]
        for k in range(3):
            i = 1000 + 100 * k + p
            texts.append((i, new(20) + passage + new(20)))
            if k:
                need[i] = (20, 80)
    assert covered(spark, texts, need) == len(need)


def test_one_changed_word_anywhere(spark):
    new, pick, texts, need = Words(4), random.Random(5), [], {}
    for g in range(120):
        base = new((55, 60, 66)[g % 3])
        words = changed(base, pick.randrange(len(base)))
        if index(base, words) >= 0.8:
            texts += [(2 * g, new(20) + base + new(20)), (2 * g + 1, new(20) + words + new(20))]
            need[2 * g + 1] = (20, 20 + len(base))
    assert covered(spark, texts, need) >= 0.97 * len(need)


def test_growth_against_all_intervals():
    rng = np.random.default_rng(6)
    for _ in range(60):
        least, n = 8, 22
        a = np.arange(n, dtype=np.uint64)
        b = np.where(rng.random(n) < 0.15, np.arange(n) + 100, np.arange(n)).astype(np.uint64)
        i = int(rng.choice(np.flatnonzero(a == b)))
        spans = [(s, e) for s in range(i + 1) for e in range(max(i + 1, s + least), n + 1)]
        best = max((a[s:e] == b[s:e]).sum() / (2 * (e - s) - (a[s:e] == b[s:e]).sum()) for s, e in spans)
        got = substrings.grown(a, b, i, i, 0.8, least)
        assert (got is not None) == (best >= 0.8)


@pytest.mark.parametrize(("copies", "gap"), [(2, 10), (6, 20)])
def test_passage_repeated_in_a_document(spark, copies, gap):
    new, texts, need = Words(7), [], {}
    for g in range(40):
        passage = new(60)
        texts += [(2 * g, new(20) + passage + new(20)), (2 * g + 1, new(20) + [w for _ in range(copies) for w in passage + new(gap)])]
        need[2 * g + 1] = (20, 20 + copies * (60 + gap) - gap)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    after = {r["doc_id"]: r["text"].split() for r in substrings.cut_repeats(docs).collect()}
    assert not [i for i in need if len(set(after[i]) & set(texts[i - 1][1])) >= 50]


def test_windows_of_equal_places():
    h = np.array([5, 1, 7, 1, 9, 1], np.uint64)
    found = zip(*(x.tolist() for x in substrings.compact_windows(h, 4)), strict=True)
    assert list(found) == [(0, 1, 5), (0, 3, 5), (0, 5, 5)]
    assert substrings.spread(np.array([0, 3, 16, 20, 40]), np.array([1, 1, 1, 2, 1]), 16).tolist() == [True, False, True, True, True]


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    new = Words(8)
    passage, unique = new(80), new(120)
    rows = [(1, passage, "a"), (2, passage + new(30), "b"), (2, unique, "c"), (None, passage, "d"), (3, None, "e"), (4, [], "f")]
    clash = "doc_id long, text string, _spans string, _id int, _text int, _word int, _bits int, spans int, mark int, own int, id int, cut int, row int, of int"
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), k, *range(11)) for i, w, k in rows], clash)
    got = substrings.cut_repeats(docs)
    assert got.schema.names == docs.schema.names
    after = {r["_spans"]: r["text"] for r in got.collect()}
    assert after["c"].split() == unique and after["a"].split() == passage and after["d"].split() == passage and after["e"] is None and after["f"] == ""
    assert len(after["b"].split()) == 30
    same = spark.createDataFrame([(5, " ".join(passage), 1), (5, " ".join(passage), 1), (6, " ".join(passage), 1)], "doc_id long, text string, n int")
    assert sorted((r["doc_id"], len(r["text"].split())) for r in substrings.cut_repeats(same).collect()) == [(5, 80), (5, 80), (6, 0)]
    assert substrings.cut_repeats(same.limit(0)).count() == 0


def test_recall_of_shifted_passages(spark):
    """480 documents that share parts of 60 common passages, each from another place on: by documents, words and pairs with brute force."""
    new, pick = Words(9), random.Random(10)
    common = [new(140) for _ in range(60)]
    texts = []
    for i in range(480):
        words = new(20)
        for p in pick.sample(common, 2):
            s = pick.randrange(0, 80)
            part = list(p[s : s + pick.randrange(52, 140 - s + 1)] if 140 - s > 52 else p[s:])
            if pick.random() < 0.3:
                part = changed(part, pick.randrange(len(part)))
            words += part + new(15)
        texts.append((i, words))
    first, need = {}, {}
    for i, w in texts:
        own = {tuple(w[k : k + 50]): k for k in range(len(w) - 49)}
        for g, k in own.items():
            if first.setdefault(g, i) != i:
                need.setdefault(i, set()).update(range(k, k + 50))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(4)
    seen = {}
    for r in substrings.passages(docs).collect():
        seen.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert need.keys() <= seen.keys()
    assert all(need[i] <= seen[i] for i in need)


def test_links_of_documents_whose_words_are_found_already(spark):
    """A later document has the same passage of many that are not similar to each other: it links them all, though one gives its words."""
    new, texts, want = Words(11), [], {}
    for g in range(12):
        base = new(60)
        first, second = changed(base, 6), changed(base, 53)  # each is similar to the base, but not to the other
        assert index(first, second) < 0.8 <= min(index(first, base), index(second, base))
        texts += [(10 * g + k, new(30) + words + new(30)) for k, words in enumerate((first, second, base, base, changed(base, 30)))]
        want |= {10 * g + k: 10 * g for k in range(4)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(4)
    got = {}
    for r in substrings.passages(docs).collect():
        got[r["doc_id"]] = got[r["source_id"]] = r["component_id"]
    assert sum(got.get(i) == c for i, c in want.items()) >= 0.97 * len(want)


def test_links_of_one_min_hash():
    """Rows of one min-hash, by brute force: what passages link is what all similar pairs link."""
    rng, least = np.random.default_rng(12), 20
    linked = 0
    for _ in range(40):
        base = rng.integers(0, 2**32, 60, np.uint32)
        rows = []
        for doc in range(14):
            body = base.copy()
            off = rng.random(60) < rng.choice([0.02, 0.08, 0.3])
            off[30] = False
            body[off] = rng.integers(0, 2**32, int(off.sum()), np.uint32)
            rows.append((0, doc, doc, 0, substrings.struct.pack("<3i", 30, 30, 29), body.tobytes()))

        def roots(pairs):
            root = list(range(14))
            for a, b in pairs:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
            return root

        pairs = []
        for a in range(14):
            for b in range(a):
                same = np.frombuffer(rows[a][5], np.uint32) == np.frombuffer(rows[b][5], np.uint32)
                spans = [(s, e) for s in range(31) for e in range(max(31, s + least), 61)]
                if any(same[s:e].sum() >= 0.8 * (2 * (e - s) - same[s:e].sum()) for s, e in spans):
                    pairs.append((a, b))
        found = [(r[0], r[4]) for r in substrings.compared(rows, least, 5, 0.8)]
        assert set(found) <= set(pairs) and roots(found) == roots(pairs)
        linked += roots(pairs) != roots((r[0], r[4]) for r in substrings.compared(rows, least, 5, 0.8, False))
    assert linked


def test_passages_of_small_blocks_are_handed_on_together():
    rng, rows = np.random.default_rng(13), []
    for v in range(300):
        body = rng.integers(0, 2**32, 60, np.uint32)
        for doc in (2 * v, 2 * v + 1):
            rows.append((v, 0, 0, 0, doc, doc, 0, substrings.struct.pack("<3i", 30, 30, 29), body.tobytes()))
            body[0] += 1
    got = list(substrings._blocks(46, 5, 0.8, True)(iter([substrings._batch(rows, substrings._BODY)])))
    assert [x for b in got for x in b.column("doc_id").to_pylist()] == list(range(1, 600, 2))
    assert len(got) == 1


def test_words_are_hashed_together_as_they_are_split(monkeypatch):
    monkeypatch.setattr(substrings, "_BYTES", 16)
    texts = ["", "Aa b", None, " \t\n\x0b\x0c\r", "aA\x0bB É \x1cx \x00  ", "w" * 33 + "Y z", "w" * 33 + "y " + "q" * 500 + " end", "a ab ba abba", "Z"]
    split = [(t or "").encode().lower().split() for t in texts]
    hashes, counts = substrings.word_hashes([(t or "").encode() for t in texts])
    assert counts.tolist() == [len(w) for w in split]
    words = [w for ws in split for w in ws]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    shingles, _ = substrings.shingle_hashes([b"a b c d e f", b"x", b"", b"B C D E F"])
    assert np.flatnonzero(shingles).tolist() == [0, 1, 7] and shingles[1] == shingles[7]
    assert not len(substrings.shingle_hashes([])[0]) and not len(substrings.shingle_hashes([b" ", b""])[0])


def test_windows_are_looked_for_a_stretch_at_a_time(monkeypatch):
    """By brute force, and the same whatever the stretch."""
    rng = np.random.default_rng(14)
    for stretch in (7, 1 << 15):
        monkeypatch.setattr(substrings, "_PLACES_AT", stretch)
        for _ in range(50):
            h, least, reach = rng.integers(0, 30, 90).astype(np.uint64), int(rng.integers(1, 12)), int(rng.integers(12, 40))
            want = []
            for c in np.flatnonzero(h).tolist():
                l = r = c  # noqa: E741
                while l > 0 and h[l - 1] >= h[c]:
                    l -= 1  # noqa: E741
                while r < 89 and h[r + 1] >= h[c]:
                    r += 1
                if r - l + 1 >= least:
                    want.append((max(l, c - reach), c, min(r, c + reach)))
            assert list(zip(*(x.tolist() for x in substrings.compact_windows(h, least, reach)), strict=True)) == want


def test_nothing_is_searched_where_every_word_of_a_window_is_found(monkeypatch):
    rng, asked = np.random.default_rng(15), []
    placed = substrings._placed
    monkeypatch.setattr(substrings, "_placed", lambda *a: asked.append(a) or placed(*a))
    base, rows = rng.integers(0, 2**32, 80, np.uint32), []
    for doc in range(2):
        body = base.copy()
        body[-5:] += np.uint32(doc)
        rows.append((0, doc, doc, 0, substrings.struct.pack("<3i", 35, 35, 35), body.tobytes()))
    assert substrings.compared(rows, 46, 5, 0.8) == [(1, 1, 0, 79, 0, 0, 79, 1.0)] and not asked


def _mutated(rng, rows, share):
    """Rows of one min-hash at place 40 of 80, with some shingles of a common body."""
    base, out = rng.integers(0, 2**32, 80, np.uint32), []
    for doc in range(rows):
        body, off = base.copy(), rng.random(80) < rng.choice(share)
        off[40] = False
        body[off] = rng.integers(0, 2**32, int(off.sum()), np.uint32)
        if doc % 3 == 0:  # moved to the right
            at = int(rng.integers(41, 80))
            body = np.concatenate([body[:at], rng.integers(0, 2**32, 2, np.uint32), body[at:]])[:80]
        out.append(body)
    return out


def test_passages_of_many_pairs_at_once_are_those_of_each():
    """Against _in_order, pair by pair."""
    rng, found, least = np.random.default_rng(16), 0, 30
    bodies = [b[int(rng.integers(0, 12)) : 80 - int(rng.integers(0, 12))] for b in _mutated(rng, 40, (0.02, 0.1, 0.2))]
    at = np.array([int(np.flatnonzero(b == _common(bodies))[0]) for b in bodies])
    values = np.unique(np.concatenate(bodies))
    numbered = np.full((40, int(at.max()) + max(len(b) - a for a, b in zip(at, bodies, strict=True))), len(values))
    for k, b in enumerate(bodies):
        numbered[k, at.max() - at[k] : at.max() - at[k] + len(b)] = np.searchsorted(values, b)
    spans = substrings._Spans(numbered, at, np.array([len(b) for b in bodies]) - at, len(values), least, 0.8)
    of, to = np.divmod(np.arange(1600), 40)
    for i, j, s, e in zip(of.tolist(), to.tolist(), *spans(of, to).tolist(), strict=True):
        order = substrings._Ordered(bodies[j])
        got = substrings._in_order(bodies[i], bodies[j], *substrings._placed(bodies[i], order.by, order.sorted), int(at[i]), 0.8, least)
        assert got is not False
        if e - s < 1 << 20:
            assert (got is None) == (s == e) and (got is None or (got[0], got[1]) == (s + at[i], e + at[i]))
            found += got is not None
    assert found > 400


def _common(bodies):
    return min(set.intersection(*(set(b.tolist()) for b in bodies)))


@pytest.mark.parametrize("rows", [40, 120])
def test_pairs_without_a_passage_are_not_searched_one_by_one(monkeypatch, rows):
    """Every two rows share many shingles, few have a passage or one with new words: the pairs grow with the square of the rows, what is
    searched does not."""
    asked, in_order = [], substrings._in_order
    monkeypatch.setattr(substrings, "_in_order", lambda *a: asked.append(a) or in_order(*a))
    bodies = _mutated(np.random.default_rng(17), rows, (0.07, 0.09))
    block = [(0, doc, doc, 0, substrings.struct.pack("<3i", 40, 40, 39), b.tobytes()) for doc, b in enumerate(bodies)]
    assert substrings.compared(block, 46, 5, 0.8)
    assert len(asked) <= 4 * rows


def test_links_and_words_are_the_same_however_pairs_are_looked_at(monkeypatch):
    rng = np.random.default_rng(18)
    for _ in range(6):
        block = [(0, doc, doc, 0, substrings.struct.pack("<3i", 40, 40, 39), b.tobytes()) for doc, b in enumerate(_mutated(rng, 36, (0.02, 0.08, 0.15)))]
        got = []
        for few, many in ((64, 8), (0, 0), (0, 1 << 20)):
            monkeypatch.setattr(substrings, "_FEW", few)
            monkeypatch.setattr(substrings, "_MANY", many)
            found = substrings.compared(block, 30, 5, 0.8)
            got.append((len(found), {(r[0], k) for r in found for k in range(r[2], r[3])}))
        assert got[0][1] == got[1][1] == got[2][1] and got[0][1]
