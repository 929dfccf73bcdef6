"""Rows that share ids, clashing columns, empty tables, and the query functions against brute force."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from streamlens.llm import language_model, pieces, quality, queries, simhash, substrings, toxicity, vectors
from tests.llm.test_corpus import brute_components, check_packing, fingerprint

LONG = [" ".join(f"{p}{k}" for k in range(40)) for p in ("red", "green", "blue")]


def test_texts_that_share_an_id_are_groups_of_their_own(spark):
    clash = "doc_id long, text string, _kept string, _n int, id long, of long, own long, mark long, k int, row int"
    rows = [(1, LONG[0], "a"), (1, LONG[1], "b"), (1, LONG[2], "c"), (2, LONG[1], "d"), (3, LONG[0], "e"), (3, LONG[0], "e"), (None, LONG[0], "f"), (None, None, "g"), (4, None, "h"), (5, "", "i")]
    docs = spark.createDataFrame([(i, t, n, *range(7)) for i, t, n in rows], clash)
    got = simhash.keep_first(docs)
    assert got.schema == docs.schema
    assert sorted(r["_kept"] for r in got.collect()) == ["a", "b", "c", "f", "g", "h"]
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_one_row_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(50)] + [(7, None), (8, "other"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    got = quality.labelled_sample(docs, labels, "quality", F.lit(True)).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(7, 1), (8, 0)]


def test_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0)
    for out in (simhash.keep_first(docs), substrings.cut_repeats(docs), quality.keep_good(docs, labels), toxicity.keep_clean(docs, labels)):
        assert out.columns == docs.columns and out.count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_votes_against_every_cosine():
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((60, quality.TERMS))).astype(np.float32) * (rng.random((60, quality.TERMS)) < 0.05)
    y = (rng.random(60) < 0.4).astype(float)
    voters = quality.fit(x, y, 8)
    got = voters.score(x[:20])
    for k in range(20):
        a = (x[k] * voters.weights) @ voters.directions
        cosine = [float(a @ v) / max(float(np.linalg.norm(a)), 1e-12) for v in voters.vectors]
        near = sorted(range(60), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        vote = [max(cosine[j], 0) ** quality.SHARPNESS + 1e-9 for j in near]
        assert abs(got[k] - sum(v * y[j] for v, j in zip(vote, near, strict=True)) / sum(vote)) < 1e-4


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    accuracy, votes = (0.95, 0.85, 0.7, 0.9, 0.8), np.zeros((4000, 6), np.int8)
    for k, a in enumerate(accuracy):
        right = rng.random(4000) < a
        votes[:, k] = np.where(right == truth, 1, -1) * (rng.random(4000) < 0.7)
    votes[:, 5] = votes[:, 4]  # one that repeats another counts half
    posterior, got, weight = toxicity.label_model(votes, 0.3)
    assert np.abs(got[:5] - accuracy).max() < 0.06
    assert abs(weight[4] - 0.5) < 0.1 and weight[0] > 0.9
    assert ((posterior > 0.5) == truth).mean() > 0.88
    # Once settled, each row's posterior follows, voter by voter, from the chances that the posteriors give.
    mass = {1: posterior, 0: 1 - posterior}
    for i in range(0, 4000, 400):
        odds = np.log(0.3 / 0.7)
        for j in range(6):
            same = votes[:, j] == votes[i, j]
            p, q = ((mass[y][same].sum() + toxicity.SMOOTHING) / (mass[y].sum() + 3 * toxicity.SMOOTHING) for y in (1, 0))
            odds += weight[j] * np.log(p / q)
        assert abs(posterior[i] - 1 / (1 + np.exp(-odds))) < 1e-3


def test_terms_are_dropped_by_rows_not_counts():
    toxic = np.array([True] * 6 + [False] * 4)
    rows = {0: np.array([0, 1, 2]), 1: np.array([3, 4, 5]), 2: np.array([0, 1]), 3: np.array([0, 1, 2, 7])}
    assert toxicity._distinct([0, 1, 2, 3], ["bomenta", "bomentb", "bomentc", "bomentd"], rows, toxic) == [0, 1]


def test_vectors_of_several_lengths_and_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, []), (6, None), (7, [0.0, 0.0]), (8, [1e-300, 0.0, 1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got[1] == got[2] == (1, 1) and got[3][1] == got[4][1] == 3 and got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (0, 7)


def test_spans_are_those_of_the_library(spark, sf_dir):
    import sentencepiece

    model = queries.tokenizer_path("piece_bpe_32k.model")
    sp, e = sentencepiece.SentencePieceProcessor(model_file=model), pieces.encoder(model)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    texts += ["", " ", "  two  spaces ", "a\u2581b", "\u2581", "🤗 ñ\u0301 \x00x", "<s></s> <unk>", "中文 и русский\r\n\t", "\ufeffx"]
    for t in texts:
        ids, ends = e.encode(t)
        told = sp.encode(t, return_type="proto").pieces
        assert ids == [sp.bos_id(), *(p.id for p in told), sp.eos_id()] and ends[0] == 0 and ends[-1] == len(t.encode())
        assert ends[1:-1] == [p.end for p in told]
        # Without a character map, from the pieces' lengths alone: one space is put before the text, and a character's bytes end with its last.
        if t and "\u2581" not in t and "\0" not in t and sp.unk_id() not in ids:
            widths = [1 if sp.is_byte(i) else 0 if sp.is_control(i) else len(sp.id_to_piece(i).replace("\u2581", " ").encode()) for i in ids]
            at, starts = np.cumsum(widths) - 1, {0}
            for c in t:
                starts.add(max(starts) + len(c.encode()))
            assert ends == [max(s for s in starts if s <= max(0, x)) for x in at.tolist()]


def test_a_cut_character_map_does_no_harm():
    blob = struct.pack("<I4I", 16, 1 << 10 | 512, 5, 6, 7) + b"x"
    for k in range(len(blob)):
        pieces.Normalizer(blob[:k] if k >= 4 else b"")("some text\x01\x02")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_query_of_packing(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    check_packing(queries.op3_best_fit_packing(spark, sf_dir).collect(), lambda t: own.encode(t, add_special_tokens=False).ids, rows, 2048)


def test_query_of_simhash(spark, sf_dir, rows):
    rows = sorted(rows)
    f = [fingerprint(t) for _, t in rows]
    root = brute_components(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])
    got = queries.op4_simhash(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{f[k]:016x}", rows[root[k]][0]) for k, (i, _) in enumerate(rows)]


def test_query_of_passages(spark, sf_dir, rows):
    """Every run of 50 words that an earlier document has lies in what is reported, and what is reported is similar."""
    words = {i: t.encode().lower().split() for i, t in rows}
    seen: dict[int, set[int]] = {}
    for r in queries.op6_passages(spark, sf_dir).collect():
        a, b = (set(substrings._shingles(words[r[i]][r[s] : r[e]], 5)) for i, s, e in (("doc_id", "start", "end"), ("source_id", "source_start", "source_end")))
        assert r["source_id"] < r["doc_id"] and abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
        seen.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            if first.setdefault(tuple(words[i][k : k + 50]), i) != i:
                assert seen.get(i, set()) >= set(range(k, k + 50))


def test_query_of_the_language_model(spark, sf_dir, rows):
    got = queries.op9_language_model(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"]) for r in got) == sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(language_model.words_of(t))) for i, t in rows)
    held = [r for r in got if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    # The model's perplexity on texts it did not learn from is below that of the base.
    assert 10 ** (-sum(r["score"] for r in held) / n) < 0.8 * 10 ** (-sum(r["base_score"] for r in held) / n)


def test_query_of_sentencepiece(spark, sf_dir, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = []
    for i, t in rows:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r[:4]) for r in queries.op10_sentencepiece(spark, sf_dir).collect()) == sorted(want)
