"""The stages of the corpus pipeline, each against brute force on what the stage before kept."""

from __future__ import annotations

import pytest

import corpus_pipeline
from streamlens.llm import quality, queries, toxicity
from tests.llm.test_corpus import brute_components, check_packing, fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(spark, sf_dir, stages):
    assert len(corpus_pipeline.STAGES) == 5
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for before, after in stages[:-1]:
        assert after.columns == columns and 0 < after.count() <= before.count()
    for (before, after), part, keeps in ((stages[0], toxicity, lambda s: s < 0.7), (stages[1], quality, lambda s: s >= 0.3)):
        scored = part.score(before, part.learn(before, labels)).collect()
        assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored if keeps(r["score"])}
    before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    f = [fingerprint(t) for _, t in rows]
    root = brute_components(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])
    assert sorted(r["doc_id"] for r in after.collect()) == [rows[k][0] for k in range(len(f)) if root[k] == k]
    before, after = stages[3]
    old, seen = {r["doc_id"]: r["text"] for r in before.collect()}, {}
    for r in sorted(after.collect()):
        assert r["n_chars"] == len(r["text"]) and (r["text"] == old[r["doc_id"]] or len(r["text"]) < len(old[r["doc_id"]]))
        words = r["text"].encode().lower().split()
        for k in range(len(words) - 49):
            assert seen.setdefault(tuple(words[k : k + 50]), r["doc_id"]) == r["doc_id"]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    before, after = stages[4]
    check_packing(after.collect(), lambda t: own.encode(t, add_special_tokens=False).ids, [(r["doc_id"], r["text"]) for r in before.collect()], 2048)


def test_registered_queries(spark, sf_dir):
    import __spark_entry__ as driver

    names = driver.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_sharding", "op5_quality", "op7_toxicity"):
        assert names[name](spark, sf_dir).count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)
