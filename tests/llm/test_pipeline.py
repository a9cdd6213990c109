"""Each stage of the pipeline on all documents of sf0.001 against a plain-Python or SQL version, on what its predecessor kept; then edges."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dup import brute_force
from wardspark.llm import personal, quality

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows by stage; each stage reads its predecessor's rows from Parquet, as run() does."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    out["input"] = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == COLUMNS
        rows = docs.collect()
        out[name] = {r.doc_id: r for r in rows}
        assert len(out[name]) == len(rows)
    out["best_fit_packing"] = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    return out


def test_quality_rules(stages):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    good = {i for i, kept in c.sql(quality.SQL).project("doc_id, kept").fetchall() if kept}
    assert stages["quality_rules"] == {i: stages["input"][i] for i in good}


def test_near_dedup(stages):
    texts = {i: r.text for i, r in stages["quality_rules"].items()}
    first = {i for i, (_, component) in brute_force(texts, 5, 80).items() if i == component}
    assert stages["minhash_near_dedup"] == {i: stages["quality_rules"][i] for i in first}


def test_substring_dedup(stages):
    """Nothing goes but passages that stand in an earlier document; no passage of 64 words stands in two."""
    before, after = stages["minhash_near_dedup"], stages["substring_dedup"]
    assert set(before) == set(after)
    grams = lambda t, n: {" ".join(w[i : i + n]) for w in [t.lower().split()] for i in range(len(w) - n + 1)}
    first = {}
    for i in sorted(before):
        for g in grams(before[i].text, 8):
            first.setdefault(g, i)
    for i, r in before.items():
        gone = grams(r.text, 8) - grams(after[i].text, 8)
        lost = Counter(r.text.lower().split()) - Counter(after[i].text.lower().split())
        assert after[i].n_chars == (len(after[i].text) if gone or lost else r.n_chars) or after[i].n_chars == len(after[i].text)
        # Every word that goes lies in a stretch of eight that an earlier document holds.
        earlier = Counter(w for g in grams(r.text, 8) if first[g] < i for w in g.split())
        assert not lost or sum((lost - earlier).values()) == 0
    seen = {}
    for i in sorted(after):
        for g in grams(after[i].text, 64):
            assert seen.setdefault(g, i) == i


def test_personal_data(stages):
    before, after = stages["substring_dedup"], stages["personal_data"]
    patterns = Counter((kind, votes, features) for r in before.values() for (kind, _, _), votes, features in personal.candidates(r.text or ""))
    model = personal.trained(sorted((*k, n) for k, n in patterns.items()))
    for i, r in before.items():
        assert after[i].text == personal.redacted_text(r.text, personal.all_spans(r.text, model)[1]) and not personal.base_spans(after[i].text)


def test_packing(stages):
    tok, p = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), stages["best_fit_packing"]
    docs = stages["personal_data"]
    assert set(p.doc_id) == set(docs)
    for i, x in p.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tok.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert x.length.sum() == len(ids) and list(x.piece) == list(range(len(x))) and (x.length[1:] == 2048).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in x.itertuples())
    g = p.groupby("sequence_id").length.sum()
    assert g.max() <= 2048 and len(g) <= -(-p.length.sum() // 2048) + 1


def test_edges(spark, tmp_path):
    """Nulls in every column, repeats, rows that share an id, clashing names; and no rows at all."""
    prose = lambda k: " ".join(f"the {w}{k}{i} of" for i, w in enumerate(["river", "stone", "paper", "light"] * 30))
    rows = [(1, prose(1), None, None, None, 5, None, "k"), (1, prose(1), "en", "a", 1, 6, True, None), (None, prose(2), None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, prose(1), "en", "a", 0, 1, False, "x"), (8, "", "en", "a", 0, 1, False, "x"), (9, " ".join(prose(100 + j) for j in range(40)), "en", "a", 0, 1, False, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, digest string"
    for name, some in (("some", rows), ("none", [])):
        path = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(path / "documents.parquet"))
        docs = spark.read.parquet(str(path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(path))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        left = sorted(((r.doc_id, r.shard) for r in docs.collect()), key=str)
        assert left == ([] if not some else sorted([(1, 5), (1, 6), (None, None), (9, 1)], key=str))
        out = corpus_pipeline.run(spark, str(path))
        assert sorted({r.doc_id for r in out.collect()}, key=str) == ([] if not some else [1, 9, None])
        assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
