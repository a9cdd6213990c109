"""Every operator on a table without rows, and on one whose texts are all null."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardspark.llm import language_model, near_dup, neighbours, packing, personal, phrases, quality, sharding, spelling, substring, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "substring": lambda d: substring.spans(d),
    "without_repeats": lambda d: substring.without_repeats(d),
    "tokens": lambda d: tokens.digest_documents(d, RANKS),
    "near_duplicates": lambda d: near_dup.near_duplicates(d),
    "personal": lambda d: personal.spans(d, personal.train(d)),
    "redact": lambda d: personal.redact(d, personal.train(d)),
    "sharding": lambda d: sharding.external_shuffle(d, 4),
    "packing": lambda d: packing.packed(packing.pieces_of(d, RANKS)),
    "language_model": lambda d: language_model.scores(d),
    "quality": lambda d: quality.judged(d),
    "neighbours": lambda d: neighbours.scores(d, neighbours.fitted(d, d.selectExpr("doc_id", "0 as label"))),
}
#: What these return is no row for each document.
GROUPED = {"spelling": lambda d: spelling.variants(spelling.vocabulary(spelling.slipped_runs(d))), "phrases": lambda d: phrases.collocations(d)}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(i, None, None, None, None, None, None) for i in range(12)], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_texts(nulls, name):
    assert OPERATORS[name](nulls).count() == 12


@pytest.mark.parametrize("name", GROUPED)
def test_groups_of_nothing(nothing, nulls, name):
    assert GROUPED[name](nothing).collect() == [] and GROUPED[name](nulls).collect() == []


def test_histogram_of_no_rows(nothing):
    assert tokens.length_histogram(tokens.token_lengths(nothing, RANKS)).collect() == []


def test_top_k_of_no_rows(spark):
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v, 5).collect() == []


def test_pipeline_keeps_columns_and_stages(spark, tmp_path):
    """Stage by stage against what each may change; duplicates and short texts go, the others stay once."""
    prose = lambda k: " ".join(f"the {w}{k}{i} of" for i, w in enumerate(["river", "stone", "paper", "light"] * 30))
    rows = [(1, prose(1), "en", "a", 0), (2, prose(1), "en", "a", 0), (3, prose(3) + " write to jo@example.org now", "en", "b", 0), (4, "too short", "en", "b", 0), (5, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(left["quality_rules"]) == {1, 2, 3} and set(left["minhash_near_dedup"]) == {1, 3}
    assert left["substring_dedup"] == {1: prose(1), 3: rows[2][1]}
    assert "jo@example.org" not in left["personal_data"][3] and left["personal_data"][1] == prose(1)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 3}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
