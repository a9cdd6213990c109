"""Each operator against brute force on small tables with nulls, empty and long texts, repeats, and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardspark.llm import _bpe, language_model, near_dup, packing, personal, quality, sharding, substring, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [None, "", "   \n", "one", "two words", "a b c", "a b c", "Mail jo@x.org or +1 (523) 555-7040 ip 1.2.3.4 x 300.1.1.1", f"start {PASSAGE} end", f"other begin {PASSAGE} tail of it", "w " * 3000, "it's <|endoftext|> don't", " ".join(f"v{i}" for i in range(300)), " ".join(f"v{i}" for i in range(299)) + " zz"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, 1, None) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None)]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA).cache()


def test_bpe_matches_the_library(docs):
    ranks = _bpe.read_ranks(tokens.rank_file())
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in tokens.digest_documents(docs, tokens.rank_file()).collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_histogram(docs):
    h = tokens.length_histogram(tokens.token_lengths(docs, tokens.rank_file()), block=4)
    n = np.array([r.n_tokens for r in tokens.token_lengths(docs, tokens.rank_file()).collect()])
    for r in h.collect():
        assert r.truncated_tokens == np.minimum(n, r.n_tokens).sum() and r.docs_at_least == (n >= r.n_tokens).sum()
    assert tokens.truncated_total(h, 7).first()[0] == np.minimum(n, 7).sum()


def test_top_k_and_ties(spark):
    rows = [(i, [0.5, float(i % 3), None if i == 7 else 0.0]) for i in range(120)] + [(120, None), (121, [float("nan")]), (3, [0.5, 0.0, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.filter("id % 50 = 0"), 5).collect()}
    good = {i: [math.floor(256 * x) for x in w] for i, w in rows[:120] if i != 7}
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(good[q], w)), i) for i, w in good.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got[6].component_id == 5 and not got[6].kept and got[13].component_id == 12 and got[0].n_shingles == 0 and got[1].kept and got[None].kept
    assert got[8].component_id == 8 and got[10].n_shingles == 1


def test_estimate_keeps_links_at_the_limit():
    """85 of the 128 least values are shared: under five sigmas, but likelier than 1e-9 at a similarity of 0.85."""
    both, a, b = np.arange(85), np.arange(85, 107), np.arange(107, 128)
    far = np.arange(1000, 1400)
    x, y = (np.concatenate([both, own, far]).astype(np.uint64) for own in (a, b))
    assert near_dup._alike(x, y, 85) and not near_dup._alike(x, np.concatenate([y, np.arange(2000, 2050).astype(np.uint64)]), 85)


def test_near_duplicates_of_no_rows(docs):
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_substring(docs):
    found = {r.doc_id: r for r in substring.spans(docs).select("row.doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").filter("doc_id in (8, 9)").collect()}
    assert set(found) == {8, 9} and found[9].first_doc == 8 and found[9].words >= 40
    rest = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert rest[8] == TEXTS[8] and "passage30 " not in rest[9] and rest[0] is None and rest[None] == "null id"


def test_substring_spans_stand_in_their_first_document(spark):
    """What a document is the first to hold stays in it; brute force on texts put together from common parts."""
    p, q = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 32), ("q", 16)))
    rng = np.random.default_rng(3)
    parts = [" ".join(f"{k}word{i}" for i in range(rng.integers(3, 40))) for k in range(12)] + ["same " * 90, "same " * 200]
    texts = [f"a b c {p} d e f", f"g h i {p} {q} j k l", f"m n o {p} {q} r s t"] + [" ".join(parts[k].strip() for k in rng.integers(0, len(parts), 6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring.spans(docs).select("row.doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").collect()
    words = lambda t: f" {' '.join(t.lower().split())} "
    assert {r.first_doc for r in found if r.doc_id == 2} == {0, 1}
    for r in found:
        assert r.first_doc <= r.doc_id and words(texts[r.doc_id][r.start : r.end]) in words(texts[r.first_doc])
    rest = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert "q4 q5 q6 q7 q8 q9 q10 q11" in rest[1] and "q8" not in rest[2] and "p16" not in rest[1]
    for part in parts:
        held = [rest[i] for i, t in enumerate(texts) if words(part) in words(t)]
        assert not held or all(any(w in t.split() for t in held) for w in part.split())


def test_personal_base():
    base = personal.base_spans(TEXTS[7])
    assert [s[0] for s in base] == ["email", "ip", "phone"]
    assert personal.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    model = personal.trained([])
    assert personal.all_spans("", model) == ([], [])


def test_long_tokens_are_candidates():
    """A key on one line is a candidate at any length."""
    for n in (512, 513, 20_000):
        (span, votes, _), = personal.candidates("secret: " + ("aB3dE5fG" * n)[:n] + " end")
        assert span == ("secret", 8, 8 + n) and votes[2] == "1"


def test_sharding_law(docs):
    rows = docs.select("doc_id", "text", "shard")
    out = sharding.external_shuffle(rows, 4, bucket_rows=3).select("row.doc_id", "shard", "slot").toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    again = sharding.external_shuffle(rows.repartition(3), 4, bucket_rows=3).select("row.doc_id", "shard", "slot").toPandas()
    key = ["shard", "slot"]
    pd.testing.assert_frame_equal(out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_sharding_query_reads_the_written_records(spark, tmp_path):
    """The digests are of the records in the shards that write_shards lays out for the same table and seed."""
    texts = {i: None if i == 5 else f"text {i} " * (1 + 900 * (i % 40)) for i in range(120)}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op7_external_shuffle(spark, str(tmp_path)).collect()}
    assert {i: (r["size"], r.text_crc32) for i, r in got.items()} == {i: (len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    sharding.write_shards(spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards")).select("row.doc_id", "row.text", "row.lang", "shard", "slot").collect()
    assert {r.doc_id: (r.text, r.lang) for r in written} == {i: (t, "en") for i, t in texts.items()} and len(written) == len(texts)
    assert {r.doc_id: (r.shard, r.slot) for r in written} == {i: (r.shard, r.slot) for i, r in got.items()}
    assert len({(r.shard, r.slot) for r in written}) == 120 and {r.shard for r in written} == set(range(40))


def test_packing(docs):
    p = packing.packed(packing.pieces_of(docs, tokens.rank_file())).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, x in p[p.doc_id.notna() & (p.doc_id != 3)].groupby("doc_id"):
        ids = np.array(tok.encode(TEXTS[int(doc)] or "", add_special_tokens=False).ids + [0], "<u4")
        assert x.length.sum() == len(ids) and (x.length.sort_values()[1:] == 2048).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in x.itertuples())
    assert p.groupby("sequence_id").length.sum().max() <= 2048 and p.sequence_id.nunique() == -(-p.length.sum() // 2048)
    bins, _ = packing.best_fit(np.array([5, 5, 5, 5]), 20, 2, 400)
    assert sorted(Counter(bins.tolist()).values()) == [2, 2]


def test_language_model(docs):
    got = language_model.scores(docs, shard_tokens=50).filter("doc_id <> 3").toPandas().set_index("doc_id")
    tok = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    all_docs = [(r.doc_id, tok(r.text)) for r in docs.collect()]
    train = [t for i, t in all_docs if not language_model.held_out(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in all_docs:
        if i is not None and i != 3:
            assert abs(got.base_score[i] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-9
            assert (got.n_tokens[i], got.n_known[i], got.train_tokens[i]) == (len(t), sum(c[w] > 0 for w in t), n)


def test_quality(docs):
    got = {r.doc_id: r for r in quality.judged(docs).select("row.doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()}
    assert got[10].n_words == 3000 and got[10].n_repeat_words == 3000 and got[10].base_failed and not got[0].kept and got[0].n_words == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_with_clashing_names(spark):
    """Columns named like measures and verdicts are carried, not read."""
    good = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, good, 7, True, "x"), (2, "short", 9, True, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept boolean, base_failed string")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == rows[:1]
    assert {r.doc_id: (r.n_words, r.own) for r in quality.judged(docs).selectExpr("row.doc_id", "n_words", "row.n_words as own").collect()} == {1: (120, 7), 2: (1, 9)}


def test_very_long_texts(spark):
    """One text of 600,000 words among short ones, through the operators that read words."""
    text = " ".join(f"w{i % 90_001}" for i in range(600_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 w3"), (3, text + " end")], "doc_id long, text string")
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert near[1].n_shingles == 90_001 and near[3].component_id == 1 and near[2].component_id == 2
    assert {r.doc_id: r.n_tokens for r in language_model.scores(docs, 100_000).collect()} == {1: 600_001, 2: 4, 3: 600_002}
    assert {r.doc_id: len(r.text.split()) for r in substring.without_repeats(docs).collect()}[3] < 600
