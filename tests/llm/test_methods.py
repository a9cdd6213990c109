"""What the operators promise of their methods: same spans under any layout, exact scores, spread copies, binding capacities, scores of the model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardspark.llm import _elias_fano, language_model, packing, sharding, substring, tokens, topk

RNG = np.random.default_rng(11)


def prose(n: int, name: str) -> str:
    return " ".join(f"{name}{k}" for k in RNG.integers(0, 10**6, n))


def found(docs):
    rows = substring.spans(docs).select("row.doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.first_doc").collect()
    return sorted(tuple(r) for r in rows)


def test_spans_do_not_depend_on_the_layout(spark):
    copies = prose(24, "c")
    texts = [copies] * 60 + [prose(30, "a") + " " + copies + " " + prose(30, "b") for _ in range(20)] + [None, "", "short"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = found(docs.coalesce(1))
    assert one == found(docs.repartition(7)) == found(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3, "doc_id"))
    assert {r[0] for r in one} >= set(range(60)) and all(r[1:3] == (0, len(copies)) for r in one if r[0] < 60)


def test_repeated_passages_are_found(spark):
    """Passages of 60 words in texts of their own: all but the words of broken chunks at the ends go, nothing else, and one copy stays."""
    passages = [prose(60, f"p{k}x") for k in range(8)]
    texts, held = [], {}
    for i in range(80):
        k = int(RNG.integers(0, 9))
        text = prose(int(RNG.integers(0, 60)), "own") + (f" {passages[k]} " if k < 8 else " ") + prose(int(RNG.integers(0, 60)), "own")
        held.setdefault(k, []).append(i)
        texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rest = {r.doc_id: set(r.text.split()) for r in substring.without_repeats(docs).collect()}
    for k, at in held.items():
        for i in at:
            assert set(texts[i].split()) - rest[i] <= (set(passages[k].split()) if k < 8 and i != at[0] else set())
            if k < 8 and i != at[0]:
                assert len(set(passages[k].split()) & rest[i]) <= 32


def test_ties_of_the_first_document_and_rows_that_share_an_id(spark):
    p = prose(40, "t")
    docs = spark.createDataFrame([(5, p), (5, p), (9, p + " and more"), (None, p)], "doc_id long, text string")
    rest = [(r.doc_id, r.text) for r in substring.without_repeats(docs).collect()]
    assert rest.count((5, p)) == 2 and (None, p) in rest and all(len(t.split()) < 20 for i, t in rest if i == 9)


def test_large_components_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    rows = [(i, [float(x) for x in RNG.normal(0, 10 ** RNG.integers(0, 9), 6)]) for i in range(90)]
    rows += [rows[4], rows[4], (200, [3e30, -3e30]), (201, []), (None, [1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    good = {i: [min(max(math.floor(float(np.float32(x)) * 256), -(2**63)), 2**63 - 1) for x in w] for i, w in rows if i is not None}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.filter("id % 10 = 0"), 5).collect()}
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-min(max(sum(a * b for a, b in zip(good[q], w)), -(2**63)), 2**63 - 1), i) for i, w in good.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_copies_spread_over_buckets(spark):
    rows = spark.createDataFrame([(1, "same")] * 6000 + [(i, f"t{i}") for i in range(500)] + [(None, None)] * 40, "doc_id long, text string")
    out = sharding.external_shuffle(rows, 7, bucket_rows=64).select("row.doc_id", "row.text", "shard", "slot").toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 6540 and sizes.max() - sizes.min() <= 1 and all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    assert (out.text == "same").sum() == 6000 and out.text.isna().sum() == 40 and set(out.text.dropna()) == {"same", *(f"t{i}" for i in range(500))}
    per = (out.text == "same").groupby(out["shard"]).sum()
    assert per.max() < 1.1 * per.min()
    keys = sharding._spread(rows.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key")))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] == 1


def test_capacities_bind(spark):
    """Documents, attention cost and tokens each limit some sequence, and none is passed."""
    lengths = [int(x) for x in RNG.integers(1, 33, 300)] + [64] * 4 + [1] * 300
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    for limits in ({"documents": 4}, {"attention": 64 * 64}, {"documents": 3, "attention": 5000}, {}):
        p = packing.packed(pieces, tokens=128, group_pieces=200, weights=(1.0, 1.0, 1.0), **limits).toPandas()
        g = p.assign(cost=p.length**2).groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"), cost=("cost", "sum"))
        assert sorted(p.doc_id) == list(range(len(lengths))) and g.tokens.max() <= 128
        assert g.n.max() <= limits.get("documents", 10**9) and g.cost.max() <= limits.get("attention", 10**9)
        if "documents" in limits:
            assert g.n.max() == limits["documents"] and len(g) > -(-sum(lengths) // 128)
        if "attention" in limits:
            assert g.cost.max() > 0.9 * limits["attention"]
        for _, x in p.sort_values("offset").groupby("sequence_id"):
            assert (x.offset.to_numpy() == np.concatenate([[0], np.cumsum(x.length)[:-1]])).all()
    with pytest.raises(Exception, match="fits no sequence"):
        packing.packed(pieces, tokens=32).collect()


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.fillna("").tolist()
    texts += ["", " \n\t", "<|endoftext|> a<|endoftext|>", "don't  stop\r\n\r\n", "‍ é👍🏽", "".join(map(chr, RNG.integers(1, 0xD7FF, 4000).tolist()))]
    for t in texts:
        assert packing.token_ids(enc, t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_offsets_decode_parts(spark):
    """Whole texts and single pre-tokens come back by the offsets; a quantile and a truncated total agree with the lengths."""
    import regex

    texts = {i: t for i, t in enumerate(["", None, "it's  a long\n\nway — é 👍🏽 100%", "x" * 5000, "a b"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = tokens.rank_file()
    encoded = tokens.encode_documents(docs, path)
    assert {r.id: bytes(r.data).decode() for r in tokens.decode_documents(encoded, path).collect()} == {i: t or "" for i, t in texts.items()}
    pieces = {i: regex.findall(public_tokenizers.PATTERN, t or "") for i, t in texts.items()}
    for first, last in ((0, 1), (1, 3), (2, 100)):
        assert {r.id: bytes(r.data).decode() for r in tokens.decode_documents(encoded, path, first, last).collect()} == {i: "".join(p[first:last]) for i, p in pieces.items()}
    with pytest.raises(Exception, match="offsets do not fit"):
        tokens.decode_documents(encoded.withColumn("starts", F.transform("starts", lambda s: s + 1)), path).collect()
    n = np.sort([len(r.ids) for r in encoded.collect()])
    h = tokens.length_histogram(tokens.token_lengths(docs, path), block=3)
    for q in (0.0, 0.2, 0.5, 0.61, 1.0):
        assert tokens.quantile(h, q).first()[0] == n[max(0, math.ceil(q * len(n)) - 1)]


def test_elias_fano():
    for values in ([], [0], [5, 5, 5], sorted(RNG.integers(0, 2**60, 3000).tolist()), sorted(RNG.integers(0, 50, 400).tolist()), list(range(1000))):
        v = np.array(values, dtype=np.uint64)
        low_bits, (lows, highs, zeros) = _elias_fano.EliasFano.parts(v)
        ef = _elias_fano.EliasFano(len(v), low_bits, lows, highs.view("<u8"), zeros.view(np.int64))
        assert (ef.get(np.arange(len(v))) == v).all()
        keys = np.unique(np.concatenate([v, v + np.uint64(1), np.zeros(1, np.uint64)]))
        at = {int(x): i for i, x in reversed(list(enumerate(values)))}
        assert ef.find(keys).tolist() == [at.get(int(k), -1) for k in keys]


def test_trie_looks_up_within_the_node():
    words = np.unique(RNG.integers(0, 2**63, 300).astype(np.uint64))
    draw = lambda k: (int(RNG.integers(0, len(words))), int(RNG.integers(0, 40) if k % 2 else RNG.integers(0, 2**32)))
    pairs = sorted({p for p in map(draw, range(4000)) if p[0] != 9})  # word 9 has no contexts
    triples = sorted({(int(RNG.integers(0, len(pairs))), int(RNG.integers(0, 6) if k % 2 else RNG.integers(0, 2**32))) for k in range(9000)})
    column = lambda rows, k, t: np.array([r[k] for r in rows], dtype=t)
    values = [(np.arange(n) + at).astype(np.uint16) for n, at in ((len(words), 60_000), (len(pairs), 20_000), (len(triples), 0))]
    trie = _elias_fano.Trie(words, values[0], [(column(pairs, 0, np.int64), column(pairs, 1, np.uint64), values[1]), (column(triples, 0, np.int64), column(triples, 1, np.uint64), values[2])])
    at_pair, at_triple = {p: k for k, p in enumerate(pairs)}, {t: k for k, t in enumerate(triples)}

    def want(w, v, u):
        p = at_pair.get((w, v))
        return int(values[0][w]) if p is None else int(values[2][t]) if (t := at_triple.get((p, u))) is not None else int(values[1][p])

    ask = [(*pairs[p], u) for p, u in triples] + [(*draw(k), int(RNG.integers(0, 6))) for k in range(3000)] + [(9, 3, 1)]
    got = trie.lookup(words[[a[0] for a in ask]], [column(ask, 1, np.uint64), column(ask, 2, np.uint64)], 1)
    assert got.tolist() == [want(*a) for a in ask]
    assert (trie.lookup(words[:5] + np.uint64(1), [np.zeros(5, np.uint64)] * 2, 1) == 1).all()
    trie.close()


def test_trie_of_training_tokens_scores_others():
    """A trie from some tokens gives the counts of any: seen triples, seen pairs with other contexts, seen words, and words it does not know; hot ones have their known counts."""
    draw = lambda n: [RNG.integers(4, 30, n).astype(np.uint64) << np.uint64(2), RNG.integers(0, 6, n).astype(np.uint64), RNG.integers(0, 5, n).astype(np.uint64)]
    w, v, u = draw(3000)
    order = np.lexsort((u, v, w))
    w, v, u = w[order], v[order], u[order]
    hot_word, hot_pair = np.uint64(40), (np.uint64(48), np.uint64(3))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    key = language_model.pair_keys(np.array([hot_pair[0]]), np.array([hot_pair[1]]))
    corpus = language_model.Corpus(10**6, 5000, 100, 1, np.array([hot_word]), np.array([77_777]), key, np.array([5555]), *none)
    train = (w != 60) & (w != hot_word)
    trie = language_model.built(w, v, u, train, corpus)
    words, pairs, triples = Counter(w[train].tolist()), Counter(zip(w[train].tolist(), v[train].tolist())), Counter(zip(w[train].tolist(), v[train].tolist(), u[train].tolist()))
    words[40], pairs[48, 3] = 77_777, 5555
    asked = draw(2000)
    at_word, at_pair, at_triple = trie.find(asked[0], asked[1:])
    for i, t in enumerate(zip(*(x.tolist() for x in asked))):
        assert ((at_word[i] >= 0), (at_pair[i] >= 0), (at_triple[i] >= 0)) == (t[0] in words, t[:2] in pairs, t in triples)
        if t[0] in words:
            assert trie.more[0][at_word[i]] == words[t[0]] and trie.values[0][at_word[i]] == corpus.numerator(0.0, 0.0, words[t[0]])
        if t[:2] in pairs:
            assert trie.values[1][at_pair[i]] == corpus.numerator(0.0, pairs[t[:2]], words[t[0]])
            assert trie.more[2][at_pair[i]] == corpus.denominator(np.array([t[0]], np.uint64), np.array([pairs[t[:2]]]), np.array([words[t[0]]]))[0]
        if t in triples:
            assert trie.values[2][at_triple[i]] == corpus.numerator(triples[t], pairs[t[:2]], words[t[0]])
    assert (at_triple >= 0).any() and ((at_pair >= 0) & (at_triple < 0)).any() and (at_word < 0).any() and not (at_triple[asked[0] == 60] >= 0).any()
    trie.close()


@pytest.mark.parametrize("shard_tokens", [40, 500, 10**6])
def test_scores_of_the_model(spark, shard_tokens):
    """Every score against plain Python, within a step of the quantisation a token; and the model's probabilities of a context add up to one."""
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").head(60)
    texts = dict(zip(table.doc_id.tolist(), [t[:800] for t in table.text.fillna("")])) | {10**6: None, 10**6 + 1: "", 10**6 + 2: "The THE the " * 4000, 10**6 + 3: "x y"}
    rows = list(texts.items()) + [(10**6 + 3, "x y")]
    got = {r.doc_id: r for r in language_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens).collect()}
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    word, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    triple = Counter(x for t in train for x in zip(["<s>", "<s>", *t], ["<s>", *t], t))
    n, v = sum(word.values()), len(word)
    word["<s>"] = pair["<s>", "<s>"] = len(train)
    p = lambda w: (word[w] + 0.5) / (n + 0.5 * (v + 1))
    a, b = language_model.A, language_model.B
    for i, t in texts.items():
        ts = tokens(t)
        want = sum(math.log10(triple[x, y, w] + b * (pair[y, w] + a * p(w))) - math.log10(pair[x, y] + b * (word[y] + a)) for x, y, w in zip(["<s>", "<s>", *ts], ["<s>", *ts], ts))
        step = (language_model.HIGH - language_model.LOW) / 65535
        assert abs(got[i].score - want) <= len(ts) * step + 1e-6
        assert abs(got[i].base_score - sum(math.log10(p(w)) for w in ts)) < 1e-6
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(ts), sum(word[w] > 0 for w in ts), n, zlib.crc32(str(i).encode()) % 5 == 1)
    some = ["</s>", *(w for w in word if w not in ("<s>", "</s>")), "never seen"]
    for x, y in (("<s>", "<s>"), ("<s>", "the"), ("the", "the"), ("x", "y"), ("none", "known")):
        total = sum((triple[x, y, w] + b * (pair[y, w] + a * p(w))) / (pair[x, y] + b * (word[y] + a)) for w in some)
        assert abs(total - 1) < 1e-9
