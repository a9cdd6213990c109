"""Spelling variants, phrase collocations and votes of neighbours against SQL and brute force, with nulls, ties, repeats, long texts and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wardspark.llm import neighbours, phrases, queries, spelling

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEW = ("op11_spelling_variants", "op12_phrase_collocations")
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, word string, n long, key long, size int, score double, label int"


def as_docs(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 0.5, 1) for r in rows], CLASH)


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (int, float, np.integer)) else v for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(queries.SQL[name]).df())


def words_of(rows):
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return count


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(n: dict[str, int]):
    others = defaultdict(set)
    for a, b in combinations(sorted(n), 2):
        if near(a, b):
            others[a].add(b)
            others[b].add(a)
    best = {w: min(others[w], key=lambda o: (-n[o], o)) for w in n if others[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(others[w]), n[form[w]] if w in form else None) for w in n}


def read(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_against_brute_force(spark):
    """Edits at every place of words of every length, chains of forms, ties, accents, capitals, a very long text, rows that repeat and rows without id."""
    rng = np.random.default_rng(3)
    base = ["straße", "Émigré", "letter", "lettre", "colour", "parallel", "aaaaa", "aaaaaa", "abcdefghijklmnopqrst"]
    words = [w for w in base for _ in range(40)]
    for w in base:
        for i in range(len(w) + 1):
            edits = [w[:i] + c + w[i:] for c in "aé"] + ([w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]] if i < len(w) else [])
            words += [e for e in edits for _ in range(int(rng.integers(1, 12)))]
    words += [w for k in range(7) for w in ["chainlink" + "abcdefg"[: 7 - k]] * (3 * 2**k)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::23]).replace(" ", " - 1 ", 3), None) for i in range(23)]
    rows += [rows[2], (None, "letter letter Letters", None), (50, None, None), (51, "", "x"), (52, "12 34", "x"), (53, "verylongtext letter " * 20_000, "x")]
    n = {w: c for w, c in words_of(rows).items() if len(w) >= 5 and c >= 3}
    want = variants_by_hand(n)
    assert read(spelling.variants(spelling.vocabulary(spelling.slipped_runs(as_docs(spark, rows))))) == want
    assert max(len(w) for w in want) > 19 and sum(f is not None for f, *_ in want.values()) > 50
    assert want["chainlinkabcdefg"][1] != want["chainlinkabcdefg"][0]


def test_random_vocabulary_of_any_length(spark):
    """Short words over two letters are near each other in every way; words of one letter have an empty half."""
    rng = np.random.default_rng(4)
    n = {"".join(rng.choice(list("ab"), int(rng.integers(1, 9)))): int(rng.integers(1, 200)) for _ in range(400)}
    assert read(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == variants_by_hand(n)


def collocations_by_hand(rows, least, most_words, percent, top):
    pieces = []
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            pieces.append(("und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)))
    f, total = Counter(), Counter()
    for lang, w in pieces:
        total[lang] += len(w)
        f.update((lang, tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= percent * a:
            continue
        cuts = [(Fraction(10**6 * a * a, f[lang, w[:k]] * f[lang, w[k:]]).__floor__(), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, x in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize("most_words,least,top", [(2, 2, 7), (3, 3, 1000), (5, 2, 1000)])
def test_collocations_against_brute_force(spark, monkeypatch, most_words, least, top):
    """Runs of few texts, pieces of all kinds, words that repeat and overlap, ties, languages that are null or say "und"."""
    monkeypatch.setattr(phrases, "RUN", 600)
    rng = np.random.default_rng(most_words)
    vocabulary, ends = ["new", "New", "york", "city", "of", "the", "é", "l'eau", "a", "b|c", " x"], [" "] * 12 + ["\t", ". ", ",", "!", "\n", "\x0b", " ; ", "  "]
    rows = [(i, "".join(str(rng.choice(vocabulary)) + str(rng.choice(ends)) for _ in range(int(rng.integers(0, 60)))), [None, "und", "en", "de"][i % 4]) for i in range(120)]
    rows += [rows[1], (None, "new york city", None), (500, None, "en"), (501, " \n. ", None), (502, "of of of of", "en"), (503, "the very long text of " * 9000, "en")]
    got = sorted(tuple(r) for r in phrases.collocations(as_docs(spark, rows), least, most_words, 50, top).collect())
    assert got == collocations_by_hand(rows, least, most_words, 50, top)


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits are cut and floored exactly."""
    a, l, r = 3 * 10**12 + 1, 4 * 10**12 + 7, 5 * 10**12 + 9
    one = spark.createDataFrame([(1, l), (2, r)], "w0 long, n long")
    two = spark.createDataFrame([(1, 2, a)], "w0 long, w1 long, n long")
    got = phrases._scored({1: one, 2: two}, 2).first().best
    assert (got.score, got.at, got.l, got.r) == (10**6 * a * a // (l * r), 1, l, r)


@pytest.mark.parametrize("distinct,apart", [(5, 1), (40_000, 300), (70_000, 70_000)])
def test_relations_are_narrow_bytes(distinct, apart):
    """Runs of few and many words, near and far pieces are read back whole; a place takes no more bytes than its gap and words need."""
    rng = np.random.default_rng(distinct)
    known = np.unique(rng.integers(0, 2**64 - 1, distinct, dtype=np.uint64))
    local = [rng.permutation(np.resize(np.arange(len(known)), 90_000)) for _ in range(3)]
    place = 7 + np.cumsum(rng.choice([1, 1, 2, apart], 90_000))
    batch = phrases._relation(known, place, local)
    (got_known, got_place, got_words), = phrases._read(batch, 3)
    assert (np.diff(got_place) == np.diff(place)).all()
    assert (got_known[got_words] == known[np.stack(local, axis=1)]).all()
    assert batch.nbytes <= 8 * len(known) + 90_000 * ((1 if apart < 256 else 2 if apart < 65536 else 4) + 3 * (2 if len(known) <= 65536 else 4)) + 100


def test_relations_have_small_row_groups(spark):
    """A reader of a relation holds a few runs at once, however large the file is."""
    docs = spark.createDataFrame([("en", "one two three four")] * 60, "lang string, text string").coalesce(1)
    with phrases.arrow_rows(spark, 2):
        found = docs.mapInArrow(lambda batches: (phrases._relation(np.arange(9, dtype=np.uint64), np.arange(5), [np.arange(5)]) for _ in batches), phrases._RELATION)
        _, path = phrases.written(found, **phrases._FILES)
    files = [pq.read_metadata(x) for x in Path(path.removeprefix("file:")).glob("*.parquet")]
    assert sum(m.num_rows for m in files) == 30
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= phrases.RUNS


def test_bitmaps_hold_every_group(spark):
    rng = np.random.default_rng(8)
    keys = list(rng.integers(0, 2**64 - 1, (3, 5000), dtype=np.uint64))
    held = phrases.Frequent(spark.createDataFrame([(int(h),) for h in phrases._hashed(keys)], "h long"))
    assert held.holds(keys).all()
    assert held.holds(list(rng.integers(0, 2**64 - 1, (3, 5000), dtype=np.uint64))).mean() < 0.2


def naive_terms(text: str) -> dict[str, Counter]:
    """The parts of a text, without hashing."""
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]

    def shape(x):
        kinds = "".join("a" if c > "\x7f" or c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in x)
        return re.sub(r"(.)\1+", r"\1", kinds)

    windows, seen = Counter(), set()
    for i in range(len(w)):
        key = (*w[i : i + 3],) if i + 3 <= len(w) else ("", i)
        windows["again" if key in seen and i + 3 <= len(w) else "new"] += 1
        seen.add(key)
    return {"words": Counter(w), "shapes": Counter(map(shape, re.findall(r"[^\x20\x09-\x0D]+", text))), "length": Counter([int(2 * np.log2(len(w) + 1))]), "repeats": windows}


def test_terms_are_those_of_the_text():
    """Each part has the counts that plain Python gives, whatever the buckets are."""
    texts = ["The cat sat; THE CAT sat 12,000 times!!", "a b c a b c a b c", "", "É1 ## é", "x " * 70_000, "STOP!! GO!! stop"]
    blocks = np.concatenate(list(neighbours.term_counts(pa.array([*texts, None]))))
    assert len(blocks) == 7 and (blocks[6] == blocks[2]).all()
    for text, row in zip(texts, blocks):
        for k, want in enumerate(naive_terms(text).values()):
            part = row[neighbours._STARTS[k] : neighbours._STARTS[k + 1]]
            got = sorted(part[part > 0].tolist())
            assert got == sorted(want.values())


def test_votes_against_brute_force(spark):
    """Every document against every labelled one, one at a time, with the fitted basis; repeats, nulls, ids with two labels, clashing columns."""
    table = pd.read_parquet(f"{DATA}/documents.parquet")
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    rows = [(int(i), t, "x") for i, t in zip(table.doc_id, table.text)] + [(10**6, None, None), (10**6 + 1, "", None), (None, "no id here", None), (int(table.doc_id[0]), table.text[0], "x")]
    told = [(int(i), int(q)) for i, q in zip(labels.doc_id, labels.quality)] + [(int(labels.doc_id[0]), 1 - int(labels.quality[0])), (10**7, 1), (None, 1), (10**6, None)]
    docs = as_docs(spark, rows)
    voters = neighbours.fitted(docs, spark.createDataFrame(told, "doc_id long, label int"), dimensions=24)
    known = {i for i, _, _ in rows}
    assert sorted(voters.labels.tolist()) == sorted(y for i, y in told if i in known and i is not None and y is not None)
    counts = dict(zip([r[0] for r in rows], np.concatenate(list(neighbours.term_counts(pa.array([r[1] for r in rows]))))))
    df = (np.array([x for x in np.concatenate(list(neighbours.term_counts(pa.array([r[1] for r in rows]))))]) > 0).sum(0)
    assert np.allclose(voters.weights, np.maximum(np.log((1 + len(rows)) / (1 + df)), 0.05), rtol=1e-5)
    assert abs(voters.basis.T @ voters.basis - np.eye(24)).max() < 1e-3
    for r in neighbours.scores(docs, voters, 9).collect():
        v = voters.latent(counts[r.doc_id][None, :].copy())[0].astype(float)
        cosine = np.array([float(v @ u.astype(float)) for u in voters.vectors])
        order = np.argsort(-cosine)[:9]
        bound = np.sort(-cosine)[8:10]
        w = np.maximum(cosine[order], 0) ** neighbours.POWER
        if abs(bound[0] - bound[1]) > 1e-5:
            assert abs(r.score - (w * voters.labels[order]).sum() / w.sum()) < 1e-3
        assert 0 <= r.score <= 1


def test_equal_cosines_go_to_the_first():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.9], [0.1, 0.1, 0.1, 0.1, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert [sorted(r) for r in neighbours.nearest(cosine, 3).tolist()] == [[0, 1, 4], [0, 1, 2], [2, 3, 4]]


def test_leading_vectors():
    x = np.random.default_rng(2).standard_normal((300, 90)).astype(np.float32) * np.linspace(9, 0.1, 90).astype(np.float32) ** 2
    values = np.linalg.svd(x, compute_uv=False)
    got = neighbours.leading_vectors(x, 10, rounds=30)
    assert np.allclose(np.linalg.norm(x @ got, axis=0), values[:10], rtol=1e-3)
    assert neighbours.leading_vectors(x[:3], 10).shape == (90, 3)


def test_without_labels(spark):
    docs = as_docs(spark, [(1, "a b", None), (2, None, None)])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in neighbours.scores(docs, neighbours.fitted(docs, none)).collect()] == [0.5, 0.5]
    one = neighbours.fitted(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert {r.doc_id: round(r.score, 6) for r in neighbours.scores(docs, one).collect()} == {1: 1.0, 2: 1.0}


def test_a_sample_of_the_labels(spark):
    docs = as_docs(spark, [(i, f"text {i} of some", None) for i in range(200)])
    voters = neighbours.fitted(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int"), most=50)
    assert len(voters.labels) == 50 == len(voters.vectors)


def test_held_out_quality(spark):
    """On held-out labels at sf0.01: the query ranks good texts above bad ones and keeps the good."""
    got = queries.QUERIES["op13_quality_neighbours"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    y, rank = both.quality.to_numpy(), both.score.rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.85 and (both.predicted == both.quality).mean() > 0.9 and both.predicted[both.quality == 1].mean() > 0.95
