"""Near-duplicate components against brute force on the word shingles themselves."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from wardspark.llm import near_dup
from wardspark.llm._words import hashed_slice


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_force(docs: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component): every pair with a common shingle is compared."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    where, parent = defaultdict(list), {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in sorted(docs):
        met = Counter(j for s in sets[i] for j in where[s])
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in docs}


def held(spark, docs, width, percent):
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), width, percent).collect()
    assert len(got) == len(docs) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_all_documents(spark, width, percent):
    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    docs = dict(zip(table.doc_id.tolist(), table.text.tolist()))
    assert held(spark, docs, width, percent) == brute_force(docs, width, percent)


@pytest.mark.parametrize("edits", [2, 14])
def test_a_group_of_more_than_one_chunk(spark, monkeypatch, edits):
    """Near copies of one text, at few edits all linked, at more of them linked in part; with exact copies and a passage that unlike texts share."""
    monkeypatch.setattr(near_dup, "CHUNK", 64)
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(700):
        text = list(base)
        for k in rng.integers(0, len(base), rng.integers(0, edits + 1)):
            text[k] = f"x{rng.integers(0, 10**6)}"
        docs[i] = " ".join(text)
    docs |= {i: docs[i - 700] for i in range(700, 900)}
    docs |= {i: " ".join(base[:60] + [f"d{i}n{k}" for k in range(int(rng.integers(1, 80)))]) for i in range(900, 1100)}
    docs |= {i: t for i, t in enumerate([None, "", " \n", "one", "One", "a b", "a b c", "a b c d"], 1100)}
    assert held(spark, docs, 3, 85) == brute_force(docs, 3, 85)


def test_words_that_collide_in_polynomial_hashes(spark):
    """A Thue-Morse word and its complement are different words."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    assert held(spark, {1: word, 2: other}, 3, 85) == {1: (1, 1), 2: (1, 2)}


def test_hashes_of_words():
    """Equal words only share a hash, at any length and place; A-Z count as a-z."""
    rng = np.random.default_rng(2)
    known = sorted({bytes(rng.integers(97, 100, int(n)).tolist()) for n in rng.integers(1, 90, 4000)} | {b"\xc3\xa9", b"a\xc3\xa9", b"\x00", b"a\x00", b"a\x00\x00"})
    text = b"\n".join(known) + b"  " + b"\t".join(w.upper() for w in reversed(known))
    data = np.frombuffer(text, np.uint8)
    h, per = hashed_slice(data, np.array([0, len(text)]))
    assert per.tolist() == [0, 2 * len(known)] and len(set(h.tolist())) == len(known) and (h[: len(known)] == h[len(known) :][::-1]).all()
    one, _ = hashed_slice(np.frombuffer(b"xx " + known[7], np.uint8), np.array([0, 3, 3 + len(known[7])]))
    assert one[1] == h[7]


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (0, 1, 50, 400, 800)]
    got = near_dup._overlaps(sets, step=64)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
