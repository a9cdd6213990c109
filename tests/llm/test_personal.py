"""Personal data against the contract's patterns, the labelers' model on known reliabilities, and every column of the query against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest

from wardspark.llm import personal


def naive_base(text: str) -> list[tuple[str, int, int]]:
    """The four patterns as stated, leftmost and non-overlapping in each kind."""
    def luhn(d):
        return sum(n if k % 2 == 0 else n * 2 - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )
    return [(kind, *m.span()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m[0])]


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_reliabilities_are_recovered():
    """Votes drawn from labelers of known reliability and coverage: EM finds both the reliabilities and the truth."""
    rng, rates = random.Random(5), (0.95, 0.85, 0.7, 0.9)
    truth, counts = {}, Counter()
    for _ in range(40_000):
        y = rng.random() < 0.4
        votes = "".join("2" if rng.random() < 0.2 else str(int(y == (rng.random() < r))) for r in rates)
        counts[votes] += 1
        truth.setdefault(votes, [0, 0])[y] += 1
    p, found, share = personal.fitted(counts, rounds=200)
    assert all(abs(a - b) < 0.02 for a, b in zip(found, rates)) and abs(share - 0.4) < 0.02
    big = [v for v, n in counts.items() if n > 300]
    assert len(big) > 20 and all(abs(p[v] - truth[v][1] / sum(truth[v])) < 0.06 for v in big)


def test_every_column_of_the_query(spark):
    """The whole query at sf0.001 and on planted texts against patterns, labelers and classifier run in plain Python."""
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(zip(table.doc_id.tolist(), table.text.tolist()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    patterns = Counter((kind, votes, features) for t in texts.values() for (kind, _, _), votes, features in personal.candidates(t or ""))
    model = personal.trained(sorted((*k, n) for k, n in patterns.items()))
    assert personal.train(docs) == model
    for r in personal.op6_personal_data(spark, "/root/testdata/sf0.001").collect():
        t = texts[r.doc_id] or ""
        base = naive_base(t)
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in personal.BASE)
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        added = [s for s, votes, features in personal.candidates(t) if model.accepts(s[0], votes, features) and not any(a < s[2] and s[1] < b for _, a, b in base)]
        assert r.spans == told(base + sorted(added, key=lambda s: (personal.ADDED.index(s[0]), s[1])))


def test_added_kinds(spark):
    """Planted spans of every added kind are found; dates, commit ids, tokens and titles of plain prose are not."""
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    rows = []
    for i in range(400):
        k = i % 10
        rows.append((i, (
            f"my password: {key()} end", f"call tel: 415-555-{1000 + i} now", f"she was born: {1 + i % 28:02d}.0{1 + i % 9}.19{50 + i % 49} there", f"lives at: {i + 1} Old Mill Road today", f"signed: Dr. Jane Ro{'abcdefgh'[i % 8]} yes",
            f"released on 0{1 + i % 9}/0{1 + i % 9}/2019 in commit {hashlib.sha1(str(i).encode()).hexdigest()}", "the river runs under the old bridge and on", f"page {i} of the road map", f"I drank Dr Pepper number {i}", f"then Peter Miller{'abcdefgh'[i % 8]} came",
        )[k]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [s.kind for s in r.spans] for r in personal.spans(docs, personal.train(docs)).select("id", "spans").collect()}
    for k, kind in enumerate(("secret", "number", "birth", "address", "name")):
        assert all(got[i] == [kind] for i in range(400) if i % 10 == k), kind
    assert not any(got[i] for i in range(400) if i % 10 in (5, 6, 7, 8)) and all(got[i] == ["name"] for i in range(400) if i % 10 == 9)


def sha(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


#: Texts with and without personal data, in shares that the tests set.
TRUE = [f'token = "{sha(i)}" x' for i in range(20)] + [f"she was born 19{50 + i}-02-03 there" for i in range(40)] + ["wrote to Jane Roe today", "dear Mr Smith, hello", "Dr. Anna Weber signed"] + [f"lives at {i + 1} Old Mill Road today" for i in range(9)] + [f"call tel 415-555-{1000 + i} now" for i in range(9)]
FALSE = [f"fixed in commit {sha(i + 99)} now" for i in range(20)] + [f"released on 0{1 + i}/0{1 + i}/2019 ok" for i in range(9)] + [f"version 1.{1 + i}.2004 is" for i in range(9)] + [f"he met them on 03.0{1 + i}.1999 ok" for i in range(9)] + [f"I drank Dr Pepper number {i}" for i in range(5)] + ["the shop in Paul Street opens", "a house on Rosa Avenue"] + [f"page {i} of the road map" for i in range(9)] + [f"order 12 415 555 100{i} 77" for i in range(9)]


def counted(good: float, bad: float) -> Counter:
    counts: Counter = Counter()
    for texts, n in ((TRUE, good), (FALSE, bad)):
        for t in texts:
            for (kind, _, _), votes, features in personal.candidates(t):
                counts[kind, votes, features] += n / len(texts)
    return counts


def found(model, text):
    return [k for k, _, _ in personal.all_spans(text, model)[1]]


SHARES = [(1, 100_000), (5, 1000), (1, 1), (1000, 5), (100_000, 1)]


@pytest.mark.parametrize("good,bad", SHARES)
def test_shares_do_not_decide(good, bad):
    """New spans of both sides, at any share of true ones."""
    model = personal.trained([(*k, n) for k, n in counted(good, bad).items()])
    yes = {f'token = "{sha(7777)}"': "secret", "she was born 1988-12-01 x": "birth", "dob: 01.02.1977": "birth", "signed: Dr. Jane Roa yes": "name", "call Peter Millera now": "name", "at 77 Long Hill Road now": "address"}
    assert {t: found(model, t) for t in yes} == {t: [k] for t, k in yes.items()}
    no = [f"in commit {sha(1000)} we", f"checksum {sha(8)}", "version 1.2.2004", "released on 09/09/2019", "they met on 04.05.1998 in", "I drank Dr Pepper number 9", "Mr Right came", "Ms Office is", "Sr Engineer wanted", "page 9 of the road", "Jane Street is closed"]
    assert [t for t in no if found(model, t)] == []


def plain_model(counts: Counter):
    """The same method written anew: votes as numbers, sums in loops, one example at a time."""
    decided = {}
    for kind in personal.ADDED:
        mine = {(v, f): n for (k, v, f), n in counts.items() if k == kind}
        size = len(personal.LABELERS[kind])
        right = [0.8] * size

        def p(votes, right=right, size=size):
            odds = personal.PRIOR / (1 - personal.PRIOR)
            for j in range(size):
                odds *= {"1": right[j] / (1 - right[j]), "0": (1 - right[j]) / right[j], "2": 1}[votes[j]]
            return odds / (1 + odds)

        for _ in range(50):
            now = {v: p(v) for v, _ in mine}
            for j in range(size):
                agree = sum(n * (now[v] if v[j] == "1" else 1 - now[v]) for (v, _), n in mine.items() if v[j] != "2")
                right[j] = min(max((agree + 8) / (sum(n for (v, _), n in mine.items() if v[j] != "2") + 10), 0.55), 0.99)
        sides = {1: Counter(), 0: Counter()}
        for (v, f), n in mine.items():
            if not 0.4 < p(v) < 0.7:
                sides[int(p(v) > 0.5)][f] += n
        w, bias = Counter(), 0.0
        for _ in range(600 if sides[1] and sides[0] else 0):
            change, moved = Counter(), 0.0
            for y, side in sides.items():
                for f, n in side.items():
                    q = 1 / (1 + math.exp(-bias - sum(w[x] for x in enumerate(f))))
                    g = n / sum(side.values()) / 2 * (q - y)
                    moved += g
                    for x in enumerate(f):
                        change[x] += g
            for x in set(w) | set(change):
                w[x] -= 2 * (change[x] + 1e-3 * w[x])
            bias -= 2 * moved
        for v, f in mine:
            decided[kind, v, f] = bool(sides[1]) and (bias + sum(w[x] for x in enumerate(f)) > 0 if sides[0] else p(v) > 0.5)
    return decided


@pytest.mark.parametrize("good,bad", SHARES)
def test_decisions_against_a_model_written_anew(spark, good, bad):
    counts = counted(good, bad)
    model = personal.trained([(*k, n) for k, n in counts.items()])
    decided = plain_model(counts)
    assert {k: model.accepts(*k) for k in counts} == decided and 5 < sum(decided.values()) < len(decided) - 5


def test_training_in_tasks_is_the_same(spark):
    rows = [(i, t) for i, t in enumerate((TRUE + FALSE) * 3 + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    patterns = Counter((kind, votes, features) for _, t in rows for (kind, _, _), votes, features in personal.candidates(t or ""))
    assert personal.train(docs) == personal.trained(sorted((*k, n) for k, n in patterns.items()))


def test_kinds_without_evidence_are_refused():
    """Dates of nobody only: none is taken, not even one that its labelers like; births only: the labelers decide."""
    none = personal.trained([(*k, 9) for t in FALSE for (k, _, _), v, f in personal.candidates(t) for k in [(k, v, f)] if k[0] == "birth"])
    assert found(none, "she was born 1988-12-01") == [] and found(none, f'token = "{sha(1)}"') == [] and found(personal.trained([]), "she was born 1988-12-01") == []
    only = personal.trained([(*k, 9) for t in TRUE for (k, _, _), v, f in personal.candidates(t) for k in [(k, v, f)] if k[0] == "birth"])
    assert found(only, "she was born 1988-12-01") == ["birth"] and found(only, "version 1.2.2004") == []


def test_gazetteers_are_a_parameter():
    own = personal.Gazetteers(secret=frozenset({"sesam"}), given=frozenset({"xaver"}))
    (_, votes, _), = personal.candidates("sesam " + "aB3dE5fG" * 4)
    (_, mine, _), = personal.candidates("sesam " + "aB3dE5fG" * 4, own)
    assert votes[0] == "2" and mine[0] == "1"
    assert [s for s, *_ in personal.candidates("met Xaver Abc", own)] == [("name", 4, 13)] and not list(personal.candidates("met Xaver Abc"))


def test_words_before_are_not_cut():
    far = "secret" + " " * 500
    assert personal.words_before(far, len(far)) == ["secret"]
    assert personal.words_before("one two three four " + "x" * 90, 19) == ["two", "three", "four"]


def test_very_long_texts():
    text = ("word " * 200_000) + "mail a@b.org " + "9" * 5000 + " +1 " + "." * 100_000
    assert [s[0] for s in personal.base_spans(text)] == ["email"]
