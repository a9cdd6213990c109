"""Personal data: base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Further candidates (secrets, numbers without the base forms, dates of birth,
street addresses, names) get votes of several labelers: regex shapes, gazetteers
(of words in front, given names, surnames, places, streets; a parameter, some
thirty to eighty entries each by default) and context.  Each labeler looks at one
fact that no other looks at, and may vote against.  Votes are counted per kind over
all documents (3**4 rows a kind at most), expectation-maximisation estimates each
labeler's reliability and each vote pattern's probability, and these label the
examples of a logistic span classifier.  It sees features of the span and its
surroundings, not the votes.

How rare a kind or its true spans are must not decide: each kind is fitted by
itself, the prior of a true span is a parameter instead of the corpus's share, and
true and false examples weigh the same in the classifier.  A kind without any
likely true span in the training documents is refused; where there are only
likely true ones, the labelers' probability decides.
Accepted candidates that touch no base span are added.

Defined results: a null or empty text has no spans; very long texts are read
whole, in linear time; repeated rows each get a row; a null id is carried; an
empty table, or one without candidates, adds no spans; extra columns are
carried in a struct.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._shared import cut, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "birth", "address", "name")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}+(?![0-9A-Za-z_/+-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{2,3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every address has one at sign, so the scan goes from sign to sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Gazetteers:
    """In lower case, of four languages by default: words in front of a span for each kind, and for something else; what names and addresses are known by."""

    secret: frozenset[str] = _set("token secret password passwd pwd passwort kennwort contraseña passe key schlüssel clave apikey api_key access_key auth bearer credential credentials pin")
    number: frozenset[str] = _set("phone tel telephone call mobile cell fax ssn social contact telefon telefonnummer handy anruf teléfono tel. móvil téléphone portable llame appelez")
    birth: frozenset[str] = _set("born birth birthday birthdate dob geboren geburtsdatum geburtstag né née naissance nacido nacida nacimiento")
    address: frozenset[str] = _set("address addr lives resides at home ship deliver mail adresse anschrift wohnt wohnhaft domicilio dirección vive habite demeurant")
    name: frozenset[str] = _set("name contact attn dear patient customer tenant signed client kunde patientin mieter liebe lieber sehr cher chère estimado estimada cliente paciente")
    plain: frozenset[str] = _set("commit sha sha1 sha256 md5 checksum digest revision version release released isbn issn figure table page section doi build serial order invoice item model part updated published meeting due since")
    streets: frozenset[str] = _set("street st avenue ave road rd lane ln boulevard blvd drive dr court ct place pl square")
    titles: frozenset[str] = _set("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra")
    given: frozenset[str] = _set(
        "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah karen charles nancy daniel lisa jane anna emma laura peter paul"
        " hans klaus jürgen wolfgang ursula monika petra sabine stefan andreas heike uwe jean pierre michel marie françoise nathalie jacques camille luc"
        " josé maría carlos carmen juan ana luis lucía miguel sofía javier pilar pedro rosa"
    )
    surnames: frozenset[str] = _set(
        "smith johnson williams brown jones davis miller wilson moore taylor anderson jackson martin lee thompson harris clark lewis walker hall allen king wright scott hill"
        " müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf"
        " bernard dubois durand moreau laurent lefebvre leroy roux garcía gonzález rodríguez fernández lópez martínez sánchez pérez gómez díaz"
    )
    places: frozenset[str] = _set("london york chicago boston berlin hamburg münchen köln paris lyon marseille madrid barcelona sevilla wien zürich bruxelles dublin toronto sydney")
    common: frozenset[str] = _set(
        "pepper right office engineer president manager director doctor professor minister editor developer analyst world universe america bean big perfect wonderful wrong history city county street road avenue park school church hospital"
        " bank day night the a an you he she it we they and or of in on at to for is was his her this that"
    )
    prefixes: tuple[str, ...] = ("sk_", "pk_", "ghp_", "gho_", "AKIA", "xoxb-", "eyJ")


GAZETTEERS = Gazetteers()
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_WORD_BEFORE = re.compile(r"[\w-]+")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-]*[0-9])")
#: The labelers of each kind; votes: 1 for, 0 against, 2 none.
LABELERS = {"secret": ("words", "form", "texture", "frame"), "number": ("words", "form", "alone"), "birth": ("words", "year", "event"), "address": ("words", "form", "suffix", "inner"), "name": ("words", "given", "surname", "common")}
#: The share of true spans among candidates that is taken for granted.
PRIOR = 0.3
LIVED = (1900, 2015)


@functools.lru_cache(maxsize=8)
def _patterns(g: Gazetteers) -> tuple[tuple[str, re.Pattern, bool], ...]:
    """(kind, pattern, whether it has a digit) of the candidates."""
    known = lambda words: "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))
    address = rf"(?<![0-9.])[0-9]{{1,5}}[A-Za-z]?\x20(?:[^\W\d_][\w'.-]*\x20){{1,3}}(?i:{known(g.streets)})\b|\b[^\W\d_]+(?:straße|strasse|str\.)\x20[0-9]{{1,4}}\b|\b(?:[Rr]ue|[Cc]alle|[Aa]venida)\x20(?:[^\W\d_][\w'.-]*\x20){{1,4}}[0-9]{{1,4}}\b"
    name = rf"\b(?:{known(g.titles)})\.?\x20[A-ZÀ-Þ][\w'-]+(?:\x20[A-ZÀ-Þ][\w'-]+)?|\b(?:{known(w.capitalize() for w in g.given)})\x20[A-ZÀ-Þ][\w'-]+"
    return (("secret", _TOKEN, True), ("number", _NUMBER, True), ("birth", _DATE, True), ("address", re.compile(address), True), ("name", re.compile(name), False))


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def words_before(text: str, at: int, n: int = 3) -> list[str]:
    """The last n words in front of a place, in lower case; the stretch that is searched grows until it holds them."""
    size = 40
    while True:
        found = _WORD_BEFORE.findall(text[max(0, at - size) : at])
        if len(found) > n or size >= at:
            return [w.lower() for w in found[-n:]]
        size *= 2


def _nearest(before: list[str], good: frozenset[str], bad: frozenset[str]) -> int:
    """The vote of the nearest word in front that is in either list."""
    for w in reversed(before):
        if w in good or w in bad:
            return int(w in good)
    return 2


def _votes(kind: str, s: str, before: list[str], left: str, right: str, g: Gazetteers) -> tuple[int, ...]:
    """One vote a labeler; left and right: the text around the span."""
    words = _nearest(before, getattr(g, kind), g.plain)
    if kind == "secret":
        cased = s.lower() != s and s.upper() != s
        form = 0 if len(s) >= 32 and _HEX.match(s) else 1 if cased or s.startswith(g.prefixes) else 2
        texture = _entropy(s) > 3.0 and sum("0" <= c <= "9" for c in s) > len(s) / 10
        frame = left.rstrip()[-1:] in tuple("\"'=:") or right[:1] in tuple("\"'")
        return words, form, int(texture), int(frame)
    if kind == "number":
        beside = re.search(r"[0-9+]\s*\Z", left) or re.match(r"\s*[0-9]", right)
        return words, int(s.startswith("(") or "-" in s or "." in s), int(not beside)
    if kind == "birth":
        year = int(s[-4:] if s[-4:].isdigit() else s[:4])
        event = any(w in g.plain for w in before)
        return int(any(w in g.birth for w in before)), int(LIVED[0] <= year <= LIVED[1]), 0 if event else 2
    if kind == "address":
        parts = s.split(" ")
        after = _WORD_BEFORE.findall(right)[:2]
        words = 1 if any(w.lower() in g.places or re.fullmatch("[0-9]{4,5}", w) for w in after) else words
        if not s[:1].isdigit():
            return words, int(parts[-2][:1].isupper()), 1, 1
        return words, int(parts[1][:1].isupper()), int(parts[-1][:1].isupper()), int(not any(w.lower() in g.common for w in parts[1:-1]))
    own = _own_words(s, g)
    given = 1 if any(w in g.given for w in own) else 0 if len(own) > 1 else 2
    surname = 1 if own[-1] in g.surnames else 0 if len(own) == 1 else 2
    return words, given, surname, int(not any(w in g.common for w in own))


def _own_words(s: str, g: Gazetteers) -> list[str]:
    """The words of a name without its title, in lower case."""
    words = s.split(" ")
    return [w.lower() for w in (words[1:] if words[0].rstrip(".") in g.titles else words)]


#: How many values each feature has: length, share of digits, case, hex, what stands in front, which list the nearest listed word in front is of, and of names whether a title, a known first name, a known last name and a common word are there.
SIZES = (6, 4, 4, 2, 5, 4, 2, 2, 2, 2)
_OFFSETS = tuple(sum(SIZES[:i]) for i in range(len(SIZES)))


def _features(kind: str, s: str, before: list[str], left: str, g: Gazetteers) -> str:
    digits = sum("0" <= c <= "9" for c in s)
    front = left.rstrip(" ")[-1:]
    at = 0 if not front else 1 if front in ":=" else 2 if front in "\"'" else 3 if front in "([*" else 4
    word = _nearest(before, getattr(g, kind), g.plain) if before else 3
    own = _own_words(s, g) if kind == "name" else []
    about = (own and len(own) < len(s.split(" ")), any(w in g.given for w in own), bool(own) and own[-1] in g.surnames, any(w in g.common for w in own))
    case = 0 if s.lower() == s.upper() else 1 if s.lower() == s else 2 if s.upper() == s else 3
    return "".join(map(str, (min(len(s) // 8, 5), min(digits * 4 // len(s), 3), case, int(bool(_HEX.match(s))), at, word, *map(int, map(bool, about)))))


def candidates(text: str, known: Gazetteers = GAZETTEERS) -> Iterator[tuple[Span, str, str]]:
    """(span, votes, features) of what may be personal data beside the base kinds."""
    has_digit = bool(_DIGIT.search(text))
    for kind, pattern, numeric in _patterns(known):
        if numeric and not has_digit:
            continue
        for m in pattern.finditer(text):
            s = m[0]
            digits = sum("0" <= c <= "9" for c in s)
            if kind == "secret" and (not digits or digits == len(s)):
                continue
            before = words_before(text, m.start())
            left, right = text[max(0, m.start() - 8) : m.start()], text[m.end() : m.end() + 40]
            yield (kind, *m.span()), "".join(map(str, _votes(kind, s, before, left, right, known))), _features(kind, s, before, left, known)


def probability(votes: np.ndarray, rates: list[float], prior: float) -> np.ndarray:
    """Of each row of votes, given the labelers' reliabilities."""
    odds = np.full(len(votes), math.log(prior / (1 - prior)))
    for j, right in enumerate(rates):
        odds += np.where(votes[:, j] == 1, 1.0, np.where(votes[:, j] == 0, -1.0, 0.0)) * math.log(right / (1 - right))
    return 1 / (1 + np.exp(-odds))


def fitted(counts: dict[str, float], rounds: int = 50, prior: float | None = None) -> tuple[dict[str, float], list[float], float]:
    """Expectation-maximisation over vote patterns and their counts: the probability of each pattern, the reliability of each labeler, the share of true ones.

    Reliabilities carry a Beta(8, 2) prior towards labelers that are mostly
    right and stay above 0.55, so that "for" keeps its sense.  With ``prior`` the
    share is given and not estimated.
    """
    keys = sorted(counts)
    v = np.array([[int(c) for c in key] for key in keys])
    n = np.array([counts[key] for key in keys], dtype=float)
    p = np.clip(0.5 + 0.15 * ((v == 1).sum(1) - (v == 0).sum(1)), 0.05, 0.95)
    if prior is not None:
        p = probability(v, [0.8] * v.shape[1], prior)
    rates, share = [0.8] * v.shape[1], prior or 0.5
    for _ in range(rounds):
        if prior is None:
            share = ((p * n).sum() + 2) / (n.sum() + 4)
        for j in range(v.shape[1]):
            right = ((n * p * (v[:, j] == 1)).sum() + (n * (1 - p) * (v[:, j] == 0)).sum() + 8) / ((n * (v[:, j] != 2)).sum() + 10)
            rates[j] = min(max(right, 0.55), 0.99)
        p = probability(v, rates, share)
    return dict(zip(keys, p.tolist())), rates, share


def _indices(features: str) -> list[int]:
    return [a + int(x) for a, x in zip(_OFFSETS, features)]


def logistic(examples: dict[tuple[str, int], float], rounds: int = 600) -> list[float]:
    """Weights of the feature values and a bias, from (features, label) and their counts; both labels weigh the same in all."""
    keys = sorted(examples)
    at = np.array([_indices(f) for f, _ in keys])
    y = np.array([label for _, label in keys], dtype=float)
    n = np.array([examples[k] for k in keys], dtype=float)
    for label in (0, 1):
        n[y == label] /= 2 * n[y == label].sum()
    size = sum(SIZES)
    w = np.zeros(size + 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-(w[at].sum(1) + w[size])))
        g = n * (q - y)
        w[:size] -= 2.0 * (np.bincount(at.ravel(), np.repeat(g, at.shape[1]), size) + 1e-3 * w[:size])
        w[size] -= 2.0 * g.sum()
    return w.tolist()


@dataclass(frozen=True)
class SpanClassifier:
    """Of each kind: nothing (refused), the labelers' reliabilities (no false example to learn from), or weights of the features."""

    rates: dict[str, list[float]]
    weights: dict[str, list[float]]
    known: Gazetteers = GAZETTEERS

    def accepts(self, kind: str, votes: str, features: str) -> bool:
        if kind in self.weights:
            w = self.weights[kind]
            return sum(w[i] for i in _indices(features)) + w[-1] > 0
        return kind in self.rates and bool(probability(np.array([[int(c) for c in votes]]), self.rates[kind], PRIOR)[0] > 0.5)


def labelled(counts: dict[tuple[str, str], float]) -> tuple[dict[tuple[str, str], int], dict[str, list[float]]]:
    """The labels (1, 0) of (kind, votes) that are likely enough, and the reliabilities of each kind's labelers."""
    labels, rates = {}, {}
    for kind in {k for k, _ in counts}:
        p, rates[kind], _ = fitted({v: n for (k, v), n in counts.items() if k == kind}, prior=PRIOR)
        labels |= {(kind, v): int(x > 0.5) for v, x in p.items() if not 0.4 < x < 0.7}
    return labels, rates


def classifier(examples: dict[tuple[str, str, int], float], rates: dict[str, list[float]], known: Gazetteers = GAZETTEERS) -> SpanClassifier:
    """From (kind, features, label) and their counts, each kind by itself."""
    kinds: dict[str, dict[tuple[str, int], float]] = {}
    for (kind, features, label), n in examples.items():
        kinds.setdefault(kind, {})[features, label] = n
    found = {k: {label for _, label in x} for k, x in kinds.items()}
    return SpanClassifier({k: rates[k] for k, x in found.items() if x == {1}}, {k: logistic(kinds[k]) for k, x in found.items() if len(x) == 2}, known)


def trained(patterns: list[tuple[str, str, str, int]], known: Gazetteers = GAZETTEERS) -> SpanClassifier:
    """The classifier of (kind, votes, features, count) rows."""
    counts: Counter = Counter()
    for kind, votes, _, n in patterns:
        counts[kind, votes] += n
    labels, rates = labelled(counts)
    examples: Counter = Counter()
    for kind, votes, features, n in patterns:
        if (kind, votes) in labels:
            examples[kind, features, labels[kind, votes]] += n
    return classifier(examples, rates, known)


def train(docs: DataFrame, text_column: str = "text", known: Gazetteers = GAZETTEERS) -> SpanClassifier:
    """Votes and features of all candidates in all documents, counted once; what comes to the driver are counts by votes (81 a kind at most), then by features and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                found.update((kind, votes, features) for (kind, _, _), votes, features in candidates(text.as_py() or "", known))
            rows = [(*k, n) for k, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "votes", "features", "n"])

    counted = docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(run, "kind string, votes string, features string, n long")
    counted = cut(counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")))
    labels, rates = labelled({(r.kind, r.votes): r.n for r in counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()})
    if not labels:
        return SpanClassifier({}, {}, known)
    told = docs.sparkSession.createDataFrame([(*k, y) for k, y in sorted(labels.items())], "kind string, votes string, label int")
    examples = counted.join(F.broadcast(told), ["kind", "votes"]).groupBy("kind", "features", "label").agg(F.sum("n").alias("n"))  # some hundred rows
    return classifier({(r.kind, r.features, r.label): r.n for r in examples.collect()}, rates, known)


def all_spans(text: str, model: SpanClassifier) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the accepted further ones, by kind and start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for (kind, a, b), votes, features in candidates(text, model.known):
        if model.accepts(kind, votes, features) and not any(x < b and a < y for x, y in taken):
            added.append((kind, a, b))
    return base, base + sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS_TYPE = "array<struct<kind:string,start:int,end:int>>"


def spans(docs: DataFrame, model: SpanClassifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, spans): spans in code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t.as_py() or "", model) for t in batch.column(1)]
            base, every = ([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(every, pa.list_(_SPAN))], names=["id", "base", "spans"])

    picked = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, base {_SPANS_TYPE}, spans {_SPANS_TYPE}")


def redacted_text(text: str, found: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in found):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """docs with personal data in text replaced; n_chars follows if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [None if not t.is_valid else redacted_text(s := t.as_py(), all_spans(s, model)[1]) for t in batch.column(k)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs)
    kinds = ("n_email", "n_ip", "n_card", "n_phone")

    def joined(found: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", model)
                rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            types = (*[pa.int64()] * 4, pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *kinds, "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in kinds) + ", base_sha256 string, spans string")
