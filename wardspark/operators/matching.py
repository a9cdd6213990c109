"""Matching of names and phrases: exact, by equi joins, never fuzzy."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.scalars import street_name

#: Forms of so many letters in all (32 more for each) may be broadcast as one automaton; some 100 MB in a worker.
AUTOMATON_LIMIT = 10_000_000
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = frozenset(string.ascii_letters + string.digits + "_")

#: A roster that is held beside every row may have so many entries; a larger one is an error, not a cut.
ROSTER_LIMIT = 10_000


# Honorifics, street types in prose, topic categories, keywords, and the titles of digests.
HONORIFICS = ("Ald.", "Ald", "Alderman", "Alderwoman", "Alderperson")
STREET_SUFFIXES = ("Ave", "Avenue", "St", "Street", "Blvd", "Boulevard", "Rd", "Road", "Dr", "Drive")
TOPICS = ("bicycling", "bikes", "bike lanes", "bike safety", "complete streets", "vision zero", "dooring")
KEYWORDS = (
    "bike", "bicycle", "cyclist", "complete streets", "vision zero", "traffic calming", "protected lane", "bike lane", "pedestrian safety",
    "speed hump", "traffic safety", "road diet", "curb extension", "dooring",
)
DIGEST = r"(?i)^today[\u2019']s headlines"
WARD = r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)\s+ward\b"


def has_keyword(text: Column) -> Column:
    """Whether a text contains a keyword in any case; false for null."""
    return F.coalesce(F.rlike(F.lower(text), F.lit("|".join(KEYWORDS))), F.lit(False))


def relevant(title: Column, categories: Column, trusted: Column, project: Column) -> Column:
    """The gate of news items: digests go; then a trusted query, a keyword in the title, a topic category, or a project match lets in."""
    topic = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.coalesce(F.lower(c).isin(*TOPICS), F.lit(False)))
    digest = F.coalesce(F.rlike(title, F.lit(DIGEST)), F.lit(False))
    return ~digest & (F.coalesce(trusted, F.lit(False)) | has_keyword(title) | topic | F.coalesce(project, F.lit(False)))


def words(text: Column) -> Column:
    """The runs of Latin letters without accents and digits, in lower case; null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))


def grams(w: Column, width: int) -> Column:
    """All phrases of ``width`` words of an array of words."""
    last = F.size(w) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))).otherwise(F.array().cast("array<string>"))


def _patterns(rows: DataFrame, kind: str, forms: list[tuple[Column, int, bool]]) -> DataFrame:
    """Pattern rows of (entity, name): a form is its text, its rank among the forms of the entity, and whether it needs a keyword beside it; null forms go."""
    each = F.explode(F.array(*[F.struct(text.alias("form"), F.lit(rank).alias("rank"), F.lit(context).alias("context")) for text, rank, context in forms]))
    made = rows.select(F.lit(kind).alias("kind"), F.col("entity").cast("string").alias("entity"), each.alias("f")).select("kind", "entity", "f.*").filter("form is not null and form <> ''")
    escaped = F.regexp_replace(F.regexp_replace("form", r"([^A-Za-z0-9\s])", r"\\$1"), r"\s+", r"\\s+")
    return made.withColumns({"phrase": F.array_join(words(F.col("form")), " "), "pattern": F.concat(F.lit("(?i)(?<!\\w)"), escaped, F.lit("(?!\\w)"))})


def person_patterns(people: DataFrame, entity: str, name: str) -> DataFrame:
    """Of names "Last, First": the full name always, honorific and last name only where no other person has it; a bare last name never."""
    parts = people.select(F.col(entity).alias("entity"), F.trim(F.split_part(F.col(name), F.lit(","), F.lit(1))).alias("last"), F.trim(F.rtrim(F.trim(F.split_part(F.col(name), F.lit(","), F.lit(2))), F.lit("."))).alias("first")).filter("last <> '' and first <> ''")
    once = parts.groupBy(F.lower("last").alias("_last")).agg((F.count(F.lit(1)) == 1).alias("alone"))
    keyed = parts.join(once, F.lower("last") == F.col("_last"))
    surname = F.when(F.col("alone"), F.col("last"))
    return _patterns(keyed, "person", [(F.concat_ws(" ", "first", "last"), 0, False), *[(F.concat(F.lit(h + " "), surname), 1, False) for h in HONORIFICS]])


def route_patterns(streets: DataFrame, tokens: DataFrame) -> DataFrame:
    """streets (entity, street): the street with a street type behind it; tokens (entity, token): as they are."""
    typed = [(F.concat(F.col("street"), F.lit(" " + x)), 0, False) for x in STREET_SUFFIXES]
    return _patterns(streets, "route", typed).unionByName(_patterns(tokens, "route", [(F.col("token"), 1, False)]))


def project_patterns(phrases: DataFrame) -> DataFrame:
    """phrases (entity, phrase, context): some count only in titles with a keyword."""
    alone, beside = F.when(~F.col("context"), F.col("phrase")), F.when(F.col("context"), F.col("phrase"))
    return _patterns(phrases, "project", [(alone, 0, False), (beside, 1, True)])


def _candidates(items: DataFrame, item: str, title: str, tags: str) -> DataFrame:
    """(item, told, texts): whether the title has a keyword, and the tags in order with the title behind them."""
    tag = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    return items.select(F.col(item), has_keyword(F.col(title)).alias("told"), F.concat(tag, F.array(F.col(title))).alias("texts"))


def _automaton(patterns: list[tuple[str, str, str, int, bool]]) -> ahocorasick.Automaton:
    """The trie of all forms with its failure links; each form carries the numbers of its patterns."""
    numbers: dict[str, list[int]] = {}
    for k, (_, _, form, _, _) in enumerate(patterns):
        numbers.setdefault(_flat(form), []).append(k)
    built = ahocorasick.Automaton()
    for form, of in numbers.items():
        built.add_word(form, (len(form), of))
    built.make_automaton()
    return built


def _flat(text: str) -> str:
    """A-Z as a-z, every run of blanks as one space."""
    return _BLANKS.sub(" ", text.translate(_LOWER))


def _spans(text: str, automaton: ahocorasick.Automaton) -> dict[int, tuple[int, int]]:
    """Of every pattern that occurs in a text as whole words, where it does first."""
    flat, found = _flat(text), {}
    for end, (size, numbers) in automaton.iter(flat):
        start = end - size + 1
        if numbers[0] not in found and not (start and flat[start - 1] in _WORD) and flat[end + 1 : end + 2] not in _WORD:
            found.update((k, (start, end + 1)) for k in numbers)
    if not found or len(flat) == len(text):
        return found
    at = [m.start() for m in re.finditer(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]", text)] + [len(text)]
    return {k: (at[a], at[b]) for k, (a, b) in found.items()}


def _named(told: bool, texts: list[str | None], patterns: list[tuple[str, str, str, int, bool]], automaton: ahocorasick.Automaton) -> list[tuple[str, str, str]]:
    """(kind, entity, via) of one item; the first form of an entity wins, then the first text, then the lesser evidence."""
    best: dict[tuple[str, str], tuple[int, int, str]] = {}
    for place, text in enumerate(texts):
        for k, (a, b) in _spans(text or "", automaton).items():
            kind, entity, _, rank, context = patterns[k]
            if context and not told:
                continue
            via = f"publisher tag '{text}'" if place < len(texts) - 1 else f"'{text[a:b]}' in headline"
            mine = (rank, place, via + (" + safety keyword in headline" if context else ""))
            if (kind, entity) not in best or mine < best[kind, entity]:
                best[kind, entity] = mine
    return [(*key, via) for key, (_, _, via) in best.items()]


def entity_matches(items: DataFrame, item: str, title: str, tags: str, patterns: DataFrame, limit: int = AUTOMATON_LIMIT) -> DataFrame:
    """(item, kind, entity, via): every entity that a tag or the title of an item names, by forms of any length, as whole words in any case.

    The first form of an entity wins, and tags come before the title.  All forms
    make one automaton, which a task builds once and runs over its texts, so
    work grows with the texts alone and nothing is shuffled.  The forms are
    counted first; beyond ``limit`` letters they are not broadcast and the
    phrases of the texts meet them in an equi-join (joined_matches), with equal results.
    """
    size = patterns.agg(F.coalesce(F.sum(F.length("form") + 32), F.lit(0))).first()[0]
    if size > limit:
        return joined_matches(items, item, title, tags, patterns)
    held = [tuple(r) for r in patterns.select("kind", "entity", "form", "rank", "context").collect()]
    asked = _candidates(items, item, title, tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held)
        for batch in batches:
            found = [_named(told, texts, held, automaton) if held else [] for told, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = [x for each in found for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array([x[i] for x in flat], pa.string()) for i in range(3))], names=[item, "kind", "entity", "via"])

    return asked.mapInArrow(run, f"`{item}` {items.schema[item].dataType.simpleString()}, kind string, entity string, via string")


def joined_matches(items: DataFrame, item: str, title: str, tags: str, patterns: DataFrame) -> DataFrame:
    """As entity_matches for any number of forms.

    A text becomes its phrases of as many words as forms have (their lengths, a
    few numbers, come to the driver), which meet the forms in an equi-join; the
    regular expression decides on those candidates.
    """
    sized = patterns.withColumn("_n", F.size(words(F.col("form"))))
    widths = [r[0] for r in sized.select("_n").distinct().collect() if r[0]]
    texts = _candidates(items, item, title, tags).select(item, "told", F.size("texts").alias("last"), F.posexplode("texts").alias("place", "text")).filter("text is not null")
    held = texts.withColumn("w", words(F.col("text")))
    some = F.array_distinct(F.concat(*[grams(F.col("w"), n) for n in widths])) if widths else F.array().cast("array<string>")
    phrases = held.select(item, "told", "last", "place", "text", F.explode(some).alias("phrase"))
    hits = phrases.join(patterns, "phrase").filter(F.rlike("text", F.col("pattern")) & (~F.col("context") | F.col("told")))
    via = F.when(F.col("place") < F.col("last") - 1, F.concat(F.lit("publisher tag '"), "text", F.lit("'"))).otherwise(F.concat(F.lit("'"), F.regexp_substr("text", F.col("pattern")), F.lit("' in headline")))
    via = F.concat(via, F.when(F.col("context"), " + safety keyword in headline").otherwise(""))
    best = hits.groupBy(item, "kind", "entity").agg(F.min(F.struct("rank", "place", via.alias("via"))).alias("b"))
    return best.select(item, "kind", "entity", F.col("b.via").alias("via"))


def ward_mentions(items: DataFrame, item: str, title: str, tags: str) -> DataFrame:
    """(item, ward, via): wards named as "35th Ward", each once, tags before the title."""
    tag = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda c, i: F.struct(i.alias("place"), F.regexp_extract(c, WARD, 1).alias("ward"), F.concat(F.lit("publisher tag '"), c, F.lit("'")).alias("via")))
    head = F.array(F.struct(F.lit(1 << 30).alias("place"), F.regexp_extract(title, WARD, 1).alias("ward"), F.concat(F.lit("'"), F.regexp_extract(title, WARD, 0), F.lit("' in headline")).alias("via")))
    found = items.select(item, F.explode(F.concat(tag, head)).alias("f")).select(item, "f.*").filter("ward <> ''")
    return found.groupBy(item, "ward").agg(F.min(F.struct("place", "via")).alias("b")).select(item, "ward", "b.via")


def roster_members(parts: DataFrame, roster: DataFrame, name: str, where: str) -> DataFrame:
    """parts with the roster line of their street; a line with low and high holds only parts whose ``where`` lies between."""
    keyed = roster.withColumn("_street", street_name(F.col("street"))).drop("street")
    inside = F.col("low").isNull() | F.col(where).between(F.col("low"), F.col("high"))
    return parts.withColumn("_street", street_name(F.col(name))).join(keyed, "_street").filter(inside).drop("_street", "low", "high")


def token_members(items: DataFrame, roster: DataFrame, name: str) -> DataFrame:
    """items with ``line``: the first roster entry (line, token, veto) whose token the name contains and whose veto it does not.

    The roster becomes one array that every row sees, so it is checked to have
    at most ROSTER_LIMIT entries before.
    """
    if (n := roster.limit(ROSTER_LIMIT + 1).count()) > ROSTER_LIMIT:
        raise ValueError(f"a roster of {n} entries or more is too large to be held beside every row")
    held = roster.agg(F.array_sort(F.collect_list(F.struct("line", "token", "veto"))).alias("_roster"))
    low = F.lower(F.col(name))
    fits = F.filter("_roster", lambda r: F.contains(low, r.token) & ~F.coalesce(F.contains(low, r.veto), F.lit(False)))
    return items.crossJoin(F.broadcast(held)).withColumn("line", F.get(fits, F.lit(0)).line).drop("_roster")  # one row
