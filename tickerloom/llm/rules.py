"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a condition over a text's counts that rejects it. Each rule's rejections and cost are measured on a
bounded sample of documents (about ``sample`` rows by a hash of id and text, whole texts, twice as many at most): the cost is the time of a pass that
evaluates the rule, less that of a pass that evaluates nothing. Rules are ordered by rejections per second, and a
``CASE`` in that order stops at the first one that rejects, so later rules aren't evaluated there. Order
never changes the verdict, only what is evaluated.

``accept`` keeps the good rows of a table; there a rule works out the counts that it needs from the text, inside
its branch, so a text that a cheap rule rejects never has its windows hashed and sorted. ``judge`` reports
all counts of every text; there the cascade skips what is left to do beside them.

Defined results: a null text has no words and fails, and so does an empty or wordless one; a text of any
length is read whole; repeated rows each get a row, also with a null id; of rules with equal rates the one listed first comes first; no rows
give no rows and the rules' listed order; extra columns are ignored by ``judge`` and kept by ``accept``.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import WORD, hash_share

#: Separators of words, and symbols that count.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: More elements than any array has.
ALL = 1 << 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hashed_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))


def dup_lines(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return _let(F.transform(worded, lambda x: F.xxhash64(x)), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a["h"] == b["h"], F.lit(False))


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


#: From hashed words (``w``) to the places of repeated three-word windows (``at``): each step's name, and its value from those before it.
#: Windows are hashes of word hashes. Where all of a text's windows differ, nothing more is done; else windows are sorted with their places,
#: and those equal to a neighbour are kept.
REPEAT_STEPS: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("p", lambda c: F.zip_with(c("w"), F.slice(c("w"), 2, ALL), lambda a, b: F.xxhash64(a, b))),
    ("t", lambda c: F.zip_with(F.slice(c("p"), 1, F.greatest(F.size(c("w")) - 2, F.lit(0))), F.slice(c("w"), 3, ALL), lambda a, b: F.xxhash64(a, b))),
    ("again", lambda c: F.size(F.array_distinct(c("t"))) < F.size(c("t"))),
    ("s", lambda c: F.when(c("again"), F.array_sort(F.transform(c("t"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
    ("next", lambda c: F.zip_with(c("s"), F.slice(c("s"), 2, ALL), _same)),
    ("marked", lambda c: F.zip_with(F.zip_with(c("next"), F.concat(F.array(F.lit(False)), c("next")), _either), c("s"), lambda m, x: F.when(m, x["i"]))),
    ("at", lambda c: F.array_sort(F.filter(c("marked"), lambda x: x.isNotNull()))),
)


def _covered(at: Column) -> Column:
    """The words that windows at these places cover, by the gaps between places."""
    gaps = F.zip_with(at, F.slice(at, 2, ALL), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")


def repeat_words(text: Column) -> Column:
    """Words in three-word windows that occur twice or more, as one expression over the text."""

    def rest(steps: tuple, known: dict[str, Column]) -> Column:
        if not steps:
            return _covered(known["at"])
        (name, value), *more = steps
        return _let(value(known.__getitem__), lambda x: rest(tuple(more), known | {name: x}))

    return _let(hashed_words(text), lambda w: rest(REPEAT_STEPS, {"w": w}))


#: Counts by name, from a text that isn't null.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda text: F.regexp_count(text, F.lit(WORD)).cast("long"),
    "word_chars": lambda text: F.length(_without(text, SPACES)).cast("long"),
    "n_symbols": lambda text: (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
    "n_dup_lines": lambda text: dup_lines(text).cast("long"),
    "n_repeat_words": repeat_words,
}


class Counts:
    """Counts of the text in a column: columns that are there, or expressions over the text."""

    def __init__(self, text: Column, known: bool) -> None:
        self.text, self.known = text, known

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if self.known else COUNTS[name](self.text)


#: True rejects.
Rule = Callable[[Counts], Column]

#: The rules and their limits; the first two are the base.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda c: c["n_words"] < 50,
    "repeated_words": lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"],
}
OTHER_RULES: dict[str, Rule] = {
    "symbols": lambda c: 10 * c["n_symbols"] > 3 * c["n_words"],
    "word_length": lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
    "duplicate_lines": lambda c: 100 * c["n_dup_lines"] > 30 * F.size(F.split(c.text, "\n")),
    "shouting": lambda c: F.length(F.regexp_replace(c.text, r"[^\p{Lu}]", "")) > 0.5 * c["word_chars"],
    "few_letters": lambda c: F.length(F.regexp_replace(c.text, r"[^\p{L}]", "")) < 0.5 * c["word_chars"],
}
RULES = BASE_RULES | OTHER_RULES


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text and all counts; the words are cut once for two of them, and each step is a column."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__w", hashed_words(F.col("text")))
    for name, value in REPEAT_STEPS:
        rows = rows.withColumn(f"__{name}", value(lambda x: F.col(f"__{x}")))
    stepped = {"n_words": F.size("__w").cast("long"), "n_repeat_words": _covered(F.col("__at"))}
    return rows.select("doc_id", "text", *[(stepped[name] if name in stepped else make(F.col("text"))).alias(name) for name, make in COUNTS.items()])


def measured_order(rows: DataFrame, conditions: dict[str, Column]) -> list[str]:
    """Names of the conditions by rejections per second on ``rows``, a bounded sample."""
    held = rows.cache()
    n = held.count()

    def run(condition: Column) -> tuple[int, float]:
        began = time.perf_counter()
        hits = held.agg(F.count_if(condition)).first()[0]
        return hits, time.perf_counter() - began

    rank = {name: (0.0, k) for k, name in enumerate(conditions)}
    if n:
        nothing = F.length("text") < 0
        run(nothing)
        idle = min(run(nothing)[1] for _ in range(2))
        for k, (name, condition) in enumerate(conditions.items()):
            hits, took = min((run(condition) for _ in range(2)), key=lambda x: x[1])
            rank[name] = (-hits / max(took - idle, 1e-4), k)
    held.unpersist()
    return sorted(conditions, key=rank.get)


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """True if no condition holds; later ones are evaluated only where earlier ones don't hold."""
    verdict = None
    for name in order:
        hit = F.coalesce(conditions[name], F.lit(False))
        verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def _sample(docs: DataFrame, sample: int) -> DataFrame:
    return docs.where(hash_share(sample / max(docs.select("doc_id").count(), 1), "doc_id", "text")).limit(2 * sample)


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, sample: int = 2000) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, the counts, base_failed and kept. ``rules``: those beside the base."""
    docs, known = docs.select("doc_id", "text"), Counts(F.col("text"), True)
    conditions = {name: rule(known) for name, rule in (OTHER_RULES if rules is None else rules).items()}
    order = measured_order(text_counts(_sample(docs, sample)), conditions)
    failed = functools.reduce(lambda a, b: a | b, [rule(known) for rule in BASE_RULES.values()])
    return text_counts(docs).select("doc_id", *COUNTS, failed.alias("base_failed"), F.when(failed, False).otherwise(cascade(conditions, order)).alias("kept"))


def accept(docs: DataFrame, rules: dict[str, Rule] | None = None, sample: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    lazy = Counts(F.coalesce("text", F.lit("")), False)
    conditions = {name: rule(lazy) for name, rule in (RULES if rules is None else rules).items()}
    order = measured_order(_sample(docs.select("doc_id", "text"), sample), conditions)
    return docs.where(cascade(conditions, order))
