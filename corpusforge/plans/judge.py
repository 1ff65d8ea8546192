"""What a model decides in a dialogue, as rules on columns; a model can take the place of any of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.plans.index import tokens
from corpusforge.plans.search import overlap


class Judge(Protocol):
    def relevant(self, question: Column, chunk: Column) -> Column: ...
    def uncovered(self, question: Column, context: Column) -> Column: ...


class RuleJudge:
    """Deterministic rules on shared words."""

    def __init__(self, least: float = 0.2) -> None:
        self.least = least

    def relevant(self, question: Column, chunk: Column) -> Column:
        return overlap(question, chunk) >= self.least

    def uncovered(self, question: Column, context: Column) -> Column:
        """Words of the question that the context lacks."""
        return F.array_sort(F.array_except(tokens(question), tokens(context)))


def status(uncovered: Column, progressed: Column) -> Column:
    """READY without open words, EXHAUSTED when a round has brought nothing, else NOT_READY; null is NOT_READY."""
    return F.when(F.size(uncovered) == 0, "READY").when(~progressed, "EXHAUSTED").otherwise("NOT_READY")


def subquery(uncovered: Column, question: Column, before: Column) -> Column:
    """The open words; the question without any; a query that was asked already gets a suffix."""
    made = F.coalesce(F.nullif(F.array_join(uncovered, " "), F.lit("")), question)
    return F.when(F.array_contains(before, made), F.concat(made, F.lit(" (meer details)"))).otherwise(made)


def replies(c: Column, schema: str, required: tuple[str, ...]) -> Column:
    """A model's JSON as a struct; null (so that a fallback is taken) if it doesn't parse or lacks a part."""
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    ok = parsed.isNotNull()
    for name in required:
        ok = ok & parsed[name].isNotNull()
    return F.when(ok, parsed)


# Words that flag a text.
DANGEROUS = ["bom"]


def keywords(c: Column, words: list[str] = DANGEROUS) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w)))


def safety(c: Column, sensitivity: Column, relevant: Column, words: list[str] = DANGEROUS) -> Column:
    """struct: keywords, whether any, level, relevance, and whether the text is flagged."""
    found = keywords(c, words)
    return F.struct(
        found.alias("dangerous_keywords"), (F.size(found) > 0).alias("has_dangerous_keywords"), sensitivity.alias("sensitivity_level"), relevant.alias("relevant"),
        ((F.size(found) > 0) | (sensitivity >= 2) | ~relevant).alias("flagged"),
    )


def safe_suggestions(suggestions: Column, words: list[str] = DANGEROUS) -> Column:
    return F.filter(suggestions, lambda s: F.size(keywords(s, words)) == 0)
