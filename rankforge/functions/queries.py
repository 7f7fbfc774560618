"""Query planning: several wordings of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions.text import WS, normalize

#: Words that open a clause, and those that open a question (fixed values).
CLAUSE = "what|which|who|when|where|how|why|did|does|do|is|are"
ASKING = "compare|contrast|summarize|explain|" + CLAUSE
#: Capitalised words, joined by hyphens or blanks; the sides of "compare A and B"; what "by" or "for" adds to both (fixed values).
PHRASE = r"\b[A-Z][A-Za-z0-9]*(?:[-\s]+[A-Z][A-Za-z0-9]*)*\b"
SIDES = r"(?i)\bcompare\s+(.+?)\s+\band\s+(.+?)(?:\s+\bby\b|\s+\bfor\b|$)"
ADDED = r"(?i)\b(?:by|for)\s+(.+)$"


def _ends(text: Column) -> Column:
    """Without blanks and question marks at its ends."""
    return F.regexp_replace(text, "^[ ?]+|[ ?]+$", "")


def query_variants(question: Column, most: int = 4) -> Column:
    """The cleaned question; the sides of a comparison; clauses after "and" with a question word; capitalised phrases. Each once, of two
    words or more, at most ``most``. A question of one word has none, and a null one neither."""
    none = F.array().cast("array<string>")
    clean = _ends(normalize(F.coalesce(question, F.lit(""))))
    sides = F.split(clean, rf"(?i){WS}+(?:vs\.?|versus){WS}+", 2)
    # only a plain "vs" or "versus" between blanks makes a comparison; "vs." parts one that there is
    versus = F.when(F.lower(clean).rlike(" (?:vs|versus) "), F.transform(sides, _ends)).otherwise(none)
    by = _ends(F.regexp_extract(clean, ADDED, 1))
    both = F.when(clean.rlike(SIDES), F.array(*[F.trim(F.concat_ws(" ", _ends(F.regexp_extract(clean, SIDES, n)), by)) for n in (1, 2)])).otherwise(none)
    clauses = F.filter(F.transform(F.split(clean, rf"(?i)\s+\band\s+(?=(?:{CLAUSE})\b)"), _ends), lambda c: c != "")
    clauses = F.when(F.size(clauses) > 1, clauses).otherwise(none)
    phrases = F.filter(F.regexp_extract_all(clean, F.lit(PHRASE), F.lit(0)), lambda p: (F.length(p) > 2) & ~p.rlike(rf"(?i)^(?:{ASKING})\b"))
    every = F.array_distinct(F.concat(F.array(clean), versus, both, clauses, phrases))
    return F.slice(F.filter(every, lambda v: F.size(F.split(v, " ")) >= 2), 1, most)
