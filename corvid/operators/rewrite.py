"""Rewriting questions: synonyms, parts, guards, prompts of past turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import strip


def expansions(x: Column, most: int = 3) -> Column:
    """The question and its variants with a term replaced by a synonym (terms are found as substrings), ``most`` in all."""
    low = F.lower(x)
    variants = [F.when(F.contains(low, F.lit(term)) & (F.replace(low, F.lit(term), F.lit(s)) != low), F.replace(low, F.lit(term), F.lit(s))) for term, synonyms in C.SYNONYMS for s in synonyms]
    return F.slice(F.array_compact(F.array(x, *variants)), 1, most)


def parts(x: Column, most: int = 3) -> Column:
    """The question and what its conjunctions part; tested in lower case, split as written."""
    low = F.lower(x)
    pieces = [F.when(F.contains(low, F.lit(f" {c} ")), F.filter(F.transform(F.split(x, f" {c} "), strip), lambda p: p != "")).otherwise(F.array().cast("array<string>")) for c in C.CONJUNCTIONS]
    return F.slice(F.concat(F.array(x), *pieces), 1, most)


def exploded(questions: DataFrame, variants: Column, key: str = "query_id") -> DataFrame:
    return questions.select(key, F.posexplode(variants).alias("variant", "text"))


def accepted(original: Column, rewritten: Column, more_than: int = 10) -> Column:
    """The rewritten question if it has more than ``more_than`` characters, else the original."""
    clean = strip(rewritten)
    return F.when(F.length(clean) > more_than, clean).otherwise(original)


def explain_prompt(code: Column) -> Column:
    """Asks for an explanation of code."""
    return F.concat(F.lit("Please explain this code:\n\n"), code)


def debug_prompt(code: Column, error: Column) -> Column:
    """Asks for help with code; with an error that is not null or empty, how to mend it."""
    plain = F.concat(F.lit("Can you help me debug this code?\n\n"), code)
    told = F.concat(F.lit("I'm getting this error in my code:\n\n"), code, F.lit("\n\nError: "), error, F.lit("\n\nHow can I fix this?"))
    return F.when(F.coalesce(error, F.lit("")) == "", plain).otherwise(told)
