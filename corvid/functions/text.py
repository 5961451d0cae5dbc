"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODE_PATTERNS, GREETINGS, PHRASE_BONUS, STOP_WORDS


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Words parted by white space; none for an empty text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_tokens(x: Column, least: int = 1) -> Column:
    """Lower-cased runs of word characters of at least ``least``."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0))


def keywords(x: Column) -> Column:
    """Word tokens of more than two characters that are no stop words; repeats stay."""
    return F.filter(word_tokens(x), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def keyword_score(keys: Column, text: Column) -> Column:
    """The share of keywords that are substrings of the lower-cased text; 0 without keywords."""
    return F.when(F.size(keys) > 0, F.size(F.filter(keys, lambda k: F.contains(text, k))) / F.size(keys)).otherwise(F.lit(0.0))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the question's distinct words found among the text's, and a bonus if the text holds the question."""
    q, t = F.array_distinct(words(F.lower(query))), F.array_distinct(words(F.lower(text)))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    return share + F.when(F.contains(F.lower(text), F.lower(query)), F.lit(PHRASE_BONUS)).otherwise(F.lit(0.0))


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / 4).cast("long")


def stats(x: Column) -> dict[str, Column]:
    """Length, words, sentences (full stops and one), words a sentence."""
    n_words = F.size(words(x)).cast("long")
    sentences = (F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) + 1).cast("long")
    return {"total_length": F.length(x).cast("long"), "word_count": n_words, "sentence_count": sentences, "avg_sentence_length": n_words / F.greatest(sentences, F.lit(1))}


def complexity(x: Column) -> Column:
    """0.7 of the mean word length and 0.3 of punctuation marks a word; 0 without words."""
    ws = words(x)
    chars = F.length(F.array_join(ws, ""))
    marks = F.length(x) - F.length(F.translate(x, ".,;:!?", ""))
    return F.when(F.size(ws) > 0, chars / F.size(ws) * 0.7 + marks / F.size(ws) * 0.3).otherwise(F.lit(0.0))


def performance_score(seconds: Column, memory: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.coalesce(seconds, F.lit(1.0)) / 10) * 0.6 + F.greatest(F.lit(0.0), 1 - F.coalesce(memory, F.lit(0.5))) * 0.4


def optimal_chunk_size(complexity_: Column, performance: Column, target: int = 500, least: int = 100, most: int = 2000) -> Column:
    size = F.lit(float(target))
    size = size * F.when(complexity_ > 0.7, 0.8).when(complexity_ < 0.3, 1.2).otherwise(1.0)
    size = size * F.when(performance < 0.5, 0.9).otherwise(1.0)
    return F.greatest(F.lit(least), F.least(F.lit(most), size.cast("int"))).cast("long")


def is_greeting(x: Column) -> Column:
    low = strip(F.lower(x))
    held = F.lit(False)
    for g in GREETINGS:
        held = held | F.contains(low, F.lit(g))
    return held & (F.size(words(low)) <= 3)


def language_hint(x: Column) -> Column:
    """A question with the programming language it seems to be about in front."""
    low = F.lower(x)

    def any_of(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(low, F.lit(p))
        return out

    hint = (
        F.when(any_of("python", "code"), "")
        .when(any_of("function", "def ", "import", "class"), "Python: ")
        .when(any_of("javascript", "js", "node"), "JavaScript: ")
        .when(any_of("java", "public class"), "Java: ")
        .otherwise("")
    )
    return F.concat(hint, x)


def repeats_itself(x: Column, prefix: int = 20, most: int = 3) -> Column:
    """Whether a text is empty or its first characters occur more than ``most`` times."""
    head = F.substring(x, 1, prefix)
    times = F.when(F.length(head) > 0, (F.length(x) - F.length(F.replace(x, head, F.lit("")))) / F.length(head)).otherwise(F.lit(0))
    return (strip(x) == "") | (times > most)


def score_band(x: Column) -> Column:
    return F.when(x >= 0.8, "green").when(x >= 0.6, "yellow").otherwise("red")


def parse_score(x: Column) -> Column:
    """A number made of digits and points, else 0.5."""
    return F.coalesce(F.when(F.replace(x, F.lit("."), F.lit("")).rlike(r"^[0-9]+$"), x.try_cast("double")), F.lit(0.5))


def says_yes(x: Column) -> Column:
    return F.contains(F.upper(x), F.lit("YES"))


def looks_like_code(x: Column) -> Column:
    """Whether one of the fixed patterns is found."""
    out = F.lit(False)
    for p in CODE_PATTERNS:
        out = out | x.rlike(p)
    return out


def prompt(contexts: Column, question: Column) -> Column:
    """Numbered contexts and the question in one template."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]: "), c))
    return F.concat(F.lit("Context:\n"), F.array_join(numbered, "\n"), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def loader_of(ext: Column) -> Column:
    """The loader for a file extension; null where there is none."""
    return F.when(ext == ".txt", "text").when(ext == ".md", "markdown").when(ext == ".pdf", "pdf").when(ext.isin(".xlsx", ".xls"), "excel").when(ext.isin(".docx", ".doc"), "docx")
