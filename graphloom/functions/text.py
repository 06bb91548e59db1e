"""Text functions on columns: tokens, estimates, counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words, and the parts of an identifier.
STOPWORDS = (
    "a an and are as at be but by for from has have if in into is it its not of on or so that the then there these this to was when which while will with"
).split()
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
TOKENS_PER_WORD = 1.3


def tokens(text: Column) -> Column:
    """Lower-case terms: each alphanumeric word, if it has several camel-case parts, and its parts; one-letter terms and stop words go."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), lambda w: w != "")

    def split(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0))
        return F.when(F.size(parts) > 1, F.concat(F.array(word), parts)).otherwise(parts)

    lowered = F.transform(F.flatten(F.transform(words, split)), F.lower)
    return F.filter(lowered, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def word_count(text: Column) -> Column:
    """Words between Unicode white space; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(word_count(text) * F.lit(TOKENS_PER_WORD)).cast("bigint")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap; an empty part occurs nowhere."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n.cast("int")).otherwise(0)


def tail(text: Column, n: int = 4000) -> Column:
    """The last ``n`` characters."""
    return F.right(text, F.lit(n))


def is_literal(value: Column) -> Column:
    """Whether a default value is a JavaScript literal: a number, a plain string, a truth value, null, or an empty list or object."""
    # The forms of a literal.
    forms = r"^(-?\d+(\.\d+)?|'[^']*'|\"[^\"]*\"|true|false|null|undefined|\[\]|\{\})$"
    return F.coalesce(F.trim(value).rlike(forms), F.lit(False))


def is_hook_name(name: Column) -> Column:
    """``use`` followed by a capital."""
    return F.coalesce(name.rlike(r"^use\p{Lu}"), F.lit(False))


def cause_tag(note: Column) -> Column:
    """The cause named in a note, or null."""
    return F.nullif(F.lower(F.regexp_extract(note, r"(?i)cause:\s*([a-z_]+)", 1)), F.lit(""))


def shown_files(prompt: Column) -> Column:
    """Paths in a prompt's file headings, without repeats."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"(?m)^#### .+ \(`([^`]+)`\)\s*$"), F.lit(1)))


def container_name(value: Column) -> Column:
    """A name of letters, digits, dots, dashes and underscores; ``c_`` goes before one that does not start with a letter or digit."""
    name = F.regexp_replace(value, r"[^a-zA-Z0-9_.-]", "_")
    return F.when(name.rlike("^[a-zA-Z0-9]"), name).otherwise(F.concat(F.lit("c_"), name))


def test_pattern(paths: Column) -> Column:
    """Alternatives of the paths' file names, each up to ``.test.``."""
    return F.array_join(F.transform(paths, lambda p: F.element_at(F.split(F.element_at(F.split(p, "/"), -1), r"\.test\."), 1)), "|")


def model_provider(model: Column) -> Column:
    """The provider in a model's name; a bare name is the default provider's."""
    return F.when(model.startswith("claude") | (F.instr(model, "/") == 0), "anthropic").otherwise(F.substring_index(model, "/", 1))


def day(timestamp: Column) -> Column:
    """The day of an ISO timestamp in text form."""
    return F.substring(timestamp, 1, 10)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def short_hash(value: Column, n: int) -> Column:
    """The first ``n`` hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, n)


def embedding_key(model: Column, text: Column) -> Column:
    """The key of a cached embedding: model and text divided by a null character."""
    return F.sha2(F.concat(model, F.char(F.lit(0)), text), 256)


def cache_key(content: Column, prompt_id: Column, model: Column) -> Column:
    return F.concat(short_hash(content, 16), F.lit("::"), prompt_id, F.lit("::"), model)
