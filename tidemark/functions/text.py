"""Text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def safe_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_for_tagging(c: Column) -> Column:
    """Lower case; & reads and; slash, underscore and hyphen are blanks. Other signs stay."""
    c = F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    return _squeezed(F.regexp_replace(c, r"[_\-]+", " "))


def normalize_for_keywords(c: Column) -> Column:
    """Lower case ASCII letters, digits and hyphens; all else is a blank."""
    return _squeezed(F.regexp_replace(F.lower(c), r"[^a-z0-9\-\s]", " "))


def search_text(columns: Sequence[Column]) -> Column:
    filled = [F.nullif(safe_text(c), F.lit("")) for c in columns]
    return normalize_for_tagging(F.concat_ws(" | ", *filled))


def document_text(columns: Sequence[Column]) -> Column:
    return normalize_for_keywords(F.concat_ws(" ", *[c.cast("string") for c in columns]))


def parse_topics(c: Column) -> Column:
    """A JSON list, else parts between |, else parts between ;, else one label; blanks go."""
    text = safe_text(c)
    listed = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("[") & listed.isNotNull(), listed).when(text.contains("|"), F.split(text, r"\|")).when(text.contains(";"), F.split(text, ";")).otherwise(F.array(text))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def parse_keywords(c: Column) -> Column:
    """A JSON list; anything else is no keyword."""
    text = safe_text(c)
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def whole_year(c: Column) -> Column:
    """Numbers cut to whole years; null where the text is no number."""
    number = c.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number.cast("int"))


def citations(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def citation_weight(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0))) + 1


def year_weight(year: Column, start: int, end: int) -> Column:
    return F.lit(1.0) if end <= start else 1 + (year - start) / F.lit(float(end - start))


def tokens(text: Column, stop: Sequence[str] | None = None) -> Column:
    """Words of a letter and more letters, digits or hyphens, without stopwords."""
    found = F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z][a-zA-Z0-9\-]{1,}\b"), F.lit(0))
    stop = list(rules.stopwords() if stop is None else stop)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of a range of sizes, joined by blanks; they bridge removed words."""
    def of_size(n: int) -> Column:
        if n == 1:
            return words
        count = F.size(words) - n + 1
        none = F.array().cast("array<string>")
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def _rewritten(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return functools.reduce(lambda x, r: F.regexp_replace(x, *r), pairs, c)


def normalize_keyword(c: Column, stop: Sequence[str] | None = None) -> Column:
    """Variants of a keyword as one form; "" if nothing is left of it. Costly: apply to distinct keywords."""
    word = F.regexp_replace(F.lower(F.trim(c)), r"\b(\w+)ss\b", "$1s")
    parts = F.filter(F.split(word, r"\s+"), lambda t: t != "")
    word = F.when(F.exists(parts, lambda t: t.isin(rules.VENUES)), F.array_join(F.filter(parts, lambda t: ~t.isin(rules.VENUES)), " ")).otherwise(word)
    word = _rewritten(word, [("(?i)" + p, r) for p, r in rules.PHRASE_RULES])
    return _finished(_rewritten(word, [(rf"\b{s}s?\b", s) for s in rules.SINGULARS]), stop)


def _finished(word: Column, stop: Sequence[str] | None) -> Column:
    def is_variant(t: Column) -> Column:
        ends = [t.endswith(s) & (t != s) & (F.length(F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - len(s)), "[-_]+$", "")) > 2) for s in rules.DROPPED_SUFFIXES]
        return functools.reduce(lambda a, b: a | b, ends)

    parts = F.filter(F.split(word, r"\s+"), lambda t: t != "")
    kept = F.filter(parts, lambda t: ~is_variant(t))
    parts = F.when(F.size(kept) > 0, kept).otherwise(parts)
    # a word after the same word goes
    single = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, t: F.when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) == t), done).otherwise(F.concat(done, F.array(t))),
    )
    out = F.array_join(single, " ")
    stop = list(rules.stopwords() if stop is None else stop)
    return F.when(out.isin(stop), F.lit("")).otherwise(out) if stop else out


def valid_phrase(c: Column, stop: Sequence[str] | None = None) -> Column:
    """Whether a term may be a keyword: not blank, no one-letter words, few stopwords, no traces of sources."""
    stop = list(rules.stopwords() if stop is None else stop)
    phrase = F.lower(F.trim(c))
    parts = F.filter(F.split(phrase, r"\s+"), lambda t: t != "")
    n = F.size(parts)
    stops = F.filter(parts, lambda t: t.isin(stop))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))
    digits = F.size(F.filter(parts, lambda t: t.rlike("[0-9]")))
    noise = functools.reduce(lambda a, b: a | b, [phrase.contains(x) for x in rules.NOISE])
    bad = (
        (n == 0)
        | (F.size(stops) == n)
        | F.exists(parts, lambda t: F.length(t) <= 1)
        | ((n == 1) & phrase.rlike("^[0-9]+$"))
        | noise
        | (F.size(stops) / n > 0.4)
        | ((digits / n > 0.5) & (n <= 2))
        | (chars(stops) / chars(parts) > 0.5)
    )
    return F.when(n == 0, F.lit(False)).otherwise(~bad)
