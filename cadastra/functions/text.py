"""Column expressions on texts: cleaning, parsing, flags, scores, ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions.fixed import ACCENTED, PLAIN


# Patterns of telephone numbers, in their order.
PHONES = [r"\+216\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}", r"\+216[0-9]{8}", r"216[0-9]{8}", r"\b([2579][0-9]{7})\b"]


def strip_noise(c: Column) -> Column:
    """Only ASCII letters, digits and plain punctuation; white space collapsed; empty as null."""
    ascii_only = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    plain = F.regexp_replace(ascii_only, r"[\x00-\x1F\x7F]", " ")
    listed = F.regexp_replace(plain, r"[^A-Za-z0-9 .,;:!?'()/+%&@-]", "")
    return F.nullif(F.trim(F.regexp_replace(listed, r" +", " ")), F.lit(""))


def number(c: Column) -> Column:
    """Digits and dots of a text, comma as dot, as a double; null if that is no number."""
    return F.nullif(F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^0-9.]", ""), F.lit("")).try_cast("double")


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def arabic(c: Column) -> Column:
    """Arabic letters in their plain forms, without vowel signs; white space collapsed."""
    plain = F.regexp_replace(F.translate(c, "أإآٱةى", "ااااهي"), "[ً-ٟ]", "")
    return F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " "))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def pairs(c: Column, line: str, separator: str) -> Column:
    """Lines of a label and a value as a map; lines of another form are passed over, of equal labels the last counts."""
    parts = F.filter(F.transform(F.split(c, line), lambda x: F.transform(F.split(x, separator), lambda v: F.trim(v))), lambda p: F.size(p) == 2)
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def phone(c: Column) -> Column:
    """The first number of a text, by ordered patterns, as its last eight digits; null without one."""
    found = [F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in PHONES]
    return F.right(F.regexp_replace(F.coalesce(*found), r"[^0-9]", ""), F.lit(8))


def first_match(c: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    """The first label one of whose words the text contains."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in rules.items():
        out = out.when(contains_any(c, words), F.lit(label))
    return out.otherwise(F.lit(default))


def theme_score(c: Column, themes: list[tuple[list[str], float]], enough: float = 0.3) -> Column:
    """Sum over themes of weight times min(hits / max(enough * words, 1), 1), at most 1, to 4 digits."""
    parts = [F.least(hits(c, words) / F.lit(max(enough * len(words), 1.0)), F.lit(1.0)) * weight for words, weight in themes]
    return F.round(F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0)), 4)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def richness(c: Column, short: int = 5, default: float = 0.3) -> Column:
    """Distinct words / words, or the default for `short` words or fewer."""
    w = words(c)
    return F.when(F.size(w) > short, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(default))


def replace_phrases(c: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced one after another, the longest first and of equal length in their order, so that what one puts in another may replace."""
    for k in sorted(phrases, key=len, reverse=True):
        c = F.replace(c, F.lit(k), F.lit(phrases[k]))
    return c


def rooms(c: Column) -> Column:
    """Number of rooms by ordered patterns: s+N is N + 1, N pieces, N chambres, fN or tN, studio, duplex, triplex."""
    t = F.lower(c)
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    word = lambda w, n: F.when(t.contains(w), F.lit(n))
    return F.coalesce(found(r"s ?\+ ?([0-9]+)") + 1, found(r"([0-9]+) ?pi[eè]ces?"), found(r"([0-9]+) ?chambres?"), found(r"(?:^|[^a-z])[ft]([0-9])(?:[^0-9]|$)"), word("studio", 1), found(r"([0-9]+) ?pic"), word("duplex", 2), word("triplex", 3))


def kwic(c: Column, keyword: str, before: int, after: int) -> Column:
    """Each occurrence of the keyword with its context, as an array of strings."""
    parts = F.split(c, F.lit(keyword))  # the keyword is plain letters
    ahead = lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1) + len(keyword), F.lit(0)) + F.length(x)))
    starts = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), ahead)  # each part is measured once
    return F.transform(starts, lambda s: F.substring(c, F.greatest(s - before + 1, F.lit(1)), F.least(s, F.lit(before)) + len(keyword) + after))
