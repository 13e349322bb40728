"""String expressions: CJK filters, dictionary matching, names, dates, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from planspark.functions import dictionaries as D


def keep_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{D.CJK}]", "")


def has_cjk(text: Column, wide: bool = True) -> Column:
    return text.rlike(f"[{D.CJK_WIDE if wide else D.CJK}]")


def label_length_ok(text: Column, low: int = 2, high: int = 7) -> Column:
    """The text has ``low`` to ``high`` CJK characters."""
    return F.char_length(keep_cjk(text)).between(low, high)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def is_legend_label(text: Column) -> Column:
    return (F.char_length(text) >= 2) & ~contains_any(text, D.NOTE_WORDS) & has_cjk(text)


def legend_role(type: Column, text: Column) -> Column:
    """'label' for CJK texts, 'drop' for longer Latin texts, else 'symbol'."""
    return (
        F.when((type == "Text") & has_cjk(text, wide=False), "label")
        .when((type == "Text") & (F.char_length(text) > 2), "drop")
        .otherwise("symbol")
    )


def first_category(text: Column, words: Mapping[str, Iterable[str]], default: str) -> Column:
    """The first category with a word that occurs in the text."""
    hits = [F.when(contains_any(text, ws), F.lit(name)) for name, ws in words.items()]
    return F.coalesce(*hits, F.lit(default))


def first_pattern(text: Column, patterns: Mapping[str, str]) -> Column:
    """The first category whose pattern occurs, ignoring case and across lines.

    An empty pattern matches everything. Patterns that are plain words side by
    side are looked up in the text, lower-cased once; only the others are run
    as regular expressions.
    """

    def test(t: Column, low: Column, pattern: str) -> Column:
        words = pattern.split("|")
        if any(re.search(r"[\\.^$*+?()\[\]{}]", w) for w in words):
            return t.rlike(f"(?is){pattern}")
        return contains_any(low, [w.lower() for w in words])

    def first(both: Column) -> Column:
        return F.coalesce(*[F.when(test(both["t"], both["low"], p), F.lit(name)) for name, p in patterns.items()])

    # inside the array the lower-cased text is a value, not an expression repeated per word
    return F.get(F.transform(F.array(F.struct(text.alias("t"), F.lower(text).alias("low"))), first), F.lit(0))


def all_categories(text: Column, words: Mapping[str, Iterable[str]], default: str | None) -> Column:
    """Every category with a word in the text, in dictionary order."""
    hits = F.array_compact(
        F.array(*[F.when(contains_any(text, ws), F.lit(name)) for name, ws in words.items()])
    )
    if default is None:
        return hits
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def subject_of(category: Column) -> Column:
    """The subject that lists a legend category."""
    pairs = [(c, s) for s, cats in D.LEGEND_SUBJECTS.items() for c in cats]
    return F.coalesce(*[F.when(category == c, F.lit(s)) for c, s in pairs])


def room_functions(text: Column) -> Column:
    """Room functions of a label; empty when only the default class applies."""
    return all_categories(text, D.ROOM_WORDS, None)


# --- names -------------------------------------------------------------------


def drop_name_parts(name: Column, parts: int, suffix: str = "") -> Column:
    """A name without its last ``parts`` dash-separated parts."""
    return F.concat(F.regexp_replace(name, f"(-[^-]*){{{parts}}}$", ""), F.lit(suffix))


def viewport_of(path: Column, kind: str = "model") -> Column:
    """The viewport in ``<drawing>--&&&--<viewport>-<kind>.json``, null for other names."""
    found = F.regexp_extract(path, f"--&&&--(.*)-{kind}\\.json$", 1)
    return F.when(path.rlike(f"--&&&--.*-{kind}\\.json$"), found)


def natural_key(name: Column) -> Column:
    """Sort key of alternating texts and numbers; numbers of any length compare by value.

    A number is written as its count of digits, then the digits.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    keyed = F.transform(
        runs,
        lambda r: F.when(r.rlike("^[0-9]"), _counted(F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(r),
    )
    return F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), keyed)).otherwise(keyed)


def _counted(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def type_fanout(task_type: Column) -> Column:
    """Jobs of a task: ``Area`` covers the others, unknown names are ignored."""
    parts = F.split(task_type, ",")
    known = F.filter(parts, lambda p: p.isin("Door", "Window", "Wall"))
    return F.when(F.array_contains(parts, "Area"), F.array(F.lit("Area"))).otherwise(known)


# --- base64 ------------------------------------------------------------------


def to_base64(content: Column, prefix: str = "") -> Column:
    """One line of base64: the line breaks of the MIME form are taken out."""
    return F.concat(F.lit(prefix), F.translate(F.base64(content), "\r\n", ""))


def from_base64(text: Column) -> Column:
    """Decode base64 text after an optional ``data:...,`` prefix."""
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))


# --- dates ---------------------------------------------------------------------


def js_date(text: Column) -> Column:
    """Naive time of a JavaScript date string.

    The weekday is not checked and the offset after ``GMT`` is ignored.
    """
    clock = F.regexp_extract(text, r"^\S+ (\w{3} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}) \S", 1)
    return F.try_to_timestamp(clock, F.lit("MMM d yyyy HH:mm:ss")).cast("timestamp_ntz")


# --- tokens ---------------------------------------------------------------------


def characters(text: Column) -> Column:
    """The characters of a text by code point."""
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def tokens(text: Column, by_word: bool = False) -> Column:
    return F.split(text, " ") if by_word else characters(text)


def padded(items: Column, size: int, filler: Column) -> Column:
    """Exactly ``size`` items: cut, or filled up at the end."""
    missing = F.greatest(F.lit(0), F.lit(size) - F.size(items))
    return F.slice(F.concat(items, F.array_repeat(filler, missing)), 1, size)


def ngram_hashes(ids: Column, buckets: int = D.HASH_BUCKETS) -> tuple[Column, Column]:
    """Bucket numbers of the two and three preceding ids per position; missing ids are 0."""
    n = F.size(ids)

    def before(i: Column, k: int) -> Column:
        return F.coalesce(F.get(ids, i - k), F.lit(0)).cast("long")

    def over(fn) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), fn)).otherwise(
            F.array().cast("array<bigint>")
        )

    bigram = over(lambda i: before(i, 1) * D.HASH_A % buckets)
    trigram = over(
        lambda i: (before(i, 2) * (D.HASH_A * D.HASH_B) + before(i, 1) * D.HASH_A) % buckets
    )
    return bigram, trigram
