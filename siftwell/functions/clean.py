"""Cleaning of single values as Column expressions; each has a plain-SQL twin in the catalog's checks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.config import STATUSES, SUFFIX_WORDS

#: White space in the syntax that Java's and RE2's regular expressions share.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def status(raw: Column) -> Column:
    """One of the canonical stages by its letters alone, else null."""
    table = F.create_map(*[x for s in STATUSES for x in (F.lit("".join(c for c in s.lower() if c.isalpha())), F.lit(s))])
    return F.element_at(table, F.regexp_replace(F.lower(raw), "[^a-z]", ""))


def country(raw: Column) -> Column:
    """Each word capitalised, words of up to three capitals kept."""

    def word(w: Column) -> Column:
        loud = (F.length(w) <= 3) & (F.upper(w) == w) & (F.lower(w) != w)
        return F.when(loud, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))

    return blank_to_null(F.array_join(F.transform(F.split(squeezed(raw), " "), word), " "))


def owner(raw: Column) -> Column:
    return blank_to_null(squeezed(raw))


def _date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (F.when(x != "", x).cast("int") for x in (year, month, day))
    first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def date(raw: Column) -> Column:
    """Year-month-day or month/day/year; of a moment with a T only what stands before it."""
    x = F.substring_index(trimmed(raw), "T", 1)
    iso, us = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    part = lambda p, i: F.regexp_extract(x, p, i)
    return F.coalesce(_date(part(iso, 1), part(iso, 2), part(iso, 3)), _date(part(us, 3), part(us, 1), part(us, 2)))


def phone_digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def phone_key(digits: Column) -> Column:
    return F.right(digits, F.lit(9))


def email(raw: Column) -> Column:
    return blank_to_null(F.lower(trimmed(raw)))


def email_local(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def email_domain(address: Column) -> Column:
    """Everything after the first @, '' without one."""
    return F.when(F.contains(address, F.lit("@")), F.substring(address, F.instr(address, F.lit("@")) + 1, F.length(address))).otherwise(F.when(address.isNotNull(), F.lit("")))


def domain_root(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def email_variants(local: Column) -> Column:
    """The mailbox name as it is and without marks."""
    low = F.lower(trimmed(local))
    return F.when(low != "", F.array_distinct(F.array(low, F.regexp_replace(low, "[^a-z0-9]", "")))).otherwise(F.array().cast("array<string>"))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, and those letters: made from Unicode's own table."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(text: Column) -> Column:
    source, target = _accents()
    return F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")


def name_tokens(text: Column) -> Column:
    """Lower-case words without accents; hyphens stay inside a word. Null gives an empty array."""
    return F.filter(F.split(F.lower(unaccented(F.coalesce(text, F.lit("")))), "[^a-z0-9-]+"), lambda t: t != "")


def resolved_name(first: Column, last: Column, full: Column) -> dict[str, Column]:
    """first_name, last_name, display_name, name_key, name_tokens from names given in parts or as a whole.

    The whole is split into its first and last word only where both parts are blank; a single
    word is a family name. The whole wins for display.
    """
    f, la, w = (F.coalesce(trimmed(c), F.lit("")) for c in (first, last, full))
    words = F.split(squeezed(w), " ")
    split = (f == "") & (la == "") & (w != "")
    display = squeezed(F.when(w != "", w).otherwise(F.concat(f, F.lit(" "), la)))
    tokens = name_tokens(display)
    return {
        "first_name": blank_to_null(F.when(split, F.when(F.size(words) > 1, words[0]).otherwise(F.lit(""))).otherwise(f)),
        "last_name": blank_to_null(F.when(split, F.element_at(words, -1)).otherwise(la)),
        "display_name": blank_to_null(display),
        "name_key": F.array_join(tokens, ""),
        "name_tokens": tokens,
    }


def company_tokens(raw: Column) -> Column:
    return F.filter(F.split(F.lower(unaccented(F.coalesce(raw, F.lit("")))), "[^a-z0-9]+"), lambda t: t != "")


def company_core(raw: Column) -> Column:
    """The name's words without the weak ones at its end; at least one word stays."""
    words = company_tokens(raw)
    suffix = F.array(*map(F.lit, SUFFIX_WORDS))
    indexed = F.transform(words, lambda t, i: F.when((i == 0) | ~F.array_contains(suffix, t), i + 1).otherwise(F.lit(0)))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(F.coalesce(F.array_max(indexed), F.lit(0)), F.lit(0))), " ")


MARKER = r"(?i)\s*possible duplicate\s*[—-]?\s*verify before contacting\.?"


def without_marker(notes: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(notes, F.lit("")), MARKER, ""))


def has_marker(notes: Column) -> Column:
    return F.rlike(F.coalesce(notes, F.lit("")), F.lit(MARKER))


def whole_number(raw: Column) -> Column:
    return F.trim(raw).try_cast("int")


def squash(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
