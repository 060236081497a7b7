"""Attribute access on spans and logs (maps ``attrs`` and ``resource``), and route parsing."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SERVICE_KEYS = ("service.name", "service_name")
VERSION_KEYS = ("service.version", "service_version")


def _at(column: str, key: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(key))


def first_of(keys: Sequence[str]) -> Column:
    """First value found under ``keys``; attributes before resource."""
    return F.coalesce(*[_at(c, k) for k in keys for c in ("attrs", "resource")])


def service() -> Column:
    return first_of(SERVICE_KEYS)


def version() -> Column:
    return first_of(VERSION_KEYS)


def any_value(keys: Sequence[str], test) -> Column:
    """True if some value under one of ``keys``, in attributes or resource, satisfies ``test``."""
    cond = F.lit(False)
    for k in keys:
        for c in ("attrs", "resource"):
            cond = cond | F.coalesce(test(_at(c, k)), F.lit(False))
    return cond


def both_spellings(key: str) -> list[str]:
    """``service.name`` and ``service_name`` name the same attribute."""
    return list(dict.fromkeys([key, key.replace(".", "_") if "." in key else key.replace("_", ".")]))


def service_list(names: Iterable[str] | None, name: str | None = None) -> list[str] | None:
    """The effective service filter: the list beats the single name, blanks fall out, empty = none."""
    for candidate in (names, [name] if name else None):
        kept = [n for n in candidate or () if n and n.strip()]
        if kept:
            return kept
    return None


def in_services(names: Sequence[str]) -> Column:
    return any_value(SERVICE_KEYS, lambda v: v.isin(list(names)))


def has_version(value: str) -> Column:
    return any_value(VERSION_KEYS, lambda v: v == value)


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


# Names of missing endpoint parts.
UNKNOWN_CONTROLLER = "(unbekannt)"
UNNAMED = "(ohne Name)"


def controller_of_route(route: Column) -> Column:
    """First path segment after a leading ``api`` and a version segment (``v1``, ``v2``, …)."""
    segments = F.split(F.regexp_replace(route, "^/+|/+$", ""), "/")
    after_api = F.when(F.lower(F.get(segments, F.lit(0))) == "api", 1).otherwise(0)
    skipped = after_api + F.when(F.get(segments, after_api).rlike("^[vV][0-9]+$"), 1).otherwise(0)

    def first_filled(a: Column) -> Column:
        return F.get(F.filter(a, lambda s: F.trim(s) != ""), F.lit(0))

    rest = F.slice(segments, skipped + 1, F.greatest(F.size(segments) - skipped, F.lit(0)))
    named = F.coalesce(first_filled(rest), first_filled(segments), F.lit(UNKNOWN_CONTROLLER))
    return F.when(_blank_to_null(route).isNull(), F.lit(UNKNOWN_CONTROLLER)).otherwise(named)


def controller(attr: Column, route: Column) -> Column:
    return F.coalesce(_blank_to_null(attr), controller_of_route(route))


def action(attr: Column, route: Column, span_name: Column) -> Column:
    return F.coalesce(_blank_to_null(attr), _blank_to_null(route), _blank_to_null(span_name), F.lit(UNNAMED))


# Characters of a search text that separate words like a blank does.
_PHRASE_BREAKERS = r"[*:()^]"


def searchable(text: Column) -> Column:
    """Lower-case words without diacritics, separated and surrounded by single blanks."""
    plain = F.regexp_replace(_fold(F.lower(text)), r"\p{M}", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


@cache
def _accented() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is a letter from a to z and marks, and those letters."""
    plain: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x10000)):
        whole = unicodedata.normalize("NFD", c)
        if whole[0] in string.ascii_lowercase and len(whole) > 1 and all(map(unicodedata.combining, whole[1:])):
            plain[c] = whole[0]
    return "".join(plain), "".join(plain.values())


def _fold(text: Column) -> Column:
    return F.translate(text, *_accented())


def contains_phrase(text: Column, phrase: str) -> Column:
    """Case- and diacritic-insensitive search for a sequence of whole words. A phrase without any word
    finds nothing."""
    wanted = searchable(F.regexp_replace(F.lit(phrase), _PHRASE_BREAKERS, " "))
    return (F.trim(wanted) != "") & F.coalesce(searchable(text).contains(wanted), F.lit(False))
