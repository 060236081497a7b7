r"""Label sets as canonical text.

A label set travels through plans as one string, ``a="1",b="2"``: pairs sorted, ``\`` and ``"``
escaped. One string is a cheap hash-aggregation, join and window key, which a MAP is not, and
most label operations are a single regular expression on it. ``labels_of`` turns it back into
a map where a map is wanted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "__name__"

_VALUE = r'[^"\\]*+(?:\\[\s\S][^"\\]*+)*+'
_KEY = r'[^=,"\\]*+(?:\\[\s\S][^=,"\\]*+)*+'
_PAIR = rf',?({_KEY})="({_VALUE})"'


def _escape_value(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _escape_key(c: Column) -> Column:
    for mark in ("\\", "=", ",", '"'):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def _escape_key_text(key: str) -> str:
    return re.sub(r'([\\=,"])', r"\\\1", key)


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def _key_pattern(key: str) -> str:
    """The escaped key, quoted for Java and Python regular expressions alike."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", _escape_key_text(key))


def pair(key: Column, value: Column) -> Column:
    """One rendered label."""
    return F.concat(_escape_key(key), F.lit('="'), _escape_value(value), F.lit('"'))


def named_pair(key: str, value: Column) -> Column:
    return F.concat(F.lit(_escape_key_text(key) + '="'), _escape_value(value), F.lit('"'))


def fingerprint(labels: Column) -> Column:
    """Canonical text of a MAP column; null keys and values do not occur."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(labels), lambda e: pair(e["key"], e["value"]))), ",")


def fingerprint_columns(labels: Mapping[str, Column | str]) -> Column:
    """Canonical text from a fixed set of label columns; a null value means the label is absent."""
    parts = []
    for key in sorted(labels, key=_place):
        value = labels[key]
        parts.append(named_pair(key, value if isinstance(value, Column) else F.lit(value)))
    return F.concat_ws(",", *parts)


def _place(key: str) -> str:
    """What decides the order of a pair: its rendered key."""
    return _escape_key_text(key) + '="'


def labels_of(fp: Column | str = "labels_fp") -> Column:
    """MAP<STRING,STRING> of a canonical text."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    keys = F.regexp_extract_all(fp, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(fp, F.lit(_PAIR), F.lit(2))
    plain = F.map_from_arrays(keys, values)
    return F.when(
        fp.contains("\\"), F.map_from_arrays(F.transform(keys, _unescape), F.transform(values, _unescape))
    ).otherwise(plain)


def has_label(fp: Column, key: str) -> Column:
    return fp.rlike(rf'(?:^|",){_key_pattern(key)}="')


def _first(fp: Column, pattern: str) -> Column:
    # null without a match, unlike regexp_extract, and evaluated once
    return F.get(F.regexp_extract_all(fp, F.lit(pattern), F.lit(1)), F.lit(0))


def label(fp: Column | str, key: str) -> Column:
    """Value of one label, null when it is absent."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return _unescape(_first(fp, rf'(?:^|",){_key_pattern(key)}="({_VALUE})"'))


def without(fp: Column | str, keys: Iterable[str]) -> Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    keys = sorted(set(keys))
    if not keys:
        return fp
    names = "|".join(_key_pattern(k) for k in keys)
    return F.regexp_replace(F.regexp_replace(fp, rf'(?:^|(?<="),)(?:{names})="{_VALUE}"', ""), "^,", "")


def without_name(fp: Column | str = "labels_fp") -> Column:
    return without(fp, [NAME])


def only(fp: Column | str, keys: Iterable[str]) -> Column:
    """Keep the listed labels that exist."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    parts = [_first(fp, rf'(?:^|",)({_key_pattern(k)}="{_VALUE}")') for k in sorted(set(keys), key=_place)]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def with_label(fp: Column | str, key: str, value: Column) -> Column:
    """Set one label, replacing an older value."""
    rest = F.regexp_extract_all(without(fp, [key]), F.lit(rf',?({_KEY}="{_VALUE}")'), F.lit(1))
    return F.array_join(F.sort_array(F.array_append(rest, named_pair(key, value))), ",")


def merge(base: Column, over: Column) -> Column:
    """Map union in which ``over`` wins on equal keys (resource overlaid by attributes)."""
    empty = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def drop_empty(labels: Column) -> Column:
    """Attributes that are null or empty text are not stored."""
    return F.map_filter(labels, lambda _, v: v.isNotNull() & (v != ""))


def _exposed_entries(labels: Column) -> Column:
    def names(e: Column) -> Column:
        both = F.array(
            F.named_struct(F.lit("key"), F.lit("job"), F.lit("value"), e["value"]),
            F.named_struct(F.lit("key"), F.lit("service_name"), F.lit("value"), e["value"]),
        )
        plain = F.array(
            F.named_struct(F.lit("key"), F.replace(e["key"], F.lit("."), F.lit("_")), F.lit("value"), e["value"])
        )
        return F.when(e["key"] == "service.name", both).otherwise(plain)

    return F.flatten(F.transform(F.map_entries(labels), names))


def expose(labels: Column) -> Column:
    """Stored attribute keys → exposed label names.

    ``service.name`` becomes both ``job`` and ``service_name``; elsewhere dots become underscores.
    If two keys collapse onto one name the last entry wins.
    """
    entries = _exposed_entries(labels)
    keys = F.transform(entries, lambda e: e["key"])
    distinct = F.array_distinct(keys)
    # only label sets in which names collide pay for the search
    last = F.transform(distinct, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.when(F.size(distinct) == F.size(keys), F.map_from_entries(entries)).otherwise(
        F.map_from_arrays(distinct, last)
    )


def _between(low: str | None, high: str | None) -> Callable[[Column], Column]:
    def test(p: Column) -> Column:
        above = F.lit(True) if low is None else p > low
        return above if high is None else above & (p < high)

    return test


def render_exposed(df: DataFrame, labels: str, around: Sequence[str]) -> DataFrame:
    """Add ``__p0, __p1, …``: the exposed labels of a row as arrays of rendered pairs, cut at the places
    where the labels ``around`` belong, so that these can be filled in later without sorting again."""
    places = sorted(_place(k) for k in around)
    out = df.withColumn("__exposed", expose(F.col(labels))).withColumn(
        "__pairs", F.sort_array(F.transform(F.map_entries("__exposed"), lambda e: pair(e["key"], e["value"])))
    )
    for i in range(len(places) + 1):
        low = places[i - 1] if i > 0 else None
        high = places[i] if i < len(places) else None
        out = out.withColumn(f"__p{i}", F.filter("__pairs", _between(low, high)))
    return out.drop("__exposed", "__pairs")


def exposed_keys(key: str) -> list[str]:
    return ["job", "service_name"] if key == "service.name" else [key.replace(".", "_")]


def matches(fp: Column, key: str, op: str, value: str) -> Column:
    """Label matcher: a missing label equals ""; ``=~`` needs the label, ``!~`` accepts its absence.

    Regular expressions are unanchored.
    """
    v = label(fp, key)
    if op == "=":
        return F.coalesce(v, F.lit("")) == value
    if op == "!=":
        return F.coalesce(v, F.lit("")) != value
    if op == "=~":
        return F.coalesce(v.rlike(value), F.lit(False))
    if op == "!~":
        return ~F.coalesce(v.rlike(value), F.lit(False))
    raise ValueError(f"unknown matcher {op!r}")
