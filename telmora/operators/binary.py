"""Operators between vectors and scalars.

A scalar is a number or, when it depends on the evaluation time, a Column of ``t_ms``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L

Scalar = float | int | Column
Operand = DataFrame | Scalar

# With on/ignoring one match key may stand for very many series of a side; its rows are cut into this
# many slices, and the reduced other side is repeated once per slice.
_SLICES = 8


def _is_vector(x: Operand) -> bool:
    return isinstance(x, DataFrame)


def match_labels(fp: Column, on: Iterable[str] | None, ignoring: Iterable[str] | None) -> Column:
    if on is not None and ignoring is not None:
        raise ValueError("give either on or ignoring")
    if on is not None:
        return L.only(fp, on)
    return L.without(fp, [*(ignoring or ()), L.NAME])


def _result_labels(fp: Column, on: Iterable[str] | None) -> Column:
    return L.without_name(fp) if on is None else L.only(fp, on)


def arithmetic(
    left: Operand,
    op: str,
    right: Operand,
    on: Iterable[str] | None = None,
    ignoring: Iterable[str] | None = None,
    group_left: Iterable[str] | None = None,
    group_right: Iterable[str] | None = None,
) -> Operand:
    """``+ - * / % ^``. Scalar operands keep all labels of the vector, including its name."""
    fn = ieee.ARITHMETIC[op]
    if not _is_vector(left) and not _is_vector(right):
        return fn(left, right)
    if not _is_vector(right):
        return _with_value(left, fn(F.col("value"), right))
    if not _is_vector(left):
        return _with_value(right, fn(left, F.col("value")))
    pairs = _matched(left, right, on, ignoring, group_left, group_right)
    return pairs.select(
        F.col("__out").alias("labels_fp"),
        "t_ms",
        F.col("t_ms").alias("sample_ts_ms"),
        fn(F.col("__l"), F.col("__r")).alias("value"),
    )


def comparison(
    left: Operand,
    op: str,
    right: Operand,
    bool_: bool = False,
    on: Iterable[str] | None = None,
    ignoring: Iterable[str] | None = None,
    group_left: Iterable[str] | None = None,
    group_right: Iterable[str] | None = None,
) -> Operand:
    """``== != > < >= <=``: keep the left sample where true, or 1/0 with ``bool_``."""
    if not _is_vector(left) and not _is_vector(right):
        return ieee.compare(op, left, right).cast("double")
    if not _is_vector(left) or not _is_vector(right):
        vector = left if _is_vector(left) else right
        l_value = F.col("value") if _is_vector(left) else left
        r_value = F.col("value") if _is_vector(right) else right
        cond = ieee.compare(op, l_value, r_value)
        return _with_value(vector, cond.cast("double")) if bool_ else vector.where(cond)
    pairs = _matched(left, right, on, ignoring, group_left, group_right)
    cond = ieee.compare(op, F.col("__l"), F.col("__r"))
    if bool_:
        value, time = cond.cast("double"), F.col("t_ms")
    else:
        pairs = pairs.where(cond)
        grouped = group_left is not None or group_right is not None
        value, time = F.col("__l"), F.col("t_ms") if grouped else F.col("__l_ts")
    return pairs.select(
        F.col("__out").alias("labels_fp"), "t_ms", time.alias("sample_ts_ms"), value.alias("value")
    )


def _with_value(vector: DataFrame, value: Column) -> DataFrame:
    return vector.select("labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), value.alias("value"))


def negate(vector: DataFrame) -> DataFrame:
    """Unary minus; labels and sample times are kept."""
    return vector.withColumn("value", -F.col("value"))


def _keyed(vector: DataFrame, on, ignoring) -> DataFrame:
    return vector.withColumn("__key", match_labels(F.col("labels_fp"), on, ignoring))


def _slices(on, ignoring) -> int:
    return 1 if on is None and ignoring is None else _SLICES


def _sliced(many: DataFrame, slices: int) -> DataFrame:
    if slices == 1:
        return many.withColumn("__slice", F.lit(0))
    return many.withColumn("__slice", F.pmod(F.xxhash64("labels_fp"), F.lit(slices)).cast("int"))


def _repeated(one: DataFrame, slices: int) -> DataFrame:
    return one.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def _matched(left, right, on, ignoring, group_left, group_right) -> DataFrame:
    """Pairs with both values and the result labels.

    Of several samples of the "one" side with the same match key, the one with the greatest labels
    counts. Result labels come from the left side; with ``group_right`` that is the "one" side.
    Labels named in ``group_left``/``group_right`` are taken from the same side as the result labels.
    """
    if group_left is not None and group_right is not None:
        raise ValueError("give either group_left or group_right")
    right_many = group_right is not None
    many, one = (right, left) if right_many else (left, right)
    reduced = (
        _keyed(one, on, ignoring)
        .groupBy("t_ms", "__key")
        .agg(F.max(F.struct("labels_fp", "value", "sample_ts_ms")).alias("__one"))
        .select(
            "t_ms",
            "__key",
            F.col("__one.labels_fp").alias("__one_fp"),
            F.col("__one.value").alias("__one_value"),
            F.col("__one.sample_ts_ms").alias("__one_ts"),
        )
    )
    n = _slices(on, ignoring)
    pairs = _sliced(_keyed(many, on, ignoring), n).join(
        _repeated(reduced, n), ["t_ms", "__key", "__slice"], "inner"
    )
    source = F.col("__one_fp") if right_many else F.col("labels_fp")
    included = list((group_right if right_many else group_left) or ())
    out = _result_labels(source, on)
    if included:
        keep = set(included) | set(on) if on is not None else None
        out = L.only(source, keep) if keep is not None else L.without_name(source)
    l_value, r_value = ("__one_value", "value") if right_many else ("value", "__one_value")
    return pairs.select(
        out.alias("__out"),
        "t_ms",
        F.col(l_value).alias("__l"),
        F.col(r_value).alias("__r"),
        F.col("__one_ts" if right_many else "sample_ts_ms").alias("__l_ts"),
    )


def _keys_of(vector: DataFrame, on, ignoring, n: int) -> DataFrame:
    return _repeated(_keyed(vector, on, ignoring).select("t_ms", "__key").distinct(), n)


def _filtered(left: DataFrame, right: DataFrame, how: str, on, ignoring) -> DataFrame:
    n = _slices(on, ignoring)
    return (
        _sliced(_keyed(left, on, ignoring), n)
        .join(_keys_of(right, on, ignoring, n), ["t_ms", "__key", "__slice"], how)
        .select("labels_fp", "t_ms", "sample_ts_ms", "value")
    )


def and_(left: DataFrame, right: DataFrame, on=None, ignoring=None) -> DataFrame:
    return _filtered(left, right, "left_semi", on, ignoring)


def unless(left: DataFrame, right: DataFrame, on=None, ignoring=None) -> DataFrame:
    return _filtered(left, right, "left_anti", on, ignoring)


def or_(left: DataFrame, right: DataFrame, on=None, ignoring=None) -> DataFrame:
    """All left samples and the right samples whose match key the left side lacks."""
    columns = ["labels_fp", "t_ms", "sample_ts_ms", "value"]
    return left.select(*columns).unionByName(unless(right, left, on, ignoring))
