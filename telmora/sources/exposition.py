"""Text exposition of an instant vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import labels as L
from telmora.operators.histogram import le_text


def sample_text(value: Column) -> Column:
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == F.lit(float("-inf")), F.lit("-Inf"))
        .otherwise(le_text(value))
    )


def exposition_lines(vector: DataFrame, metadata: DataFrame) -> DataFrame:
    """``family, position, line``: a ``# TYPE`` header (position 0) per family, then its samples.

    ``metadata``: ``metric, kind`` of the exposed names. Sorting by (family, position, line) gives the
    text; a histogram's ``_bucket``, ``_sum`` and ``_count`` share one family.
    """
    family = F.when(
        F.col("kind") == "histogram", F.regexp_replace("metric", r"(?<=.)(_bucket|_sum|_count)$", "")
    ).otherwise(F.col("metric"))
    meta = metadata.withColumn("family", family)
    header = meta.select(
        "family",
        F.lit(0).alias("position"),
        F.concat_ws(" ", F.lit("# TYPE"), "family", "kind").alias("line"),
    ).distinct()
    labels = L.without_name("labels_fp")
    text = F.concat(
        F.col("metric"),
        F.when(labels != "", F.concat(F.lit("{"), F.replace(labels, F.lit("\n"), F.lit("\\n")), F.lit("}"))).otherwise(
            F.lit("")
        ),
        F.lit(" "),
        sample_text(F.col("value")),
        F.lit(" "),
        F.col("sample_ts_ms").cast("string"),
    )
    body = (
        vector.withColumn("metric", L.label("labels_fp", L.NAME))
        .join(meta.select("metric", "family"), "metric")
        .select("family", F.lit(1).alias("position"), text.alias("line"))
    )
    return header.unionByName(body)


def write_exposition(lines: DataFrame, path: str) -> None:
    lines.orderBy("family", "position", "line").select("line").write.mode("overwrite").text(path)
