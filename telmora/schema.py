"""Column layouts of the telemetry tables and the integer codes they use."""

from __future__ import annotations

from pyspark.sql import types as T

# Span kind, status, severity, metric type and temporality codes.
KIND_INTERNAL, KIND_SERVER, KIND_CLIENT, KIND_PRODUCER, KIND_CONSUMER = 0, 1, 2, 3, 4
STATUS_UNSET, STATUS_OK, STATUS_ERROR = 0, 1, 2
SEV_TRACE, SEV_DEBUG, SEV_INFO, SEV_WARN, SEV_ERROR, SEV_FATAL = 1, 5, 9, 13, 17, 21
TYPE_GAUGE, TYPE_SUM, TYPE_HISTOGRAM = 0, 1, 2
TEMP_UNSPECIFIED, TEMP_DELTA, TEMP_CUMULATIVE = 0, 1, 2

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000
DEFAULT_LOOKBACK_MS = 300_000

LABELS = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType(
    [T.StructField("ts", T.LongType()), T.StructField("name", T.StringType()), T.StructField("attrs", LABELS)]
)
LINK = T.StructType(
    [T.StructField("trace", T.StringType()), T.StructField("span", T.StringType()), T.StructField("attrs", LABELS)]
)

SPANS = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("start_unix_nano", T.LongType()),
        T.StructField("end_unix_nano", T.LongType()),
        T.StructField("duration_ns", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("status_msg", T.StringType()),
        T.StructField("attrs", LABELS),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("resource", LABELS),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("ts_unix_nano", T.LongType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("attrs", LABELS),
        T.StructField("resource", LABELS),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

# A metric point before its labels are interned into the series dictionary.
POINTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("temporality", T.IntegerType()),
        T.StructField("ts_unix_nano", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("bucket_counts", T.ArrayType(T.LongType())),
        T.StructField("explicit_bounds", T.ArrayType(T.DoubleType())),
        T.StructField("attrs", LABELS),
        T.StructField("resource", LABELS),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
    ]
)

METRIC_SERIES = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("attrs", LABELS),
        T.StructField("resource", LABELS),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
    ]
)

METRICS = T.StructType(
    [T.StructField("series_id", T.StringType())]
    + [f for f in POINTS.fields if f.name not in ("attrs", "resource", "scope_name", "scope_version")]
    + [T.StructField("day", T.DateType())]
)

# samples: one row per Prometheus-style point; vector: one row per series and evaluation step.
SAMPLES = T.StructType(
    [
        T.StructField("labels_fp", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("is_delta", T.BooleanType()),
    ]
)
VECTOR = T.StructType(
    [
        T.StructField("labels_fp", T.StringType()),
        T.StructField("t_ms", T.LongType()),
        T.StructField("sample_ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)
