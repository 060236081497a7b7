"""OTLP/JSON exports → span, log and metric-point rows.

One JSON document per line holds one export request. The same functions work on a batch and on a
streaming DataFrame read with these schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora import schema as S
from telmora.operators.histogram import le_text

CORRUPT = "_corrupt_record"

# 64-bit integers may be JSON numbers or text, so they are read as text; nested values stay JSON text.
_ANY = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:string,bytesValue:string,"
    "arrayValue:string,kvlistValue:string>"
)
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_RESOURCE = f"struct<attributes:{_ATTRS}>"
_SCOPE = f"struct<name:string,version:string,attributes:{_ATTRS}>"
_NUMBER_POINT = f"struct<attributes:{_ATTRS},timeUnixNano:string,asDouble:string,asInt:string>"
_HISTOGRAM_POINT = (
    f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,"
    "explicitBounds:array<string>,min:double,max:double>"
)

TRACES_DDL = (
    f"resourceSpans array<struct<resource:{_RESOURCE},scopeSpans:array<struct<scope:{_SCOPE},"
    "spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRS}>>,"
    f"links:array<struct<traceId:string,spanId:string,attributes:{_ATTRS}>>,"
    "status:struct<code:string,message:string>>>>>>>"
)
LOGS_DDL = (
    f"resourceLogs array<struct<resource:{_RESOURCE},scopeLogs:array<struct<scope:{_SCOPE},"
    "logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,"
    f"severityText:string,body:{_ANY},attributes:{_ATTRS},traceId:string,spanId:string>>>>>>"
)
METRICS_DDL = (
    f"resourceMetrics array<struct<resource:{_RESOURCE},scopeMetrics:array<struct<scope:{_SCOPE},"
    "metrics:array<struct<name:string,unit:string,"
    f"gauge:struct<dataPoints:array<{_NUMBER_POINT}>>,"
    f"sum:struct<aggregationTemporality:string,dataPoints:array<{_NUMBER_POINT}>>,"
    f"histogram:struct<aggregationTemporality:string,dataPoints:array<{_HISTOGRAM_POINT}>>,"
    "exponentialHistogram:string,summary:string>>>>>>"
)
DDL = {"traces": TRACES_DDL, "logs": LOGS_DDL, "metrics": METRICS_DDL}


def _schema(signal: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[signal]).add(CORRUPT, T.StringType())


def read_requests(spark: SparkSession, signal: str, path: str) -> DataFrame:
    """Requests of one signal ("traces", "logs", "metrics"); unreadable lines keep their text in
    ``_corrupt_record`` and yield no rows."""
    return spark.read.schema(_schema(signal)).option("mode", "PERMISSIVE").json(path)


def stream_requests(spark: SparkSession, signal: str, path: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(_schema(signal))
        .option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def any_text(v: Column) -> Column:
    """Any value as text: booleans ``true``/``false``, bytes as lower-case hex, lists and maps as JSON."""
    number = v["doubleValue"].try_cast("double")
    double = F.when(F.isnan(number), F.lit("NaN")).when(number == float("-inf"), F.lit("-Infinity")).when(
        number == float("inf"), F.lit("Infinity")
    ).otherwise(le_text(number))
    return F.coalesce(
        v["stringValue"],
        v["boolValue"].cast("string"),
        v["intValue"],
        double,
        F.lower(F.hex(F.try_to_binary(v["bytesValue"], F.lit("base64")))),
        F.concat(F.lit('{"arrayValue":'), _compact(v["arrayValue"]), F.lit("}")),
        F.concat(F.lit('{"kvlistValue":'), _compact(v["kvlistValue"]), F.lit("}")),
    )


def _compact(json: Column) -> Column:
    """The same JSON without insignificant blanks."""
    return F.to_json(F.try_parse_json(json))


def attributes(list_: Column) -> Column:
    """Key/value list → map; empty keys and values fall out, the last of equal keys wins."""
    pairs = F.filter(
        F.transform(list_, lambda e: _named(key=e["key"], value=any_text(e["value"]))),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_from_arrays(keys, values), empty)


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _long(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def _code(c: Column, names: dict[str, int]) -> Column:
    """Enum value written as number or as name."""
    out = None
    for name, n in names.items():
        out = F.when(c == name, n) if out is None else out.when(c == name, n)
    return F.coalesce(c.try_cast("int"), out)


# Protocol names of span kinds, status codes, temporalities.
_KINDS = {f"SPAN_KIND_{n}": i for i, n in enumerate(["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"])}
_STATUSES = {"STATUS_CODE_UNSET": 0, "STATUS_CODE_OK": 1, "STATUS_CODE_ERROR": 2}
_TEMPORALITIES = {
    "AGGREGATION_TEMPORALITY_UNSPECIFIED": 0,
    "AGGREGATION_TEMPORALITY_DELTA": 1,
    "AGGREGATION_TEMPORALITY_CUMULATIVE": 2,
}


def span_kind(c: Column) -> Column:
    """Protocol kind (1 internal … 5 consumer) → stored kind; unknown means internal."""
    n = _code(c, _KINDS)
    return F.when(n.between(2, 5), n - 1).otherwise(S.KIND_INTERNAL).cast("int")


def status_code(c: Column) -> Column:
    n = _code(c, _STATUSES)
    return F.when(n.isin(1, 2), n).otherwise(S.STATUS_UNSET).cast("int")


def temporality(c: Column) -> Column:
    n = _code(c, _TEMPORALITIES)
    return F.when(n.isin(1, 2), n).otherwise(S.TEMP_UNSPECIFIED).cast("int")


_SEVERITY_NAMES = {
    f"SEVERITY_NUMBER_{band}{'' if i == 0 else i + 1}": b * 4 + i + 1
    for b, band in enumerate(["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"])
    for i in range(4)
}


def severity(c: Column) -> Column:
    """Severity number 1…24 → lowest number of its band; unknown means info."""
    n = F.coalesce(_code(c, _SEVERITY_NAMES), F.lit(0))
    return (
        F.when(n <= 0, S.SEV_INFO)
        .when(n <= 4, S.SEV_TRACE)
        .when(n <= 8, S.SEV_DEBUG)
        .when(n <= 12, S.SEV_INFO)
        .when(n <= 16, S.SEV_WARN)
        .when(n <= 20, S.SEV_ERROR)
        .otherwise(S.SEV_FATAL)
        .cast("int")
    )


def _flatten(requests: DataFrame, resources: str, scopes: str, items: str) -> DataFrame:
    """Resource → scope → item, one row per item."""
    return (
        requests.select(F.explode(resources).alias("r"))
        .select(F.col("r.resource.attributes").alias("__res"), F.explode(f"r.{scopes}").alias("s"))
        .select(
            attributes(F.col("__res")).alias("resource"),
            _nonempty(F.col("s.scope.name")).alias("scope_name"),
            F.when(F.col("s.scope.name") != "", _nonempty(F.col("s.scope.version"))).alias("scope_version"),
            F.explode(f"s.{items}").alias("x"),
        )
        .where(F.col("x").isNotNull())
    )


def to_spans(requests: DataFrame) -> DataFrame:
    """Span rows; spans without trace id are dropped, links need both ids."""
    x = F.col("x")
    rows = _flatten(requests, "resourceSpans", "scopeSpans", "spans").where(F.length("x.traceId") > 0)
    events = F.transform(
        x["events"],
        lambda e: _named(
            ts=_long(e["timeUnixNano"]),
            name=F.coalesce(e["name"], F.lit("")),
            attrs=attributes(e["attributes"]),
        ),
    )
    links = F.transform(
        F.filter(x["links"], lambda e: (F.length(e["traceId"]) > 0) & (F.length(e["spanId"]) > 0)),
        lambda e: _named(
            trace=F.lower(e["traceId"]), span=F.lower(e["spanId"]), attrs=attributes(e["attributes"])
        ),
    )
    start, end = _long(x["startTimeUnixNano"]), _long(x["endTimeUnixNano"])
    return rows.select(
        F.lower(x["traceId"]).alias("trace_id"),
        F.lower(F.coalesce(x["spanId"], F.lit(""))).alias("span_id"),
        F.lower(_nonempty(x["parentSpanId"])).alias("parent_id"),
        F.coalesce(x["name"], F.lit("")).alias("name"),
        span_kind(x["kind"]).alias("kind"),
        start.alias("start_unix_nano"),
        end.alias("end_unix_nano"),
        F.greatest(F.lit(0).cast("long"), end - start).alias("duration_ns"),
        status_code(x["status"]["code"]).alias("status_code"),
        x["status"]["message"].alias("status_msg"),
        attributes(x["attributes"]).alias("attrs"),
        F.coalesce(events, F.array().cast(T.ArrayType(S.EVENT))).alias("events"),
        F.coalesce(links, F.array().cast(T.ArrayType(S.LINK))).alias("links"),
        "resource",
        "scope_name",
        "scope_version",
    )


def to_logs(requests: DataFrame, now_ns: int | Column | None = None) -> DataFrame:
    """Log rows; the time falls back to the observed time, then to ``now_ns`` (default: query time in
    whole seconds)."""
    x = F.col("x")
    if now_ns is None:
        now = F.unix_timestamp() * F.lit(S.NS_PER_S)
    else:
        now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns)
    zero = F.lit(0).cast("long")
    ts = F.coalesce(
        F.nullif(_long(x["timeUnixNano"]), zero), F.nullif(_long(x["observedTimeUnixNano"]), zero), now.cast("long")
    )
    return _flatten(requests, "resourceLogs", "scopeLogs", "logRecords").select(
        ts.alias("ts_unix_nano"),
        F.lower(_nonempty(x["traceId"])).alias("trace_id"),
        F.lower(_nonempty(x["spanId"])).alias("span_id"),
        severity(x["severityNumber"]).alias("severity"),
        _nonempty(x["severityText"]).alias("severity_text"),
        any_text(x["body"]).alias("body"),
        attributes(x["attributes"]).alias("attrs"),
        "resource",
        "scope_name",
        "scope_version",
    )


def to_points(requests: DataFrame) -> DataFrame:
    """Metric points of gauges, sums and histograms; the value of a histogram is its sum.

    The three kinds are brought to one point layout inside the row and exploded once, so the input is
    read once.
    """
    x = F.col("x")

    def number(points: Column, type_: int, temp: Column) -> Column:
        return F.transform(
            points,
            lambda p: _point(
                type_,
                temp,
                p,
                F.when(p["asInt"].isNotNull(), p["asInt"].try_cast("long").cast("double"))
                .otherwise(F.coalesce(p["asDouble"].try_cast("double"), F.lit(0.0))),
            ),
        )

    gauge = number(x["gauge"]["dataPoints"], S.TYPE_GAUGE, F.lit(S.TEMP_UNSPECIFIED))
    sum_ = number(x["sum"]["dataPoints"], S.TYPE_SUM, temporality(x["sum"]["aggregationTemporality"]))
    hist = F.transform(
        x["histogram"]["dataPoints"],
        lambda p: _histogram_point(temporality(x["histogram"]["aggregationTemporality"]), p),
    )
    chosen = (
        F.when(x["gauge"].isNotNull(), gauge).when(x["sum"].isNotNull(), sum_).when(x["histogram"].isNotNull(), hist)
    )
    rows = _flatten(requests, "resourceMetrics", "scopeMetrics", "metrics")
    return rows.select(
        x["name"].alias("name"),
        _nonempty(x["unit"]).alias("unit"),
        F.explode(chosen).alias("p"),
        "resource",
        "scope_name",
        "scope_version",
    ).select(
        "name",
        "unit",
        "p.type",
        "p.temporality",
        "p.ts_unix_nano",
        "p.value",
        "p.count",
        "p.sum",
        "p.min",
        "p.max",
        "p.bucket_counts",
        "p.explicit_bounds",
        "p.attrs",
        "resource",
        "scope_name",
        "scope_version",
    )


def _named(**fields: Column) -> Column:
    """Struct with explicit names; aliases get lost inside array lambdas."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def _point(type_: int, temp: Column, p: Column, value: Column) -> Column:
    none = F.lit(None)
    return _named(
        type=F.lit(type_),
        temporality=temp.cast("int"),
        ts_unix_nano=_long(p["timeUnixNano"]),
        value=value,
        count=none.cast("long"),
        sum=none.cast("double"),
        min=none.cast("double"),
        max=none.cast("double"),
        bucket_counts=none.cast("array<bigint>"),
        explicit_bounds=none.cast("array<double>"),
        attrs=attributes(p["attributes"]),
    )


def _histogram_point(temp: Column, p: Column) -> Column:
    total = F.coalesce(p["sum"], F.lit(0.0))

    def filled(list_: Column, type_: str) -> Column:
        return F.when(F.size(list_) > 0, F.transform(list_, lambda v: v.try_cast(type_)))

    return _named(
        type=F.lit(S.TYPE_HISTOGRAM),
        temporality=temp.cast("int"),
        ts_unix_nano=_long(p["timeUnixNano"]),
        value=total,
        count=_long(p["count"]),
        sum=total,
        min=p["min"],
        max=p["max"],
        bucket_counts=filled(p["bucketCounts"], "bigint"),
        explicit_bounds=filled(p["explicitBounds"], "double"),
        attrs=attributes(p["attributes"]),
    )


def rejected_metrics(requests: DataFrame) -> DataFrame:
    """Number of metrics of an unsupported kind (exponential histogram, summary), as ``rejected``."""
    x = F.col("x")
    kept = F.coalesce(
        F.size(x["gauge"]["dataPoints"]), F.size(x["sum"]["dataPoints"]), F.size(x["histogram"]["dataPoints"]), F.lit(0)
    )
    unsupported = x["exponentialHistogram"].isNotNull() | x["summary"].isNotNull()
    rows = _flatten(requests, "resourceMetrics", "scopeMetrics", "metrics")
    return rows.agg(F.count(F.when(unsupported & (kept <= 0), 1)).alias("rejected"))
