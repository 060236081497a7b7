"""Names, labels, series, services and the mapping of names and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, rounded
from catalog.views import sql
from telmora.functions import labels as L
from telmora.functions import naming as N
from telmora.operators import discovery as D
from telmora.operators.samples import expand_points
from telmora.plans.maintenance import roll_up
from telmora.sources.tables import intern_series


def _points(spark, sf):
    return V.metric_points(spark, sf).withColumn("labels", L.merge(F.col("resource"), F.col("attrs")))


query(
    "service_names",
    sql("select service_name as service from logs union select service_name from spans", "logs", "spans"),
)(lambda spark, sf: D.service_names(V.logs(spark, sf), V.spans(spark, sf)))
query(
    "service_versions",
    sql("select version from logs where service_name = 'svc-f' union select version from spans where service_name = 'svc-f'", "logs", "spans"),
)(lambda spark, sf: D.service_versions("svc-f", V.logs(spark, sf), V.spans(spark, sf)))
query(
    "metric_names",
    sql("select distinct unnest(['app.value', 'app.level', 'app.cents']) as name from ev", "ev"),
)(lambda spark, sf: _metric_names(spark, sf))


def _metric_names(spark, sf):
    facts, _ = intern_series(V.metric_points(spark, sf))
    rollup = roll_up(facts, (V.EVENTS_FROM_MS + 10 * V.DAY_MS) * 1_000_000)
    return D.stored_metric_names(facts, rollup)


query(
    "exposed_metric_names",
    sql("select distinct unnest(['app_value_total', 'app_value', 'app_level_ratio', 'app_level', 'app_cents_total', 'app_cents']) as metric from ev", "ev"),
)(lambda spark, sf: D.exposed_metric_names(_points(spark, sf)))
query(
    "metric_metadata",
    sql(
        "select distinct unnest(['app_value_total', 'app_value', 'app_cents_total', 'app_cents']) as metric, 'counter' as kind from ev "
        "union select distinct unnest(['app_level_ratio', 'app_level']), 'gauge' from ev",
        "ev",
    ),
)(lambda spark, sf: D.metric_metadata(_points(spark, sf)))
query("label_names", sql("select distinct unnest(['job', 'service_name', 'event_type']) as label from ev", "ev"))(
    lambda spark, sf: D.label_names(_points(spark, sf))
)
query(
    "label_values",
    sql(
        "select 'job' as label, service_name as value from ev union select 'event_type', event_type from ev where service_name <> 'svc-2'",
        "ev",
    ),
)(
    lambda spark, sf: D.label_values(_points(spark, sf), "job")
    .withColumn("label", F.lit("job"))
    .unionByName(
        D.label_values(D.matching_points(_points(spark, sf), [("service.name", "!=", "svc-2")]), "event_type").withColumn(
            "label", F.lit("event_type")
        )
    )
)
query(
    "series_list",
    sql(
        "select distinct 'app_value_total' as name, event_type, service_name from ev where event_type = 'click' union "
        "select distinct 'app_value_total', event_type, service_name from ev where regexp_matches(service_name, '[34]$')",
        "ev",
    ),
)(
    lambda spark, sf: D.series_list(
        V.counter(spark, sf),
        [("app_value_total", [("event_type", "=", "click")]), (None, [("job", "=~", "[34]$")])],
    ).select(
        L.label("labels_fp", "__name__").alias("name"),
        L.label("labels_fp", "event_type").alias("event_type"),
        L.label("labels_fp", "service_name").alias("service_name"),
    )
)

query(
    "label_mapping",
    sql(
        "select event_type, service_name, 'event_type=\"' || event_type || '\",job=\"' || service_name || '\",service_name=\"' || service_name || '\"' as labels, "
        "count(*) as points from ev group by all",
        "ev",
    ),
)(
    lambda spark, sf: _points(spark, sf)
    .where(F.col("name") == "app.level")
    .withColumn("exposed", L.expose(F.col("labels")))
    .groupBy(
        F.try_element_at("labels", F.lit("event.type")).alias("event_type"),
        F.try_element_at("exposed", F.lit("job")).alias("service_name"),
        L.fingerprint(F.col("exposed")).alias("labels"),
    )
    .agg(F.count(F.lit(1)).alias("points"))
)
query(
    "name_mapping",
    sql(
        "select distinct m as name, unnest(case m when 'app.value' then ['app_value_total', 'app_value'] when 'app.level' then ['app_level_ratio', 'app_level'] "
        "else ['app_cents_total', 'app_cents'] end) as exposed from (select distinct unnest(['app.value', 'app.level', 'app.cents']) as m from ev)",
        "ev",
    ),
)(
    lambda spark, sf: _points(spark, sf)
    .select("name", "unit", "type")
    .distinct()
    .select("name", F.explode(N.exposed_names(F.col("name"), F.col("unit"), F.col("type"))).alias("exposed"))
)
query(
    "name_resolution",
    sql("select distinct 'app_level_ratio' as exposed, 'app.level' as name from ev", "ev"),
)(
    lambda spark, sf: N.resolve_stored_name(_points(spark, sf).select("name").distinct(), "app_level_ratio").select(
        F.lit("app_level_ratio").alias("exposed"), "name"
    )
)
query(
    "unit_scaling",
    sql("select event_id, round(level / 1000, 6) + 0.0 as seconds, 'app_level_seconds' as name from ev", "ev"),
)(
    lambda spark, sf: V.table(spark, sf, "events").select(
        "event_id",
        rounded(N.scale(F.lit("ms"), F.col("value"))).alias("seconds"),
        N.base_name(F.lit("app.level"), F.lit("ms")).alias("name"),
    )
)
query(
    "samples_counter",
    sql(
        "select unnest(['app_value_total', 'app_value']) as name, event_type, service_name, ts_ms, value, false as is_delta from ev "
        "union all select 'app_cents_total', event_type, service_name, ts_ms, cents::double, true from ev",
        "ev",
    ),
)(
    lambda spark, sf: expand_points(_points(spark, sf).where("name = 'app.value'"))
    .unionByName(expand_points(_points(spark, sf), "app_cents_total"))
    .select(
        L.label("labels_fp", "__name__").alias("name"),
        L.label("labels_fp", "event_type").alias("event_type"),
        L.label("labels_fp", "service_name").alias("service_name"),
        "ts_ms",
        "value",
        "is_delta",
    )
)
