"""Column contracts of the wire payloads and of the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SDK = "sdk struct<name:string,version:string>"
FRAME = (
    "struct<function:string,module:string,filename:string,abs_path:string,lineno:int,colno:int,"
    "in_app:boolean,pre_context:array<string>,context_line:string,post_context:array<string>>"
)
EXCEPTIONS = (
    "array<struct<type:string,value:string,module:string,"
    f"mechanism:struct<type:string,handled:boolean>,frames:array<{FRAME}>>>"
)
USER = "user struct<id:string,email:string,ip_address:string>"
TAGS = "map<string,string>"

# A queued job; the payload stays JSON text until its type is known.
JOB = (
    f"project_id long, type string, payload string, received_at string, sent_at string, {SDK}, "
    "client_ip string"
)
# Wire payloads.  Free-form parts (contexts, breadcrumbs) stay JSON text.
ERROR_PAYLOAD = (
    "event_id string, timestamp string, level string, platform string, release string, "
    f"environment string, exception {EXCEPTIONS}, message string, breadcrumbs string, "
    f"contexts string, {USER}, tags {TAGS}, trace_id string, span_id string, "
    "fingerprint array<string>"
)
LOG_PAYLOAD = (
    "timestamp string, severity string, service string, body string, template string, "
    f"environment string, release string, trace_id string, span_id string, attributes {TAGS}"
)
SPAN_PAYLOAD = (
    "event_id string, trace_id string, span_id string, parent_span_id string, segment_id string, "
    "is_segment boolean, name string, op string, service string, start_time string, "
    "duration_ms double, status string, environment string, release string, http_method string, "
    "http_status int, http_route string, db_system string, db_statement string, "
    f"tags {TAGS}, measurements map<string,double>, {USER}"
)
METRIC_PAYLOAD = (
    "timestamp string, name string, type string, unit string, value double, "
    f"environment string, release string, tags {TAGS}"
)
ALERT_SIGNAL = (
    "kind string, project_id long, issue_id long, group_hash string, title string, "
    "culprit string, level string, release string, environment string, at string"
)
CONDITIONS = (
    "struct<environment:string,level:string,release:string,threshold:long,window_minutes:int,"
    "metric_name:string,agg:string,operator:string,value:double>"
)
CHANNELS = "array<struct<type:string,settings:map<string,string>>>"

KINDS = ("error", "log", "span", "metric", "session", "client_report")

# Event tables, in column order.
ERRORS = (
    "project_id long, group_hash long, event_id string, timestamp timestamp, "
    "received_at timestamp, level string, environment string, release string, platform string, "
    "exception_type string, exception_value string, culprit string, trace_id string, "
    "span_id long, user_id string, user_email string, user_ip string, geo_country string, "
    f"browser string, os string, sdk_name string, sdk_version string, tags {TAGS}, "
    "stacktrace string, breadcrumbs string, contexts string"
)
LOGS = (
    "project_id long, severity string, severity_number tinyint, timestamp timestamp, ts_ns long, "
    "received_at timestamp, service string, environment string, release string, body string, "
    f"template string, trace_id string, span_id long, attributes {TAGS}"
)
SPANS = (
    "project_id long, trace_id string, span_id long, parent_span_id long, segment_id long, "
    "is_segment boolean, name string, op string, service string, timestamp timestamp, "
    "received_at timestamp, duration_ns long, status string, environment string, release string, "
    "http_method string, http_status int, http_route string, db_system string, "
    f"db_statement string, tags {TAGS}, measurements map<string,double>, user_id string, "
    "geo_country string"
)
METRICS_RAW = (
    "project_id long, timestamp timestamp, name string, type string, unit string, "
    f"tags {TAGS}, value double"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select exactly the table's columns, in order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(ddl).fields])


def empty_map(ddl: str = TAGS) -> Column:
    return F.create_map().cast(ddl)
