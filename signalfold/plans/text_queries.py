"""Registered queries for text, scrub, grouping, enrichment and raw-stack functions (R, G, E, Y, N)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from signalfold import schemas
from signalfold.functions import enrich, grouping, normalize, scrub
from signalfold.functions.stack import parse_stack
from signalfold.operators.source_maps import decode_segments, floor_segments
from signalfold.operators.symbolicate import (
    match_artifacts,
    normal_url,
    path_parts,
    source_context,
    symbolicate,
)
from signalfold.plans.adapters import errors, table
from signalfold.plans.registry import register
from signalfold.scale import spread_scan, work_dir

# White space as RE2 writes it, the secrets that are redacted and the message parts that are replaced.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JWT = r"\beyJ[\w-]*\.[\w-]+\.[\w-]+\b"
AUTH = r"(?i)\b(bearer|basic|token)\s+[\w\-._~+/]+=*"
CARD = r"\b(?:\d[ -]?){13,19}\b"
PARTS = [
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?i)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>"),
    (r"(?i)\bhttps?://[^\s''\"]+", "<url>"),
    (r"(?i)\b(?:0x)?[0-9a-f]{8,}\b", "<hex>"),
    (r"(?:/[\w.@:-]+){2,}/?", "<path>"),
    (r"''[^'']*''|\"[^\"]*\"", "<str>"),
    (r"\b\d[\d.,]*\b", "<num>"),
]


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_parameterize(x: str) -> str:
    out = sql_trim(x)
    for pattern, placeholder in PARTS:
        out = f"regexp_replace({out}, '{pattern}', '{placeholder}', 'g')"
    return sql_trim(f"regexp_replace({out}, '{WS}+', ' ', 'g')")


def sql_secrets(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{JWT}', '[redacted]', 'g'), '{AUTH}', '[redacted]', 'g')"


def sql_luhn(digits: str) -> str:
    return f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST({digits}[length({digits}) - i + 1] AS INTEGER)
        ELSE CAST({digits}[length({digits}) - i + 1] AS INTEGER) * 2
          - CASE WHEN CAST({digits}[length({digits}) - i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


def sql_cards(source: str, keys: str, text: str) -> str:
    """Rows of `source` with the card runs of `text` redacted in column `scrubbed`."""
    return f"""
WITH src AS ({source}),
cut AS (SELECT {keys}, {text} AS t, regexp_split_to_array({text}, '{CARD}') AS between, regexp_extract_all({text}, '{CARD}') AS runs FROM src),
joined AS (SELECT {keys}, between, runs, list_transform(runs, lambda r: regexp_replace(r, '[ -]', '', 'g')) AS digits FROM cut)
SELECT {keys}, array_to_string(list_transform(range(1, len(between) + 1), lambda k: between[k] ||
  CASE WHEN k > len(runs) THEN '' WHEN {sql_luhn('digits[k]')} THEN '[redacted]' ELSE runs[k] END), '') AS scrubbed
FROM joined
"""


def text_table(spark, d, name):
    """A table whose rows cost much more to work on than to read."""
    return spread_scan(table(spark, d, name))


# --- scrub ---------------------------------------------------------------------------------------


@register(
    "r3_scrub_documents",
    sql_cards(f"SELECT doc_id, {sql_secrets('text')} AS t0 FROM documents", "doc_id", "t0"),
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", scrub.scrub_text(F.col("text")).alias("scrubbed"))


@register(
    "r3_scrub_pages",
    sql_cards(f"SELECT page_id, {sql_secrets('html')} AS t0 FROM pages", "page_id", "t0"),
)
def _(spark, d):
    return text_table(spark, d, "pages").select("page_id", scrub.scrub_text(F.col("html")).alias("scrubbed"))


@register(
    "r3_scrub_conversations",
    sql_cards(f"SELECT conv_id, turn, {sql_secrets('text')} AS t0 FROM conversations", "conv_id, turn", "t0"),
)
def _(spark, d):
    return text_table(spark, d, "conversations").select(
        "conv_id", "turn", scrub.scrub_text(F.col("text")).alias("scrubbed")
    )


PAYMENT = """'pay ' || l_orderkey || ' with 4' || lpad(CAST(l_orderkey * 100003 + l_partkey AS STRING), 11, '0')
  || CASE l_linenumber % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '' END || lpad(CAST(l_suppkey * 37 + l_linenumber AS STRING), 4, '0') || '.'"""


@register(
    "r4_card_numbers",
    sql_cards(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {PAYMENT} AS t0 FROM lineitem",
        "l_orderkey, l_linenumber, l_partkey, l_suppkey",
        "t0",
    ),
)
def _(spark, d):
    """One card-like number per order line; about a tenth passes the check digit."""
    return text_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        scrub.redact_cards(F.expr(PAYMENT)).alias("scrubbed"),
    )


KEYS = """CASE event_id % 9 WHEN 0 THEN 'user_id' WHEN 1 THEN 'X-Api-Key' WHEN 2 THEN ' Pass word.Hint ' WHEN 3 THEN 'sessionId'
  WHEN 4 THEN 'shipping' WHEN 5 THEN 'Token-Count' WHEN 6 THEN 'author' WHEN 7 THEN 'plan' ELSE 'diagnosis code' END || event_type"""
DENIED_RE = (
    "password|passwd|secret|token|auth|authorization|credential|api_key|apikey|access_key|private_key|session|cookie|csrf|xsrf"
    "|credit_card|creditcard|card_number|cardnumber|cvv|cvc|ssn|social_security|pin"
)
NORMAL_KEY = f"translate(lower({sql_trim('k')}), '- .', '___')"


@register(
    "r1_denied_keys",
    f"""WITH e AS (SELECT event_id, {KEYS} AS k FROM events)
SELECT event_id, regexp_matches({NORMAL_KEY}, '{DENIED_RE}') AS denied,
  NOT {NORMAL_KEY} IN ('token_countview') AND (regexp_matches({NORMAL_KEY}, '{DENIED_RE}') OR contains({NORMAL_KEY}, 'diagnosis_code')) AS denied_by_policy
FROM e""",
)
def _(spark, d):
    key = F.expr(KEYS)
    return table(spark, d, "events").select(
        "event_id",
        scrub.denied_key(key).alias("denied"),
        scrub.denied_key(
            key, F.array(F.lit("Diagnosis.Code")), F.array(F.lit("Token Countview"))
        ).alias("denied_by_policy"),
    )


@register(
    "r2_scrub_map",
    """SELECT event_id, 'note=' || event_type || ' [redacted];password=[redacted];user=' || user_id AS tags FROM events""",
)
def _(spark, d):
    tags = F.create_map(
        F.lit("password"), F.col("props"),
        F.lit("user"), F.col("user_id").cast("string"),
        F.lit("note"), F.concat("event_type", F.lit(" Bearer "), F.col("event_id").cast("string")),
    )
    entries = F.array_sort(F.map_entries(scrub.scrub_map(tags)))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(text, ";").alias("tags"))


CONVERSATION_TEXT = sql_cards(
    f"SELECT conv_id, turn, role, {sql_secrets('text')} AS t0 FROM conversations", "conv_id, turn, role", "t0"
)


@register(
    "r5_scrub_json",
    f"""SELECT conv_id, turn, '[redacted]' AS secret, '[redacted]' AS nested, role AS kept, scrubbed AS list_text
FROM ({CONVERSATION_TEXT})""",
)
def _(spark, d):
    doc = F.to_json(
        F.struct(
            F.struct(F.col("text").alias("Api-Key"), F.col("role").alias("role")).alias("headers"),
            F.struct(F.struct(F.col("text").alias("csrf")).alias("form")).alias("data"),
            F.array("text").alias("list"),
        )
    )
    out = F.from_json(
        scrub.scrub_json(doc),
        "headers struct<`Api-Key`:string,role:string>, data struct<form:struct<csrf:string>>, list array<string>",
    )
    return text_table(spark, d, "conversations").withColumn("o", out).select(
        "conv_id", "turn",
        F.col("o.headers.Api-Key").alias("secret"),
        F.col("o.data.form.csrf").alias("nested"),
        F.col("o.headers.role").alias("kept"),
        F.col("o.list")[0].alias("list_text"),
    )


IP = """CASE event_id % 5 WHEN 4 THEN 'host' || event_id WHEN 3 THEN '2001:db8:' || (1 + user_id % 90) || '::' || (1 + event_id % 9)
  ELSE '10.' || user_id % 256 || '.' || event_id % 256 || '.' || (event_id + user_id) % 256 END"""


@register(
    "r6_ip_policy",
    f"""WITH e AS (SELECT event_id, user_id, {IP} AS ip FROM events)
SELECT event_id, ip AS kept, '' AS dropped, CASE event_id % 5 WHEN 4 THEN '' WHEN 3 THEN '2001:db8:' || (1 + user_id % 90) || '::'
  ELSE regexp_replace(ip, '[0-9]+$', '0') END AS cut FROM e""",
)
def _(spark, d):
    ip = F.expr(IP)
    return table(spark, d, "events").select(
        "event_id",
        scrub.apply_ip_policy(ip, False, False).alias("kept"),
        scrub.apply_ip_policy(ip, True, True).alias("dropped"),
        scrub.apply_ip_policy(ip, True, False).alias("cut"),
    )


@register(
    "r9_project_policy",
    """SELECT o_orderkey, CASE WHEN o_custkey % 25 % 2 = 0 THEN '[redacted]' ELSE o_orderpriority END AS priority,
  CASE WHEN o_custkey % 25 % 3 = 0 THEN 'x' || o_orderkey ELSE '[redacted]' END AS token,
  CASE WHEN o_custkey % 25 % 5 = 1 THEN '' WHEN o_custkey % 25 % 5 = 2 THEN '10.0.0.0' ELSE '10.0.0.7' END AS ip
FROM orders""",
)
def _(spark, d):
    """Policies of 25 projects, one per nation, over every order."""
    key = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    policies = table(spark, d, "nation").select(
        key.cast("long").alias("project_id"),
        F.when(key % 2 == 0, F.array(F.lit("Priority"))).otherwise(none).alias("deny_keys"),
        F.when(key % 3 == 0, F.array(F.lit("token"))).otherwise(none).alias("allow_keys"),
        (key % 5 == 2).alias("truncate_ip"),
        (key % 5 == 1).alias("drop_ip"),
    )
    orders = table(spark, d, "orders").withColumn("project_id", F.col("o_custkey") % 25)
    rows = scrub.with_policy(orders, policies)
    tags = scrub.scrub_map(
        F.create_map(
            F.lit("priority"), "o_orderpriority",
            F.lit("token"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")),
        ),
        F.col("deny_keys"), F.col("allow_keys"),
    )
    return rows.select(
        "o_orderkey",
        tags["priority"].alias("priority"),
        tags["token"].alias("token"),
        scrub.apply_ip_policy(F.lit("10.0.0.7"), F.col("truncate_ip"), F.col("drop_ip")).alias("ip"),
    )


# --- grouping --------------------------------------------------------------------------------------


@register("g6_parameterize_documents", f"SELECT doc_id, {sql_parameterize('text')} AS shape FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", grouping.parameterize(F.col("text")).alias("shape"))


@register("g6_parameterize_pages", f"SELECT page_id, {sql_parameterize('html')} AS shape FROM pages")
def _(spark, d):
    return text_table(spark, d, "pages").select("page_id", grouping.parameterize(F.col("html")).alias("shape"))


@register(
    "g7_page_filenames",
    r"""SELECT page_id, regexp_replace(split_part(regexp_replace(u, '(?s)[?#].*', ''), '/', -1),
  '(?i)[.\-_](?:[0-9a-f]{4,}|[0-9a-z]{8,})(\.\w+)$', '\1') AS file
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE split_part(url, '?', 1) || '/app.' || substr(md5(url), 1, 6) || '.js?v=1' END AS u FROM pages)""",
)
def _(spark, d):
    built = F.concat(
        F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/app."), F.substring(F.md5("url"), 1, 6), F.lit(".js?v=1")
    )
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(built)
    return table(spark, d, "pages").select("page_id", grouping.normal_filename(url).alias("file"))


def _error_events(spark, d):
    """Errors shaped as exceptions; every fourth has an explicit fingerprint, every fifth no stack."""
    library = F.struct(
        F.lit("next").alias("function"), F.lit("express").alias("module"), F.lit(False).alias("in_app")
    )
    own = F.struct(F.col("func").alias("function"), "module", F.lit(True).alias("in_app"))
    frames = F.filter(F.array(library, own), lambda f: F.col("event_id") % 5 != 0)
    exc = F.from_json(
        F.to_json(
            F.array(
                F.struct(
                    F.col("exception_type").alias("type"),
                    F.col("exception_value").alias("value"),
                    frames.alias("frames"),
                )
            )
        ),
        schemas.EXCEPTIONS,
    )
    explicit = F.when(
        F.col("event_id") % 4 == 0, F.array(F.concat(F.lit(" "), "level"), F.lit(""), "release")
    ).when(F.col("event_id") % 4 == 1, F.array(F.lit("{{default}}"), F.lit("x")))
    return errors(spark, d).select("event_id", exc.alias("e"), explicit.alias("f"))


@register(
    "g1_fingerprint",
    f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'custom' WHEN event_id % 5 = 0 THEN 'message' ELSE 'stack_trace' END AS method,
  CASE WHEN event_id % 4 = 0 THEN level || '|' || release
    WHEN event_id % 5 = 0 THEN 'message:' || {sql_parameterize('exception_value')}
    ELSE 'type:' || exception_type || '|frame:' || module || ':' || func END AS components
FROM fx_errors""",
)
def _(spark, d):
    rows = _error_events(spark, d)
    p = grouping.fingerprint(F.col("e"), F.lit(None).cast("string"), F.col("f"))
    return rows.withColumn("p", p).select(
        "event_id", "p.method", F.array_join("p.components", "|").alias("components")
    )


@register(
    "g2_custom_components",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN level || '|' || release END AS components FROM fx_errors",
)
def _(spark, d):
    return _error_events(spark, d).select(
        "event_id", F.array_join(grouping.custom_components(F.col("f")), "|").alias("components")
    )


@register(
    "g3_stack_components",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'type:' || exception_type || '|frame:' || module || ':' || func END AS components
FROM fx_errors""",
)
def _(spark, d):
    return _error_events(spark, d).select(
        "event_id", F.array_join(grouping.stack_components(F.col("e")), "|").alias("components")
    )


@register(
    "g4_message_components",
    f"SELECT doc_id, 'message:' || {sql_parameterize('text')} AS component FROM documents WHERE {sql_trim('text')} <> ''",
)
def _(spark, d):
    none = F.lit(None).cast(schemas.EXCEPTIONS)
    component = grouping.message_components(F.col("text"), none)[0]
    rows = text_table(spark, d, "documents").select("doc_id", component.alias("component"))
    return rows.filter(F.col("component").isNotNull())


@register(
    "g5_fallback_components",
    f"""SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'empty' ELSE 'type:' || exception_type || '|value:' || {sql_parameterize('exception_value')} END AS components
FROM fx_errors""",
)
def _(spark, d):
    exc = F.when(F.col("event_id") % 2 == 1, F.col("e"))
    return _error_events(spark, d).select(
        "event_id", F.array_join(grouping.fallback_components(exc), "|").alias("components")
    )


@register(
    "g8_group_sizes",
    f"""SELECT method, count(*) AS groups, CAST(sum(n) AS BIGINT) AS events FROM (
  SELECT CASE WHEN event_id % 4 = 0 THEN 'custom' WHEN event_id % 5 = 0 THEN 'message' ELSE 'stack_trace' END AS method,
    CASE WHEN event_id % 4 = 0 THEN level || '|' || release
      WHEN event_id % 5 = 0 THEN 'message:' || {sql_parameterize('exception_value')}
      ELSE 'type:' || exception_type || '|frame:' || module || ':' || func END AS c, count(*) AS n
  FROM fx_errors GROUP BY ALL) GROUP BY method""",
)
def _(spark, d):
    rows = _error_events(spark, d)
    p = grouping.fingerprint(F.col("e"), F.lit(None).cast("string"), F.col("f"))
    hashed = rows.withColumn("p", p).select(
        "p.method", grouping.hash_hex(grouping.group_hash(F.col("p.components"), exact=True)).alias("h")
    )
    per_group = hashed.groupBy("method", "h").agg(F.count("*").alias("n"))
    return per_group.groupBy("method").agg(
        F.count("*").alias("groups"), F.sum("n").alias("events")
    )


# --- enrichment -------------------------------------------------------------------------------------

AGENT = """CASE user_id % 8 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120' WHEN 1 THEN 'Mozilla/5.0 (iPhone; like Mac OS X) CriOS/119 Safari/604'
  WHEN 2 THEN 'Mozilla/5.0 (X11; Ubuntu; Linux) Firefox/121' WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 13) SamsungBrowser/23 Chrome/115 Safari/537'
  WHEN 4 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X) Version/17 Safari/605' WHEN 5 THEN 'Opera/9.80 (X11; Linux)' WHEN 6 THEN 'Mozilla/5.0 (X11; CrOS) Chrome/118'
  ELSE 'curl/' || event_id END"""
BROWSER = "CASE user_id % 8 WHEN 0 THEN 'Edge' WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Firefox' WHEN 3 THEN 'Samsung Internet' WHEN 4 THEN 'Safari' WHEN 5 THEN 'Opera' WHEN 6 THEN 'Chrome' ELSE '' END"
SYSTEM = "CASE user_id % 8 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Ubuntu' WHEN 3 THEN 'Android' WHEN 4 THEN 'macOS' WHEN 5 THEN 'Linux' WHEN 6 THEN 'ChromeOS' ELSE '' END"


@register("e1_user_agents", f"SELECT event_id, {BROWSER} AS browser, {SYSTEM} AS os FROM events")
def _(spark, d):
    agent = F.expr(AGENT)
    return table(spark, d, "events").select(
        "event_id", enrich.browser(agent).alias("browser"), enrich.operating_system(agent).alias("os")
    )


@register(
    "e2_declared_client",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'App ' || event_type ELSE {BROWSER} END AS browser,
  CASE WHEN event_id % 4 = 0 THEN 'NextOS' ELSE {SYSTEM} END AS os FROM events""",
)
def _(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" App "), "event_type", F.lit(" ")))
    os = F.when(F.col("event_id") % 4 == 0, F.lit("NextOS")).otherwise(F.lit(" "))
    contexts = F.to_json(
        F.struct(
            F.struct(name.alias("name"), F.expr(AGENT).alias("user_agent")).alias("browser"),
            F.struct(os.alias("name")).alias("os"),
        )
    )
    browser, system = enrich.client_from_contexts(F.col("contexts"))
    return (
        table(spark, d, "events")
        .select("event_id", contexts.alias("contexts"))
        .select("event_id", browser.alias("browser"), system.alias("os"))
    )


PAGE_PATH = r"regexp_replace(regexp_replace(regexp_replace({0}, '^[^:]*://[^/]*', ''), '[?#].*', ''), '^$', '/')"


@register(
    "y1_artifact_match",
    f"""WITH p AS (SELECT page_id, url, string_split(trim({PAGE_PATH.format('url')}, '/'), '/') AS parts FROM pages),
arts AS (SELECT DISTINCT '~/' || parts[-1] AS pattern, [parts[-1]] AS parts FROM p
  UNION SELECT DISTINCT '~/cdn/' || parts[-2] || '/' || parts[-1], ['cdn', parts[-2], parts[-1]] FROM p WHERE len(parts) > 1 AND page_id % 2 = 0),
scored AS (SELECT p.url, pattern, (SELECT count(*) FROM range(1, len(a.parts) + 1) r(k)
    WHERE list_slice(p.parts, -k, -1) = list_slice(a.parts, -k, -1)) AS score
  FROM (SELECT DISTINCT url, parts FROM p) p JOIN arts a ON a.parts[-1] = p.parts[-1])
SELECT url, max(score) AS score, arg_min(pattern, {{'s': -score, 'p': pattern}}) AS pattern FROM scored GROUP BY url""",
)
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("parts", path_parts(normal_url(F.col("url"))))
    last, before = F.element_at("parts", -1), F.try_element_at("parts", F.lit(-2))
    short = pages.select(F.concat(F.lit("~/"), last).alias("url_pattern"))
    long = pages.filter((F.size("parts") > 1) & (F.col("page_id") % 2 == 0)).select(
        F.concat(F.lit("~/cdn/"), before, F.lit("/"), last).alias("url_pattern")
    )
    artifacts = (
        short.unionByName(long)
        .distinct()
        .select(F.lit(1).alias("project_id"), F.lit("r").alias("version"), "url_pattern", F.col("url_pattern").alias("artifact_key"))
    )
    files = pages.select(F.lit(1).alias("project_id"), F.lit("r").alias("release"), F.col("url").alias("filename"))
    return match_artifacts(files, artifacts).select(
        F.col("filename").alias("url"), F.col("score").cast("long").alias("score"), F.col("url_pattern").alias("pattern")
    )


@register(
    "y3_floor_join",
    """WITH seg AS (SELECT DISTINCT l_suppkey AS artifact, l_linenumber AS line, CAST(l_partkey AS INTEGER) AS col FROM lineitem),
ask AS (SELECT DISTINCT o_custkey % 100 AS artifact, 1 + o_orderkey % 7 AS line, CAST(o_orderkey % 2500 AS INTEGER) AS col FROM orders)
SELECT CAST(a.artifact AS STRING) AS artifact_key, CAST(a.line AS INTEGER) AS gen_line, a.col AS gen_col, s.line, s.col
FROM ask a ASOF JOIN (SELECT artifact, line, col, line * 1000000 + col AS pos FROM seg) s
  ON a.artifact = s.artifact AND a.line * 1000000 + a.col >= s.pos""",
)
def _(spark, d):
    segments = (
        table(spark, d, "lineitem")
        .select(
            F.col("l_suppkey").cast("string").alias("artifact_key"),
            F.col("l_linenumber").cast("int").alias("gen_line"),
            F.col("l_partkey").cast("int").alias("gen_col"),
        )
        .distinct()
        .select("*", F.lit("s").alias("source"), F.col("gen_line").alias("line"), F.col("gen_col").alias("col"), F.lit("").alias("name"))
    )
    asks = table(spark, d, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("artifact_key"),
        (F.lit(1) + F.col("o_orderkey") % 7).cast("int").alias("gen_line"),
        (F.col("o_orderkey") % 2500).cast("int").alias("gen_col"),
    )
    return floor_segments(asks, segments).select("artifact_key", "gen_line", "gen_col", "line", "col")


# --- source maps made from the order lines: one map per supplier --------------------------------------

# Fixed value: the digits of base 64.
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _digits(number: int) -> str:
    rest, out = (-number << 1 | 1) if number < 0 else number << 1, ""
    while True:
        digit, rest = rest & 31, rest >> 5
        out += _B64[digit | (32 if rest else 0)]
        if not rest:
            return out


def _write_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """Encode (gen_line, gen_col) -> (line, col) of one supplier; every tenth map is cut short."""
    key = pdf["artifact_key"].iloc[0]
    old_line = old_col = 0
    rows = []
    for _, part in sorted(pdf.groupby("gen_line")):
        old_gen, fields = 0, []
        for r in part.sort_values("gen_col").itertuples():
            deltas = (r.gen_col - old_gen, 0, r.line - 1 - old_line, r.col - old_col)
            fields.append("".join(map(_digits, deltas)))
            old_gen, old_line, old_col = r.gen_col, r.line - 1, r.col
        rows.append(",".join(fields))
    text = "\n".join(f"line {i} of {key}" for i in range(1, 1001))
    source = {"version": 3, "sources": [f"src/s{key}.ts"], "names": [], "sourcesContent": [text], "mappings": ";".join(rows)}
    content = json.dumps(source).encode()
    return pd.DataFrame({"artifact_key": [key], "content": [content[:-9] if int(key) % 10 == 9 else content]})


def _maps(spark, d):
    points = (
        table(spark, d, "lineitem")
        .select(
            F.col("l_suppkey").cast("string").alias("artifact_key"),
            F.col("l_linenumber").cast("int").alias("gen_line"),
            F.col("l_partkey").cast("int").alias("gen_col"),
            (F.lit(1) + F.col("l_partkey") % 1000).cast("int").alias("line"),
            (F.col("l_partkey") % 77).cast("int").alias("col"),
        )
        .distinct()
    )
    maps = points.groupBy("artifact_key").applyInPandas(_write_map, "artifact_key string, content binary")
    path = work_dir(spark, "maps")
    maps.write.parquet(path)
    return spark.read.parquet(path)


# Maps start with line 1 only where the supplier has an order line numbered 1, as all of them do.
MAP_ROWS = """seg AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS gen_line, l_partkey AS gen_col, 1 + l_partkey % 1000 AS line, l_partkey % 77 AS col
  FROM lineitem WHERE l_suppkey % 10 <> 9)"""


@register(
    "y2_decode_source_maps",
    f"""WITH {MAP_ROWS} SELECT CAST(s AS STRING) AS artifact_key, CAST(gen_line AS INTEGER) AS gen_line, CAST(gen_col AS INTEGER) AS gen_col,
  'src/s' || s || '.ts' AS source, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM seg""",
)
def _(spark, d):
    return decode_segments(_maps(spark, d)).drop("name")


@register(
    "y7_symbolicate_orders",
    f"""WITH {MAP_ROWS},
f AS (SELECT o_orderkey, o_custkey % 100 AS s, o_orderkey % 9 AS lineno, o_orderkey % 2500 AS colno, o_orderstatus = 'P' AS lost FROM orders),
hit AS (SELECT f.*, g.line, g.col FROM f ASOF JOIN (SELECT *, gen_line * 1000000 + gen_col AS pos FROM seg) g
  ON f.s = g.s AND f.lineno * 1000000 + f.colno >= g.pos WHERE lineno > 0 AND NOT lost)
SELECT o_orderkey, CASE WHEN h.line IS NULL THEN 'https://x.example.com/js/s' || f.s || '.min.js' ELSE 'src/s' || f.s || '.ts' END AS filename,
  coalesce(h.line, f.lineno) AS lineno, coalesce(h.col, f.colno) AS colno, CASE WHEN h.line IS NULL THEN '' ELSE 'src/s' || f.s END AS module,
  CASE WHEN h.line IS NULL THEN '' ELSE 'line ' || h.line || ' of ' || f.s END AS context_line
FROM f LEFT JOIN hit h USING (o_orderkey)""",
)
def _(spark, d):
    """Every order is an event with one minified frame; what cannot be resolved keeps its frame."""
    artifacts = _maps(spark, d).select(
        F.lit(1).cast("long").alias("project_id"),
        F.lit("web@1").alias("version"),
        F.concat(F.lit("~/js/s"), "artifact_key", F.lit(".min.js")).alias("url_pattern"),
        "artifact_key",
        "content",
    )
    frame = F.struct(
        F.expr("'https://x.example.com/js/s' || (o_custkey % 100) || '.min.js'").alias("filename"),
        (F.col("o_orderkey") % 9).cast("int").alias("lineno"),
        (F.col("o_orderkey") % 2500).cast("int").alias("colno"),
    )
    exceptions = F.from_json(F.to_json(F.array(F.struct(F.array(frame).alias("frames")))), schemas.EXCEPTIONS)
    items = text_table(spark, d, "orders").select(
        F.lit(1).cast("long").alias("project_id"),
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("web@1").alias("release"),
        exceptions.alias("exceptions"),
    )
    f = F.col("exceptions")[0]["frames"][0]
    return symbolicate(items, artifacts).select(
        F.col("event_id").cast("long").alias("o_orderkey"),
        f["filename"].alias("filename"),
        f["lineno"].cast("long").alias("lineno"),
        f["colno"].cast("long").alias("colno"),
        F.coalesce(f["module"], F.lit("")).alias("module"),
        F.coalesce(f["context_line"], F.lit("")).alias("context_line"),
    )


@register(
    "y4_module",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(?s:.*?)://', ''), '^\./', ''), '^/', ''), '\.[^./]*$', '') AS module FROM pages""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", enrich.module_of(F.col("url")).alias("module"))


SOURCE_PATH = """CASE event_id % 6 WHEN 0 THEN 'webpack://app/Node_Modules/react/' WHEN 1 THEN 'src/vendor/' WHEN 2 THEN '/deps/' ELSE 'src/routes/' END || event_type || '.ts'"""


@register(
    "y5_in_app",
    f"""SELECT event_id, NOT regexp_matches(lower({SOURCE_PATH}), 'node_modules/|webpack/bootstrap|webpack-internal:|/deps/|\\.pnpm/|/vendor/') AS in_app FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", enrich.is_in_app(F.expr(SOURCE_PATH)).alias("in_app"))


@register(
    "y6_source_context",
    r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS lines FROM documents),
n AS (SELECT doc_id, lines, CAST(1 + doc_id % (len(lines) + 1) AS BIGINT) AS n FROM l)
SELECT doc_id, array_to_string(list_slice(lines, greatest(n - 5, 1), n - 1), '|') AS pre, lines[n] AS line,
  array_to_string(list_slice(lines, n + 1, n + 5), '|') AS post
FROM n WHERE n <= len(lines)""",
)
def _(spark, d):
    docs = text_table(spark, d, "documents")
    lines = F.size(F.split("text", "\r?\n", -1))
    at = (F.lit(1) + F.col("doc_id") % (lines + 1)).cast("int")
    return (
        docs.withColumn("c", source_context(F.col("text"), at))
        .filter(F.col("c").isNotNull())
        .select(
            "doc_id",
            F.array_join("c.pre_context", "|").alias("pre"),
            F.col("c.context_line").alias("line"),
            F.array_join("c.post_context", "|").alias("post"),
        )
    )


# --- normalisation of single values --------------------------------------------------------------------


@register(
    "n12_titles",
    f"""WITH t AS (SELECT doc_id, {sql_trim("'Error: ' || text")} AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) <= 200 THEN t
  ELSE left(t, (SELECT CAST(max(k) AS BIGINT) FROM range(0, 200) r(k) WHERE strlen(left(t, k)) <= 199)) || '…' END AS title
FROM t""",
)
def _(spark, d):
    exc = F.array(F.struct(F.lit("Error").alias("type"), F.col("text").alias("value")))
    return text_table(spark, d, "documents").select(
        "doc_id", normalize.title(exc, F.lit(None).cast("string")).alias("title")
    )


@register(
    "n16_raw_stacks",
    """SELECT event_id, 'fn' || user_id % 7 || '@/srv/m' || user_id % 5 || '.js:' || (1 + user_id) || ':' || (event_id % 90) || ':true'
  || '|<anonymous>@/srv/node_modules/x/i.js:3:4:false' AS frames FROM events""",
)
def _(spark, d):
    """Half of the stacks in V8 spelling, half in Gecko spelling; innermost frame last in both."""
    where = F.expr("'/srv/m' || user_id % 5 || '.js:' || (1 + user_id) || ':' || (event_id % 90)")
    name = F.expr("'fn' || user_id % 7")
    v8 = F.concat(
        F.lit("TypeError: boom\n    at /srv/node_modules/x/i.js:3:4\n    at "), name, F.lit(" ("), where, F.lit(")\nend")
    )
    gecko = F.concat(F.lit("@/srv/node_modules/x/i.js:3:4\n"), name, F.lit("@"), where, F.lit("\n"))
    stack = F.when(F.col("event_id") % 2 == 0, v8).otherwise(gecko)
    text = F.transform(
        parse_stack(stack),
        lambda f: F.concat_ws(
            ":",
            F.concat(f["function"], F.lit("@"), f["filename"]),
            f["lineno"].cast("string"), f["colno"].cast("string"), f["in_app"].cast("string"),
        ),
    )
    return table(spark, d, "events").select("event_id", F.array_join(text, "|").alias("frames"))
