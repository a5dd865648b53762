"""Removal of personal data and secrets: keys, free text, cards, addresses, nested JSON."""

from __future__ import annotations

import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.functions.text import EDGE, SPACES, WORD_START, let, replace_with_probe, trim
from signalfold.scale import broadcast_if_small

REDACTED = "[redacted]"

# Words that make a key's value secret wherever they occur in the key.
DENIED_WORDS = [
    "password", "passwd", "secret", "token", "auth", "authorization", "credential", "api_key", "apikey", "access_key",
    "private_key", "session", "cookie", "csrf", "xsrf", "credit_card", "creditcard", "card_number", "cardnumber", "cvv",
    "cvc", "ssn", "social_security", "pin",
]
# Secrets recognised inside text, in the order they are removed.  A cheap test of
# the first character comes before the look-behind that asks for a word start.
JWT = WORD_START + r"eyJ[\w-]*\.[\w-]+\.[\w-]+" + EDGE
AUTH_SCHEME = r"(?=[bBtT])(?<!\w)(?i:bearer|basic|token)[\t\n\f\r ]+[\w\-._~+/]+=*"
CARD = r"\d(?<!\w\d)[ -]?(?:\d[ -]?){12,18}" + EDGE
MAX_DEPTH = 20


# --- keys ------------------------------------------------------------------------------


def normal_key(key: Column) -> Column:
    return F.translate(F.lower(trim(key)), "- .", "___")


def denied_key(key: Column, deny: Column | None = None, allow: Column | None = None) -> Column:
    """Whether a key's value must go.  `deny` and `allow` are array columns of extra keys."""

    def test(k: Column) -> Column:
        hit = k.rlike("|".join(DENIED_WORDS))
        if deny is not None:
            extra = F.filter(F.transform(deny, normal_key), lambda w: w != "")
            hit = hit | F.coalesce(F.exists(extra, lambda w: k.contains(w)), F.lit(False))
        if allow is not None:
            kept = F.array_contains(F.transform(allow, normal_key), k)
            hit = hit & ~F.coalesce(kept, F.lit(False))
        return hit

    return let(normal_key(key), test)


# --- text ------------------------------------------------------------------------------


def redact_cards(text: Column) -> Column:
    """Replace digit runs that pass the Luhn check; any other run stays as it is."""

    def rebuild(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(CARD), F.lit(0))
        joined = F.zip_with(
            F.split(t, CARD, -1),
            runs,
            lambda between, run: F.concat(
                between,
                F.coalesce(
                    F.when(F.call_function("luhn_check", F.regexp_replace(run, "[ -]", "")), F.lit(REDACTED)),
                    run,
                    F.lit(""),
                ),
            ),
        )
        return F.when(t.rlike(CARD), F.array_join(joined, "")).otherwise(t)

    return let(text, rebuild)


def scrub_text(text: Column) -> Column:
    """JSON web tokens, then authorisation schemes, then card numbers."""
    without_tokens = replace_with_probe(text, "eyJ", JWT, REDACTED)
    return redact_cards(F.regexp_replace(without_tokens, AUTH_SCHEME, REDACTED))


def scrub_map(
    values: Column, deny: Column | None = None, allow: Column | None = None
) -> Column:
    """Values of denied keys are replaced, all other values are scrubbed as text."""
    return F.transform_values(
        values,
        lambda k, v: F.when(denied_key(k, deny, allow), F.lit(REDACTED)).otherwise(scrub_text(v)),
    )


# --- nested JSON: recursion has no native form ---------------------------------------------

_PY_SECRETS = [re.compile(p, re.ASCII) for p in (JWT, AUTH_SCHEME)]
_PY_CARD = re.compile(CARD, re.ASCII)
_PY_DENIED = re.compile("|".join(DENIED_WORDS))


def _luhn_ok(run: str) -> bool:
    digits = [int(c) for c in reversed(run) if c.isdigit()]
    total = sum(digits[0::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])
    return total % 10 == 0


def _scrub_str(text: str) -> str:
    for pattern in _PY_SECRETS:
        text = pattern.sub(REDACTED, text)
    return _PY_CARD.sub(lambda m: REDACTED if _luhn_ok(m.group()) else m.group(), text)


def _scrub_node(node, depth: int, deny: list[str], allow: set[str]):
    if depth > MAX_DEPTH:
        return REDACTED
    if isinstance(node, dict):
        out = {}
        for key, child in node.items():
            k = _key(key)
            secret = k not in allow and (_PY_DENIED.search(k) or any(w in k for w in deny))
            out[key] = REDACTED if secret else _scrub_node(child, depth + 1, deny, allow)
        return out
    if isinstance(node, list):
        return [_scrub_node(child, depth + 1, deny, allow) for child in node]
    return _scrub_str(node) if isinstance(node, str) else node


def _key(key: str) -> str:
    return key.strip(SPACES).lower().translate(str.maketrans("- .", "___"))


def _scrub_json_text(text, deny, allow):
    if text is None:
        return None
    try:
        node = json.loads(text)
    except (ValueError, RecursionError):
        # Neither readable nor safe to keep.
        return json.dumps(REDACTED)
    deny = [k for k in map(_key, deny if deny is not None else []) if k]
    allow = {k for k in map(_key, allow if allow is not None else []) if k}
    return json.dumps(
        _scrub_node(node, 0, deny, allow), ensure_ascii=False, separators=(",", ":"), sort_keys=True
    )


def scrub_breadcrumbs_text(text, deny, allow):
    """Breadcrumb list as JSON: messages are scrubbed as text, data as nested JSON."""
    if text is None:
        return None
    try:
        crumbs = json.loads(text)
    except (ValueError, RecursionError):
        return json.dumps(REDACTED)
    deny = [k for k in map(_key, deny if deny is not None else []) if k]
    allow = {k for k in map(_key, allow if allow is not None else []) if k}
    for crumb in crumbs if isinstance(crumbs, list) else []:
        if isinstance(crumb, dict):
            if isinstance(crumb.get("message"), str):
                crumb["message"] = _scrub_str(crumb["message"])
            if crumb.get("data") is not None:
                crumb["data"] = _scrub_node(crumb["data"], 0, deny, allow)
    return json.dumps(crumbs, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _scrub_json_udf(text: pd.Series, deny: pd.Series, allow: pd.Series) -> pd.Series:
    return pd.Series([_scrub_json_text(t, d, a) for t, d, a in zip(text, deny, allow)], dtype=object)


def scrub_json(text: Column, deny: Column | None = None, allow: Column | None = None) -> Column:
    """Scrub every key and string of a JSON document, up to 20 levels deep."""
    empty = F.array().cast("array<string>")
    return _scrub_json_udf(
        text, empty if deny is None else deny, empty if allow is None else allow
    )


# --- addresses -----------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^({_OCTET}\.{_OCTET}\.{_OCTET})\.{_OCTET}\z"


@F.pandas_udf(T.StringType())
def _truncate_ipv6(text: pd.Series) -> pd.Series:
    def one(value):
        if value is None:
            return None
        try:
            address = ipaddress.IPv6Address(value.partition("%")[0])
        except ValueError:
            return ""
        if address.ipv4_mapped:
            return str(ipaddress.ip_network((address.ipv4_mapped, 24), strict=False)[0])
        return str(ipaddress.ip_network((address, 48), strict=False)[0])

    return pd.Series([one(v) for v in text], dtype=object)


def truncate_ip(ip: Column) -> Column:
    """/24 of IPv4, /48 of IPv6, '' for anything else.  Only IPv6 text leaves the JVM."""
    is_v4 = ip.rlike(IPV4)
    other = _truncate_ipv6(F.when(ip.contains(":"), ip))
    return F.when(is_v4, F.regexp_replace(ip, IPV4, "$1.0")).otherwise(
        F.coalesce(other, F.lit(""))
    )


def apply_ip_policy(ip: Column, truncate: Column | bool, drop: Column | bool) -> Column:
    truncate = F.lit(truncate) if isinstance(truncate, bool) else truncate
    drop = F.lit(drop) if isinstance(drop, bool) else drop
    return (
        F.when(drop | ip.isNull() | (ip == ""), F.lit(""))
        .when(truncate, truncate_ip(ip))
        .otherwise(ip)
    )


# --- per-project policy ----------------------------------------------------------------------

POLICY_COLUMNS = ("deny_keys", "allow_keys", "truncate_ip", "drop_ip")


def with_policy(df: DataFrame, policies: DataFrame | None) -> DataFrame:
    """Attach the project's policy columns; projects without one get the default policy."""
    if policies is None:
        df = df.withColumns({c: F.lit(None) for c in POLICY_COLUMNS})
    else:
        side = broadcast_if_small(policies.select("project_id", *POLICY_COLUMNS))
        df = df.join(side, "project_id", "left")
    no_keys = F.array().cast("array<string>")
    return df.withColumns(
        {
            "deny_keys": F.coalesce(F.col("deny_keys").cast("array<string>"), no_keys),
            "allow_keys": F.coalesce(F.col("allow_keys").cast("array<string>"), no_keys),
            "truncate_ip": F.coalesce(F.col("truncate_ip").cast("boolean"), F.lit(False)),
            "drop_ip": F.coalesce(F.col("drop_ip").cast("boolean"), F.lit(False)),
        }
    )
