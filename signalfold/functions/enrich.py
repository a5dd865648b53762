"""Browser, operating system and source-path facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalfold.functions.text import blank_to_null, first_token, trim

# User-agent tokens in the order they are tried.
BROWSER_TOKENS = [
    ("Edg/", "Edge"),
    ("EdgA/", "Edge"),
    ("OPR/", "Opera"),
    ("Opera", "Opera"),
    ("SamsungBrowser", "Samsung Internet"),
    ("Firefox/", "Firefox"),
    ("FxiOS/", "Firefox"),
    ("CriOS/", "Chrome"),
    ("Chrome/", "Chrome"),
    ("Chromium/", "Chromium"),
    ("Safari/", "Safari"),
]
OS_TOKENS = [
    ("Android", "Android"),
    ("iPhone", "iOS"),
    ("iPad", "iPadOS"),
    ("iPod", "iOS"),
    ("Windows NT", "Windows"),
    ("Mac OS X", "macOS"),
    ("Macintosh", "macOS"),
    ("CrOS", "ChromeOS"),
    ("Ubuntu", "Ubuntu"),
    ("Linux", "Linux"),
]
# Parts of a path that mark third-party code.
VENDOR_MARKERS = (
    "node_modules/",
    "webpack/bootstrap",
    "webpack-internal:",
    "/deps/",
    ".pnpm/",
    "/vendor/",
)


def browser(user_agent: Column) -> Column:
    return first_token(user_agent, BROWSER_TOKENS)


def operating_system(user_agent: Column) -> Column:
    return first_token(user_agent, OS_TOKENS)


def client_from_contexts(contexts: Column) -> tuple[Column, Column]:
    """(browser, os) from context JSON: what the SDK declared wins, the user agent fills gaps."""

    def declared(section: str) -> Column:
        return blank_to_null(trim(F.get_json_object(contexts, f"$.{section}.name")))

    agent = F.coalesce(F.get_json_object(contexts, "$.browser.user_agent"), F.lit(""))
    return (
        F.coalesce(declared("browser"), browser(agent)),
        F.coalesce(declared("os"), operating_system(agent)),
    )


def module_of(source: Column) -> Column:
    """Original source path without scheme, leading './' and '/', and extension."""
    path = F.regexp_replace(source, r"^(?s:.*?)://", "")
    path = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/", "")
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def is_in_app(path: Column, markers=VENDOR_MARKERS) -> Column:
    """True unless a vendor marker occurs in the lower-cased path."""
    lower = F.lower(path)
    vendor = F.lit(False)
    for marker in markers:
        vendor = vendor | lower.contains(marker)
    return ~vendor
