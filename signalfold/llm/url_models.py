"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides teach two variable-order Markov models, one of accepted and one of rejected
URLs.  The chance of a character follows from the longest context that its model has seen, smoothed by
shorter ones (interpolated Witten-Bell).  The log-likelihood difference of a URL, divided by its
length, becomes a chance of rejection by a logistic curve fitted on decided URLs kept out of the counts.

All counts are tables: contexts grow with the input, and nothing but totals and a histogram of bounded
size comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.llm.components import stored

BEGIN, END = "\x02", "\x03"
ORDER = 5
BLOCK_CHARS = 1_000_000  # characters of the URLs that are scored together
HELD_OUT = 5  # one of so many decided URLs calibrates instead of being counted
BINS, BIN = 1000, 0.01  # differences are counted in bins of this width, at most so many to either side


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to the next `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, such as `net/`, or null.

    A rule `host/path` fits its host and all subdomains if the URL's path starts with its own.  Of
    rules of one length that both fit, the first in string order counts.
    """
    found = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (-len(r), r), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(url: Column, order: int) -> Column:
    """Every character of the URL and its end, each after the `order` characters before it."""
    text = F.concat(F.lit(BEGIN * order), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(text, i, F.lit(order + 1)))


def gram_ratios(urls: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log of the accepted over the rejected chance of the last character, for all grams of `urls`.

    `urls` has url, accepted and rejected (0 or 1; both 0 where a URL only needs its grams scored).
    """
    grams = urls.select(F.explode(_grams(F.col("url"), order)).alias("gram"), "accepted", "rejected")
    counts = [grams.groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))]
    counts[0] = stored(counts[0], "url-grams")
    for _ in range(order):  # a shorter context sums the longer ones that end like it
        longer = counts[0].select(F.expr("substring(gram, 2)").alias("gram"), "a", "r")
        counts.insert(0, longer.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    total = counts[0].agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("kinds")).first()
    kinds = total["kinds"] + 1
    chance = counts[0].select(
        "gram", *[((F.col(c) + 1) / F.lit(float((total[c] or 0) + kinds))).alias(f"p{c}") for c in ("a", "r")]
    )
    for k in range(1, order + 1):
        context = Window.partitionBy(F.substring("gram", 1, k))
        seen = counts[k].select(
            "gram", F.expr("substring(gram, 2)").alias("shorter"), "a", "r",
            *[F.sum(c).over(context).alias(f"n{c}") for c in ("a", "r")],
            *[F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"t{c}") for c in ("a", "r")],
        )
        less = chance.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        chance = seen.join(less, "shorter").select("gram", *[
            F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
            .otherwise(F.col(f"q{c}")).alias(f"p{c}") for c in ("a", "r")
        ])
    return chance.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def differences(urls: DataFrame, order: int, block_chars: int) -> DataFrame:
    """(url, difference) for distinct URLs: the mean log ratio of its characters and its end.

    A block of URLs asks for each of its grams once and adds up the ratios it gets back, so a gram
    that all URLs hold costs one row per block.
    """
    chars = urls.agg(F.sum(F.length("url") + 1).alias("n")).first()["n"] or 0
    block = F.pmod(F.xxhash64("url"), F.lit(chars // block_chars + 1)).alias("block")
    asked = urls.select(block, F.explode(_grams(F.col("url"), order)).alias("gram")).distinct()
    answers = asked.join(gram_ratios(urls, order), "gram").select("block", "gram", "ratio")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        ratio = dict(zip(right.column("gram").to_pylist(), right.column("ratio").to_pylist(), strict=True))
        means = []
        for url in left.column("url").to_pylist():
            text = BEGIN * order + url + END
            means.append(math.fsum(ratio[text[i : i + order + 1]] for i in range(len(url) + 1)) / (len(url) + 1))
        return pa.table({"url": left.column("url"), "difference": pa.array(means, pa.float64())})

    return urls.select(block, "url").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, "url string, difference double")


def calibrate(bins: Iterator[tuple[int, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic chance of rejection over the difference, from (bin, accepted, rejected) rows.

    Targets are moved off 0 and 1 by one example a class, so separable classes have a finite slope.
    Without examples of both classes a difference of 0 means even chances.
    """
    table = np.array(list(bins), float).reshape(-1, 3)
    d, n = table[:, 0] * BIN, table[:, 1:]
    accepted, rejected = n.sum(axis=0)
    if not accepted or not rejected:
        return -1.0, 0.0
    target = np.array([1 / (accepted + 2), (rejected + 1) / (rejected + 2)])
    x = np.column_stack([d, np.ones(len(d))])
    beta = np.array([-1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((n * (np.logaddexp(0, z)[:, None] - target * z[:, None])).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (n * (p[:, None] - target)).sum(axis=1)
        curve = (x * (n.sum(axis=1) * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        move, part, now = np.linalg.solve(curve, slope), 1.0, loss(beta)
        while part > 1e-6 and loss(beta - part * move) > now:
            part /= 2
        beta = beta - part * move
        if np.abs(part * move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", order: int = ORDER,
    most_risk: float = 0.5, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per row: the id, host, path, rule, verdict (`allow` or `block`) and risk (chance of rejection, 0 to 1).

    `rules` are (rule, verdict) pairs; the longest rule that fits gives the verdict.  Other URLs are
    blocked if their risk exceeds `most_risk`.  The models learn from the URLs that rules decide, each
    distinct URL once, however many rows repeat it; one of five of them calibrates.  Without decided
    URLs of both kinds there is no model: the risk is null and what no rule blocks is allowed.

    A null URL counts as an empty one, which has only its end to be judged by; without `://` host and
    path are empty, no rule fits and the whole text is judged.  A risk equal to `most_risk` allows.
    Null and repeated ids and repeated rows stay; other columns are ignored, whatever their names.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), url.alias("url"))
    told = {rule: verdict for rule, verdict in rules}
    assert set(told.values()) <= {"allow", "block"}, "a rule allows or blocks"
    said = F.lit(None).cast("string")
    for rule, verdict in told.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    distinct = rows.select("url").distinct().withColumn("rule", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    counted = F.pmod(F.xxhash64("url", F.lit(11)), F.lit(HELD_OUT)) != 0
    is_ = lambda verdict: F.coalesce((F.col("said") == verdict) & F.col("counted"), F.lit(False)).cast("long")
    decided = distinct.withColumn("said", said).withColumn("counted", counted)
    urls = stored(decided.select("url", "rule", "said", "counted", is_("allow").alias("accepted"), is_("block").alias("rejected")), "urls")
    seen = urls.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).first()
    if seen["accepted"] and seen["rejected"]:
        means = stored(urls.join(differences(urls, order, block_chars), "url"), "url-scores")
        bins = F.least(F.greatest(F.round(F.col("difference") / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int")
        held = means.where("not counted and said is not null").groupBy(bins.alias("bin")).agg(
            F.sum((F.col("said") == "allow").cast("long")).alias("a"), F.sum((F.col("said") == "block").cast("long")).alias("r")
        )
        slope, offset = calibrate(tuple(r) for r in held.orderBy("bin").collect())
        risk = 1 / (1 + F.exp(-(F.col("difference") * slope + offset)))
    else:
        means, risk = urls, F.lit(None).cast("double")
    judged = means.select("url", "rule", "said", risk.alias("risk"))
    verdict = F.coalesce("said", F.when(F.col("risk") > most_risk, "block").otherwise("allow"))
    return rows.join(judged, "url").select(
        id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"), "risk"
    )
