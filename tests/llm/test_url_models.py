"""URL filter against a brute-force model, and odd tables."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signalfold.llm import url_models as um
from signalfold.llm.queries import URL_RULES

COLUMNS = "page_id long, url string, host string, rule string, said string, block long, gram string"


def urls(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = rng.choice(["a.example", "blog.b.example", "Shop.example", "example"]) + rng.choice([".net", ".com", ".org"])
        path = rng.choice(["/en/", "/fr/", "/de/", "/es/"]) + rng.choice(["news", "casino-win", "garden", "cheap-pills"])
        out.append(f"http{rng.choice(['', 's'])}://{host}{path}/{rng.randrange(40)}{rng.choice(['', '?x=1', '#top'])}")
    return out


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
    path = min((rest[len(host) :].split(c, 1)[0] for c in "?#"), key=len)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(url):
    host, path = split(url)
    fits = [r for r, _ in URL_RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len) if fits else None


class Markov:
    """Interpolated Witten-Bell by plain counting."""

    def __init__(self, texts, order, kinds):
        self.n, self.order, self.kinds = defaultdict(Counter), order, kinds
        for t in texts:
            t = um.BEGIN * order + t + um.END
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.n[t[i - k : i]][t[i]] += 1

    def chance(self, context, c):
        seen = self.n[context]
        total = sum(seen.values())
        if not context:
            return (seen[c] + 1) / (total + self.kinds)
        less = self.chance(context[1:], c)
        return (seen[c] + len(seen) * less) / (total + len(seen)) if total else less


def test_models_equal_brute_force(spark):
    texts = sorted(set(urls(120))) + ["", "ü漢x", "x" * 3000]
    rows = [(t, int(i % 3 == 0), int(i % 3 == 1)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "url string, accepted long, rejected long").repartition(3)
    order = 3
    kinds = len(set("".join(texts)) | {um.END}) + 1
    yes, no = (Markov([r[0] for r in rows if r[i]], order, kinds) for i in (1, 2))
    for size in (1 << 20, 500):
        got = {r["url"]: r["difference"] for r in um.differences(df, order, size).collect()}
        assert set(got) == set(texts)
        for t, d in got.items():
            x = um.BEGIN * order + t + um.END
            pairs = [(x[i - order : i], x[i]) for i in range(order, len(x))]
            want = sum(math.log(yes.chance(*p) / no.chance(*p)) for p in pairs) / len(pairs)
            assert d == pytest.approx(want, abs=1e-9)


def test_verdicts(spark):
    texts = [*urls(), None, "", "no scheme", "ftp://", "http://a.net", "http://net/", "http://xnet/", "HTTP://A.NET/?q", "x://y/://net/", "http://a.example.net/EN/", "http://q.org/fr/" + "z" * 20_000]
    rows = [(i, t, "h", "r", "s", 1, "g") for i, t in enumerate(texts)] + [(7, texts[7], "h", "r", "s", 1, "g"), (None, texts[0], "h", "r", "s", 1, "g")]
    rows += [(5000 + i, texts[0], "h", "r", "s", 1, "g") for i in range(900)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = um.judge_urls(docs, URL_RULES).collect()
    want = Counter((i, *split(t), rule(t)) for i, t, *_ in rows)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    told = dict(URL_RULES)
    text = {i: t for i, t, *_ in rows}
    same = defaultdict(set)
    for r in got:
        assert r["verdict"] == told.get(r["rule"], "block" if r["risk"] > 0.5 else "allow") and 0 <= r["risk"] <= 1
        same[text[r["page_id"]]].add((r["verdict"], r["risk"]))
    assert all(len(s) == 1 for s in same.values())  # copies of a URL are judged alike


def test_learned_words_decide(spark):
    """Held-out accuracy: rejected URLs have other words than accepted ones; neither host nor path has a rule."""
    rng = random.Random(8)
    good, bad = ["garden", "science", "history", "recipe"], ["casino", "pills", "jackpot", "viagra"]
    rows = []
    for i in range(1500):
        spam = i % 2 == 0
        word = "-".join(rng.choices(bad if spam else good, k=2))
        host = rng.choice(["bad.net", "free.com"] if spam else ["good.org", "free.com"])
        rows.append((i, f"http://{host}/{'x' if host == 'free.com' else 'l'}/{word}/{rng.randrange(99)}", spam))
    docs = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r["page_id"]: r for r in um.judge_urls(docs, [("bad.net/", "block"), ("good.org/", "allow")]).collect()}
    left = [(spam, got[i]["verdict"]) for i, _, spam in rows if got[i]["rule"] is None]
    assert len(left) > 500 and sum((v == "block") == spam for spam, v in left) > 0.97 * len(left)


def test_without_models(spark):
    docs = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["risk"]) for r in um.judge_urls(docs, URL_RULES).collect()}
    assert got == {1: ("block", None), 2: ("allow", None)}
    assert um.judge_urls(docs.limit(0), URL_RULES).count() == 0


def test_calibration():
    slope, offset = um.calibrate([(-50, 0, 100), (0, 50, 50), (50, 100, 0)])
    assert slope < 0 and abs(offset) < 1e-6
    assert um.calibrate([]) == (-1.0, 0.0) and um.calibrate([(3, 5, 0)]) == (-1.0, 0.0)
    slope, offset = um.calibrate([(40, 900, 0), (60, 0, 0), (-40, 0, 900)])  # separable
    assert -1000 < slope < -5


def test_host_and_path(spark):
    texts = [*urls(50), None, "a://b", "a://b/c?d/e#f", "a://B.C#x/y", "://h/p"]
    df = spark.createDataFrame([(t,) for t in texts], "url string")
    got = df.select(um.host_of(F.coalesce("url", F.lit(""))), um.path_of(F.coalesce("url", F.lit("")))).collect()
    assert [tuple(r) for r in got] == [split(t) for t in texts]
