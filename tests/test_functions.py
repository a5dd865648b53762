"""Known input/output pairs of the column functions."""

import json
import random
import uuid

from pyspark.sql import functions as F

from signalfold.functions import enrich, grouping, normalize, scrub
from signalfold.functions.stack import parse_stack
from signalfold import schemas


def apply(spark, fn, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def check(spark, fn, pairs, ddl="string"):
    got = apply(spark, fn, [a for a, _ in pairs], ddl)
    assert got == [b for _, b in pairs]


PLAIN = "pump valve engine drum stops while moving over green hills again".split()


def test_parameterize(spark):
    """Sentences of plain words with generated variable parts; each part becomes its placeholder and nothing else changes."""
    rng = random.Random(9)
    word = lambda: rng.choice(PLAIN)
    parts = {
        "<num>": lambda: rng.choice([str(rng.randrange(9_999_999)), f"{rng.randrange(99)}.{rng.randrange(99)}", "1,000,000"]),
        "<uuid>": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "<email>": lambda: f"{word()}.{word()}+{rng.randrange(9)}@{word()}-{word()}.org",
        "<url>": lambda: f"{rng.choice(['http', 'HTTPS'])}://{word()}.net:{rng.randrange(9000)}/{word()}?{word()}={rng.randrange(99)}",
        "<hex>": lambda: rng.choice(["", "0x"]) + f"{rng.getrandbits(72) | 1 << 71:x}",
        "<path>": lambda: "/" + "/".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["", ".log"]),
        "<str>": lambda: rng.choice(["'{}'", '"{}"']).format(" ".join(word() for _ in range(rng.randint(0, 3)))),
    }
    pairs = [("  a \t b  c\n", "a b c"), ("é12 x", "é<num> x"), ("/a" * 20000, "<path>"), ("", "")]
    for _ in range(120):
        raw, want = [], []
        for _ in range(rng.randint(1, 7)):
            kind = rng.choice([None, *parts])
            raw.append(parts[kind]() if kind else word())
            want.append(kind or raw[-1])
        pairs.append((" ".join(raw), " ".join(want)))
    check(spark, grouping.parameterize, pairs)


def test_filename(spark):
    """A build hash before the suffix goes, with whatever stands around the base name; words that are no hash stay."""
    rng = random.Random(10)
    pairs = [("", ""), ("plain", "plain"), ("a.b.c.d", "a.b.c.d")]
    for _ in range(80):
        base, suffix = rng.choice(PLAIN), rng.choice(["js", "ts", "mjs", "css"])
        mark = rng.choice([f".{rng.getrandbits(16) | 1 << 15:x}", f"-{rng.getrandbits(40) | 1 << 39:X}", "_Zq7Rk2Lm", ".min", "-beta", ""])
        lost = mark not in (".min", "-beta", "")
        folder = rng.choice(["", "/", "out/", "https://cdn.example.org/x/y/", "/deep/er/"])
        tail = rng.choice(["", "?build=7", "#part", "?a/b"])
        pairs.append((f"{folder}{base}{mark}.{suffix}{tail}", f"{base}{'' if lost else mark}.{suffix}"))
    check(spark, grouping.normal_filename, pairs)


def _exc(kind="TypeError", value="boom", frames=()):
    return (kind, value, None, None, [
        (f.get("function"), f.get("module"), f.get("filename"), None, f.get("lineno"), None, f.get("in_app"), None, None, None)
        for f in frames
    ])


def fingerprints(spark, rows):
    df = spark.createDataFrame(
        [(i, e, m, f) for i, (e, m, f) in enumerate(rows)],
        f"i int, e {schemas.EXCEPTIONS}, m string, f array<string>",
    )
    out = df.select("i", grouping.fingerprint(F.col("e"), F.col("m"), F.col("f")).alias("p"))
    return [(r.p.method, r.p.components) for r in out.orderBy("i").collect()]


def test_fingerprint(spark):
    app = dict(function="render", module="app/cart", lineno=4, in_app=True)
    shifted = dict(app, lineno=40)
    lib = dict(function="next", module="express", lineno=1, in_app=False)
    got = fingerprints(spark, [
        ([_exc(frames=[lib, app])], None, None),
        ([_exc(frames=[shifted])], None, None),
        ([_exc(frames=[lib])], None, None),
        ([_exc(frames=[dict(function="", module="", filename="", in_app=True)])], None, None),
        ([_exc(frames=[dict(function="f", filename="/static/main.a3f9.js", in_app=True)])], None, None),
        ([_exc(frames=[app])], None, [" checkout ", "", "eu"]),
        ([_exc(frames=[app])], None, ["{{default}}", "eu"]),
        (None, "  user 12 gone ", None),
        ([_exc("", "", [])], None, None),
        (None, None, None),
        ([_exc("E", "", [])], None, None),
        ([_exc(frames=[app]), _exc("", "", [])], None, None),
    ])
    stack = ("stack_trace", ["type:TypeError", "frame:app/cart:render"])
    assert got[0] == got[1] == got[6] == got[11] == stack
    assert got[2] == ("stack_trace", ["type:TypeError", "frame:express:next"])
    assert got[3] == ("message", ["message:boom"])
    assert got[4] == ("stack_trace", ["type:TypeError", "frame:main.js:f"])
    assert got[5] == ("custom", ["checkout", "eu"])
    assert got[7] == ("message", ["message:user <num> gone"])
    assert got[8] == got[9] == ("fallback", ["empty"])
    assert got[10] == ("fallback", ["type:E", "value:"])


def test_group_hash(spark):
    import xxhash

    comps = [["a"], ["ab", "c"], ["a", "bc"], ["type:TypeError", "frame:é:f"]]
    exact = apply(spark, lambda c: grouping.group_hash(c, exact=True), comps, "array<string>")
    want = [xxhash.xxh64("\x1f".join(c).encode()).intdigest() for c in comps]
    assert [v % (1 << 64) for v in exact] == want
    fast = apply(spark, grouping.group_hash, comps, "array<string>")
    assert [v % (1 << 64) for v in fast] == [xxhash.xxh64("\x1f".join(c).encode(), seed=42).intdigest() for c in comps]
    check(spark, grouping.hash_hex, [(1, "0000000000000001"), (-1, "f" * 16)], "long")
    check(spark, lambda c: grouping.hash_from_hex(grouping.hash_hex(c)), [(1, 1), (-1, -1), (-(1 << 63), -(1 << 63))], "long")


def test_denied_keys(spark):
    """Every fixed word makes a key secret wherever it stands and however it is written; other keys stay."""
    rng = random.Random(12)
    pairs = [(k, False) for k in [*PLAIN, "", "order.total", "Zip-Code", "retry count"]]
    for denied in scrub.DENIED_WORDS:
        spelled = denied.replace("_", rng.choice("_-. "))
        pairs += [(f"{rng.choice(['', 'my_', 'X-'])}{rng.choice([spelled, spelled.upper(), spelled.title()])}{rng.choice(['', '_2', 'Value'])}", True) for _ in range(3)]
    check(spark, scrub.denied_key, pairs)
    policy = lambda c: scrub.denied_key(c, F.array(F.lit("Diag-nosis")), F.array(F.lit("token count")))
    check(spark, policy, [("token_count", False), ("token", True), ("x_diag_nosis_y", True), ("plain", False)])


def test_scrub_text(spark):
    jwt = "eyJhbGciOi.eyJzdWIi.SflKxw"
    check(spark, scrub.scrub_text, [
        (f"got {jwt} here", "got [redacted] here"),
        ("Authorization: Bearer abc.def-1==", "Authorization: [redacted]"),
        ("card 4111 1111 1111 1111", "card [redacted]"),
        ("card 4111-1111-1111-1111.", "card [redacted]."),
        ("4111111111111111, 41111111111111110000", "[redacted], 41111111111111110000"),
        ("4111 1111 1111 1111 now", "[redacted]now"),
        ("part 90210443218765432109 is due", "part 90210443218765432109 is due"),
        ("clock says 1690000000123 already", "clock says 1690000000123 already"),
        ("seat 31 of 40", "seat 31 of 40"),
        ("", ""),
        (None, None),
    ])


def test_scrub_map_and_json(spark):
    got = apply(spark, scrub.scrub_map, [{"password": "x", "note": "basic dXNlcg==", "plan": "free"}, None], "map<string,string>")
    assert got == [{"password": "[redacted]", "note": "[redacted]", "plan": "free"}, None]
    doc = {
        "headers": {"Authorization": "Bearer x", "Accept": "json"},
        "cookies": "a=b", "url": "/x", "data": {"password": "p", "message": "pay 4111 1111 1111 1111", "n": 4111111111111111},
        "list": ["basic abc", 1, None, True],
    }
    out = json.loads(apply(spark, scrub.scrub_json, [json.dumps(doc)])[0])
    assert out == {
        "headers": {"Authorization": "[redacted]", "Accept": "json"},
        "cookies": "[redacted]", "url": "/x",
        "data": {"password": "[redacted]", "message": "pay [redacted]", "n": 4111111111111111},
        "list": ["[redacted]", 1, None, True],
    }
    deep = "1"
    for _ in range(200):
        deep = '{"a":' + deep + "}"
    out = apply(spark, scrub.scrub_json, [deep])[0]
    assert out.count('"a"') == 21 and "[redacted]" in out


def test_ip_policy(spark):
    ips = ["203.0.113.42", "2001:db8:1234:5678::1", "::ffff:203.0.113.42", "not-an-ip", "", "1.2.3.999", "fe80::1%eth0"]
    cut = lambda c: scrub.apply_ip_policy(c, True, False)
    assert apply(spark, cut, ips) == ["203.0.113.0", "2001:db8:1234::", "203.0.113.0", "", "", "", "fe80::"]
    assert apply(spark, lambda c: scrub.apply_ip_policy(c, False, False), ips) == ips
    assert set(apply(spark, lambda c: scrub.apply_ip_policy(c, True, True), ips)) == {""}


def test_clock_correction(spark):
    day = "2026-07-14 "
    rows = [
        (day + "12:00:00", day + "12:00:05", day + "12:00:04", day + "12:00:01"),
        ("2035-01-01 00:00:00", day + "12:00:05", None, day + "12:00:05"),
        (None, day + "12:00:05", day + "12:00:04", day + "12:00:05"),
        (day + "12:00:00", day + "12:00:05", "2026-07-10 00:00:00", day + "12:00:05"),
        ("2026-07-12 12:00:00", day + "12:00:05", None, day + "12:00:05"),
        (day + "12:01:05", day + "12:00:05", None, day + "12:01:05"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string, s string, w string")
    ts = lambda c: F.col(c).cast("timestamp")
    out = df.select("i", normalize.corrected_time(ts("t"), ts("r"), ts("s")).alias("o"), ts("w").alias("w"))
    for r in out.collect():
        assert r.o == r.w, r


def test_ids(spark):
    u = "6fa459ea-ee8a-3ca4-894e-db77e160355e"
    check(spark, normalize.parse_uuid, [
        (u.upper(), u), (u.replace("-", ""), u), ("{" + u + "}", u), ("urn:uuid:" + u, u),
        ("nope", normalize.NIL_UUID), ("", normalize.NIL_UUID), (None, normalize.NIL_UUID),
    ])
    check(spark, normalize.parse_span_id, [
        ("00f067aa0ba902b7", 0x00F067AA0BA902B7), ("ffffffffffffffff", -1), ("1ffffffffffffffff", -1),
        ("A", 10), ("xyz", 0), ("", 0), (None, 0),
    ])
    check(spark, normalize.severity, [
        (" WARNING ", "warn"), ("err", "error"), ("panic", "fatal"), ("verbose", "debug"), ("", "info"), (None, "info"), ("trace", "trace"),
    ])


def test_title_and_culprit(spark):
    message = "Cannot read properties of undefined (reading 'id')"
    frames = [
        dict(function="dispatch", module="react-dom", in_app=False),
        dict(function="renderCart", module="app/cart", in_app=True),
        dict(function="inner", module="lib", in_app=False),
    ]
    rows = [
        ([_exc(value=message, frames=frames)], None),
        ([_exc(value="")], None),
        ([_exc("", "v")], "only message"),
        (None, None),
        ([_exc(value="é" * 150)], None),
        ([_exc(frames=[dict(function="", filename="a.js", in_app=False)])], None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, e {schemas.EXCEPTIONS}, m string")
    got = df.select("i", normalize.title(F.col("e"), F.col("m")).alias("t"), normalize.culprit(F.col("e")).alias("c")).orderBy("i").collect()
    assert got[0].t == "TypeError: " + message and got[0].c == "renderCart(app/cart)"
    assert [r.t for r in got[1:4]] == ["TypeError", "only message", "Unknown error"]
    assert got[4].t == "TypeError: " + "é" * 94 + "…"
    assert got[5].c == "a.js" and got[3].c == ""


def test_user_agents(spark):
    edge = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0"
    iphone = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1"
    check(spark, enrich.browser, [(edge, "Edge"), (iphone, "Safari"), ("", "")])
    check(spark, enrich.operating_system, [(edge, "Windows"), (iphone, "iOS"), ("curl", "")])
    ctx = [json.dumps({"browser": {"name": " Brave ", "user_agent": edge}, "os": {}}), json.dumps({"browser": "x"}), None]
    both = apply(spark, lambda c: F.concat_ws("|", *enrich.client_from_contexts(c)), ctx)
    assert both == ["Brave|Windows", "|", "|"]


def test_source_paths(spark):
    check(spark, enrich.module_of, [
        ("src/routes/cart.ts", "src/routes/cart"), ("webpack://app/./src/routes/cart.ts", "app/./src/routes/cart"),
        ("./src/lib/api.js", "src/lib/api"), ("/src/lib/api.js", "src/lib/api"), ("a.b/c", "a.b/c"),
    ])
    check(spark, enrich.is_in_app, [
        ("src/routes/cart.ts", True), ("node_modules/react/index.js", False), ("/vendor/lodash.js", False), ("", True),
    ])


def test_raw_stacks(spark):
    v8 = """TypeError: boom
    at renderCart (https://app.example.com/static/js/main.a3f9.js:1:48213)
    at https://app.example.com/static/js/main.a3f9.js:1:9
    at Array.map (<anonymous>)
    at next (/srv/node_modules/express/lib/router.js:10:5)"""
    gecko = "renderCart@https://app.example.com/static/js/main.a3f9.js:1:48213\n@https://x/y.js:2:3"
    got = apply(spark, parse_stack, [v8, gecko, None, "a@b.js:1:1\n" * 80])
    f = [tuple(x) for x in got[0]]
    main = "https://app.example.com/static/js/main.a3f9.js"
    assert f == [
        ("next", "/srv/node_modules/express/lib/router.js", 10, 5, False),
        ("Array.map", "<anonymous>", None, None, True),
        ("<anonymous>", main, 1, 9, True),
        ("renderCart", main, 1, 48213, True),
    ]
    assert [tuple(x) for x in got[1]] == [("<anonymous>", "https://x/y.js", 2, 3, True), ("renderCart", main, 1, 48213, True)]
    assert got[2] == [] and len(got[3]) == 50
    dropped = apply(spark, lambda c: F.size(parse_stack(c, r"main\.a3f9")), [v8])
    assert dropped == [2]
