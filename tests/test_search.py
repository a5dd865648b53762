"""The search text: terms, literals, errors, scope."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalfold.functions import search as s
from signalfold.operators import listing

NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def errors(spark):
    rows = [
        (1, 1, datetime(2024, 1, 10), "error", "web@2.4.1", "Chrome", "a@example.com", "Cannot read properties of undefined", "f(app)", {"tenant": "acme", "feature_flag.new_cart": "true"}, "production"),
        (1, 2, datetime(2024, 1, 20), "fatal", "my-app-2.0", "Safari", "", "value is >= 10", "g(app)", {}, "staging"),
        (2, 3, datetime(2024, 1, 30, 12), "error", "web@2.4.1", "", "", "plain", "h(lib)", {"tenant": "other"}, "production"),
    ]
    return spark.createDataFrame(rows, "project_id long, event_id long, timestamp timestamp, level string, release string, browser string, user_email string, exception_value string, culprit string, tags map<string,string>, environment string")


@pytest.mark.parametrize("text,ids", [
    ("level:error release:web@2.4.1", [1, 3]),
    ("!browser:Safari", [1, 3]), ("-browser:Safari", [1, 3]),
    ("release:my-app-2.0", [2]),
    ("tenant:acme", [1]), ("!tenant:acme", [2, 3]), ("tags.feature_flag.new_cart:true", [1]),
    ("user.email:a@example.com", [1]),
    ('value:"Cannot read properties of undefined"', [1]),
    ('"is >= 10"', [2]), ('value:">= is a comparison"', []),
    ("level:error undefined PROPERTIES", [1]),
    ("", [1, 2, 3]), ("   ", [1, 2, 3]),
    ("timestamp:>2024-01-15", [2, 3]), ("timestamp:>-24h", [3]), ("timestamp:<=2024-01-10", [1]),
    ("!timestamp:>2024-01-15", [1]),
    ("level:", [1, 2, 3]),
    ('browser:""', [3]),
    ("x' OR 1=1", []),
])
def test_matches(errors, text, ids):
    got = s.search(errors, "errors", text, now=NOW).select("event_id").orderBy("event_id").collect()
    assert [r[0] for r in got] == ids


def test_scope(errors):
    def ids(**kw):
        return sorted(r.event_id for r in s.search(errors, "errors", "", **kw).collect())

    assert ids(project_id=1) == [1, 2]
    assert ids(start="2024-01-10", end="2024-01-20") == [1]
    assert ids(environment="staging") == [2] and ids(environment="") == [1, 2, 3]


@pytest.mark.parametrize("signal,text,term", [
    ("spans", "duration:>abc", "duration:>abc"), ("spans", "name:>x", "name:>x"), ("spans", "http.status:many", "http.status:many"),
    ("logs", "severity:>=loud", "severity:>=loud"), ("errors", "timestamp:>yesterday", "timestamp:>yesterday"),
    ("errors", "level:>=error", "level:>=error"), ("errors", "tenant:>5", "tenant:>5"), ("errors", "tags:x", "tags:x"),
])
def test_errors_name_the_term(errors, signal, text, term):
    with pytest.raises(s.SearchError) as e:
        s.search_condition(errors, s.SIGNALS[signal], text, NOW)
    assert e.value.term == term and e.value.reason


def test_negated_word(errors):
    s.search_condition(errors, s.ERRORS, "!word")
    with pytest.raises(s.SearchError):
        s.search_condition(errors, s.ERRORS, "!word", strict=True)


def test_literals():
    assert s.parse_duration("500ms") == 500_000_000 and s.parse_duration("1.5s") == 1_500_000_000
    assert s.parse_duration("1h30m") == 5_400_000_000_000 and s.parse_duration("0") == 0 and s.parse_duration("-2us") == -2000
    for bad in ("", "5", "ms", "1x", "1h 2m"):
        with pytest.raises(ValueError):
            s.parse_duration(bad)
    assert s.parse_time("2024-01-02T03:04:05+01:00", None) == datetime(2024, 1, 2, 2, 4, 5)
    assert s.lookup(s.ERRORS, "user.email") == ("user_email", "string", "")
    assert s.lookup(s.ERRORS, "a.b") == ("tags", "map", "a.b")


def test_time_range():
    two_weeks = (datetime(2024, 1, 17), NOW)
    assert s.time_range(NOW) == two_weeks
    assert s.time_range(NOW, "2024-01-20", "2024-01-10") == two_weeks
    assert s.time_range(NOW, "bad", None) == two_weeks
    assert s.time_range(NOW, "2024-01-20T00:00:00Z") == (datetime(2024, 1, 20), NOW)


def test_cursor_walks_all_pages(spark):
    rows = [(1, i, datetime(2024, 1, 1 + i % 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "project_id long, event_id long, timestamp timestamp")
    seen, token = [], ""
    while True:
        page, token = listing.take_page(listing.list_events(df, 5, listing.decode_cursor(token)), listing.EVENT_ORDER, 5)
        seen += [(r.timestamp, r.event_id) for r in page]
        if not token:
            break
    assert seen == sorted(seen, reverse=True) and len(seen) == 23
    for bad in ("%%%", "bm90IGpzb24", "MTI"):
        with pytest.raises(ValueError):
            listing.decode_cursor(bad)
    assert listing.decode_cursor("") is None and listing.encode_cursor(None) == ""


def test_time_bounds_reach_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.lit(1).alias("project_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("timestamp"), F.expr("date'2024-01-01' + cast(id as int)").alias("day"))
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    rows = s.search(spark.read.parquet(str(tmp_path / "t")), "logs", "", 1, "2024-01-03", "2024-01-05")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert rows.count() == 2
