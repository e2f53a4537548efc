"""Temporal list join against a loop over entries."""

import datetime as dt
import random

import pytest

from conftest_llm import with_clashes
from peerlabel.llm.url_filters import TemporalUrlFilter

DAY = dt.date(2024, 1, 1)
URLS = [
    "http://a.b.example.com/x/y?q#f",
    "HTTPS://user:pw@B.Example.com:8080/x",
    "http://example.com",
    "http://c.org//z//",
    "ftp://c.org/z/",
    "no url",
    "",
    None,
    "http:///nohost",
]


def patterns(url):
    if not url or "://" not in url:
        return set()
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower()
    if not host:
        return set()
    labels, steps = host.split("."), [s for s in path.split("/") if s]
    return {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(steps[: i + 1]) for i in range(len(steps))}


def listed(entries, name, pattern, day):
    past = [(e[2], e[3]) for e in entries if e[:2] == (name, pattern) and e[2] and e[2] <= day and e[3] in ("add", "remove")]
    if not past:
        return False
    last = max(d for d, _ in past)
    return all(a == "add" for d, a in past if d == last)


@pytest.mark.parametrize("bucket_days, small", [(1, 500_000), (30, 500_000), (30, 0), (10000, 500_000)])
def test_verdicts_match_a_loop(spark, bucket_days, small):
    rng = random.Random(bucket_days)
    names = ["spam", "adult", "allow"]
    some = sorted({p for u in URLS for p in patterns(u)})
    entries = [
        (rng.choice(names), rng.choice(some), DAY + dt.timedelta(rng.randint(0, 90)), rng.choice(["add", "remove", "note"]))
        for _ in range(150)
    ]
    entries += [entries[0], ("spam", None, DAY, "add"), ("spam", "c.org", None, "add"), (None, "c.org", DAY, "add")]
    captures = [(i, rng.choice(URLS), DAY + dt.timedelta(rng.randint(-5, 120))) for i in range(200)]
    captures += [(900, URLS[0], None)]
    table = spark.createDataFrame(entries, "list STRING, pattern STRING, day DATE, action STRING")
    asked = with_clashes(spark.createDataFrame(captures, "capture_id LONG, url STRING, fetched DATE"), "list", "bucket", "since")
    got = {r.capture_id: r for r in TemporalUrlFilter(bucket_days, small).verdicts(asked, table).collect()}
    assert len(got) == len(captures)
    for i, url, day in captures:
        found = {(n, p) for n in names for p in patterns(url) if day and listed(entries, n, p, day)}
        lists = sorted({n for n, _ in found})
        blocked = bool(set(lists) - {"allow"}) and "allow" not in lists
        assert (got[i].n_matches, got[i].lists, got[i].blocked) == (len(found), ",".join(lists), blocked), (url, day)


def test_intervals(spark):
    rows = [
        ("l", "p", DAY, "add"),
        ("l", "p", DAY + dt.timedelta(5), "add"),
        ("l", "p", DAY + dt.timedelta(9), "remove"),
        ("l", "q", DAY, "add"),
        ("l", "q", DAY, "remove"),
        ("l", "r", DAY, "remove"),
        ("l", "s", DAY, "add"),
    ]
    table = spark.createDataFrame(rows, "list STRING, pattern STRING, day DATE, action STRING")
    got = sorted((r.pattern, r.since, r.until) for r in TemporalUrlFilter().intervals(table).collect())
    assert got == [
        ("p", DAY, DAY + dt.timedelta(5)),
        ("p", DAY + dt.timedelta(5), DAY + dt.timedelta(9)),
        ("s", DAY, None),
    ]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "list STRING, pattern STRING, day DATE, action STRING")
    captures = spark.createDataFrame([(1, "http://a.b/", DAY), (1, "http://a.b/", DAY), (None, None, None)], "capture_id LONG, url STRING, fetched DATE")
    rows = TemporalUrlFilter().verdicts(captures, none).collect()
    assert len(rows) == 3 and not any(r.blocked or r.n_matches or r.lists for r in rows)
    assert TemporalUrlFilter().verdicts(captures.limit(0), none).count() == 0


def test_entries_hold_for_ever_and_from_any_time(spark):
    entries = [("spam", "a.org", dt.date(1950, 1, 1), "add"), ("adult", "b.org", dt.date(2024, 1, 1), "add")]
    table = spark.createDataFrame(entries, "list STRING, pattern STRING, day DATE, action STRING")
    captures = [(1, "http://a.org/", dt.date(1949, 12, 31)), (2, "http://a.org/", dt.date(1950, 1, 1)), (3, "http://a.org/", dt.date(2900, 5, 5)), (4, "http://b.org/", dt.date(9999, 12, 31)), (5, "http://b.org/", dt.date(2023, 12, 31))]
    asked = spark.createDataFrame(captures, "capture_id LONG, url STRING, fetched DATE")
    got = {r.capture_id: r.lists for r in TemporalUrlFilter().verdicts(asked, table).collect()}
    assert got == {1: "", 2: "spam", 3: "spam", 4: "adult", 5: ""}


def test_rows_of_an_entry_do_not_grow_with_time(spark, monkeypatch):
    """One row for the entry and one for each bucket that is asked for."""
    from peerlabel.llm import url_filters

    written = {}
    plain = url_filters.materialize
    monkeypatch.setattr(url_filters, "materialize", lambda df, what: written.setdefault(what, plain(df, what)))
    table = spark.createDataFrame([("spam", "a.org", dt.date(1900, 1, 1), "add")], "list STRING, pattern STRING, day DATE, action STRING")
    captures = [(i, "http://x.a.org/", dt.date(2000 + i % 2, 1, 1)) for i in range(1000)]
    asked = spark.createDataFrame(captures, "capture_id LONG, url STRING, fetched DATE")
    assert TemporalUrlFilter().matches(asked, table).count() == 1000
    assert written["url-relevant"].count() == 1 + 2 and written["url-asked"].count() == 1000
