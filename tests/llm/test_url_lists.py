import datetime as dt

from repetend.llm import url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def frames(spark, captures, events):
    return spark.createDataFrame(captures, "page_id long, url string, day date, pattern string"), spark.createDataFrame(events, "pattern string, category string, action string, day date, since int")


def test_intervals_and_the_entry_in_force(spark):
    events = [
        ("bad.example.org", "spam", "add", day(10), 0), ("bad.example.org", "spam", "remove", day(20), 0), ("bad.example.org", "spam", "add", day(30), 0),
        ("example.org", "wide", "add", day(15), 0), ("bad.example.org/x", "path", "add", day(0), 0), ("one.net", "spam", "add", day(5), 0), ("one.net", "spam", "remove", day(5), 0),
        (None, "spam", "add", day(1), 0), ("two.net", None, "add", day(1), 0), ("two.net", "spam", "block", day(1), 0), ("two.net", "spam", "add", None, 0),
    ]
    host = "https://u@BAD.example.org:443/"
    cases = [
        (1, f"{host}y", day(9), None), (2, f"{host}y", day(10), "bad.example.org"), (3, f"{host}y", day(20), "example.org"), (4, f"{host}y?q", day(40), "bad.example.org"),
        (5, f"{host}x/z", day(12), "bad.example.org/x"), (6, "http://one.net", day(6), None), (7, "http://two.net./", day(6), "two.net"), (8, None, day(6), None), (9, "no url", day(6), None),
        (10, "http://example.org.evil.com/", day(50), None), (11, f"{host}y", None, None), (12, "http://notexample.org/", day(50), None),
    ]
    captures, listed = frames(spark, [(*c[:3], "clash") for c in cases], events)
    rows = {r.page_id: r for r in url_lists.evaluate(captures, listed).collect()}
    assert {i: r.pattern for i, r in rows.items()} == {c[0]: c[3] for c in cases}
    assert all(r.blocked == (r.pattern is not None) == (r.n_active > 0) for r in rows.values())
    assert (rows[4].category, rows[4].since, rows[4].n_active) == ("spam", day(30), 2)


def test_repeated_rows_and_empty_tables(spark):
    captures, listed = frames(spark, [(1, "http://a.b/", day(1), "")] * 3 + [(None, "http://a.b/", day(1), "")], [("a.b", "c", "add", day(0), 0)])
    rows = url_lists.evaluate(captures, listed).collect()
    assert len(rows) == 4 and all(r.blocked for r in rows)
    assert url_lists.evaluate(captures.limit(0), listed).count() == 0
    assert not any(r.blocked for r in url_lists.evaluate(captures, listed.limit(0)).collect())


def test_entries_with_deeper_paths_and_parent_domains_with_paths(spark):
    listed = [("a.example.org/one/two", "deep", "add", day(0), 0), ("example.org/ads", "parent", "add", day(0), 0)]
    cases = [
        (1, "http://a.example.org/one/two/three?q=/x", "a.example.org/one/two"), (2, "http://a.example.org/one/twofold", None), (3, "http://www.example.org/ads#/a", "example.org/ads"),
        (4, "http://example.org/x/ads", None), (5, "http://a.example.org/one", None), (6, "http://a.example.org//", None), (7, "http://www.example.org?/ads", None),
    ]
    captures, events = frames(spark, [(i, url, day(1), "") for i, url, _ in cases], listed)
    assert {r.page_id: r.pattern for r in url_lists.evaluate(captures, events).collect()} == {i: want for i, _, want in cases}


def test_columns_with_clashing_names_and_a_very_long_url(spark):
    captures, listed = frames(spark, [(1, "http://a.b/" + "x/" * 200, day(1), ""), (2, "http://c.d/" + "y" * 200_000, day(1), "")], [("a.b/x/x", "c", "add", day(0), 9), ("c.d", "c", "add", day(0), 9)])
    for name in ("host", "salt", "copies", "category", "since", "n_active", "best", "until", "blocked"):
        captures = captures.withColumn(name, captures["page_id"] * 7)
        listed = listed if name in listed.columns else listed.withColumn(name, listed["since"])
    found = url_lists.evaluate(captures, listed)
    assert found.columns == ["page_id", "url", "day", "host", "blocked", "pattern", "category", "since", "n_active"]
    assert sorted((r.page_id, r.host, r.pattern, r.since, r.n_active) for r in found.collect()) == [(1, "a.b", "a.b/x/x", day(0), 1), (2, "c.d", "c.d", day(0), 1)]
