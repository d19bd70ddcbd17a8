"""Feed parsing, registry, state, streaming restarts and other cases that the tables do not hold."""

import json

from pyspark.sql import functions as F

from newsgrid.functions import text as x
from newsgrid.operators import library, normalize, state
from newsgrid.operators import weather
from newsgrid.sources import feeds
from newsgrid.streaming import jobs

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>
<item><title>First &amp; best</title><link>HTTPS://News.Example.com/a/amp?utm_source=x&amp;b=2&amp;a=1#top</link><description><![CDATA[<p>Hello<script>x()</script> <b>world</b></p>]]></description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title> </title><link>https://e.com/2</link></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One</title><link rel="self" href="https://e.com/self"/><link rel="alternate" href="https://e.com/one"/><content>Text</content><updated>2024-01-02T10:00:00Z</updated></entry></feed>"""
BOMB = '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><title>t</title><link>l</link></item></channel></rss>'


def raw(spark):
    rows = [("r", "rss", RSS), ("a", "atom", ATOM), ("b", "rss", BOMB), ("m", "rss", "<rss><channel><item>"), ("e", "rss", ""), ("j", "json-api", "{broken")]
    return spark.createDataFrame([(i, k, "https://feed", b) for i, k, b in rows], "source_id string, type string, feed_url string, body string")


def test_feeds(spark):
    got = {r.source_id: r for r in feeds.ingest(raw(spark)).collect()}
    assert set(got) == {"r", "a"}
    assert got["r"].title == "First & best" and str(got["r"].published_at) == "2024-01-02 10:00:00" and got["a"].url == "https://e.com/one" and got["a"].summary_html == "Text"
    assert {(r.source_id, r.reason) for r in feeds.parse_errors(raw(spark)).collect()} == {("b", "declarations"), ("e", "empty"), ("m", "no items"), ("j", "no items")}
    sources = spark.createDataFrame([("r", "Daily", "RSS_EXCERPT_ALLOWED", "en"), ("a", "Atom", "LINK_ONLY", None)], "source_id string, name string, rights_mode string, language string")
    out = {r.source_id: r for r in normalize.normalize(feeds.ingest(raw(spark)), sources, F.lit("2024-01-03").cast("timestamp")).collect()}
    assert out["r"].url == "https://news.example.com/a?a=1&b=2" and out["r"].excerpt == "Hello world" and out["r"].publisher == "Daily"
    assert out["a"].excerpt is None and out["a"].language == "en"
    early = normalize.normalize(feeds.ingest(raw(spark)), sources, F.lit("2024-01-02 08:30:00").cast("timestamp"))
    assert early.count() == 0


def test_charsets(spark):
    rows = [(1, "é “x”".encode(), None), (2, "é “x”".encode("cp1252"), None), (3, b'<?xml version="1.0" encoding="ISO-8859-15"?>' + "€".encode("iso-8859-15"), None), (4, "é".encode("utf-16"), "UTF-16")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, body binary, c string").select("i", feeds.decode_body(F.col("body"), F.col("c")).alias("t")).collect()}
    assert got[1] == got[2] == "é “x”" and got[3].endswith("€") and got[4] == "é"


def test_urls(spark):
    cases = {
        " HTTP://A.com:80/x/?utm_x=1 ": "http://a.com/x/", "https://a.com/x/amp/": "https://a.com/x", "https://a.com:8080": "https://a.com:8080/", "https://a.com/?b=&a=%7E*": "https://a.com/?a=~%2A&b=",
        "https://a.com/p;v=1?output=amp&Q=A+b#f": "https://a.com/p?Q=A+b", "https://a.com/?fbclid=1&amp=1": "https://a.com/",
    }
    got = spark.createDataFrame(list(cases.items()), "u string, want string").select("want", x.canonicalize_url(F.col("u")).alias("got")).collect()
    assert [(r.want, r.got) for r in got if r.want != r.got] == []


def test_registry(spark, tmp_path):
    (tmp_path / "us").mkdir()
    (tmp_path / "us" / "a.json").write_text(json.dumps({"id": "a", "type": "rss", "enabled": True, "priority": 5, "coverage": {"country": "US", "cities": ["Troy"]}}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "type": "rss", "enabled": False}))
    (tmp_path / "us" / "regions.json").write_text(json.dumps({"id": "r"}))
    assert [r.id for r in feeds.read_sources(spark, str(tmp_path)).collect()] == ["a"]
    assert feeds.read_sources(spark, str(tmp_path), enabled_only=False).count() == 2


def test_images(spark):
    page = lambda title, url, lic: {"title": title, "imageinfo": [{"url": url, "descriptionurl": "https://c/d", "extmetadata": {"LicenseShortName": {"value": lic}, "Artist": {"value": "<a>Ann</a>"}}}]}
    body = json.dumps({"query": {"pages": {"1": page("File:Old Mill.jpg", "https://upload.w/1", "CC BY 4.0"), "2": page("File:B.jpg", "https://upload.w/2", "CC BY-NC 4.0"), "3": page("File:C.jpg", "http://x", "CC0")}}})
    got = library.parse_image_candidates(spark.createDataFrame([(1, body), (2, "no")], "story_id long, body string")).collect()
    assert [(r.story_id, r.title, r.creator) for r in got] == [(1, "Old Mill", "Ann")]


def test_oldest_id_survives(spark):
    prev = spark.createDataFrame([("new", None, 100, 1, ["gone"]), ("old", 5, 90, 4, []), ("mid", 50, 95, 2, [])], "event_id string, first_seen_s long, last_seen_s long, version int, aliases array<string>")
    pm = spark.createDataFrame([("new", 1, "a"), ("old", 2, "b"), ("mid", 3, "c"), ("mid", 9, "c")], "event_id string, item_id long, source_id string")
    new = spark.createDataFrame([("x", 60, 120, []), ("gone", 70, 121, [])], "event_id string, first_seen_s long, last_seen_s long, aliases array<string>")
    nm = spark.createDataFrame([("x", 2, "b"), ("x", 3, "z"), ("gone", 7, "a")], "event_id string, item_id long, source_id string")
    got = {r.event_id: r for r in state.update_state(new, nm, prev, pm, 200).collect()}
    assert set(got) == {"old", "new", "mid"}  # mid is an alias of old, but one of its members is not there
    assert (got["old"].status, got["old"].version, got["old"].aliases) == ("updated", 5, ["mid", "x"])
    assert (got["new"].status, got["new"].version) == ("unchanged", 1) and got["mid"].status == "unchanged"
    wide = {r.event_id: r.first_seen_s for r in state.update_state(new, nm, prev, pm, 200, members="union").collect()}
    assert wide["old"] == 5


def test_weather_json(spark):
    hour = lambda h, t: {"time": f"2024-01-0{1 + h // 24}T{h % 24:02d}:00:00Z", "data": {"instant": {"details": {"air_temperature": t, "wind_speed": 5.0, "wind_from_direction": 90.0}}, "next_6_hours": {"summary": {"symbol_code": "heavyrain_day"}, "details": {"probability_of_precipitation": 40.0}}}}
    body = json.dumps({"properties": {"timeseries": [hour(h, float(h)) for h in range(30)]}})
    tables = weather.weather_tables(spark.createDataFrame([("k", body)], "bucket string, body string"), "met")
    assert tables["hourly"].count() == 24 and tables["current"].collect()[0].wind_kph == 18.0
    assert [(r.hi, r.lo, r.condition) for r in tables["daily"].orderBy("day").collect()] == [(23.0, 0.0, "RAIN"), (29.0, 24.0, "RAIN")]
    period = lambda i, day, f: {"startTime": f"2024-01-01T{6 + 12 * i % 24:02d}:00:00-05:00", "isDaytime": day, "temperature": f, "temperatureUnit": "F", "windSpeed": "5 to 10 mph", "shortForecast": "Sunny", "icon": "https://x/icons/land/day/few?size=m", "probabilityOfPrecipitation": {"value": 10 * i}}
    body = json.dumps({"properties": {"periods": [period(0, True, 50.0), period(1, False, 32.0)]}})
    day = weather.weather_tables(spark.createDataFrame([("k", body)], "bucket string, body string"), "nws", "America/New_York")["daily"].collect()
    assert [(r.hi, r.lo, r.precip, r.condition) for r in day] == [(10.0, 0.0, 10, "PARTLY_CLOUDY")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    line = lambda i: json.dumps({"source_id": f"s{i}", "type": "atom", "feed_url": "f", "body": ATOM}) + "\n"
    for part in ("one", "two"):
        (land / f"{part}.json").write_text("".join(line(f"{part}{i}") for i in range(3)))
        jobs.stream_ingest(spark, str(land), str(tmp_path / "items"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "items")).count() == 6


def test_stream_state_takes_the_last_snapshot(spark, tmp_path):
    schema = "event_id string, first_seen_s long, last_seen_s long, aliases array<string>, item_id long, source_id string"
    for i, rows in enumerate([[("e", 1, 10, [], 1, "a"), ("f", 1, 10, [], 5, "x")], [("e", 2, 20, [], 2, "b"), ("g", 3, 20, [], 1, "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "land"))
        held = jobs.stream_state(spark.readStream.schema(schema).json(str(tmp_path / "land")), str(tmp_path / "snap"), 100, checkpoint=str(tmp_path / "check"))
    got = {r.event_id: (r.status, r.version) for r in held.clusters(1).collect()}
    assert got == {"e": ("unchanged", 1), "f": ("unchanged", 1)}  # g holds e's item, so it goes on as e and is the last of two


def test_errors_go_by_document(spark):
    """A broken document of a source is reported though another one of that source gave items."""
    good = '{"features": [{"properties": {"title": "M 3", "time": 0, "url": "https://q/1"}}]}'
    rows = [("s", "json-api", good), ("s", "json-api", "{"), ("s", "json-api", '{"features": []}'), ("s", "other", "x"), ("t", "json-api", good)]
    raw = spark.createDataFrame(rows, "source_id string, type string, body string").withColumns({"feed_url": F.lit("https://f"), "http_charset": F.lit("")})
    assert feeds.ingest(raw).count() == 2
    assert sorted(tuple(r) for r in feeds.parse_errors(raw).collect()) == [("s", "json-api", "no items")] * 2 + [("s", "other", "no items")]
