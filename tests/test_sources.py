"""Feeds, pages, typed tables and registered sources."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import registry
from gleanery.plans import fixtures
from gleanery.sources import feeds, pages, tables

AT = dt.datetime(2026, 4, 12, 10, 30)

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title> News </title><link>https://example.com</link>
<language>en</language><item><title>One</title><link>https://example.com/1</link><guid isPermaLink="false">g1</guid>
<dc:creator>Ann</dc:creator><author>no</author><pubDate>Mon, 12 Apr 2026 10:30:00 GMT</pubDate>
<description><![CDATA[<p>Body &amp; more</p>]]></description></item><item>text only</item><item><link href="https://example.com/2"/>
<pubDate>never</pubDate><content:encoded>Full</content:encoded><description>Short</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><title type="html">F</title><subtitle>S</subtitle>
<link rel="self" href="https://example.com/self"/><link href="https://example.com/home"/>
<entry><title>A</title><link rel="enclosure" href="x"/><link rel="alternate" href="https://example.com/a"/>
<author><name> Eve </name></author><updated>2026-04-14T03:00:00Z</updated><summary>Sum</summary></entry>
<entry><id>2</id><link>https://example.com/plain</link><link href="https://example.com/b"/><author>Bob</author>
<published>bad</published><content>C</content></entry></feed>"""


def parse(spark, *documents):
    rows = [(i, i + 10, xml) for i, xml in enumerate(documents)]
    return feeds.feed_assets(spark.createDataFrame(rows, "payload_id bigint, source_id bigint, xml string"))


def test_rss_precedence(spark):
    assets = parse(spark, RSS)[0].orderBy("pos").collect()
    assert [a["pos"] for a in assets] == [0, 2]
    first, last = assets
    assert (first["external_id"], first["title"], first["author"], first["url"]) == (
        "g1", "One", "Ann", "https://example.com/1",
    )
    assert first["published_at"] == AT and first["raw_content"] == "<p>Body &amp; more</p>"
    assert first["feed"]["title"] == "News" and first["feed"]["site_url"] == "https://example.com"
    assert (last["external_id"], last["url"], last["published_at"], last["raw_content"]) == (
        "https://example.com/2", "https://example.com/2", None, "Full",
    )


def test_atom_precedence(spark):
    first, last = parse(spark, ATOM)[0].orderBy("pos").collect()
    assert (first["external_id"], first["url"], first["author"], first["raw_content"]) == (
        "https://example.com/a", "https://example.com/a", "Eve", "Sum",
    )
    assert first["feed"]["language"] == "de" and first["feed"]["site_url"] == "https://example.com/home"
    assert (last["external_id"], last["url"], last["author"], last["published_at"]) == (
        "2", "https://example.com/plain", "Bob", None,
    )


@pytest.mark.parametrize(
    ("xml", "problem"),
    [
        ("<rss><channel><item>", "RSS parsing failed"),
        ("<rss version='2.0'></rss>", "RSS channel is missing"),
        ("<html></html>", "Unsupported RSS document shape"),
        ("just text", "RSS parsing returned no document"),
        ("", "RSS parsing returned no document"),
    ],
)
def test_broken_payloads_are_quarantined(spark, xml, problem):
    assets, broken = parse(spark, xml)
    assert assets.count() == 0
    assert broken.first()["error"] == f"{problem} for source 10."


def test_feed_without_items_is_no_error(spark):
    assets, broken = parse(spark, "<rss><channel><title>t</title></channel></rss>", "<feed><title>x</title></feed>")
    assert assets.count() == 0 and broken.count() == 0


PAGE = """<html lang=en><head><title>Captured &amp; kept</title><meta content='Ann' name="author">
<meta property="article:published_time" content="2026-04-14T03:00:00Z"><meta name="description" content=" An
excerpt "></head><body><nav>menu</nav><article><!-- ad --><script>var a="</article>";</script><p>First paragraph.</p>
<aside>side</aside><p>Second one.</p></article><footer>foot</footer></body></html>"""


def page(spark, html):
    return pages.extract_articles(spark.createDataFrame([(html,)], "html string")).first()


def test_article_extraction(spark):
    row = page(spark, PAGE)
    assert (row["title"], row["author"], row["language"], row["excerpt"]) == (
        "Captured & kept", "Ann", "en", "An excerpt",
    )
    assert row["published_at"] == dt.datetime(2026, 4, 14, 3)
    assert row["content_text"] == "First paragraph. Second one."


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        ("<meta name='pubdate' content='2026-01-02'><time datetime='2026-05-05'>x</time>", dt.datetime(2026, 1, 2)),
        ("<time datetime=2026-05-05>x</time>", dt.datetime(2026, 5, 5)),
        ("<meta name='timestamp' content='bad'><time datetime='2026-05-05'>x</time>", None),
        ("<meta property='og:article:published_time' content='2026-03-03T01:00:00+01:00'>", dt.datetime(2026, 3, 3)),
        ("<meta name='pubdate' content=' '><meta name='publishdate' content='2026-02-02'>", dt.datetime(2026, 2, 2)),
        ("", None),
    ],
)
def test_published_at_precedence(spark, head, expected):
    assert page(spark, f"<html><head>{head}</head><body><p>x</p></body></html>")["published_at"] == expected


def test_region_order(spark):
    assert page(spark, "<body>b<main>m</main></body>")["content_text"] == "m"
    assert page(spark, "<body>b</body>")["content_text"] == "b"
    assert page(spark, "<head><title>t</title></head>bare")["content_text"] == "bare"
    assert page(spark, "<body><script>x</script></body>")["has_content"] is False


def test_fetch_outcomes_and_assets(spark):
    html, url = "<body><p>Text</p></body>", "https://example.com/"
    rows = [
        (None, None, 0, None, None, "network_error"), (302, None, 0, None, None, "invalid_redirect"),
        (302, "x", 6, None, None, "redirect_limit_exceeded"), (500, None, 0, "text/plain", "oops", "response_error"),
        (404, None, 0, "image/png", "bin", "response_error"), (200, None, 0, "application/pdf", "b", "non_html_response"),
        (200, None, 0, "text/html", "<body></body>", "extract_failed"), (200, None, 1, "text/html", html, None),
        (301, "x", 2, None, None, None),
    ]
    frame = spark.createDataFrame(
        [(f"{url}{i}", f"{url}{i}", AT, *row) for i, row in enumerate(rows)],
        "submitted_url string, final_url string, fetched_at timestamp, http_status int, location string, "
        "redirect_count int, content_type string, html string, expected string",
    )
    outcomes = pages.fetch_outcomes(frame)
    assert outcomes.where("not (code <=> expected)").count() == 0
    assert [r["outcome"] for r in outcomes.orderBy("submitted_url").collect()][-2:] == ["succeeded", "redirect"]
    assets = {r["url"][-1]: r for r in pages.page_assets(outcomes).collect()}
    assert sorted(assets) == ["3", "6", "7"]
    assert (assets["3"]["asset_type"], assets["3"]["status"], assets["3"]["raw_content"]) == ("url", "failed", "oops")
    assert (assets["7"]["asset_type"], assets["7"]["status"]) == ("article", "new")
    meta = spark.createDataFrame([(assets["3"]["raw_metadata"],)], "j string")
    assert meta.select(F.get_json_object("j", "$.failure.message")).first()[0].endswith("with status 500.")


def test_typed_tables_round_trip(spark, tmp_path):
    rows = [("s1", "rss", "u", "u", "n", None, "broken", AT, AT)]
    frame = spark.createDataFrame(rows, tables.schemas.TABLES["sources"])
    for kind in ("parquet", "json", "orc"):
        tables.write_table(frame, str(tmp_path / kind), format=kind)
        assert tables.read_table(spark, "sources", str(tmp_path / kind), format=kind).collect() == frame.collect()
    assert tables.invalid_enums(frame, "sources").count() == 1
    assert tables.stream_table(spark, "sources", str(tmp_path / "parquet")).isStreaming


# ------------------------------------------------------------------ registered sources
def test_registration(spark):
    rows = [
        (1, " Feed ", "https://example.com/a#x", " ", 1), (2, "Again", "https://EXAMPLE.com/a", None, 2),
        (3, " ", "https://example.com/b", None, 3), (4, "F", "ftp://example.com", None, 4), (5, "F", "nope", None, 5),
        (6, "Held", "https://example.com/held", None, 6),
    ]
    frame = spark.createDataFrame(
        rows, "request_id bigint, name string, source_url string, topic string, requested_at bigint"
    )
    held = spark.createDataFrame([("https://example.com/held",)], "source_ref string")
    got = {r["request_id"]: r for r in registry.register_sources(frame, held).collect()}
    assert (got[1]["name"], got[1]["source_ref"], got[1]["topic"], got[1]["rejection"]) == (
        "Feed", "https://example.com/a", None, None,
    )
    assert [got[i]["rejection"] for i in range(2, 7)] == [
        registry.ALREADY_REGISTERED, registry.NAME_REQUIRED, registry.URL_SCHEME, registry.URL_INVALID,
        registry.ALREADY_REGISTERED,
    ]
    accepted = registry.accepted_sources(registry.register_sources(frame, held))
    assert accepted.select("status", "source_type").collect() == [("active", "rss")]


def test_commands(spark):
    steps = [
        ("a", "pause"), ("a", "register"), ("a", "register"), ("a", "pause"), ("b", "register"), ("b", "delete"),
        ("b", "reactivate"), ("b", "register"), (" ", "pause"), ("c", "pause"), ("d", "delete"), ("d", "pause"),
    ]
    rows = [(i, s, a, AT + dt.timedelta(minutes=i // 3)) for i, (s, a) in enumerate(steps)]
    frame = spark.createDataFrame(rows, "command_id bigint, source_id string, action string, at timestamp")
    existing = spark.createDataFrame(
        [("c", "active", AT, AT), ("d", "active", AT, AT), ("e", "error", AT, AT)],
        "source_id string, status string, created_at timestamp, updated_at timestamp",
    )
    checked = registry.check_commands(frame, existing)
    got = {r["command_id"]: r["rejection"] for r in checked.collect()}
    assert got[0] == registry.NOT_FOUND and got[2] == registry.ALREADY_REGISTERED
    assert got[6] == registry.NOT_FOUND and got[8] == registry.ID_REQUIRED and got[11] == registry.NOT_FOUND
    assert all(got[i] is None for i in (1, 3, 4, 5, 7, 9, 10))
    left = registry.apply_commands(checked, existing)
    assert sorted((r["source_id"], r["status"]) for r in left.collect()) == [
        ("a", "paused"), ("b", "active"), ("c", "paused"), ("e", "error"),
    ]
    entries = spark.createDataFrame([(1, "a"), (2, "d")], "capture_entry_id bigint, source_id string")
    cleared = registry.cascade_deletes(entries, left, keep_rows=True).orderBy("capture_entry_id").collect()
    assert [tuple(r) for r in cleared] == [(1, "a"), (2, None)]
    assert registry.cascade_deletes(entries, left, keep_rows=False).count() == 1


def test_status_branches(spark):
    later = AT + dt.timedelta(hours=1)
    sources = spark.createDataFrame(
        [(i, f"n{i}", s, u, AT, AT) for i, (s, u) in enumerate(
            [("active", "u"), ("paused", "u"), ("paused", "u"), ("error", "u"), ("error", "u"), ("active", "u"),
             ("active", ""), ("active", "u")])],
        "source_id int, name string, status string, source_url string, created_at timestamp, updated_at timestamp",
    )
    state = spark.createDataFrame(
        [(1, later, later, None, None), (2, None, None, None, None), (3, later, None, later, "boom"),
         (4, later, None, None, None), (5, later, later, None, None), (6, later, None, None, None),
         (7, None, None, None, None)],
        "source_id int, last_synced_at timestamp, last_success_at timestamp, last_error_at timestamp, "
        "last_error_message string",
    )
    got = [r["detail"] for r in registry.source_status(sources, state).orderBy("source_id").collect()]
    when = "Apr 12, 2026, 11:30 AM"
    assert got == [
        "Sync state has not been initialized yet.", f"Paused. Last successful sync {when}.",
        "Paused before the first sync.", f"Last sync error {when}: boom", "An error state is recorded for this source.",
        f"Last successful sync {when}.", f"Last sync attempt {when}.", "Awaiting first sync.",
    ]
    refusals = [r["refusal"] for r in registry.sync_eligibility(sources).orderBy("source_id").collect()]
    assert refusals[1] == "Paused RSS sources cannot be synced."
    assert refusals[6] == "RSS source URL is required for sync." and refusals[0] is None
    filled = registry.backfill_sync_state(sources.withColumn("source_type", F.lit("rss")), state)
    assert filled.count() == 8


def test_fixture_tables_keep_every_row(spark):
    d = "/root/testdata/sf0.001"
    count = fixtures.table(spark, d, "documents").count()
    for build in (fixtures.items, fixtures.raw_assets, fixtures.feed_entries, fixtures.rss_payloads):
        assert build(spark, d).count() == count


def test_feeds_of_every_shape_are_parsed_in_one_scan(spark):
    """One read of the payloads and two XML parses, one for each shape, for assets and quarantine together."""
    from gleanery.plans import catalog

    for name in ("feed_rss_assets", "feed_atom_assets", "feed_dispatch"):
        frame = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_xml(") <= 2 and plan.count("Union") == 0
        assert len(re.findall(r"FileScan parquet", plan)) == 1
