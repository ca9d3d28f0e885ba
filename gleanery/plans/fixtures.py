"""Curation tables derived from the given driver tables.

Every driver row yields rows here; nothing is filtered, sampled or capped.
Ids decide which variant a row becomes, by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery import fixed_values as V
from gleanery.functions import text
from gleanery.operators.groups import group_id
from gleanery.session import tune
from gleanery.sources.pages import PUBLISHED_META

# Declared, so that opening a table runs no inference.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "region": "r_regionkey int, r_name string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_linenumber int",
    "customer": "c_custkey bigint",
}
AS_OF = "2024-01-25 00:00:00"
_JAN_1 = 1704067200000000  # 2024-01-01 UTC in microseconds
_FEB_1 = 1706745600000000
_MINUTE = 60000000

FEED = "(doc_id % 48 - doc_id % 16)"
TOPIC = "concat('Topic ', doc_id % 96 - doc_id % 16)"
TITLE = (
    "case when doc_id % 11 <> 4 then concat(case doc_id % 11 when 0 then 'Benchmark report '"
    " when 1 then 'Product launch ' when 2 then 'How to guide ' when 3 then 'Weekly news roundup '"
    " else '' end, substring(flat, 1, 60)) end"
)
SOURCE_TOPIC = "case lang when 'en' then 'AI' when 'fr' then 'Systems' when 'es' then 'Research' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_SPLITS: dict[str, int] = {}


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on.

    Text work is bound by cores, and one file with one row group is one task; such
    a table is spread over up to 64 tasks. A table with more splits than cores, as on
    a cluster, is read as it is.
    """
    rows = table(spark, sf_dir, name)
    cores = min(spark.sparkContext.defaultParallelism, 64)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SPLITS:
        _SPLITS[path] = rows.rdd.getNumPartitions()
    return rows.repartition(cores) if _SPLITS[path] < cores else rows


def at_minutes(base: int, expression: str) -> str:
    return f"timestamp_micros({base} + ({expression}) * {_MINUTE})"


def at_seconds(base: int, expression: str) -> str:
    return f"timestamp_micros({base} + ({expression}) * 1000000)"


def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir, "documents")
    # Space runs to one space; a single plain space is left where it is.
    runs = "(?: [ \t\r\n]|[\t\r\n])[ \t\r\n]*"
    return documents.withColumn("flat", F.regexp_replace("text", runs, " "))


# ------------------------------------------------------------------ items
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_documents(spark, sf_dir).selectExpr(
        "doc_id as item_id",
        "concat('a-', doc_id) as raw_asset_id",
        "doc_id % 16 as audience",
        "'article' as item_type",
        f"{TITLE} as title",
        "case when doc_id % 3 = 0 then concat('https://example.com/a/', doc_id % 150) end as canonical_url",
        "case when doc_id % 21 = 1 then concat('https://Example.com/a/', doc_id % 150) end"
        " as canonical_url_conflict",
        "case when doc_id % 7 = 2 then concat('author ', doc_id % 5) end as author",
        f"case when doc_id % 13 <> 5 then {at_minutes(_JAN_1, 'doc_id * 37')} end as published_at",
        f"{at_seconds(_FEB_1, 'doc_id')} as created_at",
        "lang as language",
        "text as content_text",
        "case when doc_id % 19 = 7 then 'new' else 'processed' end as status",
        "case when doc_id % 23 = 4 then doc_id - 1 end as duplicate_of_item_id",
        f"{TOPIC} as item_topic",
    )


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current version of every item, plus an older one for some."""
    labels = table(spark, sf_dir, "labels")
    documents = flat_documents(spark, sf_dir).join(labels, "doc_id", "left")
    versions = documents.withColumn(
        "v", F.expr("explode(case when doc_id % 6 = 2 then array(0, 1) else array(1) end)")
    )
    return versions.selectExpr(
        "doc_id as item_id",
        "v as version_id",
        "case when v = 0 then 0.5D when doc_id % 29 <> 6 then ((doc_id * 37) % 101) / 100.0D end"
        " as importance_score",
        "case when v = 0 then 0.5D else ((doc_id * 53) % 101) / 100.0D end as novelty_score",
        "case doc_id % 7 when 1 then null when 0 then 'Quick note' else substring(flat, 61, 140) end"
        " as summary_short",
        "case when doc_id % 4 = 1 then substring(flat, 201, 300) end as summary_long",
        "array(substring(flat, 1, 40), substring(flat, 41, 40), substring(flat, 81, 40)) as key_points",
        "case when doc_id % 10 <> 9 then array(concat('t', doc_id % 3), lang) end as tags",
        f"{TOPIC} as topic",
        "case doc_id % 5 when 0 then 'research' when 1 then 'tutorial' when 2 then 'news' else 'general' end"
        " as classification",
        "case when doc_id % 5 <> 0 then 'Useful background for the weekly topic review.' end as why_it_matters",
        "case when toxic = 1 then 'discard' when quality = 1 then 'keep' when quality = 0 then 'review' end"
        " as preserve_recommendation",
        "case doc_id % 9 when 4 then concat('  Draft about ', substring(flat, 1, 30), '  ')"
        " when 5 then '# Own heading\\n\\nSee [the source](https://example.com) for *more*.' end as note_draft",
        "v = 1 as is_current",
        f"{at_seconds(_FEB_1, 'doc_id + v * 86400')} as created_at",
    )


def raw_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset ids with their entry; one manual entry owns a fixed share."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('a-', doc_id) as raw_asset_id",
        f"case when doc_id % 17 = 3 then 'e-manual' else concat('e-', {FEED}, '-', lang) end"
        " as capture_entry_id",
    )


def capture_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            f"case when doc_id % 17 = 3 then 'e-manual' else concat('e-', {FEED}, '-', lang) end"
            " as capture_entry_id",
            f"case when doc_id % 17 <> 3 then concat('s-', {FEED}, '-', lang) end as source_id",
        )
        .distinct()
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            f"concat('s-', {FEED}, '-', lang) as source_id",
            f"concat('  feed ', {FEED}, ' ') as name",
            f"{SOURCE_TOPIC} as topic",
            "'rss' as source_type",
        )
        .distinct()
    )


def topic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = f"""case
        when doc_id % 8 = 0 then array({TOPIC}, 'Second topic')
        when doc_id % 8 = 4 then array()
        else array({TOPIC}) end"""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id as item_id", f"explode({tags}) as title")
    return rows.select("item_id", group_id(text.slugify(F.col("title"))).alias("group_id"), "title")


def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        topic_members(spark, sf_dir).select("group_id", "title").distinct().withColumn("group_type", F.lit("topic"))
    )


# ------------------------------------------------------------------ capture
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed batches with colliding ids and URLs; ``stored`` marks earlier captures."""
    numbered = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "cast((doc_id % 1024 - doc_id % 16) / 16 as bigint) as s",
        "doc_id - doc_id % 1024 as batch_id",
    )
    return numbered.selectExpr(
        "doc_id as row_id",
        "doc_id % 16 as source_id",
        "batch_id",
        "doc_id as pos",
        "s % 5 = 0 and s < 32 as stored",
        "case when doc_id % 10 <> 9 then concat('g', (s * s) % 41, '-', batch_id) end as external_id",
        "case when doc_id % 14 <> 13 then concat('https://example.com/p/', (s * 11 + s * s * 3) % 47,"
        " '-', batch_id) end as url",
        "case when doc_id % 7 <> 3 and doc_id % 16 <> 5 then "
        f"{at_minutes(_JAN_1, '(doc_id % 5) * 1440 + (batch_id div 1024) * 60')} end as published_at",
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url as submitted_url",
        "case when page_id % 11 = 6 then concat(url, '/moved') else url end as final_url",
        f"{at_seconds(_FEB_1, 'page_id')} as fetched_at",
        "case page_id % 11 when 1 then null when 2 then 302 when 3 then 301 when 4 then 404 when 5 then 500"
        " else 200 end as http_status",
        "case when page_id % 11 = 3 then url end as location",
        "cast(case page_id % 11 when 3 then 6 when 6 then 2 else 0 end as int) as redirect_count",
        "case page_id % 11 when 1 then null when 5 then 'application/json' when 7 then 'application/pdf'"
        " when 8 then null when 9 then 'application/xhtml+xml' else ' text/html;  charset=utf-8 ' end"
        " as content_type",
        "case page_id % 11 when 1 then null when 10 then '<html><body><script>1</script></body></html>'"
        " else html end as html",
    )


def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw assets with JSON metadata of many shapes; URLs folded to collide."""
    language = "case page_id % 4 when 0 then '\"  fr \"' when 1 then '7' when 2 then 'null' else '\"\"' end"
    meta = (
        f"concat('{{\"connectorType\":\"rss\",\"language\":', {language},"
        "',\"feed\":{\"language\":\"en\",\"title\":\"Feed ', page_id % 5, '\",\"siteUrl\":3},"
        "\"extractor\":\"x\",\"httpStatus\":', case when page_id % 3 = 0 then '\"200\"' else '200' end, '}')"
    )
    return texts(spark, sf_dir, "pages").selectExpr(
        "concat('p-', page_id) as raw_asset_id",
        "page_id",
        "concat('e-', page_id % 23) as capture_entry_id",
        "'article' as asset_type",
        "case when page_id % 2 = 0 then concat('x', page_id) end as external_id",
        "concat('Page ', page_id) as title",
        "cast(null as string) as author",
        "case when page_id % 29 <> 8 then regexp_extract(url, '^https?://[^/]+', 0) end as url",
        f"{at_minutes(_JAN_1, 'page_id')} as published_at",
        "case page_id % 31 when 3 then null when 4 then '  ' when 5 then concat('plain ', page_id) else html end"
        " as raw_content",
        f"{meta} as raw_metadata",
        "case when page_id % 17 = 5 then 'failed' else 'new' end as status",
        f"{at_seconds(_FEB_1, 'page_id * 7 % 101')} as created_at",
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 20 as source_id",
        "cast(ts as timestamp) as at",
        "event_id as seq",
        "event_type <> 'error' as ok",
        "case when event_type = 'error' then concat('fetch failed ', event_id, ' ',"
        " repeat('x', cast(event_id % 600 as int))) end as message",
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as command_id",
        "case when user_id % 50 = 7 then ' ' else concat('src-', user_id) end as source_id",
        "case event_type when 'signup' then 'register' when 'error' then 'delete' when 'click' then 'reactivate'"
        " else 'pause' end as action",
        "cast(ts as timestamp) as at",
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id as request_id",
        "case when page_id % 13 = 5 then '  ' else concat(' Feed ', page_id, ' ') end as name",
        "case page_id % 10 when 3 then concat('ftp://host', page_id, '/') when 7 then concat('no url ', page_id)"
        " when 1 then concat('  ', upper(regexp_extract(url, '^https?://[^/]+', 0)), ':443/ ') when 2 then ''"
        " else concat(regexp_extract(url, '^https?://[^/]+', 0), '#f', page_id) end as source_url",
        "case when page_id % 4 = 0 then ' ' else ' Topic ' end as topic",
        f"{at_seconds(_FEB_1, 'page_id * 7 % 101')} as requested_at",
    )


# ------------------------------------------------------------------ payloads
_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def rss_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RSS document per driver document: two entries, or one when id % 5 = 0."""
    body = _XML.format("text")
    head = _XML.format("substring(flat, 1, 50)")
    first = (
        f"concat('<item><title>', {head}, '</title><link> https://example.com/r/', doc_id, ' </link>',"
        " case when doc_id % 4 = 1 then '' else concat('<guid isPermaLink=\"false\">g', doc_id, '</guid>') end,"
        " case when doc_id % 3 = 0 then '<dc:creator>Ann</dc:creator><author>x</author>' when doc_id % 3 = 1"
        " then '<author>Bob</author>' else '' end,"
        " case when doc_id % 6 = 2 then '<pubDate>not a date</pubDate>' else concat('<pubDate>Sun, ',"
        " 1 + doc_id % 28, ' Apr 2026 10:30:00 GMT</pubDate>') end,"
        f" '<description><![CDATA[<p>', text, '</p>]]></description>',"
        " case when doc_id % 7 = 0 then '<content:encoded>full text</content:encoded>' else '' end, '</item>')"
    )
    second = (
        f"case when doc_id % 5 = 0 then '' else concat('<item><id>i', doc_id, '</id><description>', {body},"
        " '</description><isoDate>2026-04-14T03:00:00Z</isoDate></item>') end"
    )
    return flat_documents(spark, sf_dir).selectExpr(
        "doc_id as payload_id",
        "doc_id % 16 as source_id",
        "concat('<?xml version=\"1.0\"?><rss version=\"2.0\" xmlns:dc=\"http://purl.org/dc/elements/1.1/\""
        " xmlns:content=\"http://purl.org/rss/1.0/modules/content/\"><channel><title>Feed ', doc_id % 16,"
        f" '</title><link>https://example.com/</link><language>', lang, '</language>', {first}, {second},"
        " '</channel></rss>') as xml",
    )


def atom_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Atom document per driver document."""
    body = _XML.format("text")
    entry = (
        "concat('<entry>', case when doc_id % 4 = 1 then '' else concat('<id>urn:', doc_id, '</id>') end,"
        f" '<title type=\"html\">', {_XML.format('substring(flat, 1, 50)')}, '</title>',"
        " '<link rel=\"self\" href=\"https://example.com/self\"/>',"
        " case when doc_id % 3 = 0 then concat('<link rel=\"alternate\" href=\"https://example.com/t/', doc_id, '\"/>')"
        " when doc_id % 3 = 1 then concat('<link href=\"https://example.com/t/', doc_id, '\"/>') else '' end,"
        " case when doc_id % 2 = 0 then '<author><name> Eve </name></author>' else '' end,"
        " case when doc_id % 5 = 0 then '<updated>2026-04-14T03:00:00Z</updated>' else"
        " '<published>2026-04-12T10:30:00+02:00</published><updated>2026-04-14T03:00:00Z</updated>' end,"
        f" case when doc_id % 7 = 0 then concat('<summary>', {body}, '</summary>') else"
        f" concat('<content type=\"html\">', {body}, '</content>') end, '</entry>')"
    )
    return flat_documents(spark, sf_dir).selectExpr(
        "doc_id as payload_id",
        "doc_id % 16 as source_id",
        "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\" xml:lang=\"', lang, '\"><title>Atom ', doc_id % 16,"
        f" '</title><subtitle>Sub</subtitle><link href=\"https://example.com/home\"/>', {entry}, '</feed>') as xml",
    )


def mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of every outcome: RSS, Atom, other roots, cut off, no channel."""
    return texts(spark, sf_dir, "documents").selectExpr(
        "doc_id as payload_id",
        "doc_id % 16 as source_id",
        "case doc_id % 6"
        " when 0 then concat('<rss><channel><item><guid>g', doc_id, '</guid></item></channel></rss>')"
        " when 1 then concat('<feed><entry><id>e', doc_id, '</id></entry></feed>')"
        f" when 2 then concat('<html>', {_XML.format('text')}, '</html>')"
        f" when 3 then concat('<rss><channel><item><title>', {_XML.format('text')})"
        " when 4 then '<rss version=\"2.0\"></rss>'"
        " else text end as xml",
    )


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that state a date in each known place, by id; half state an older one, in a weaker place, first."""
    places = [
        f"<meta {key}=\"{value}\" content=\"2024-01-0{n + 1}T03:00:00Z\">" for n, (key, value) in enumerate(PUBLISHED_META)
    ]
    places += [
        "<time class=\"d\" datetime=\"2024-01-07T03:00:00Z\">",
        "<meta property=\"article:published_time\" content=\"no date\">",
    ]
    cases = " ".join(f"when {n} then '{place}'" for n, place in enumerate(places))
    older = "<meta name=\"timestamp\" content=\"2020-01-01T00:00:00Z\">"
    return texts(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"concat(if(page_id % 2 = 0, '{older}', ''), case page_id % {len(places) + 1} {cases} else '' end, html) as html",
    )


def _json_safe(value: str) -> str:
    return f"replace(replace(replace({value}, '\\\\', ' '), '\"', ' '), '\\n', ' ')"


def _json_text(value: str) -> str:
    return f"concat('\"', {_json_safe(value)}, '\"')"


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment outputs as JSON text, with a fault chosen by id."""
    f = "doc_id % 23"
    documents = flat_documents(spark, sf_dir).selectExpr("*", f"{TITLE} as title")
    short = _json_text("substring(flat, 61, 140)")
    title = _json_text("coalesce(title, 'x')")
    # What stands before the label is trimmed after quotes became spaces.
    head = f"btrim({_json_safe("coalesce(title, 'x')")}, '{V.SPACE_TEXT}')"
    summary = (
        f"case {f} when 1 then '\"text\"' when 2 then '{{\"short\":5,\"long\":null}}'"
        f" when 3 then '{{\"short\":\"  \",\"long\":null}}' when 4 then concat('{{\"short\":', {short}, ',\"long\":7}}')"
        f" when 20 then concat('{{\"short\":', {title}, ',\"long\":null}}')"
        f" when 21 then concat('{{\"short\":', {_json_text(f"concat(lower({head}), ' - more')")}, ',\"long\":null}}')"
        f" else concat('{{\"short\":', {short}, ',\"long\":', case when doc_id % 2 = 0 then 'null' else '\" Long. \"' end, '}}') end"
    )
    classification = (
        f"case {f} when 5 then 'null' when 6 then '{{\"topic\":null}}' when 7 then '{{\"label\":\"a\"}}'"
        " else '{\"label\":\" research \",\"topic\":\"AI\"}' end"
    )
    points = (
        f"case {f} when 8 then '[\"one\"]' when 9 then '[\"1\",\"2\",\"3\",\"4\",\"5\",\"6\"]' when 10 then"
        " '[\"a\",\"b\",3]' when 11 then '[\"a\",\" \",\"c\"]' when 12 then '\"a\"' else '[\" a\",\"b\",\"c\"]' end"
    )
    tags = f"case {f} when 13 then '[]' when 14 then '[1]' else '[\"x\",\"y\"]' end"
    importance = f"case {f} when 15 then '1.4' when 16 then '\"0.5\"' else cast((doc_id % 101) / 100.0D as string) end"
    return documents.selectExpr(
        "doc_id as item_id",
        "title",
        f"case {f} when 0 then '{{broken' when 22 then '[1]' else concat('{{\"summary\":', {summary},"
        f" ',\"key_points\":', {points}, ',\"classification\":', {classification}, ',\"tags\":', {tags},"
        f" ',\"importance_score\":', {importance}, ',\"novelty_score\":', case {f} when 17 then 'true' else '0.456' end,"
        f" ',\"why_it_matters\":', case {f} when 18 then 'null' else '\"It matters.\"' end,"
        f" ',\"preserve_recommendation\":', case {f} when 19 then '\"maybe\"' else '\"keep\"' end,"
        " case when doc_id % 46 = 30 then '' else ',\"note_draft\":null' end, '}') end as output_json",
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns wrapped in every known response shape."""
    body = _json_text("text")
    return texts(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        f"case (conv_id + turn) % 7 when 0 then concat('{{\"choices\":[{{\"message\":{{\"content\":', {body}, '}}}}]}}')"
        " when 1 then concat('{\"choices\":[{\"message\":{\"content\":[{\"type\":\"image\",\"text\":\"no\"},"
        f"{{\"type\":\"text\",\"text\":\" \"}},{{\"type\":\"output_text\",\"text\":', {body}, '}}]}}}}]}}')"
        f" when 2 then concat('{{\"output_text\":', {body}, '}}')"
        f" when 3 then concat('{{\"output\":[{{}},{{\"content\":[{{\"type\":\"text\",\"text\":', {body}, '}}]}}]}}')"
        " when 4 then '{\"choices\":[]}' when 5 then '{bad'"
        " else '{\"choices\":[{\"message\":{\"content\":5}}]}' end as response",
    )


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of the regions; one is switched off."""
    return table(spark, sf_dir, "region").selectExpr(
        "concat('d', r_regionkey) as destination_id",
        "'notion' as destination_type",
        "r_name as name",
        "concat('notion://', lower(replace(r_name, ' ', '-'))) as target_ref",
        "case when r_regionkey = 1 then 'disabled' else 'active' end as status",
    )
