"""Feed payloads (RSS 2.0 and Atom) to asset rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import dates, text
from gleanery.functions.staging import with_once

_TEXT = "struct<_VALUE:string>"
_LINK = "struct<_VALUE:string,_rel:string,_href:string,_url:string>"

RSS_SCHEMA = (
    "channel struct<title:{t},description:{t},generator:{t},language:{t},link:array<{l}>,"
    "item:array<struct<_VALUE:string,title:{t},link:{l},guid:{t},id:{t},`dc:creator`:{t},author:{t},"
    "creator:{t},pubDate:{t},isoDate:{t},published:{t},updated:{t},`content:encoded`:{t},"
    "description:{t},content:{t}>>>"
).format(t=_TEXT, l=_LINK)

ATOM_SCHEMA = (
    "title {t}, subtitle {t}, generator {t}, `_xml:lang` string, link array<{l}>, "
    "entry array<struct<_VALUE:string,id:{t},title:{t},link:array<{l}>,author:struct<_VALUE:string,name:{t}>,"
    "published:{t},updated:{t},content:{t},summary:{t}>>"
).format(t=_TEXT, l=_LINK)

XML_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def _text(node: Column) -> Column:
    return text.blank_to_null(node["_VALUE"])


def _url(link: Column) -> Column:
    """URL of an RSS link: its href, url or text."""
    return text.first_present(link["_href"], link["_url"], link["_VALUE"])


def _atom_link(links: Column) -> Column:
    """First alternate (or unmarked) href, or plain link text met before it."""
    def target(link: Column) -> Column:
        plain = link["_href"].isNull() & link["_rel"].isNull()
        usable = (link["_rel"] == "alternate") | link["_rel"].isNull() | (link["_rel"] == "")
        return F.when(plain, text.blank_to_null(link["_VALUE"])).when(
            usable, text.blank_to_null(link["_href"])
        )

    targets = F.filter(F.transform(links, target), lambda found: found.isNotNull())
    return F.get(targets, F.lit(0))


def _is_record(item: Column, schema_fields: list[str]) -> Column:
    """An element with at least one known child; bare text is no item."""
    return reduce(lambda a, b: a | b, [item[name].isNotNull() for name in schema_fields])


def feed_root(xml: Column) -> Column:
    """Local name of the root element, null if there is none."""
    lead = r"(?s)\A(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z_][\w.\-]*)"
    return F.nullif(F.regexp_extract(xml, lead, 1), F.lit(""))


def classify_payloads(payloads: DataFrame) -> DataFrame:
    """Parse once; add the parsed documents and ``error`` (null when usable).

    ``payloads``: payload_id, source_id, source_url, xml.
    """
    root = F.col("_root")
    parsed = with_once(payloads, _root=feed_root(F.col("xml")))
    parsed = parsed.withColumn("feed_kind", F.when(root == "rss", "rss").when(root == "feed", "atom"))
    parsed = with_once(
        parsed,
        _rss=F.when(F.col("feed_kind") == "rss", F.from_xml("xml", RSS_SCHEMA, XML_OPTIONS)),
        _atom=F.when(F.col("feed_kind") == "atom", F.from_xml("xml", ATOM_SCHEMA, XML_OPTIONS)),
    )
    closed = F.col("xml").rlike(
        r"(?s)</(rss|feed)\s*>\s*(<!--.*?-->\s*)*\z|<(rss|feed)\b[^>]*/>\s*\z"
    )
    no_channel = (F.col("feed_kind") == "rss") & F.col("_rss.channel").isNull()
    problem = (
        F.when(root.isNull(), "RSS parsing returned no document")
        .when(F.col("feed_kind").isNull(), "Unsupported RSS document shape")
        .when(~closed, "RSS parsing failed")
        .when(no_channel, "RSS channel is missing")
    )
    error = F.concat(problem, F.lit(" for source "), F.col("source_id").cast("string"), F.lit("."))
    return with_once(parsed, error=error).drop("_root")


def _fields(classified: DataFrame, *path: str) -> list[str]:
    """Child elements an item of the parsed document may have."""
    kind = classified.schema[path[0]].dataType
    for name in path[1:]:
        kind = kind[name].dataType
    return [field.name for field in kind.elementType.fields if field.name != "_VALUE"]


def _rss_entry(names: list[str]):
    def entry(item: Column, pos: Column) -> Column:
        url = _url(item["link"])
        return F.struct(
            pos.cast("int").alias("pos"),
            _is_record(item, names).alias("known"),
            F.coalesce(_text(item["guid"]), _text(item["id"]), url).alias("external_id"),
            _text(item["title"]).alias("title"),
            F.coalesce(*[_text(item[name]) for name in ("dc:creator", "author", "creator")]).alias("author"),
            url.alias("url"),
            F.coalesce(*[_text(item[name]) for name in ("pubDate", "isoDate", "published", "updated")]).alias("stated"),
            F.coalesce(*[_text(item[name]) for name in ("content:encoded", "description", "content")]).alias("raw_content"),
            F.to_json(item).alias("raw_item"),
        )

    return entry


def _atom_entry(names: list[str]):
    def entry(item: Column, pos: Column) -> Column:
        url = _atom_link(item["link"])
        return F.struct(
            pos.cast("int").alias("pos"),
            _is_record(item, names).alias("known"),
            F.coalesce(_text(item["id"]), url).alias("external_id"),
            _text(item["title"]).alias("title"),
            F.coalesce(_text(item["author"]["name"]), text.blank_to_null(item["author"]["_VALUE"])).alias("author"),
            url.alias("url"),
            F.coalesce(_text(item["published"]), _text(item["updated"])).alias("stated"),
            F.coalesce(_text(item["content"]), _text(item["summary"])).alias("raw_content"),
            F.to_json(item).alias("raw_item"),
        )

    return entry


def feed_rows(payloads: DataFrame) -> DataFrame:
    """Assets of all usable payloads in document order, and quarantined payloads, in one pass.

    Entries of either shape become one array of equal structs inside the payload's
    row, which is exploded once. An asset has no ``error``; a quarantined payload
    is one row with ``error`` and without a position.
    """
    classified = classify_payloads(payloads)
    channel, doc = F.col("_rss.channel"), F.col("_atom")
    rss_feed = F.struct(
        _text(channel["title"]).alias("title"),
        _text(channel["description"]).alias("description"),
        F.get(F.filter(F.transform(channel["link"], _url), lambda u: u.isNotNull()), F.lit(0)).alias("site_url"),
        _text(channel["generator"]).alias("generator"),
        _text(channel["language"]).alias("language"),
    )
    atom_feed = F.struct(
        _text(doc["title"]).alias("title"),
        _text(doc["subtitle"]).alias("description"),
        _atom_link(doc["link"]).alias("site_url"),
        _text(doc["generator"]).alias("generator"),
        text.blank_to_null(doc["_xml:lang"]).alias("language"),
    )
    rss = F.transform(channel["item"], _rss_entry(_fields(classified, "_rss", "channel", "item")))
    atom = F.transform(doc["entry"], _atom_entry(_fields(classified, "_atom", "entry")))
    is_rss = F.col("feed_kind") == "rss"
    entries = F.when(F.col("error").isNull(), F.when(is_rss, rss).otherwise(atom))
    rows = classified.select(
        "payload_id", "source_id", "feed_kind", "error",
        F.when(F.col("error").isNull(), F.when(is_rss, rss_feed).otherwise(atom_feed)).alias("feed"),
        F.explode_outer(F.filter(entries, lambda e: e["known"])).alias("e"),
    )
    return rows.where("error is not null or e is not null").select(
        "payload_id", "source_id", "feed_kind", "e.pos", "e.external_id", "e.title", "e.author", "e.url",
        dates.parse_date(F.col("e.stated")).alias("published_at"), "e.raw_content", "feed", "e.raw_item", "error",
    )


def feed_assets(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets of all usable payloads, quarantined payloads with their error).

    Each of the two is a pass over the payloads; store ``feed_rows`` to use both.
    """
    return split_rows(feed_rows(payloads))


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and quarantined payloads of ``feed_rows``."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("payload_id", "source_id", "error")


def asset_metadata() -> Column:
    """Raw metadata text kept with a feed asset (feed_assets joined to payloads)."""
    return F.to_json(
        F.struct(
            F.lit("rss").alias("connectorType"),
            dates.iso_utc(F.col("requested_at")).alias("fetchedAt"),
            F.struct(
                F.col("feed.title").alias("title"),
                F.col("feed.description").alias("description"),
                F.col("feed.site_url").alias("siteUrl"),
                F.col("feed.generator").alias("generator"),
                F.col("feed.language").alias("language"),
            ).alias("feed"),
            F.col("final_url").alias("finalUrl"),
            F.col("source_url").alias("sourceUrl"),
        )
    )
