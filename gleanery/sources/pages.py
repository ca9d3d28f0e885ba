"""Captured web pages: fetch outcomes, article region, publishing date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery import fixed_values as V
from gleanery.functions import dates, text
from gleanery.functions.staging import with_once

# Where pages state their publishing date, best first.
PUBLISHED_META = (
    ("property", "article:published_time"),
    ("name", "article:published_time"),
    ("name", "pubdate"),
    ("name", "publishdate"),
    ("name", "timestamp"),
    ("property", "og:article:published_time"),
)
_NOISE = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "nav", "aside"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag's text, collapsed; null if blank."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']$""", "")
    return F.nullif(text.collapse(text.decode_entities(value)), F.lit(""))


def with_tags(pages: DataFrame) -> DataFrame:
    """Pages with their meta tags and first dated time tag, found in one pass each."""
    return with_once(
        pages,
        _meta=F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
        _time=F.regexp_extract("html", r"(?is)<time\b[^>]*\sdatetime\s*=[^>]*>", 0),
    )


def meta_content(key: str, value: str) -> Column:
    """Content of the first meta tag whose ``key`` is ``value``."""
    pattern = rf"""(?is)\s{key}\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s/>]))"""
    tag = F.get(F.filter("_meta", lambda tag: tag.rlike(pattern)), F.lit(0))
    return attribute(F.coalesce(tag, F.lit("")), "content")


def _with_date(tagged: DataFrame) -> DataFrame:
    stated = [meta_content(key, value) for key, value in PUBLISHED_META]
    found = with_once(tagged, _stated=F.coalesce(*stated, attribute(F.col("_time"), "datetime")))
    return found.withColumn("published_at", dates.parse_date(F.col("_stated"))).drop("_stated")


def with_published_at(pages: DataFrame) -> DataFrame:
    """Publishing date; the first stated value decides, a bad one gives null."""
    return _with_date(with_tags(pages)).drop("_meta", "_time")


def article_html(html: Column) -> Column:
    """Main region without scripts, styles, navigation, asides and comments."""
    cleaned = F.regexp_replace(html, f"(?is){_NOISE}|<!--.*?-->", " ")
    regions = [F.regexp_extract(cleaned, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1) for tag in ("article", "main", "body")]
    bare = F.regexp_replace(cleaned, r"(?is)<head\b.*?</head\s*>", " ")
    return F.coalesce(*[F.nullif(region, F.lit("")) for region in regions], bare)


def is_html(content_type: Column) -> Column:
    found = F.contains(content_type, F.lit("text/html")) | F.contains(
        content_type, F.lit("application/xhtml+xml")
    )
    return F.coalesce(found, F.lit(False))


def is_text(content_type: Column) -> Column:
    return F.coalesce(F.startswith(content_type, F.lit("text/")), F.lit(False))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Add article columns to pages with an ``html`` column.

    In steps with a boundary between them, so that no step's code grows too large
    to compile and every scan of the page happens once.
    """
    html = F.col("html")
    region = with_once(
        with_tags(pages),
        content_html=article_html(html),
        _title=F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1),
        _root=F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0),
    )

    def clean(value: Column) -> Column:
        return F.nullif(text.collapse(text.decode_entities(value)), F.lit(""))

    first_paragraph = F.regexp_extract(F.col("content_html"), r"(?is)<p\b[^>]*>(.*?)</p\s*>", 1)
    described = with_once(
        region,
        content_text=text.collapse(text.html_to_text(F.col("content_html"))),
        title=clean(F.col("_title")),
        author=meta_content("name", "author"),
        language=attribute(F.col("_root"), "lang"),
        site_name=meta_content("property", "og:site_name"),
        excerpt=F.coalesce(
            meta_content("name", "description"), clean(F.regexp_replace(first_paragraph, "<[^>]+>", " "))
        ),
    )
    return (
        _with_date(described)
        .withColumn("has_content", text.is_present(F.col("content_text")))
        .drop("_meta", "_time", "_title", "_root")
    )


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """Classify a fetch log and extract the articles of good fetches.

    ``fetches``: submitted_url, final_url, fetched_at, http_status (null when
    the network failed), location, redirect_count, content_type, html (body).
    """
    status = F.coalesce("http_status", F.lit(0))
    extracted = extract_articles(fetches)
    redirect = status.between(300, 399)
    code = (
        F.when(status == 0, "network_error")
        .when(redirect & F.col("location").isNull(), "invalid_redirect")
        .when(redirect & (F.col("redirect_count") > V.MAX_REDIRECTS), "redirect_limit_exceeded")
        .when(redirect, F.lit(None).cast("string"))
        .when(~status.between(200, 299), "response_error")
        .when(~is_html(F.col("content_type")), "non_html_response")
        .when(~F.col("has_content"), "extract_failed")
    )
    staged = extracted.withColumn("code", code).withColumn(
        "outcome",
        F.when(F.col("code").isNotNull(), "failed").when(redirect, "redirect").otherwise("succeeded"),
    )
    url = F.col("submitted_url")
    # fixed values: the texts below must be these, in this order
    message = (
        F.when(F.col("code") == "network_error", F.concat(F.lit("URL fetch failed for "), url, F.lit(".")))
        .when(
            F.col("code") == "invalid_redirect",
            F.concat(
                F.lit("URL redirect response from "), "final_url", F.lit(" did not include a location header.")
            ),
        )
        .when(F.col("code") == "redirect_limit_exceeded", f"URL fetch exceeded {V.MAX_REDIRECTS} redirects.")
        .when(
            F.col("code") == "response_error",
            F.concat(F.lit("URL fetch failed for "), url, F.lit(" with status "), status.cast("string"), F.lit(".")),
        )
        .when(
            F.col("code") == "non_html_response",
            F.concat(
                F.lit("URL ingest expected HTML but received "),
                F.coalesce("content_type", F.lit("an unknown content type")),
                F.lit("."),
            ),
        )
        .when(F.col("code") == "extract_failed", "URL ingest could not extract article-like content.")
    )
    body = F.nullif(F.col("html"), F.lit(""))
    readable = is_html(F.col("content_type")) | is_text(F.col("content_type"))
    failed_body = F.when(F.col("code") == "extract_failed", body).when(
        (F.col("code") == "response_error") & readable, body
    )
    return (
        staged.withColumn("message", message)
        .withColumn("failed_body", failed_body)
        .withColumn("capture", capture_record())
    )


def capture_record() -> Column:
    """Metadata record of one capture."""
    return F.struct(
        F.nullif(text.collapse(F.col("content_type")), F.lit("")).alias("contentType"),
        F.lit(V.EXTRACTOR_NAME).alias("extractor"),
        F.lit(V.EXTRACTOR_VERSION).alias("extractorVersion"),
        F.when(F.col("outcome") == "succeeded", "succeeded").otherwise("failed").alias("extractionStatus"),
        dates.iso_utc(F.col("fetched_at")).alias("fetchTimestamp"),
        F.col("final_url").alias("finalUrl"),
        F.coalesce("http_status", F.lit(0)).alias("httpStatus"),
        F.col("redirect_count").alias("redirectCount"),
        F.col("submitted_url").alias("submittedUrl"),
        F.lit(V.FETCH_TIMEOUT_MS).alias("timeoutMs"),
        F.lit(V.USER_AGENT).alias("userAgent"),
    )


def page_assets(outcomes: DataFrame) -> DataFrame:
    """Raw assets of a classified fetch log.

    Good fetches give an article. A failed fetch with a body is kept as a
    failed asset; one without a body gives no asset.
    """
    common = [F.col("capture.*"), F.lit("submitted_url").alias("connectorType")]
    good = [F.length("content_text").alias("contentTextLength"), "excerpt", "language", F.col("site_name").alias("siteName")]
    bad = ["code", F.struct(F.col("capture.fetchTimestamp").alias("failedAt"), "message").alias("failure")]
    succeeded = F.col("outcome") == "succeeded"
    kept = outcomes.where(succeeded | F.col("failed_body").isNotNull())

    def when_good(value: Column) -> Column:
        return F.when(succeeded, value)

    return kept.select(
        F.sha2(F.concat_ws("|", F.lit("page"), "submitted_url", F.col("capture.fetchTimestamp")), 256).alias(
            "raw_asset_id"
        ),
        F.sha2(F.concat_ws("|", F.lit("entry"), "submitted_url", F.col("capture.fetchTimestamp")), 256).alias(
            "capture_entry_id"
        ),
        F.when(succeeded, "article").otherwise("url").alias("asset_type"),
        F.lit(None).cast("string").alias("external_id"),
        when_good(F.col("title")).alias("title"),
        when_good(F.col("author")).alias("author"),
        F.coalesce("final_url", "submitted_url").alias("url"),
        when_good(F.col("published_at")).alias("published_at"),
        F.when(succeeded, F.col("content_html")).otherwise(F.col("failed_body")).alias("raw_content"),
        F.when(succeeded, F.to_json(F.struct(*common, *good)))
        .otherwise(F.to_json(F.struct(*common, *bad)))
        .alias("raw_metadata"),
        F.when(succeeded, "new").otherwise("failed").alias("status"),
    )
