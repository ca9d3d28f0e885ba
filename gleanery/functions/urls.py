"""URL validation and normalization expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions import text

_WEB = r"(?i)^(https?):[\\/]*([^\\/?#]*)([^?#]*)(\?[^#]*)?"
_HOST = r"^(?:[^@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|]+)(?::[0-9]{0,5})?$"


def _resolve_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of a path that starts with a slash."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(
            part == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        )
        .when(part == ".", acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    open_end = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.concat(F.lit("/"), F.array_join(open_end, "/"))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), joined).otherwise(path)


def _escape(part: Column) -> Column:
    for raw, coded in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E")):
        part = F.replace(part, F.lit(raw), F.lit(coded))
    return part


def normalize(url: Column) -> Column:
    """Web URL without fragment, lower-case scheme and host; null if unusable."""
    trimmed = F.regexp_replace(text.strip(url), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(trimmed, _WEB, 1))
    authority = F.regexp_extract(trimmed, _WEB, 2)
    path = F.replace(F.regexp_extract(trimmed, _WEB, 3), F.lit("\\"), F.lit("/"))
    query = F.regexp_extract(trimmed, _WEB, 4)

    user = F.regexp_extract(authority, r"^(.*@)?", 0)
    host_port = F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))
    default_port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host_port = F.regexp_replace(host_port, ":$", "")
    host_port = F.when(
        F.endswith(host_port, default_port),
        F.substring(host_port, F.lit(1), F.length(host_port) - F.length(default_port)),
    ).otherwise(host_port)
    port = F.regexp_extract(host_port, r":([0-9]+)$", 1).try_cast("int")
    rooted = F.when(path == "", F.lit("/")).otherwise(path)

    usable = (scheme != "") & authority.rlike(_HOST) & (F.coalesce(port, F.lit(0)) <= 65535)
    query = F.when(query == "?", F.lit("?")).otherwise(_escape(query))
    return F.when(
        usable,
        F.concat(scheme, F.lit("://"), user, host_port, _escape(_resolve_dots(rooted)), query),
    )


def problem(url: Column, invalid: str, wrong_scheme: str) -> Column:
    """Why a URL is rejected, or null."""
    trimmed = text.strip(F.coalesce(url, F.lit("")))
    other_scheme = trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:.+") & ~trimmed.rlike("(?i)^https?:")
    return F.when(other_scheme, F.lit(wrong_scheme)).when(normalize(url).isNull(), F.lit(invalid))
