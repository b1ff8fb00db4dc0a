"""Keys: hashes, fingerprints, addresses, situation keys and IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.functions.text import dash_slug, underscore_slug

UNKNOWN_MONTH = "unknown"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def snippet_id(link: Column, term: Column, start: Column) -> Column:
    """Twelve hex digits of the SHA-1 of link, term and start."""
    joined = F.concat_ws("|", link, term, start.cast("string"))
    return F.concat(F.lit("snippet:"), F.substring(F.sha1(joined), 1, 12))


def source_row_id(reference: Column, row_number: Column) -> Column:
    return F.substring(F.sha1(F.concat(reference, row_number.cast("string"))), 1, 12)


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, in alphabetical order, nulls kept."""
    struct = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_of_text(c: Column) -> Column:
    """First seven characters if they look like a month."""
    return F.when((F.length(c) >= 7) & (F.substring(c, 5, 1) == "-"), F.substring(c, 1, 7))


def split_context(disease: Column) -> tuple[Column, Column]:
    """(disease, animal context) of a label such as ``A.S.F. in wild boar``."""
    pattern = "^(.+?) in (.+)$"
    context = F.nullif(F.regexp_extract(disease, pattern, 2), F.lit(""))
    base = F.when(context.isNotNull(), F.regexp_extract(disease, pattern, 1)).otherwise(disease)
    return base, context


def situation_key(disease: Column, country: Column, month: Column, version: str = "0.1.1") -> Column:
    """``disease|country|month``: what events and narrative statements meet on.

    Version 0.1.1 slugs the whole disease label; 0.1.2 drops its animal context first.
    """
    base = disease if version == "0.1.1" else split_context(disease)[0]
    return F.concat(
        dash_slug(base),
        F.lit("|"),
        dash_slug(country),
        F.lit("|"),
        F.coalesce(month, F.lit(UNKNOWN_MONTH)),
    )


def report_situation_key(disease: Column, country: Column, month: Column) -> Column:
    """Key of a report, null unless all three parts are known."""
    known = disease.isNotNull() & country.isNotNull() & month.isNotNull()
    return F.when(known, situation_key(disease, country, month))


def iri(kind: str, local: Column) -> Column:
    return F.concat(F.lit(f"ts:{kind}_"), local)


def local_name(c: Column) -> Column:
    return F.regexp_replace(c, "^(?:ts:)?[a-z]+_", "")


def concept_iri(kind: str, label: Column) -> Column:
    return iri(kind, underscore_slug(label))


def last_path_segment(url: Column) -> Column:
    path = F.rtrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    return F.element_at(F.split(path, "/"), -1)


def report_id(source_id: Column, raw_path: Column, link: Column) -> Column:
    """Source and the stem of the raw file for API sources, or the last path segment."""
    stem = F.nullif(F.regexp_extract(raw_path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit(""))
    own = F.when((source_id == "padi_web") & stem.isNotNull(), stem)
    return F.concat(source_id, F.lit(":"), F.coalesce(own, last_path_segment(link), F.lit("")))


def url_path(url: Column) -> Column:
    """Path of an address, blank if it has none."""
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def cache_file_name(url: Column, ext: str = "html") -> Column:
    """Last path segment, every character but letters, digits, ``-`` and ``_`` a dash, cut to
    120, then a dash and 12 hex digits of the address."""
    segment = F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "[^/]*$", 0)
    slug = F.substring(F.regexp_replace(segment, r"[^\p{L}\p{N}_-]", "-"), 1, 120)
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(url, 256), 1, 12), F.lit(f".{ext}"))


def query_file_name(url: Column, text: Column) -> Column:
    """``filename`` of the query string, or the text with other characters as underscores."""
    named = F.try_parse_url(url, F.lit("QUERY"), F.lit("filename"))
    return F.coalesce(named, F.regexp_replace(text, r"[^\w.-]+", "_"))


def allowed_url(url: Column, host: str, path_prefix: str, https_only: bool = False) -> Column:
    """Whether an address is of exactly the host (with its port, if any) and below the path."""
    place = F.regexp_extract(url, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)
    ok = (place == host) & F.startswith(url_path(url), F.lit(path_prefix))
    if https_only:
        ok = ok & (F.lower(F.regexp_extract(url, r"^([^:/?#]+):", 1)) == "https")
    return F.coalesce(ok, F.lit(False))
