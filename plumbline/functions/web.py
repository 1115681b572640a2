"""URL policy, redaction and catalogue name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import strip


def redact_secrets(text: Column) -> Column:
    """Blank credential values in any URL inside a text."""
    return F.regexp_replace(text, f"(?i)([?&](?:{vocab.SECRET_PARAMS})=)[^&\\s'\"]*", "$1REDACTED")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(url), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(url: Column) -> Column:
    """Host without user name and port, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(strip(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:@]*)", 1))


def off_portal(host: Column, portal: str) -> Column:
    return ~((host == portal) | host.endswith("." + portal))


def url_verdict(url: Column, portal: str, allow_http: bool, allow_off_portal: bool) -> Column:
    """``ok`` or the first policy rule a URL breaks."""
    scheme, host = url_scheme(url), url_host(url)
    return (
        F.when(url.isNull() | (strip(url) == ""), F.lit("no_url"))
        .when(~scheme.isin("http", "https"), F.lit("scheme"))
        .when(host == "", F.lit("no_host"))
        .when((scheme == "http") & F.lit(not allow_http), F.lit("plain_http"))
        .when(off_portal(host, portal) & F.lit(not allow_off_portal), F.lit("off_portal"))
        .otherwise(F.lit("ok"))
    )


def publisher_kind(name: Column, patterns=vocab.PUBLISHER_PATTERNS, default=vocab.PUBLISHER_DEFAULT) -> Column:
    out = F.lit(default)
    for kind, pattern in reversed(patterns):
        out = F.when(F.coalesce(name, F.lit("")).rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def theme_code(uri: Column) -> Column:
    """Last path segment of a theme URI; null when empty."""
    code = strip(F.regexp_extract(uri, "([^/]*)/*$", 1))
    return F.when(code != "", code)


def theme_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.THEME_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def dataset_link(base_url: str, dataset_id: Column) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/dataset/"), dataset_id)
