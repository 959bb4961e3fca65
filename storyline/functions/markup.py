"""Escaping, labels and small text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is escaped in Markdown text and in link targets, and keys that logs must not show.
MARKDOWN = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", r"\["), ("]", r"\]"), ("(", r"\("), (")", r"\)"))
LINK = ((")", "%29"), ("<", "%3C"), (">", "%3E"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ('"', "%22"), ("'", "%27"))
KEYS = r"((?:sk|tvly)-[A-Za-z0-9_-]{10})[A-Za-z0-9_-]*"


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_markdown(text: Column) -> Column:
    return _replaced(text, MARKDOWN)


def escape_link(url: Column) -> Column:
    return _replaced(url, LINK)


def badge(score: Column) -> Column:
    """Two decimals, half to even on the exact double."""
    return F.replace(F.format_number(score, 2), F.lit(","), F.lit(""))


def sources_label(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " source").otherwise(" sources"))


def heading(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def iso_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def redact_keys(text: Column) -> Column:
    return F.regexp_replace(text, KEYS, "$1**REDACTED**")


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()
