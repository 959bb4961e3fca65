"""Title functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words by which titles are classified, in order of precedence, and what is stripped from titles.
RELEASE_WORDS = ("release", "launches", "launch", "v1.", "v2.", "v3.", "version", "ships", "shipped")
TYPE_WORDS = (
    ("release", RELEASE_WORDS),
    ("research", ("paper", "arxiv", "study", "survey", "benchmark")),
    ("opinion", ("opinion", "editorial", "why ", "how ", "thoughts on")),
    ("tutorial", ("tutorial", "guide", "how to", "howto", "step by step")),
)
INJECTIONS = (r"(?iU)ignore\s+previous", r"(?iU)system\s*:", r"(?iU)\b(user|assistant|human|ai)\s*:", r"!\[")
TITLE_LENGTH = 500


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_base64_blob(text: Column) -> Column:
    """Whether a run of 30 or more base64 characters holds upper and lower case and digits."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9+/=]{30,})"), F.lit(1))
    return F.exists(runs, lambda r: r.rlike("[A-Z]") & r.rlike("[a-z]") & r.rlike("[0-9]"))


def sanitize_title(title: Column) -> Column:
    """Without NULs, phrases that address a model, image marks and (if there is a blob) base64 runs; spaces collapsed."""
    text = F.replace(title, F.lit("\x00"), F.lit(""))
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, "")
    text = F.when(has_base64_blob(text), F.regexp_replace(text, r"[A-Za-z0-9+/]{30,}={0,2}", "")).otherwise(text)
    return _strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def stored_title(title: Column) -> Column:
    return F.substring(sanitize_title(title), 1, TITLE_LENGTH)


def normalize_title(title: Column) -> Column:
    """For comparison: without a leading "ask hn:" and the like and closing brackets, lower case, single spaces."""
    text = F.regexp_replace(_strip(title), r"(?iU)^(ask hn|show hn|tell hn)\s*:\s*", "")
    text = F.regexp_replace(text, r"(?U)(\s*[\[(][^\])]*[\])]\s*)+$", "")
    return _strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def without_outlet(title: Column) -> Column:
    """Without one closing " - Outlet", " | Outlet" or " — Outlet" of at most four words."""
    return F.regexp_replace(title, r"(?U)\s+[-|–—]\s+[^\s|–—]+(\s+[^\s|–—-]+){0,3}\s*$", "")


def number_tokens(normal: Column) -> Column:
    """Sorted distinct numbers and versions; titles whose tokens differ are never one story."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normal, F.lit(r"(?U)(\d+(?:\.\d+)*)"), F.lit(1))))


def word_count(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.size(F.split(normal, " ")))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def is_release(title: Column) -> Column:
    return contains_any(F.lower(title), RELEASE_WORDS)


def story_type(title: Column) -> Column:
    """The first type one of whose words the title holds, else news."""
    kinds = F
    for name, words in TYPE_WORDS:
        kinds = kinds.when(contains_any(F.lower(title), words), name)
    return kinds.otherwise("news")


def sanitize_text(text: Column) -> Column:
    """Without control characters other than tab and line feed, 500 characters at most."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", ""), 1, TITLE_LENGTH)
