"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query keys that only track, for either generation of rules, and hosts that mirror papers.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_cid", "utm_reader", "utm_name",
    "utm_social", "utm_social-type", "fbclid", "gclid", "gclsrc", "ref", "source",
)
LEGACY_TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "utm_reader", "utm_brand", "utm_cid",
    "ref", "ref_src", "ref_url", "fbclid", "gclid", "gclsrc", "dclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "mkt_tok", "igshid",
)
PAPER_HOSTS = ("arxiv.org", "tldr.takara.ai")

#: RFC 3986, appendix B: scheme 2, authority 4, path 5, query 7, fragment 9.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#([\s\S]*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def _host_and_port(url: Column) -> tuple[Column, Column]:
    server = F.regexp_replace(part(url, 4), r"^.*@", "")
    bracketed = server.startswith("[")
    host = F.when(bracketed, F.regexp_extract(server, r"^\[([^\]]*)\]?", 1)).otherwise(F.substring_index(server, ":", 1))
    port = F.when(bracketed, F.regexp_extract(server, r"\]:?(.*)$", 1)).otherwise(F.regexp_extract(server, r"^[^:]*:(.*)$", 1))
    return F.lower(host), port


def host(url: Column) -> Column:
    """Lower-cased host name, without user or port; brackets of an address are dropped."""
    return _host_and_port(url)[0]


def _decode_unreserved(path: Column) -> Column:
    """%XX of letters, digits and -._~ decoded; all other escapes stay as they are."""

    def tail(piece: Column) -> Column:
        code = F.substring(piece, 1, 2)
        char = F.char(F.conv(code, 16, 10).cast("int"))
        return F.when(code.rlike("^[0-9A-Fa-f]{2}$") & char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, F.substring(piece, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), piece))

    pieces = F.split(path, "%", -1)
    decoded = F.array_join(F.transform(pieces, lambda p, k: F.when(k == 0, p).otherwise(tail(p))), "")
    return F.when(path.contains("%"), decoded).otherwise(path)


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query_pairs(query: Column) -> Column:
    """Array of (key, place, value), decoded, in order of appearance."""
    items = F.filter(F.split(query, "&", -1), lambda x: x != "")
    return F.transform(
        items,
        lambda x, k: F.struct(
            _decoded(F.substring_index(x, "=", 1)).alias("key"), k.alias("place"), _decoded(F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1)).alias("value")
        ),
    )


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")


def canonical_url(url: Column) -> Column:
    """The form under which articles are one; null where the port is no port number.

    https always; host lower-cased without user, leading ``www.`` and default
    ports; path with unreserved characters decoded, without parameters of the
    last segment and closing slashes; tracking keys dropped, the others sorted
    (values of one key keep their order); fragment only if it starts with ``!``.
    """
    name, port = _host_and_port(url)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    bad = (port != "") & (number.isNull() | (number > 65535))
    server = F.concat(F.regexp_replace(name, r"^www\.", ""), F.when(number.isNull() | number.isin(80, 443), "").otherwise(F.concat(F.lit(":"), number.cast("string"))))
    path = _decode_unreserved(F.regexp_replace(part(url, 5), r";[^/]*$", ""))
    path = F.when(path == "", "/").when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.array_sort(F.filter(_query_pairs(part(url, 7)), lambda p: ~F.lower(p["key"]).isin(*TRACKING)))
    query = _joined(kept)
    fragment = part(url, 9)
    return F.when(
        ~bad,
        F.concat(
            F.lit("https://"), server, path,
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
            F.when(fragment.startswith("!"), F.concat(F.lit("#"), fragment)).otherwise(""),
        ),
    )


def legacy_url(url: Column) -> Column:
    """The older form: empty unless http(s), then https; tracking keys and any ``utm_`` key dropped, first
    value of a key kept, keys sorted; closing slashes (but not a lone one) and fragment dropped; host,
    port, user and parameters as they are.
    """
    pairs = F.filter(_query_pairs(part(url, 7)), lambda p: ~(F.lower(p["key"]).isin(*LEGACY_TRACKING) | F.lower(p["key"]).startswith("utm_")))
    firsts = F.array_sort(F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["place"] < p["place"]))))
    query = _joined(firsts)
    params = F.regexp_extract(part(url, 5), r"(;[^/]*)$", 1)
    path = F.regexp_replace(part(url, 5), r";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    whole = F.concat(F.lit("https://"), part(url, 4), path, F.when(params == ";", "").otherwise(params), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.lower(part(url, 2)).isin("http", "https"), whole).otherwise("")


def url_accepted(url: Column) -> Column:
    """http(s) with a host, and no control character, space or quote anywhere."""
    return (
        F.lower(part(url, 2)).isin("http", "https") & (host(url) != "") & ~url.rlike("[\\x00-\\x20\"']")
    )


def paper_id(url: Column) -> Column:
    """Number of the paper that a url of a known paper host names, else null."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    found = F.regexp_extract(url, r"(\d{4}\.\d{4,6})", 1)
    return F.when(name.isin(*PAPER_HOSTS) & (found != ""), found)
