"""URL canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldscope.functions.columns import let, string_list, strip

# Query parameters that carry no identity.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "ref_src", "source", "src", "gh_src", "gh_jid", "fbclid", "gclid",
    "mc_cid", "mc_eid", "cmpid", "cid",
)

# Component pattern of RFC 3986, appendix B.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


# Schemes that keep an empty authority ("//") in front of an absolute path.
_AUTHORITY_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss", "sftp")


def _decode(c: Column) -> Column:
    """Form-decode.  A percent sign that opens no escape stands for itself."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    """Form-encode, leaving exactly letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(part: Column) -> Column:
    name = F.regexp_extract(part, "^([^=]*)", 1)
    value = F.regexp_extract(part, "^[^=]*=(.*)$", 1)
    return F.struct(_decode(name).alias("k"), _decode(value).alias("v"))


def _query(raw: Column) -> Column:
    """Surviving parameters, sorted by (name, value) and encoded again."""
    pairs = F.transform(F.split(raw, "&"), _pair)
    kept = F.filter(pairs, lambda p: (
        (p["v"] != "") & ~F.array_contains(string_list(TRACKING_PARAMS), F.lower(p["k"]))))
    encoded = F.transform(F.array_sort(kept), lambda p: F.concat(
        _encode(p["k"]), F.lit("="), _encode(p["v"])))
    return F.array_join(encoded, "&")


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, drop fragment, tracking and blank parameters,
    sort the rest, and drop trailing slashes.  Path case is kept; a blank URL
    stays the empty string."""
    def taken_apart(url: Column) -> Column:
        parts = [F.regexp_extract(url, _PARTS, at) for at in (1, 2, 3, 4)]
        return F.struct(F.lower(parts[0]).alias("scheme"), F.lower(parts[1]).alias("host"),
                        F.rtrim(parts[2], F.lit("/")).alias("path"), parts[3].alias("query"))

    bare = F.regexp_replace(strip(c), r"[\t\r\n]", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        let(bare, lambda url: let(taken_apart(url), _assemble)))


def _assemble(p: Column) -> Column:
    scheme = F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"])
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    hosted = F.concat(F.lit("//"), p["host"], F.when(path.startswith("/"), path)
                      .otherwise(F.concat(F.lit("/"), path)))
    keeps_slashes = path.startswith("//") | (path.startswith("/") & scheme.isin(*_AUTHORITY_SCHEMES))
    located = (F.when(p["host"] != "", hosted)
               .when(keeps_slashes, F.concat(F.lit("//"), path))
               .otherwise(path))
    kept = F.when(p["query"] != "", _query(p["query"])).otherwise(F.lit(""))
    query = let(kept, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(q))
    return F.concat(scheme, F.lit(":"), located, query)
