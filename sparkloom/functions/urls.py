"""Columns over addresses: parts, normal forms, site rules, robots rules and sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query parameters that only follow visitors: fixed values.
TRACKING = ("ref", "source")
TRACKING_PREFIX = "utm_"


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query, 6 fragment; empty if absent."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, number)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 4)


def _rebuilt(url: Column, parameters: Column) -> Column:
    cut = F.regexp_replace(path(url), "/+$", "")
    joined = F.array_join(F.array_sort(parameters), "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.when(cut == "", "/").otherwise(cut), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def _parameters(url: Column) -> Column:
    return F.filter(F.split(part(url, 5), "&"), lambda p: p != "")


def normalized(url: Column) -> Column:
    """Lower-case host, no port, fragment or trailing slash, parameters in order."""
    return _rebuilt(url, _parameters(url))


def untracked(url: Column) -> Column:
    """The normal form without parameters that only follow visitors."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    return _rebuilt(url, F.filter(_parameters(url), lambda p: ~(name(p).isin(*TRACKING) | name(p).startswith(TRACKING_PREFIX))))


def slug(url: Column) -> Column:
    """Host and path as one lower-case word with dashes."""
    text = F.concat(host(url), F.regexp_replace(path(url), r"\.[A-Za-z0-9]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def on_domain(domain: Column, names: Sequence[str]) -> Column:
    """Whether a domain is one of the names or below one."""
    tests = [(domain == n) | domain.endswith(f".{n}") for n in names]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def allowed(domain: Column, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """Blocked domains never; if any domains are allowed, only those."""
    return ~on_domain(domain, block) & (on_domain(domain, allow) if allow else F.lit(True))


def same_section(url: Column, seed: Column) -> Column:
    """Whether a URL lies under the parent section of the seed: same host, same path but for the seed's last level.

    Seeds of fewer than two levels take the whole host.
    """
    levels = F.filter(F.split(path(seed), "/"), lambda x: x != "")
    section = F.when(F.size(levels) >= 2, F.concat(F.lit("/"), F.array_join(F.slice(levels, 1, F.size(levels) - 1), "/"), F.lit("/"))).otherwise("/")
    return (host(url) == host(seed)) & F.startswith(path(url), section)


def private_address(domain: Column) -> Column:
    """Whether a host may not be fetched: local names, metadata services, private, loopback and link-local addresses."""
    four = F.split(domain, r"\.")
    n = lambda i: F.element_at(four, i).cast("int")
    dotted = domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (n(1) == 10) | (n(1) == 127) | (n(1) == 0) | ((n(1) == 172) & n(2).between(16, 31)) | ((n(1) == 192) & (n(2) == 168)) | ((n(1) == 169) & (n(2) == 254))
    named = domain.isin("localhost", "metadata.google.internal") | domain.endswith(".localhost") | domain.endswith(".internal") | domain.endswith(".local")
    return F.when(dotted, inside).otherwise(named | domain.rlike(r"^\[?(::1|f[cd][0-9a-f]{2}:|fe80:)"))


def fetchable(url: Column) -> Column:
    return F.lower(part(url, 1)).isin("http", "https") & (host(url) != "") & ~private_address(host(url))


def rule_pattern(rule: Column) -> Column:
    """A robots path rule as a regular expression: * matches anything, a last $ ends the path, else it is a prefix."""
    ends = F.endswith(rule, F.lit("$"))
    body = F.when(ends, F.expr("1")).otherwise(F.lit("0"))
    core = F.when(ends, F.regexp_replace(rule, r"\$$", "")).otherwise(rule)
    quoted = F.regexp_replace(core, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    del body
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(ends, "$").otherwise(""))


def path_allowed(target: Column, allow: Column, disallow: Column) -> Column:
    """Allow rules first, then disallow rules, else allowed. allow, disallow: arrays of rules."""
    hit = lambda rules: F.exists(rules, lambda r: F.regexp_like(target, rule_pattern(r)))
    return hit(allow) | ~hit(F.filter(disallow, lambda r: r != ""))


def sitemap_urls(xml: Column) -> Column:
    """loc values of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_sitemap_index(xml: Column) -> Column:
    return F.regexp_like(xml, F.lit("(?i)<sitemapindex"))


def listed_urls(text: Column) -> Column:
    """Lines of a plain list of addresses (llms.txt): no blank lines, no comments."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\r]+|[\s\r]+$", "")))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
