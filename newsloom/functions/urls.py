"""Url expressions. The patterns follow RFC 3986, appendix B, and accept any characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col

# Fixed patterns: scheme and host part of a url.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME, 1))


def host(url: Column | str) -> Column:
    """Host with its port; empty when the url has none."""
    return F.regexp_extract(col(url), HOST, 1)


def path(url: Column | str) -> Column:
    p = F.regexp_extract(col(url), PATH, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def same_escapes(p: Column | str) -> Column:
    """A path with the digits of its percent-escapes in capitals."""
    parts = F.split(col(p), "%")
    upper = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda x: F.when(F.rlike(x, F.lit("^[0-9a-fA-F]{2}")), F.concat(F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3)))).otherwise(x),
    )
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(1)), upper), "%")


def site_base(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute links stay; others go under the site of `base`; no link gives `base`."""
    h = col(href)
    slash = F.when(F.startswith(h, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    return (
        F.when(h.isNull(), col(base))
        .when(host(h) != "", h)
        .otherwise(F.concat(site_base(base), slash, h))
    )
