"""URL expressions.

Splitting is done with regular expressions rather than ``parse_url`` because a
raw blank or bracket makes the latter give up on the whole URL.
"""

from __future__ import annotations

import html
import sys
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenaudit.functions.text import before_first

# The Arrow functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host with port and user info, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def host(url: Column) -> Column:
    """Host only, lower case, without user info and port."""
    a = F.substring_index(authority(url), "@", -1)
    return F.regexp_replace(a, r":\d*$", "")


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def _bare(a: Column) -> Column:
    return F.regexp_replace(a, r"^www\.", "")


def in_scope(url: Column, target: Column) -> Column:
    """Same authority as the target or a subdomain of it, ``www.`` aside."""
    h, b = _bare(authority(url)), _bare(authority(target))
    return (h == b) | h.endswith(F.concat(F.lit("."), b))


def registered_domain(target: Column) -> Column:
    return _bare(host(target))


def _decode(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("+"), F.lit(" ")), "%(?![0-9A-Fa-f]{2})", "%25")
    # url_decode reads '+' as a blank, none are left by now
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)


def query_pairs(url: Column, keep_blank: bool = True) -> Column:
    """Decoded query parameters as ``array<struct<key, value>>`` in URL order.

    Without ``keep_blank`` parameters without a value are left out, and the
    positions are those of the remaining ones.
    """
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    if not keep_blank:
        parts = F.filter(parts, lambda p: p.rlike("^[^=]*=(?s:.)"))

    def pair(p):
        k = before_first(p, "=")
        v = F.substring(p, F.length(k) + 2, F.length(p))
        return F.struct(_decode(k).alias("key"), _decode(v).alias("value"))

    return F.transform(parts, pair)


def _join(base, href):
    if base is None or href is None:
        return None
    try:
        return urljoin(base, html.unescape(href).strip())
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _resolve_one(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve_many(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if hs is None else [_join(b, h) for h in hs] for b, hs in zip(base, hrefs)],
                     dtype=object)


# References whose resolution is plain concatenation.
_ABSOLUTE = r"^https?://[^\s/?#;&]+(?:/[^\s?#;&]*)?(?:\?[^\s#&]+)?(?:#\S*)?$"
_ROOTED = r"^/(?:[^\s/.?#;&][^\s/?#;&]*(?:/[^\s/.?#;&][^\s/?#;&]*)*/?)?(?:\?[^\s#&]+)?(?:#\S*)?$"
_BELOW = r"^\./[^\s/.?#;&:][^\s/?#;&:]*(?:/[^\s/.?#;&][^\s/?#;&]*)*/?$"
_PLAIN_BASE = r"^https?://[^\s/?#;]+(?:[/?#]\S*)?$"


def _origin(base: Column) -> Column:
    return F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)


def resolve(base: Column, href: Column, keep_fragment: bool = False, relative: bool = False) -> Column:
    """``href`` as seen from ``base``, entities decoded, fragment removed.

    Absolute and root-relative references, nearly all there are, are joined in
    the JVM; the Arrow function receives nulls for them and resolves only the
    remaining kinds.  With ``relative`` the base ends in a slash and references
    of the form ``./name`` are joined in the JVM as well.
    """
    plain = base.rlike(_PLAIN_BASE)
    absolute = plain & href.rlike(_ABSOLUTE)
    rooted = plain & href.rlike(_ROOTED)
    below = (plain & href.rlike(_BELOW)) if relative else F.lit(False)
    easy = absolute | rooted | below
    full = (F.when(absolute, href)
            .when(rooted, F.concat(_origin(base), href))
            .when(below, F.concat(base, F.substring(href, 3, 1 << 30)))
            .otherwise(_resolve_one(F.when(~easy, base), F.when(~easy, href))))
    return full if keep_fragment else before_first(full, "#")


def resolve_all(base: Column, hrefs: Column) -> Column:
    """``resolve`` for an array of references; the order is not kept."""
    plain = base.rlike(_PLAIN_BASE)

    def easy(h):
        return plain & (h.rlike(_ABSOLUTE) | h.rlike(_ROOTED))

    quick = F.transform(F.filter(hrefs, easy),
                        lambda h: F.when(h.startswith("/"), F.concat(_origin(base), h)).otherwise(h))
    odd = F.filter(hrefs, lambda h: ~easy(h))
    some = F.size(odd) > 0
    rest = F.coalesce(_resolve_many(F.when(some, base), F.when(some, odd)), F.array().cast("array<string>"))
    return F.transform(F.concat(quick, rest), lambda u: before_first(u, "#"))
