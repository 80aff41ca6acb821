"""URL functions. Column expressions hold for URLs in plain ASCII; normalise_any covers percent-encoding too."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import SKIPPED_EXTENSIONS, TRACKING_PARAMETERS
from .text import let


def host(url: Column) -> Column:
    """Lower-cased host without user and port; '' where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def base_domain(name: Column) -> Column:
    """The last two labels, three where the second-last is one of a few public ones."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    second = F.try_element_at(parts, n - 1)
    take = F.when(second.isin("ac", "co", "com", "edu", "gov", "net", "org"), 3).otherwise(2)
    return F.when(n <= 2, name).otherwise(F.concat_ws(".", F.slice(parts, F.greatest(n - take + 1, F.lit(1)), F.lit(3))))


def path(url: Column) -> Column:
    """The path without query and fragment; / where it is empty."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def meaningful(part: Column) -> Column:
    """Whether a fragment is a client-side route."""
    return part.startswith("/") | part.rlike(r"[?&]")


def strip_tracking(q: Column, extra: tuple[str, ...] = ()) -> Column:
    """Query parameters in order of key, without tracking ones; a bare key becomes key=. Values of one key keep their order."""
    names = sorted({*TRACKING_PARAMETERS, *(e.strip() for e in extra if e.strip())})
    pairs = F.transform(F.filter(F.split(q, "&"), lambda p: p != ""), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_sort(F.filter(pairs, lambda s: ~s["k"].isin(*names)))
    return F.concat_ws("&", F.transform(kept, lambda s: s["p"]))


def normalise(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """The canonical form; null for what isn't an http(s) URL with a host. A client-side route in the fragment is kept."""
    t = F.trim(url)
    return let(F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t), lambda u: _normal(u, extra))


def _normal(t: Column, extra: tuple[str, ...]) -> Column:
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    p = let(F.regexp_replace(path(t), "/+", "/"), lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, "/$", "")).otherwise(x))
    q = let(strip_tracking(query(t), extra), lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(""))
    f = let(fragment(t), lambda x: F.when(meaningful(x), F.concat(F.lit("#"), x)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (authority != ""), F.concat(scheme, F.lit("://"), authority, p, q, f))


def resolve(href: Column, base: Column) -> Column:
    """The normalised target of a link on a page; null for what isn't a link to a page."""
    return let(F.trim(href), lambda h: _resolved(h, base))


def _resolved(h: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    target = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("#"), F.concat(origin, F.lit("/"), h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .otherwise(F.concat(origin, folder, h))
    )
    skip = (h == "") | h.rlike("^(javascript|mailto|tel|data):") | (h.startswith("#") & ~meaningful(F.substring(h, F.lit(2), F.length(h))))
    return F.when(~skip, normalise(target))


def skipped_extension(url: Column, extensions: tuple[str, ...] = tuple(sorted(SKIPPED_EXTENSIONS))) -> Column:
    """Whether the path's last part ends in one of the extensions; a leading dot may be missing from those."""
    dotted = [e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in extensions) if e]
    return F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1)).isin(*dotted)


def allowed(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Include patterns, if any is valid, decide alone; else a URL must match no exclude pattern."""
    valid = [[p for p in ps if p and _valid(p)] for ps in (include, exclude)]
    if valid[0]:
        return _any(url, valid[0])
    return ~_any(url, valid[1])


def _any(url: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(f"(?i){p}")
    return out


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def clean_domain(name: Column) -> Column:
    """A domain as entered by hand, without scheme, www., path and port; prefixes are recognised in lower case only."""
    n = name
    for prefix in ("^http://", "^https://", r"^www\."):
        n = F.regexp_replace(n, prefix, "")
    return F.lower(F.trim(F.substring_index(F.substring_index(n, "/", 1), ":", 1)))


def normalise_one(url: str | None, extra: tuple[str, ...] = ()) -> str | None:
    """normalise for one URL, with percent-encoding decoded and encoded again."""
    t = (url or "").strip()
    if t.startswith("//"):
        t = "https:" + t
    try:
        u = urlsplit(t)
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in ("http", "https") or not u.hostname:
        return None
    name = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    if port and (scheme, port) not in (("http", 80), ("https", 443)):
        name += f":{port}"
    if "@" in u.netloc:
        name = u.netloc.rpartition("@")[0] + "@" + name
    drop = TRACKING_PARAMETERS | set(extra)
    pairs = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in drop), key=lambda p: p[0])
    p = re.sub("/+", "/", quote(unquote(u.path), safe="/:@!$&'()*+,;=~-._") or "/")
    if len(p) > 1:
        p = p.removesuffix("/")
    f = unquote(u.fragment)
    route = f"#{f}" if f.startswith("/") or "?" in f or "&" in f else ""
    return f"{scheme}://{name}{p}{'?' + urlencode(pairs) if pairs else ''}{route}"


@F.pandas_udf(T.StringType())
def normalise_any(urls: pd.Series) -> pd.Series:
    return urls.map(normalise_one)


@F.pandas_udf(T.StringType())
def resolve_any(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
    def one(h: str | None, b: str | None) -> str | None:
        if not h or h.startswith(("javascript:", "mailto:", "tel:", "data:")):
            return None
        return normalise_one(urljoin(b or "", h))

    return pd.Series([one(h, b) for h, b in zip(hrefs, bases)])
