"""URL and host rules as native column expressions (no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrgraph.functions.common import let, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Path extensions whose links are never followed (compared ignoring case):
BLOCKED_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico",
    "pdf", "zip", "rar", "7z", "tar", "gz", "mp3", "wav", "mp4",
    "avi", "mov", "wmv", "mkv", "css", "js", "json", "xml", "csv",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "msi", "dmg",
    "woff", "woff2", "ttf", "eot", "otf",
]
# Host-name syntax accepted for discovery hosts:
HOST_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9-]{1,63})+$"
# Link prefixes that are never followed (the "#" test is case-sensitive):
SKIPPED_LINK_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]
# Scheme prefixed to seed lines without one:
DEFAULT_SCHEME_PREFIX = "https://"
# ---------------------------------------------------------------------------

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*"
_ORIGIN_RE = rf"^({_SCHEME}://[^/?#]*)"
_PATH_RE = rf"^{_SCHEME}://[^/?#]*([^?#]*)"
_HOST_RE = r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(c: Column | str) -> Column:
    """P14.  Lower-cased host of an http(s) URL, null when there is none.

    Taken by regex rather than ``parse_url``: raw links may hold spaces, for
    which URL parsing returns null.
    """
    h = F.lower(F.regexp_extract(_c(c), _HOST_RE, 1))
    return F.when(F.length(h) > 0, h)


def path_of(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), _PATH_RE, 1)


def ext_of(c: Column | str) -> Column:
    """P14.  Lower-cased extension of the URL's path (query not looked at)."""
    return F.lower(F.regexp_extract(path_of(c), r"\.([^./]+)$", 1))


def blocked_extension(c: Column | str) -> Column:
    """F4 predicate: true when the path extension is in the blocked set."""
    return ext_of(c).isin(BLOCKED_EXTENSIONS)


def skipped_link(c: Column | str) -> Column:
    """F2 (first half): blank, fragment-only, mailto:, tel:, javascript: links."""
    v = _c(c)
    skip = F.length(strip_ws(v)) == 0
    for p in SKIPPED_LINK_PREFIXES:
        skip = skip | (v.startswith(p) if p == "#" else F.lower(v).startswith(p))
    return skip


def is_http_url(c: Column | str) -> Column:
    """F2 (second half): http/https with a non-empty host."""
    return _c(c).rlike(r"(?i)^https?://[^/?#]") & host_of(c).isNotNull()


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal on a path, as a fold over its segments."""

    def body(p: Column) -> Column:
        segs = F.split(p, "/", -1)
        folded = F.aggregate(
            segs,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segs, -1)
        out = F.concat(F.array_join(folded, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
        return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), out).otherwise(p)

    return let(path, body)


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """P6.  Resolve ``ref`` against the page URL ``base``; fragment dropped.

    Forms, in test order: absolute (has a scheme), network-path ``//``,
    absolute-path ``/``, query-only ``?``, relative path.  Dot segments are
    removed from the resulting path; an empty path becomes ``/``.
    """
    r = _c(ref)

    def joined_of(b: Column) -> Column:
        origin = F.regexp_extract(b, _ORIGIN_RE, 1)
        scheme = F.regexp_extract(b, rf"^({_SCHEME}):", 1)
        bpath = let(path_of(b), lambda p: F.when(F.length(p) == 0, F.lit("/")).otherwise(p))
        bdir = F.regexp_extract(bpath, r"^(.*/)", 1)
        j = (
            F.when(r.rlike(rf"^{_SCHEME}:"), r)
            .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when(r.startswith("?"), F.concat(origin, bpath, r))
            .otherwise(F.concat(origin, bdir, r))
        )
        return F.when(b.rlike(_ORIGIN_RE), F.regexp_replace(j, "#.*$", ""))

    def finish(u: Column) -> Column:
        origin = F.regexp_extract(u, _ORIGIN_RE, 1)
        return let(path_of(u), lambda p: F.concat(
            origin,
            F.when(F.length(p) == 0, F.lit("/")).otherwise(remove_dot_segments(p)),
            F.substring(u, F.length(origin) + F.length(p) + 1, 1 << 30)))

    return let(joined_of(_c(base)), lambda u: F.when(u.rlike(_ORIGIN_RE), finish(u)).otherwise(u))


def url_key(c: Column | str) -> Column:
    """P7.  Case-insensitive identity of a URL for the seen-set.

    Cut at ``#``; lower-case; drop :80 (http) / :443 (https); empty path
    becomes ``/``; when the path is longer than ``/`` strip all trailing ``/``.
    """
    a = F.lower(F.regexp_replace(_c(c), "#.*$", ""))
    b = F.regexp_replace(a, r"^(http://[^/:?]+):80([/?]|$)", "$1$2")
    b = F.regexp_replace(b, r"^(https://[^/:?]+):443([/?]|$)", "$1$2")
    d = F.regexp_replace(b, r"^(https?://[^/?]+)([?]|$)", "$1/$2")
    return let(d, lambda k: F.when(F.length(F.regexp_extract(k, r"^https?://[^/?]+([^?]*)", 1)) > 1,
                                   F.regexp_replace(k, "/+$", "")).otherwise(k))


def normalize_url(c: Column | str) -> Column:
    """P8 (lenient seed rule).  Trim; prefix ``https://`` unless the text starts
    with ``http://``/``https://`` (case-sensitive); require a non-empty
    authority; drop the fragment and an empty query mark.  Null when invalid.
    """
    def with_scheme(v: Column) -> Column:
        return F.when(v.startswith("http://") | v.startswith("https://"), v).otherwise(
            F.concat(F.lit(DEFAULT_SCHEME_PREFIX), v))

    def finish(v: Column) -> Column:
        netloc = F.regexp_extract(v, r"^https?://([^/?#]*)", 1)
        out = F.regexp_replace(F.regexp_replace(v, "#.*$", ""), r"\?$", "")
        return F.when(F.length(netloc) > 0, out)

    trimmed = F.regexp_replace(strip_ws(_c(c)), "[\t\r\n]", "")
    return let(trimmed, lambda t: F.when(F.length(t) > 0, let(with_scheme(t), finish)))


def strict_seed_url(c: Column | str) -> Column:
    """S2 rule for one line: trimmed, ``https://`` added when no http(s) scheme
    (case-insensitive test); null when not an absolute http(s) URL with a host."""
    v = strip_ws(_c(c))
    v = F.when(v.rlike(r"(?i)^https?://"), v).otherwise(F.concat(F.lit(DEFAULT_SCHEME_PREFIX), v))
    host = F.regexp_extract(v, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    port = F.regexp_extract(v, r"(?i)^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:[^/?#]*)?", 1)
    port_ok = port.rlike(r"^:[0-9]{1,5}$") & (F.substring(port, 2, 5).cast("int") <= 65535)
    ok = (F.length(host) > 0) & ~host.rlike(r"\s") & ((F.length(port) == 0) | port_ok)
    return F.when(ok, v)


def normalize_host(c: Column | str) -> Column:
    """P10.  Host name from a discovery value, null unless it is a syntactically
    valid host.  Full URLs give their host; otherwise a leading ``*.`` is
    dropped, the text is cut at ``/`` and a ``:digits`` port removed."""
    def host(v: Column) -> Column:
        from_url = F.regexp_extract(v, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
        bare = F.regexp_replace(F.substring_index(F.regexp_replace(v, r"^\*\.", ""), "/", 1), ":[0-9]+$", "")
        return F.when(v.contains("//"), from_url).otherwise(bare)

    return let(host(F.lower(strip_ws(_c(c)))), lambda h: F.when((F.length(h) > 0) & h.rlike(HOST_PATTERN), h))


def in_domain(host: Column | str, domain: Column | str) -> Column:
    """F6 predicate: host equals the domain or is below it; empty domain = all."""
    h, d = _c(host), _c(domain)
    return (F.length(d) == 0) | (h == d) | h.endswith(F.concat(F.lit("."), d))


def registrable_domain(host: Column | str) -> Column:
    """P9 two-label rule: last two labels of a host; an IPv4 address stays whole."""
    h = F.lower(strip_ws(_c(host)))
    labels = F.split(h, r"\.", -1)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return (F.when(h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), h)
            .when(F.size(labels) >= 2, two)
            .otherwise(h))
