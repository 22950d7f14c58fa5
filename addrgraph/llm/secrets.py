"""Secret scan with multipart credential linking.

Assignments, access identifiers and long hexadecimal strings are reported for themselves.
Weak parts (an account or client name, an unlabelled key-like string, an endpoint) say
nothing alone.  Each part covers the interval of its scope (a paragraph), or, where a reach is
given, itself widened by that many code points within the scope; a sweep joins intervals that
overlap, and a weak part is reported only if its complements are in reach: a name needs a
secret, a key-like string needs an identifier or a name, an endpoint needs both.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, text_or_empty

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "name", "key", "endpoint")
#: what a part stands for in a link
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "name": "identifier", "key": "secret",
        "endpoint": "endpoint"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAME = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.I | re.A)
#: A whole run of base64 in either alphabet, prefixed tokens included, of any length.
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|ftp)://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I | re.A)
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost non-overlapping within each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "name") for m in _NAME.finditer(text)]
        found += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    for m in _KEY.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
            found.append((m.start(), m.end(), "key"))
    return found


def link_parts(text: str, base: list, weak: list, reach: int | None) -> list[tuple[int, int, str]]:
    """The weak parts that have their complements in reach (None: anywhere in their scope)
    and lie inside no base span.

    Parts of a role are kept by start and by end; a part has one of them in reach if its
    widened interval holds more starts before its end than ends before its start, so the
    join takes a sort and two searches a part, however many pairs there are.
    """
    if not weak:
        return []
    cuts = [m.start() for m in _PARAGRAPH.finditer(text)]
    sides = {}
    for role in ("identifier", "secret"):
        own = [(s, e) for s, e, kind in (*base, *weak) if ROLE[kind] == role]
        sides[role] = sorted(s for s, _ in own), sorted(e for _, e in own)

    def near(role, start, end):
        at = bisect_right(cuts, start)
        low, high = cuts[at - 1] if at else 0, cuts[at] if at < len(cuts) else len(text)
        if reach is not None:
            low, high = max(start - reach, low), min(end + reach, high)
        starts, ends = sides[role]
        return bisect_left(starts, high) - bisect_right(ends, low) > 0

    begun = sorted((s, e) for s, e, _ in base)
    starts0, furthest = [s for s, _ in begun], list(accumulate((e for _, e in begun), max))

    def covered(s, e):  # a weak part inside a base span adds nothing
        at = bisect_right(starts0, s)
        return at > 0 and furthest[at - 1] >= e

    need = {"name": ("secret",), "key": ("identifier",), "endpoint": ("identifier", "secret")}
    return [(s, e, kind) for s, e, kind in weak
            if not covered(s, e) and all(near(role, s, e) for role in need[kind])]


def _line(spans: list) -> str:
    spans = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(reach: int | None):
    def scan(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                spans = base + link_parts(text, base, weak_spans(text), reach)
                rows.append((*(sum(kind == k for _, _, kind in base) for k in BASE),
                             hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan


def scan_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, one row per row of ``docs``.

    Spans are code points, end exclusive.  Null and empty texts have none (the digest is that
    of the empty string); null and repeated ids and repeated rows keep a row each; an empty
    table gives none; other columns are ignored.  Whole texts are read, however long, and
    parts of one document are linked only with each other, so nothing is exchanged; spans that
    start together are listed by kind.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(
        _scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_linked_secrets(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents"))
