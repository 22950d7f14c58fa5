"""Text rules as native column expressions: address pattern, checks, decoding.

Everything here returns a ``Column``; nothing runs Python per row.  The
expressions stay inside the JVM (regex and higher-order functions), so they
pipeline with the scan and never shuffle.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrgraph.functions.common import let, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Address pattern (Java regex syntax; matches what both reference engines use):
EMAIL_PATTERN = r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![A-Z0-9._%+-])"
# Characters stripped from the right end of a candidate address:
EMAIL_RSTRIP_CHARS = ".,;:)]>"
# Longest accepted address:
EMAIL_MAX_LEN = 254
# Named character references of HTML 4, from the standard library's table, and the apostrophe:
NAMED_REFS = {name: chr(cp) for name, cp in name2codepoint.items()} | {"apos": "'"}
# ---------------------------------------------------------------------------

_RSTRIP_RE = "[" + "".join("\\" + c if c in "]\\^-" else c for c in EMAIL_RSTRIP_CHARS) + "]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_email(c: Column | str, mode: str = "basic") -> Column:
    """F5.  ``basic``: non-empty, length <= 254, no ``..``, exactly one ``@``,
    both sides non-empty, domain neither starts nor ends with ``.`` and holds a
    ``.``.  ``strict`` adds: the local part does not start with ``.``.
    """
    e = _c(c)
    local = F.substring_index(e, "@", 1)
    domain = F.substring_index(e, "@", -1)
    ok = (
        (F.length(e) > 0)
        & (F.length(e) <= EMAIL_MAX_LEN)
        & ~e.contains("..")
        & (F.size(F.split(e, "@", -1)) == 2)
        & (F.length(local) > 0)
        & (F.length(domain) > 0)
        & ~domain.startswith(".")
        & ~domain.endswith(".")
        & domain.contains(".")
    )
    if mode == "strict":
        ok = ok & ~local.startswith(".")
    elif mode != "basic":
        raise ValueError(f"unknown address check mode: {mode!r}")
    return F.coalesce(ok, F.lit(False))


def normalize_email(c: Column | str) -> Column:
    """P3.  Trim, strip trailing punctuation, lower-case, then the basic check;
    null when the value is not an address."""
    e = F.lower(F.regexp_replace(strip_ws(_c(c)), _RSTRIP_RE, ""))
    return let(e, lambda x: F.when(valid_email(x, "basic"), x))


def _decode_code_point(cp: Column) -> Column:
    """One Unicode scalar value -> its character; null when out of range."""
    ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    legal = (cp >= 1) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(legal, ch)


def decode_numeric_refs(c: Column | str) -> Column:
    """P1 (numeric part).  Decode ``&#NNN;`` and ``&#xHHH;`` once.

    The text is split at ``&#``; each tail that starts with a well-formed
    reference gets its first characters replaced.  Malformed or out-of-range
    references are kept verbatim, as the HTML decoder does.
    """
    t = _c(c)
    parts = F.split(t, "&#", -1)

    def tail(x: Column) -> Column:
        dec_digits = F.regexp_extract(x, r"^([0-9]{1,7});", 1)
        hex_digits = F.regexp_extract(x, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        dec_ch = _decode_code_point(dec_digits.cast("long"))
        hex_ch = _decode_code_point(F.conv(hex_digits, 16, 10).cast("long"))
        return (
            F.when((F.length(dec_digits) > 0) & dec_ch.isNotNull(),
                   F.concat(dec_ch, F.substring(x, F.length(dec_digits) + 2, 1 << 30)))
            .when((F.length(hex_digits) > 0) & hex_ch.isNotNull(),
                  F.concat(hex_ch, F.substring(x, F.length(hex_digits) + 3, 1 << 30)))
            .otherwise(F.concat(F.lit("&#"), x))
        )

    decoded = F.array_join(
        F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 1 << 30), tail)), "")
    # Only texts that hold a reference pay for the split/transform.
    return F.when(t.contains("&#"), decoded).otherwise(t)


def decode_html(c: Column | str) -> Column:
    """P1.  Numeric references and the named ones of HTML 4, decoded in one pass.

    The text is split at ``&`` and each tail decided once, so what a reference
    decodes to is never read again (``&#38;lt;`` gives ``&lt;``).  Unknown and
    malformed references stay as they are.  Named references never decode into an
    address character, so for address extraction ``decode_numeric_refs`` alone
    gives identical matches.
    """
    names = F.create_map(*[F.lit(x) for name, ch in sorted(NAMED_REFS.items()) for x in (name, ch)])

    def tail(x: Column) -> Column:
        ref = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)

        def decided(r: Column) -> Column:
            hexa = F.lower(F.substring(r, 1, 2)) == "#x"
            # only digits of the form at hand reach the conversions
            dec_cp = F.when(r.startswith("#") & ~hexa, F.substring(r, 2, 8)).cast("long")
            hex_cp = F.conv(F.when(hexa, F.substring(r, 3, 8)), 16, 10).cast("long")
            ch = (F.when(F.length(r) == 0, F.lit(None).cast("string"))
                  .when(r.startswith("#"), _decode_code_point(F.coalesce(dec_cp, hex_cp)))
                  .otherwise(F.try_element_at(names, r)))
            return F.coalesce(F.concat(ch, F.substring(x, F.length(r) + 2, 1 << 30)), F.concat(F.lit("&"), x))

        return let(ref, decided)

    def whole(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        out = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 1 << 30), tail)), "")
        return F.when(t.contains("&"), out).otherwise(t)

    return let(_c(c), whole)


def email_matches(c: Column | str, decode: bool = True) -> Column:
    """All non-overlapping address-pattern matches of a text, in order.

    A cheap ``contains`` guard skips the regex for texts with no ``@`` (and no
    numeric reference when decoding): most of a corpus never reaches the
    regex engine.
    """
    t = _c(c)
    if decode:
        src = decode_numeric_refs(t)
        guard = t.contains("@") | t.contains("&#")
    else:
        src = t
        guard = t.contains("@")
    return F.when(guard, F.regexp_extract_all(src, F.lit(EMAIL_PATTERN), 0)).otherwise(
        F.array().cast("array<string>"))


def page_emails(c: Column | str, decode: bool = True, mode: str = "basic") -> Column:
    """P2 + D1 in-row: matches -> trim/strip -> check -> lower -> distinct."""
    m = F.transform(email_matches(c, decode),
                    lambda x: F.regexp_replace(strip_ws(x), _RSTRIP_RE, ""))
    m = F.filter(m, lambda x: valid_email(x, mode))
    return F.array_distinct(F.transform(m, F.lower))
