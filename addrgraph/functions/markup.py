"""Tags of HTML markup, as one pass of the JVM's pattern engine over the text.

The alternatives of ``_TOKEN`` are the states of a tokenizer: comment, text of an element
that holds no markup, link element, any other tag, declaration.  Each match consumes its
token whole and the search goes on behind it, so what looks like a tag or an attribute
inside a comment, a script or a quoted value is never seen as one.  All repeats are
possessive: no backtracking, and no recursion however long a token is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrgraph.functions.common import col

# ---------------------------------------------------------------------------
# Element and attribute rules of HTML.
LINK_ELEMENTS = ["a", "area"]
LINK_ATTRIBUTE = "href"
# Elements whose content is text up to their end tag, whatever it looks like:
TEXT_ELEMENTS = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]
# ---------------------------------------------------------------------------

_W = r"\t\n\f\r "  # white space between attributes
_VALUE = rf"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|(?!["'])[^{_W}>]*+)"""
_IS = rf"[{_W}]*+=[{_W}]*+"
_ATTRIBUTE = rf"[^{_W}/>][^{_W}/>=]*+(?:{_IS}{_VALUE})?+"
_REST = rf"(?:[{_W}/]++|{_ATTRIBUTE})*+"
_UNTIL_LINK = rf"(?:[{_W}/]++|(?!{LINK_ATTRIBUTE}[{_W}/>=]){_ATTRIBUTE})*+"
_CLOSED_VALUE = rf"""("[^"]*+"|'[^']*+'|(?!["'])[^{_W}>]*+)"""

_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_TEXT = rf"<({'|'.join(TEXT_ELEMENTS)})(?=[{_W}/>]){_REST}(?:>.*?(?=</\1[{_W}/>])|\z|>.*\z)"
_LINK = rf"<(?:{'|'.join(LINK_ELEMENTS)})(?=[{_W}/]){_UNTIL_LINK}{LINK_ATTRIBUTE}{_IS}{_CLOSED_VALUE}{_REST}>"
_TAG = rf"</?[a-z][^{_W}/>]*+{_REST}(?:>|\z)"
_DECLARATION = r"<(?:[!?]|/(?![a-z>]))[^>]*+(?:>|\z)"

#: One token; group 2 is the raw value of a link element's first ``href``.
TOKEN = rf"(?is){_COMMENT}|{_TEXT}|{_LINK}|{_TAG}|{_DECLARATION}"
_LINK_GROUP = 2


def link_values(html: Column | str) -> Column:
    """The raw ``href`` values (with their quotes) of link elements, in document order.

    A value counts if it is the element's first ``href`` attribute and the tag is closed.
    ``data-href``, ``href=`` within other values, and whatever stands in comments or in
    elements that hold text only do not count.  A null text has none.
    """
    h = F.coalesce(col(html), F.lit(""))
    found = F.filter(F.regexp_extract_all(h, F.lit(TOKEN), F.lit(_LINK_GROUP)), lambda v: F.length(v) > 0)
    return F.when(F.lower(h).contains(LINK_ATTRIBUTE), found).otherwise(F.array().cast("array<string>"))


def unquoted(value: Column) -> Column:
    """An attribute value without its quotes."""
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
