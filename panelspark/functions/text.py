"""Text, HTML and URL expressions.  Everything stays in the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

# White space as Python's str.split() has it: Unicode's, plus the four separators.
_SPACE = r"[\s\x1c-\x1f]"
# Runs to replace by one space: white space that is not a plain space, or is
# followed by more.  Single spaces between words match nothing.
_RUN = rf"(?U){_SPACE}(?:(?<! )|{_SPACE}){_SPACE}*"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+$"

# Comments, scripts and styles hold no page text.
_NOT_TEXT = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
_TAG = r"(?s)<(?:/?[A-Za-z]|!)[^>]*>"

# Entities without a closing semicolon are limited to the older names; the
# longest one wins.
_OPEN_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len)[::-1]
_ENTITY = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|%s)" % "|".join(_OPEN_NAMES)
# The names by length, as the shortest are the most usual and a map is read from its start.
_NAMES = dict(sorted(html.entities.html5.items(), key=lambda x: len(x[0])))
# Numeric references 128..159 are read as Windows-1252.
_C1 = {
    str(i): bytes([i]).decode("cp1252", errors="ignore") or chr(i) for i in range(128, 160)
}


def _table(mapping: dict[str, str]) -> Column:
    """A constant map column; folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _RUN, " "))


def strip_whitespace(c: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(c, _EDGES, "")


def limit_text(c: Column, limit: int) -> Column:
    """Text over ``limit`` characters keeps ``limit - 1``, stripped, plus an ellipsis."""

    def cut(t: Column) -> Column:
        short = F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))
        return F.when(F.length(t) > limit, short).otherwise(t)

    return let(c, cut)


def normalize_text(c: Column, limit: int) -> Column:
    """Collapse whitespace, then limit the length."""
    return limit_text(collapse_whitespace(c), limit)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that using it twice computes it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _code_point(n: Column) -> Column:
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return let(
        F.when(bad, F.lit(0xFFFD)).otherwise(n),
        lambda p: F.coalesce(
            F.try_element_at(_table(_C1), p.cast("string")),
            F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"),
        ),
    )


def _numeric_reference(token: Column) -> Column:
    """``#233`` or ``#xe9`` to its character; too many digits are out of range."""
    digits = F.regexp_replace(F.regexp_extract(token, "^#[xX]?0*([0-9a-fA-F]*)", 1), "^$", "0")
    base16 = F.lower(F.substring(token, 2, 1)) == "x"
    number = F.when(base16, F.conv(F.substring(digits, 1, 8), 16, 10)).otherwise(
        F.substring(digits, 1, 8)
    )
    fits = F.length(digits) <= 7
    return let(
        F.when(fits, number.try_cast("long")).otherwise(F.lit(0x110000).cast("long")), _code_point
    )


def _named_reference(token: Column) -> Column:
    """A name to its text; the longest older name that starts it; or unchanged."""
    names = _table(_NAMES)

    def older(start: Column) -> Column:
        return F.coalesce(
            F.concat(
                F.try_element_at(names, start), token.substr(F.length(start) + 1, F.length(token))
            ),
            F.concat(F.lit("&"), token),
        )

    start = F.regexp_extract(token, "^(?:%s)" % "|".join(_OPEN_NAMES), 0)
    return F.coalesce(F.try_element_at(names, token), let(start, older))


def _decode_entity(token: Column) -> Column:
    """One matched reference, without its ampersand, to text."""
    numeric = F.substring(token, 1, 1) == "#"
    return F.when(numeric, _numeric_reference(token)).otherwise(_named_reference(token))


def unescape_html(c: Column) -> Column:
    """Replace every character reference (named or numeric) by its text.

    The text is split at the ampersands: one character is no pattern to compile per row.
    """

    def part(piece: Column, i: Column) -> Column:
        def read(token: Column) -> Column:
            rest = piece.substr(F.length(token) + 1, F.length(piece))
            return F.when(token == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(_decode_entity(token), rest))

        return F.when(i == 0, piece).otherwise(let(F.regexp_extract(piece, _ENTITY, 0), read))

    return let(
        c,
        lambda t: F.when(
            t.contains("&"), F.array_join(F.transform(F.split(t, "&", -1), part), "")
        ).otherwise(t),
    )


def drop_non_text(c: Column) -> Column:
    """HTML without comments, scripts and styles; markup is kept."""
    return F.regexp_replace(c, _NOT_TEXT, " ")


def markup_to_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags separate words, whitespace collapses."""
    bare = F.when(fragment.contains("<"), F.regexp_replace(fragment, _TAG, " ")).otherwise(fragment)
    return collapse_whitespace(unescape_html(bare))


def url_format_valid(url: Column) -> Column:
    """HTTP(S) scheme, non-blank host, no credentials, no control characters."""
    control = url.rlike(r"[\x00-\x1f\x7f]")
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":[0-9]*$", "")
    ok = (
        url.rlike(r"(?i)^https?://")
        & (F.trim(host) != "")
        & ~authority.contains("@")
        & ~authority.rlike(r"\s")
        & ~control
    )
    return F.coalesce(ok, F.lit(False))


def source_url_valid(url: Column) -> Column:
    """The lighter source check: HTTP(S) scheme and a non-empty authority."""
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))
