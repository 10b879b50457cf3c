"""Cleaning of raw model answers, as column expressions."""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Statement keywords that may start an answer.
STATEMENT_KEYWORDS = "SELECT|WITH|UPDATE|DELETE|INSERT|CREATE|DROP|ALTER"

FENCE = "```"
_OPEN_FENCE = r"(?i)```(?:sql)?\s*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim all Unicode whitespace (``trim`` alone removes spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _entity_tables() -> tuple[str, str, str]:
    """As texts for ``str_to_map``: names that end with a semicolon, those that need none, and code
    points by number that stand for another character; with a pattern of the second, longest first."""
    pairs = lambda d: _NEXT.join(f"{k}{_IS}{v}" for k, v in d.items())
    closed = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
    open_ = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
    # The bytes 80 to 9F are read as that code page has them, where it has them.
    page = {str(k): v for k in range(0x80, 0xA0) if (v := bytes([k]).decode("cp1252", "ignore"))}
    return pairs(closed), pairs(open_), pairs(page)


# Private-use characters between the entries of a table.
_IS, _NEXT = "\ue030", "\ue031"
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape(c: Column | str) -> Column:
    """Decode HTML entities, by the rules for text in a page: names with or without their semicolon
    (the longest that is known), decimal and hexadecimal numbers. Texts without an ampersand are left as they are."""
    closed, open_, page = (F.str_to_map(F.lit(t), F.lit(_NEXT), F.lit(_IS)) for t in _entity_tables())
    known = "^(?:" + "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)) + ")"

    def character(n: Column) -> Column:
        """The character of a code point; those that are no text have none."""
        byte = F.try_element_at(page, n.cast("string"))
        control = ((n < 32) & ~n.isin(9, 10, 12, 13)) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n == 13, "\r")
            .when(byte.isNotNull(), byte)
            .when(n.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D), utf32)
            .when(control, "")
            .otherwise(utf32)
        )

    def number(t: Column) -> Column:
        digits = F.regexp_extract(t, "[0-9a-fA-F]+", 0)
        # More than ten digits are beyond all characters, whatever they are.
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        base = F.when(F.lower(F.substring(t, 2, 1)) == "x", F.conv(short, 16, 10)).otherwise(short)
        return let(F.when(F.length(short) > 10, F.lit(0x110000)).otherwise(base.cast("bigint")), character)

    def name(t: Column) -> Column:
        exact = F.try_element_at(closed, t)
        prefix = F.regexp_extract(t, known, 0)
        part = F.concat(F.try_element_at(open_, prefix), F.substr(t, F.length(prefix) + 1))
        return F.coalesce(exact, F.when(prefix != "", part), F.concat(F.lit("&"), t))

    def decoded(m: Column) -> Column:
        return F.when(m.startswith("#"), number(m)).otherwise(name(m))

    def all_of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1))
        put = F.zip_with(F.split(t, _ENTITY, -1), found, lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(decoded(m))))
        return F.array_join(put, "")

    return let(_col(c), lambda t: F.when(F.contains(t, F.lit("&")), all_of(t)).otherwise(t))


def strip_think(c: Column | str, tolerant: bool = False) -> Column:
    """Drop reasoning blocks and trim.

    ``tolerant`` also decodes entities, accepts tags with attributes and blanks,
    and drops a block that is never closed up to the end of the text.
    """
    c = _col(c)
    if not tolerant:
        return strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    t = F.coalesce(unescape(c), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<\s*think\b[^>]*>.*?<\s*/\s*think\s*>", "")
    t = F.regexp_replace(t, r"(?is)<\s*think\b[^>]*>.*", "")
    return strip(t)


def tail(c: Column | str, n: int = 240) -> Column:
    """Last ``n`` characters after trimming."""
    return F.right(strip(c), F.lit(n))


def last_answer_token(c: Column | str) -> Column:
    """Last whole word A/B/C/D/True/False in any case; '' when there is none."""
    hit = F.try_element_at(
        F.regexp_extract_all(_col(c), F.lit(r"(?iU)\b(A|B|C|D|True|False)\b"), F.lit(1)),
        F.lit(-1),
    )
    shown = let(hit, lambda h: F.when(F.length(h) == 1, F.upper(h)).otherwise(F.initcap(h)))
    return F.coalesce(shown, F.lit(""))


def final_answer(c: Column | str, n: int = 240) -> Column:
    """The choice an answer ends with, looked for in its last ``n`` characters."""
    return last_answer_token(tail(strip_think(c, tolerant=True), n))


def last_fence(t: Column | str) -> Column:
    """Body of the last closed code fence; null without one, '' when it is empty."""
    return strip(
        F.try_element_at(
            F.regexp_extract_all(_col(t), F.lit(_OPEN_FENCE + r"([\s\S]*?)```"), F.lit(1)),
            F.lit(-1),
        )
    )


def open_fence(t: Column | str) -> Column:
    """Text after the first fence when it is not closed; trailing backticks are dropped."""
    return let(
        F.regexp_replace(_col(t), r"`+\z", ""),
        lambda u: F.when(
            F.contains(u, F.lit(FENCE)),
            strip(F.regexp_extract(u, _OPEN_FENCE + r"([\s\S]*)\z", 1)),
        ),
    )


def last_statement(t: Column | str) -> Column:
    """Last run from a statement keyword to a ``;`` that ends its line.

    The text is cut behind its last such ``;`` first. Every keyword left then
    reaches an end, so a long answer is read once instead of once per keyword.
    """
    end = r";(?=[^\S\n]*(?:\n|\z))"
    upto = F.regexp_extract(_col(t), rf"(?s)\A(.*{end})", 1)
    return strip(
        F.try_element_at(
            F.regexp_extract_all(
                upto, F.lit(rf"(?iU)((?:{STATEMENT_KEYWORDS})\b[\s\S]*?{end})"), F.lit(1)
            ),
            F.lit(-1),
        )
    )


def last_keyword_line(t: Column | str) -> Column:
    """From the last-found statement keyword to the end of that line."""
    return strip(
        F.try_element_at(
            F.regexp_extract_all(
                _col(t), F.lit(rf"(?iU)((?:{STATEMENT_KEYWORDS})\b[^\n]*)"), F.lit(1)
            ),
            F.lit(-1),
        )
    )


def extract_sql(c: Column | str) -> Column:
    """The SQL of an answer: closed fence, open fence, terminated statement, keyword line.

    The first stage that matches decides, even with an empty match; '' if none does.
    """
    return let(
        strip_think(c),
        lambda t: F.coalesce(
            last_fence(t), open_fence(t), last_statement(t), last_keyword_line(t), F.lit("")
        ),
    )


def strip_fences(c: Column | str) -> Column:
    """Remove the outer fence and quotes at the time an answer is stored."""
    c = _col(c)
    t = (
        F.when(c.startswith("```sql"), strip(F.substr(c, F.lit(7))))
        .when(c.startswith(FENCE), strip(F.substr(c, F.lit(4))))
        .otherwise(c)
    )
    t = F.when(t.endswith(FENCE), strip(F.left(t, F.length(t) - 3))).otherwise(t)
    return F.btrim(F.btrim(t, F.lit('"')), F.lit("'"))


def clean_label(c: Column | str) -> Column:
    """First line of a label without blanks, backticks and quotes around it."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    for mark in ("`", '"', "'"):
        t = F.btrim(t, F.lit(mark))
    first = F.regexp_extract(t, r"\A[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*", 0)
    return strip(first)


def type_key(c: Column | str) -> Column:
    """Question type as a key: upper case, other characters to single underscores."""
    t = F.upper(strip(F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("UNKNOWN"))))
    t = F.btrim(F.regexp_replace(t, "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("UNKNOWN"))


def norm_answer(c: Column | str, kind: str = "mcq") -> Column:
    """Comparable answer: upper case and trimmed; for choices also the comma list tidied."""
    t = F.upper(strip(F.coalesce(_col(c), F.lit(""))))
    if kind == "tf":
        return t
    return F.array_join(F.filter(F.transform(F.split(t, ","), strip), lambda p: p != ""), ",")


def norm_ident(c: Column | str) -> Column:
    """Comparable table or column name."""
    return F.lower(F.btrim(strip(F.coalesce(_col(c), F.lit(""))), F.lit('"')))


def wrap_reasoning(answer: Column | str, reasoning: Column | str) -> Column:
    """Put the reasoning text, if any, in front of the answer as a think block."""
    answer, reasoning = _col(answer), _col(reasoning)
    wrapped = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), answer)
    return F.when(F.coalesce(reasoning, F.lit("")) == "", answer).otherwise(wrapped)


def unwrap_reasoning(c: Column | str) -> Column:
    """Delete the two think markers, keep the text between them."""
    t = F.replace(_col(c), F.lit("<think>\n"), F.lit(""))
    return F.replace(t, F.lit("\n</think>\n\n"), F.lit(""))
