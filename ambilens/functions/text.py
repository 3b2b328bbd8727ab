"""Text functions: strip, blank test, translation cleanup, answer parsing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.strip() removes. Spark's plain
# trim() removes U+0020 only.
WHITESPACE_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(chr(point) for point in WHITESPACE_CODE_POINTS)

# Word characters as Python's \w sees them; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"

NOTE_MARKER = "Note: "

_TO_END = 2**31 - 1


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    Catalyst copies an expression to each of its uses; inside lambda functions the
    copies are not shared again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.trim(as_column(text), F.lit(WHITESPACE))


def is_blank(text: Column | str) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_translation(text: Column | str) -> Column:
    """First line of a generated translation without closing quote and note.

    Strip the text and drop one closing quote; where lines remain, keep the first
    and drop one closing quote of it; cut at the first note marker; strip after
    each step. Null (not a text) gives the empty string.

    Only the first line is worked on. Of the lines after it one thing matters: if
    they hold a lone quote and nothing else, that was the closing quote, and the
    first line keeps its own.
    """
    blank = F.lit(WHITESPACE)
    lines = F.split(F.ltrim(as_column(text), blank), "\n", 2)
    first = F.rtrim(F.get(lines, F.lit(0)), blank)
    rest = F.ltrim(F.get(lines, F.lit(1)), blank)
    after_quote = F.ltrim(F.substring(rest, 2, _TO_END), blank)
    lone_quote = F.startswith(rest, F.lit('"')) & (after_quote == "")
    unquoted = strip(F.regexp_replace(first, r'"\z', ""))
    line = F.when(lone_quote, first).otherwise(unquoted)
    return F.coalesce(strip(F.substring_index(line, NOTE_MARKER, 1)), F.lit(""))


def token_choice(token: Column | str, choices: Sequence[str]) -> Column:
    """The choice a token spells once stripped, else null."""
    stripped = strip(token)
    return F.when(stripped.isin(list(choices)), stripped)


def parse_answer(response: Column | str, choices: Sequence[str]) -> Column:
    """Last choice that stands alone in the response, else null.

    Words are what lies between other characters. A response that is nothing but a
    choice counts too, whatever its characters.
    """
    response = as_column(response)
    if all(re.fullmatch(r"\w+", choice) for choice in choices):
        words = F.split(response, f"[^{WORD[1:-1]}]+")
        alone = F.filter(words, lambda word: word.isin(list(choices)))
    else:  # choices with other characters lie across such words
        longest_first = sorted(map(quoted, choices), key=len, reverse=True)
        pattern = f"(?<!{WORD})(?:{'|'.join(longest_first)})(?!{WORD})"
        alone = F.regexp_extract_all(response, F.lit(pattern), F.lit(0))
    return F.coalesce(F.try_element_at(alone, F.lit(-1)), token_choice(response, choices))


def quoted(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)
