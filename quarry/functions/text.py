"""String column functions with exact Python string semantics.

Patterns use only syntax shared by Java regex and RE2 so that the same
pattern text can be used in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as K

# Characters Python's str.strip() / str.split() treat as whitespace.
WS_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STRIP_RE = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"
RSTRIP_RE = rf"{WS_CLASS}+\z"
NON_BLANK_RE = rf"[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"


def py_strip(c: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(c, STRIP_RE, "")


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, RSTRIP_RE, "")


def is_blank(c: Column) -> Column:
    """``not s.strip()`` (NULL stays NULL)."""
    return ~c.rlike(NON_BLANK_RE)


def splitlines(c: Column) -> Column:
    """``str.splitlines()``: no trailing empty line, empty text gives []."""
    parts = F.split(c, LINE_BREAK, -1)
    trimmed = F.when(
        F.regexp_extract(c, rf"(?:{LINE_BREAK})\z", 0) != "",
        F.slice(parts, 1, F.size(parts) - 1),
    ).otherwise(parts)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def normalize_newlines(c: Column) -> Column:
    r"""Text-mode read: ``\r\n`` and ``\r`` become ``\n``."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def truncate(c: Column, limit: int, notice: str) -> Column:
    """First ``limit`` characters plus ``notice`` when longer, else unchanged."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(notice))) \
        .otherwise(c)


def truncate_payload(c: Column) -> tuple[Column, Column]:
    """(payload, was_truncated) with the 15,000-character limit."""
    flag = F.length(c) > K.MAX_PAYLOAD_CHARS
    return truncate(c, K.MAX_PAYLOAD_CHARS, K.PAYLOAD_TRUNCATION_NOTICE), flag
