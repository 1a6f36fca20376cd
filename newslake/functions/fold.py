"""Search folding: case, accents and special letters away, as a Catalyst expression, and its Python twin for queries."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition, and what they fold to.
SINGLE = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe"}


@lru_cache(maxsize=1)
def _pairs() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base letter and marks, with that letter (Hangul stays composed)."""
    src, dst = [], []
    for c in range(0x80, 0xFFFF):
        ch = chr(c)
        parts = [x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"]
        if len(parts) == 1 and parts[0] != ch and ch == ch.lower() and not 0xAC00 <= c < 0xD7B0:
            src.append(ch)
            dst.append(parts[0])
    return "".join(src) + "".join(SINGLE), "".join(dst) + "".join(SINGLE.values())


def fold(text: Column) -> Column:
    """Invalid UTF-8 replaced, lower case, composed letters to their base, combining marks dropped, special letters spelt out; null stays null."""
    src, dst = _pairs()
    out = F.regexp_replace(F.translate(F.lower(F.make_valid_utf8(text)), src, dst), r"\p{Mn}", "")
    for a, b in DOUBLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_py(text: str) -> str:
    """`fold` for what a user types."""
    base = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    base = unicodedata.normalize("NFC", base)  # Hangul
    return "".join(SINGLE.get(c, DOUBLE.get(c, c)) for c in base)


def tokens(folded: Column) -> Column:
    """Tokens of the index: runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.filter(F.split(folded, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def fragments(text: str, least: int = 4) -> list[str]:
    """The folded runs of letters and digits of a substring pattern, long ones only: every match has them all."""
    return [w for w in query_words(text.lower()) if len(w) >= least]


def query_words(text: str) -> list[str]:
    """Words of a query: runs of letters and digits of any script, folded; marks alone vanish."""
    return [w for w in (fold_py(w) for w in re.findall(r"[^\W_]+", text)) if w]
