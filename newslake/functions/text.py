"""Names, urls and text keys as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = r"[\u200b\u200c\u200d\u2060\ufeff]"
SPACES = r"[\s\u0085\u001c-\u001f\p{Z}]+"


def site(domain: Column) -> Column:
    """The domain without letter case, one leading `www.` and one trailing dot; null stays null."""
    return F.regexp_replace(F.lower(F.trim(domain)), r"^www\.|\.$", "")


def page(url: Column) -> Column:
    """The url in lower case without scheme, then a leading `www.`, then trailing slashes; null stays null."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", "")


def same_text(text: Column) -> Column:
    """Letters and digits of a text in order, without case: equal keys mean the same text. Blank gives ''; null stays null."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def letters(text: Column) -> Column:
    """Letters of a text in order, without case."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}]+", ""))


def squeezed(text: Column) -> Column:
    """Each run of white space (line breaks and no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def seconds(ts: Column) -> Column:
    """Whole epoch seconds (UTC) of a timestamp with or without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def moment(at) -> Column:  # noqa: ANN001
    """A literal timestamp without zone, so that comparisons with such columns reach the scan."""
    return F.lit(str(at)).cast("timestamp_ntz")
