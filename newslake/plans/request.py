"""Search requests: validation, the parts of the archive they read, canonical form, cursors and compare series."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from urllib.parse import urlencode

from newslake.functions.fold import query_words

# Limits and dates of the service.
PAGE, WINDOW, MAX_SKIP, MAX_DOMAINS, MAX_SERIES = 100, 1000, 10_000, 10, 6
MAX_QUERY, MAX_GROUPS, MAX_WORDS = 200, 8, 8
FIRST_DAY, LAST_DAY, UNIFIED_START = dt.date(2019, 10, 1), dt.date(2100, 1, 1), dt.date(2026, 9, 1)
SOURCES = ("gdelt", "feeds", "blogs")
# What the service answers to a wrong request.
SAYS = {
    "long": "query too long",
    "short": "query must be at least two characters",
    "words": "no words to search for",
    "many_groups": "at most eight alternatives",
    "many_words": "at most eight words",
    "many_sites": f"at most {MAX_DOMAINS} sources",
    "site": "a source is a site name like bbc.com",
    "date": "dates are YYYY-MM-DD",
    "range": "from is after to",
    "cursor": "before/after is a timestamp like 20260911183000",
    "src": "src is some of gdelt, feeds, blogs",
}


@dataclass(frozen=True)
class Part:
    """A range of days on one table."""

    first: dt.date
    last: dt.date
    unified: bool


@dataclass(frozen=True)
class Request:
    q: str = ""
    mode: str = "word"
    groups: tuple[tuple[str, ...], ...] = ()
    first: dt.date = FIRST_DAY
    last: dt.date = LAST_DAY
    domains: tuple[str, ...] = ()
    newest: bool = True
    cursor: dt.datetime | None = None
    skip: int = 0
    src: tuple[str, ...] = field(default=("gdelt",))

    @property
    def mixed(self) -> bool:
        return self.src != ("gdelt",)

    @property
    def both_news(self) -> bool:
        return {"gdelt", "feeds"} <= set(self.src)

    def canonical(self) -> str:
        """One string for all spellings of a request: a cache key."""
        own = {"q": self.q, "mode": self.mode, "from": self.first, "to": self.last, "domain": ",".join(self.domains), "newest": self.newest, "cursor": self.cursor or "", "skip": self.skip}
        return urlencode(own | ({"src": ",".join(self.src)} if self.mixed else {}))

    def parts(self, start: dt.date = UNIFIED_START) -> list[Part]:
        """Oldest first: the plain table alone, or it before `start` (if asked for) and the unified one from then on."""
        if not self.mixed:
            return [Part(self.first, self.last, False)]
        old = [Part(self.first, min(self.last, start - dt.timedelta(days=1)), False)] if "gdelt" in self.src and self.first < start else []
        new = [Part(max(self.first, start), self.last, True)] if self.last >= start else []
        return old + new

    def reading(self, start: dt.date = UNIFIED_START) -> list[tuple[Part, int]]:
        """The parts that a page reads, in its order, with the rows to pass over: those before the cursor's day are left out, its own part has the skip."""
        day = self.cursor.date() if self.cursor else None
        parts = self.parts(start)[:: -1 if self.newest else 1]
        if day is None:
            return [(p, 0) for p in parts]
        left = [p for p in parts if (p.first <= day if self.newest else p.last >= day)]
        return [(p, self.skip if p.first <= day <= p.last else 0) for p in left]

    def without_paging(self) -> Request:
        return replace(self, cursor=None, skip=0)


def _day(text: str, default: dt.date) -> dt.date:
    if not text:
        return default
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(SAYS["date"])
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise ValueError(SAYS["date"]) from None


def _stamp(text: str) -> dt.datetime | None:
    if not text:
        return None
    try:
        if re.fullmatch(r"\d{14}", text):
            return dt.datetime.strptime(text, "%Y%m%d%H%M%S")
    except ValueError:
        pass
    raise ValueError(SAYS["cursor"])


def parse(p: dict[str, str], totals: bool = False) -> Request:
    """A request from its parameters; ValueError says what is wrong with them. `totals` ignores the term."""
    q = "" if totals else p.get("q", "").strip()
    if len(q) > MAX_QUERY:
        raise ValueError(SAYS["long"])
    if len(q) == 1:
        raise ValueError(SAYS["short"])
    domains = tuple(sorted({x.strip() for x in p.get("domain", "").lower().split(",")} - {""}))
    if len(domains) > MAX_DOMAINS:
        raise ValueError(SAYS["many_sites"])
    if any(len(x) > 100 or re.search(r"[^a-z0-9.-]", x) for x in domains):
        raise ValueError(SAYS["site"])
    mode = "substring" if p.get("mode") == "substring" else "word"
    raw = re.split(r"(?:(?<=\s)|^)OR(?=\s|$)", q) if mode == "word" else [q]
    groups = tuple(g for g in (tuple(query_words(x)) for x in raw) if g) if q else ()
    if q and mode == "word" and not groups:
        raise ValueError(SAYS["words"])
    if len(groups) > MAX_GROUPS:
        raise ValueError(SAYS["many_groups"])
    if any(len(g) > MAX_WORDS for g in groups):
        raise ValueError(SAYS["many_words"])
    first, last = _day(p.get("from", ""), FIRST_DAY), _day(p.get("to", ""), LAST_DAY)
    if first > last:
        raise ValueError(SAYS["range"])
    newest = p.get("sort") != "oldest"
    given = [x.strip() for x in (p.get("src") or "gdelt").lower().split(",") if x.strip()]
    if not given or set(given) - set(SOURCES):
        raise ValueError(SAYS["src"])
    cursor = _stamp(p.get("before" if newest else "after", ""))
    skip = min(max(int(m[0]) if (m := re.match(r"\s*-?\d+", p.get("skip", ""))) else 0, 0), MAX_SKIP) if cursor else 0
    return Request(q, mode, groups, first, last, domains, newest, cursor, skip, tuple(x for x in SOURCES if x in given))


def series(text: str, base: Request) -> Request:
    """One line of a comparison: words with `site:a,b` and `in:src` anywhere among them."""
    sites = ",".join(re.findall(r"(?:^|\s)site:(\S+)", text))
    src = ",".join(re.findall(r"(?:^|\s)in:(\S+)", text)) or ",".join(base.src)
    words = " ".join(w for w in text.split() if not w.startswith(("site:", "in:")))
    return parse({"q": words, "mode": base.mode, "domain": sites, "src": src, "from": str(base.first), "to": str(base.last)})


def shifted(first: dt.date, last: dt.date, by: int) -> tuple[dt.date, dt.date]:
    """The range of equal length before (-1) or after (1) a range of days."""
    step = dt.timedelta(days=((last - first).days + 1) * by)
    return first + step, last + step


def source_name(text: str) -> str:
    """A bare site name from what a user types: no scheme, `www.`, path or case."""
    return re.sub(r"^(?:https?://)?(?:www\.)?", "", text.strip().lower()).split("/")[0]


def windows(first: dt.date, last: dt.date, months: int = 12) -> list[tuple[dt.date, dt.date]]:
    """Windows of whole months, newest first, cut from the newest end."""
    out, end = [], last
    while end >= first:
        m = end.year * 12 + end.month - 1 - (months - 1)
        begin = max(first, dt.date(m // 12, m % 12 + 1, 1))
        out.append((begin, end))
        end = begin - dt.timedelta(days=1)
    return out
