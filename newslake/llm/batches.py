"""Problem 7: new batches of titles held against everything accepted, by a segment index for edit distance.

A title becomes a *form*: site labels gone, marks and invisible characters gone, its distinct words and figures sorted, so
moved phrases and all formatting vanish. Equal forms are one class. A class's *anchor* is the string of what a story
keeps: its names and uncommon words, without those that are within two edits of a common plain word (misspellings of it).

The index holds each anchor cut into a fixed number of segments, stored by figures, length, position and text. A batch
probes it with the substrings of its anchors that may match a segment: by pigeonhole two anchors within SLIPS edits share
one. An anchor's own uncommon words may also be new (a synonym, a further name), so it probes with up to MOST_NEW of them
left out. Candidates are verified: the same figures, the same common names, a bounded number of other words replaced, added
or dropped, and each uncommon word of the accepted title in the new one or within SLIPS edits of a word there. Then the
batch's segments are appended. Labels, common words and names are learned from what was accepted first and kept with the index, so
a batch costs one read of the index's keys and no look at any accepted text.

The segments are cut from the anchor, not from the running text: replaced, dropped and moved phrases of one story are up
to half its characters, and segments of so many edits would be shorter than a word. Titles without any anchor are posted
under their rarest words, misspellings corrected, as many as a title of two thirds the same words must share one of; two
such titles are one story only if so many are the same. No list is capped.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import letters, site
from newslake.llm.lines import DASHES, count_lines, repeated, title_rows, with_found
from newslake.session import cut, small

#: Words in at least this share of all forms are common; at most (words a form) / share of them can exist, so their list is small.
COMMON_SHARE = 0.0002
COMMON_LEAST = 8
#: Of its appearances inside a sentence, the share with a capital that makes a common word a name.
NAME_SHARE = 0.8
#: Words of the shorter and of the longer list of differing words of two forms of one story, at most.
MOST_REPLACED = 4
MOST_ADDED = 9
#: Uncommon words a new title may have that the accepted one lacks.
MOST_NEW = 2
#: Edits of an anchor, and of a misspelt word. An anchor has one segment more.
SLIPS = 2
#: A short piece is a section heading if it stands at this share of the sites that have pieces, and in this share of their titles: at most (pieces a title) / share.
SECTION_SITES, SECTION_ROWS, SECTION_LEAST = 0.004, 0.0005, 4
SECTION_WORDS = 3
#: Batch keys are broadcast to the index up to this many; beyond, the join shuffles.
BROADCAST_KEYS = 400_000
#: Appended batches after which the index is written anew, in one piece.
COMPACT_EVERY = 32
#: Distinct words that a task holds while counting.
MOST_HELD = 200_000

_CLASS = "form string, first_id bigint, figs string, names string, anchor string, loose array<string>, rare array<string>, keys array<bigint>, probes array<bigint>"
_SOFT = re.compile("­")
_BREAKS = re.compile(r"[^\w]+|_+")
_LEAD = re.compile(r"(?:^|[|:.?!–—-] )[\W\d_]*[^\W\d_]+")


@dataclass(frozen=True)
class Stored:
    """The index with what it was made with: site labels (tbl, source, line), section headings, and the common words."""

    posted: DataFrame
    labels: DataFrame
    heads: frozenset[str] = frozenset()
    words: dict[str, bool] = field(default_factory=dict)  # bounded by COMMON_SHARE
    plain: frozenset[str] = frozenset()  # words that batches since then made common, no names
    batches: int = 0


def known_labels(titles: DataFrame, site_labels: DataFrame | None = None) -> tuple[DataFrame, frozenset[str]]:
    """Per-site labels (tbl, source, line) and section headings, learned from the pieces of `titles` (row_id, domain, title).

    Labels are the lines that problem 5 finds, and the pieces of `site_labels` (domain, tail). Headings are pieces that
    stand at SECTION_SITES of all sites and in SECTION_ROWS of all titles, so there are at most (pieces a title) / share.
    """
    counts = cut(count_lines(title_rows(titles)))
    labels = repeated(counts)
    if site_labels is not None:
        given = site_labels.select(F.lit("headlines").alias("tbl"), site(F.col("domain")).alias("source"), F.explode(F.split("tail", DASHES)).alias("p"))
        labels = labels.unionByName(given.select("tbl", "source", letters(F.col("p")).alias("line")).where("line <> '' and source is not null")).distinct()
    all_ = counts.where("line is null").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sites")).first()
    at_sites, in_rows = max(SECTION_LEAST, SECTION_SITES * all_.sites), max(SECTION_LEAST, SECTION_ROWS * (all_.rows or 0))
    heads = counts.where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n")).where((F.col("sites") >= at_sites) & (F.col("n") >= in_rows))
    return labels, frozenset(r.line for r in heads.select("line").collect())


def _words(text: str) -> list[str]:
    return [w for w in _BREAKS.split(text) if w]


def forms(titles: DataFrame, labels: DataFrame, heads: frozenset[str]) -> DataFrame:
    """(row_id, text, form): titles without labels as distinct sorted words. Blank or null titles have no form and are left out.

    A piece is a label if it is known, or if it is short and names the site itself; the longest piece never is.
    """
    schema = pa.schema([("row_id", pa.int64()), ("text", pa.string()), ("form", pa.string())])

    def one(source: str, parts: list[str], found: set[str]) -> tuple[str, str]:
        longest = max(map(len, parts))
        stem = re.match(r"[^\W\d_]*", source)[0].upper()
        kept = []
        for p in parts:
            if len(p) < longest:
                key, n = "".join(filter(str.isalpha, p)).upper(), p.strip().count(" ") + 1
                if key in found or (n <= SECTION_WORDS and key in heads) or (n <= 5 and stem and key.startswith(stem)):
                    continue
            kept.append(p)
        text = _SOFT.sub("", " | ".join(kept))
        return text, " ".join(sorted(set(_words(text.lower()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, parts, found = (c.to_pylist() for c in b.columns)
            out = [(i, *one(s, p, set(f or ()))) for i, s, p, f in zip(ids, sources, parts, found)]
            out = [x for x in out if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), ()), schema.types)], schema=schema)

    rows = with_found(title_rows(titles).where("parts is not null"), labels)
    return rows.select(F.col("id").cast("long").alias("id"), "source", "parts", "_found").mapInArrow(run, "row_id bigint, text string, form string")


def classes(formed: DataFrame) -> DataFrame:
    """(form, first_id, text): each distinct form once, with its smallest id and that row's text. Counts are combined before the shuffle."""
    return formed.groupBy("form").agg(F.min("row_id").alias("first_id"), F.min_by("text", "row_id").alias("text"))


def _cased(text: str) -> list[str]:
    """The distinct words inside the sentences of a title that is written with ordinary capitals."""
    ws = _words(text)
    if not ws or not ws[0][0].isupper():
        return []
    upper = [w for w in ws if w[0].isupper()]
    if len(upper) >= sum(w[0].islower() for w in ws) or any(w[1:] != w[1:].lower() for w in ws):
        return []
    return [w for w in set(_words(_LEAD.sub(" ", text))) if w[0].isalpha()]


def lexicon(classed: DataFrame) -> dict[str, bool]:
    """The common words of all forms, and whether each is a name (capitals within sentences)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inside, capital = Counter(), Counter(), Counter()

        def given() -> pa.RecordBatch:
            keys = list(n | inside)
            return pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.string()), "n": pa.array([n[k] for k in keys], pa.int64()), "inside": pa.array([inside[k] for k in keys], pa.int64()), "capital": pa.array([capital[k] for k in keys], pa.int64())})

        for b in batches:
            for form, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update(form.split(" "))
                cased = _cased(text)
                inside.update(map(str.lower, cased))
                capital.update(w.lower() for w in cased if w[0].isupper())
            if len(n) > MOST_HELD:
                yield given()
                n, inside, capital = Counter(), Counter(), Counter()
        yield given()

    per = classed.select("form", "text").mapInArrow(count, "word string, n bigint, inside bigint, capital bigint")
    per = per.groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum("capital").alias("capital"))
    common = per.where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * classed.count())).where(~F.col("word").rlike(r"^\p{N}"))
    return {r.word: bool(r.inside and r.capital >= r.inside * NAME_SHARE) for r in common.collect()}


def edits(a: str, b: str, most: int = SLIPS) -> int:
    """The edit distance of two strings, or `most` + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        before = row
    return min(before[-1], most + 1)


def cuts(n: int, slips: int = SLIPS) -> list[tuple[int, int]]:
    """(start, length) of the `slips` + 1 segments of a string of length n, as even as can be, the longer ones last."""
    k = slips + 1
    short, size = k - n % k, n // k
    out, at = [], 0
    for i in range(k):
        length = size + (i >= short)
        out.append((at, length))
        at += length
    return out


def substrings(text: str, slips: int = SLIPS) -> Iterator[tuple[int, int, str]]:
    """(length, segment, substring): the substrings of `text` that a string within `slips` edits may have as a segment.

    Of the segments left of a first match at most that many edits lie, and of those right of it the rest: this bounds the
    places of a substring on both sides.
    """
    n = len(text)
    for size in range(max(n - slips, 1), n + slips + 1):
        for i, (start, length) in enumerate(cuts(size, slips)):
            right = start + n - size
            for p in range(max(0, start - i, right - (slips - i)), min(n - length, start + i, right + slips - i) + 1):
                yield size, i, text[p : p + length]


def _letters(word: str) -> int:
    """The set of letters of a word, as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=2)
def _worker_slips(words: tuple[str, ...]) -> Slips:
    """One for the tasks of a Python worker."""
    return Slips(dict.fromkeys(words, False))


class Slips:
    """The common plain word that a word is a misspelling of, or '': found by a segment index over these words, the nearest first."""

    def __init__(self, words: dict[str, bool]):
        self.by: dict[tuple[int, int, str], list[tuple[str, int]]] = {}
        self.memo: dict[str, str] = {}
        for w in (w for w, name in words.items() if not name):
            for i, (start, length) in enumerate(cuts(len(w))):
                self.by.setdefault((len(w), i, w[start : start + length]), []).append((w, _letters(w)))

    def __call__(self, word: str) -> str:
        got = self.memo.get(word)
        if got is None:
            own = _letters(word)  # an edit adds or takes one letter each, at most
            near = {w for key in substrings(word) for w, has in self.by.get(key, ()) if (own ^ has).bit_count() <= 2 * SLIPS} if len(word) > SLIPS + 1 else ()
            n, got = min(((edits(word, w), w) for w in near), default=(SLIPS + 1, ""))
            got = got if n <= SLIPS else ""
            if len(self.memo) > MOST_HELD:
                self.memo.clear()
            self.memo[word] = got
        return got


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _posts(figs: str, anchor: str) -> list[int]:
    return [_key(figs, len(anchor), i, anchor[s : s + n]) for i, (s, n) in enumerate(cuts(len(anchor)))]


def _probes(figs: str, fixed: list[str], free: list[str]) -> list[int]:
    """The keys an anchor probes: its substrings, and the first segment of what is left of it without some of its free words."""
    anchor = " ".join(sorted(fixed + free))
    out = {_key(figs, *x) for x in substrings(anchor)}
    for k in range(1, MOST_NEW + 1):
        for gone in combinations(range(len(free)), k):
            rest = sorted(fixed + [w for i, w in enumerate(free) if i not in gone])
            if rest:
                out.add(_posts(figs, " ".join(rest))[0])
    return list(out)


def _rarest(figs: str, words: list[str], known: dict[str, bool]) -> list[int]:
    """Keys of a title without an anchor: its uncommon words first, then by length, as many as leave fewer than two thirds out."""
    if not words:
        return [_key(figs)]
    ranked = sorted(words, key=lambda w: (w in known, -len(w), w))
    return [_key(figs, "word", w) for w in ranked[: len(ranked) - -(-2 * len(ranked) // 3) + 1]]


def segmented(classed: DataFrame, words: dict[str, bool], plain: frozenset[str] = frozenset(), probing: bool = True) -> DataFrame:
    """`classed` with figs, names, anchor, rare (uncommon words), the keys of its segments and, with `probing`, those it probes with.

    An uncommon word is no part of the anchor if it is in `plain`, or in lower case within a title of ordinary capitals.
    """
    known = classed.sparkSession.sparkContext.broadcast((words, plain))
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names_ = ["form", "first_id", "figs", "names", "anchor", "loose", "rare", "keys", "probes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ordinary = known.value
        slip = _worker_slips(tuple(w for w, name in common.items() if not name))
        for b in batches:
            out = []
            for form, first, text in zip(*(c.to_pylist() for c in b.columns)):
                ws = form.split(" ")
                figs = " ".join(w for w in ws if w[0].isnumeric())
                rest = [w for w in ws if not w[0].isnumeric()]
                names, odd = [w for w in rest if common.get(w)], [w for w in rest if w not in common]
                lower = {w for w in _cased(text) if w[0].islower()} | ordinary if odd else ()
                rare = [w for w in odd if w not in lower]
                free = [w for w in rare if not slip(w)]
                anchor = " ".join(sorted(names + free))
                loose = None if names else sorted({(slip(w) if w in odd else "") or w for w in rest if w not in free})
                # What counts as ordinary is known of a title by its capitals; one without them has all its uncommon words.
                whole = " ".join(sorted(names + [w for w in odd if not slip(w)])) if len(rare) < len(odd) else anchor
                keys, probes = {_key("form", form)}, set()
                if anchor:
                    keys.update(_posts(figs, anchor))
                if whole != anchor:
                    keys.update(_posts(figs, whole))
                if loose is not None and not anchor:
                    keys.update(_rarest(figs, loose, common))
                if probing:
                    probes.update(keys, _probes(figs, names, free) if anchor else (), _probes(figs, [whole], []) if whole != anchor else (), _rarest(figs, loose, common) if loose is not None else ())
                out.append((form, first, figs, " ".join(names), anchor, loose, rare, list(keys), list(probes)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 9, types)], names=names_)

    return classed.select("form", "first_id", "text").mapInArrow(run, _CLASS)


def probe(posted: DataFrame, batch: DataFrame) -> DataFrame:
    """(form, first_id): for each class of the batch (`segmented`) the smallest id of an equal or verified class of the index, where there is one.

    The batch's keys meet the index's in one pass over its keys; a batch too large to be broadcast is joined by a shuffle.
    """
    b = small(cut(batch.select(F.explode("probes").alias("key"), F.col("form").alias("b"), F.col("figs").alias("b_figs"), F.col("names").alias("b_names"), F.col("loose").alias("b_loose"), F.col("rare").alias("b_rare"))), BROADCAST_KEYS)
    a = posted.select(F.explode("keys").alias("key"), F.col("form").alias("a"), F.col("first_id").alias("a_id"), "figs", "names", F.col("loose").alias("a_loose"), F.col("anchor").alias("a_anchor"), F.col("rare").alias("a_rare"))
    pairs = a.join(b, "key").where("figs = b_figs and names = b_names")
    return pairs.where((F.col("a") == F.col("b")) | _same_story()).groupBy(F.col("b").alias("form")).agg(F.min("a_id").alias("first_id"))


def _same_story() -> Column:
    """Bounded edits between two forms with the same figures and common names."""
    wa, wb = F.split("a", " "), F.split("b", " ")
    ao, bo = F.array_except(wa, wb), F.array_except(wb, wa)
    odd_a, odd_b = F.array_except("a_rare", wb), F.array_except("b_rare", wa)
    few = (F.least(F.size(ao), F.size(bo)) <= MOST_REPLACED) & (F.greatest(F.size(ao), F.size(bo)) <= MOST_ADDED) & (F.size(F.array_intersect(wa, wb)) * 2 >= F.least(F.size(wa), F.size(wb)))
    few &= (F.col("a_anchor") != "") | (F.size(F.array_intersect("a_loose", "b_loose")) * 3 >= F.greatest(F.size("a_loose"), F.size("b_loose")) * 2)

    def slips(odd: Column, other: Column, names: str) -> Column:
        near = lambda x, y: (F.levenshtein(x, y, SLIPS) >= 0) & ~F.array_contains(F.col(names), y)
        return F.filter(odd, lambda x: ~F.exists(other, lambda y: near(x, y)))

    # What the accepted title names, the new one names too; the new one may hold a few words nobody else uses.
    return few & (F.size(slips(odd_a, bo, "b_rare")) == 0) & (F.size(slips(odd_b, ao, "a_rare")) <= MOST_NEW)


def store(titles: DataFrame, site_labels: DataFrame | None = None) -> Stored:
    """The index of the titles (row_id, domain, title) accepted so far, with the labels and words learned from them."""
    rows = titles.select("row_id", "domain", "title").where("row_id is not null")
    labels, heads = known_labels(rows, site_labels)
    labels = cut(labels)
    classed = cut(classes(forms(rows, labels, heads)))
    words = lexicon(classed)
    return Stored(cut(segmented(classed, words, probing=False).drop("probes")), labels, heads, words)


def check_batch(stored: Stored, titles: DataFrame) -> tuple[DataFrame, Stored]:
    """((kept_id, in_id), the index with the batch): one batch (row_id, domain, title) against the stored index, without its history.

    Ids of the batch lie above all ids of the index. A row's story may have been told by the index or earlier in the batch.
    """
    formed = cut(forms(titles.select("row_id", "domain", "title").where("row_id is not null"), stored.labels, stored.heads))
    classed = cut(classes(formed))
    plain = stored.plain | {w for w, name in lexicon(classed).items() if not name and w not in stored.words}
    batch = cut(segmented(classed, stored.words, plain))
    after = stored.posted.unionByName(batch.drop("probes"))
    n = stored.batches + 1
    first = probe(after, batch)
    found = cut(formed.join(first, "form").where("first_id < row_id").select(F.col("first_id").alias("kept_id"), F.col("row_id").alias("in_id")))
    return found, replace(stored, posted=after if n % COMPACT_EVERY else cut(after), plain=plain, batches=n)


def known_stories(headlines: DataFrame, incoming: DataFrame, site_labels: DataFrame | None = None) -> DataFrame:
    """(kept_id, in_id): rows of `incoming` whose story an earlier row told, with the first such row.

    Each batch in turn goes through `check_batch` on the index of `headlines`, whose labels and words are kept as they are.
    Rows without batch arrive last. Blank titles tell nothing. Rows that only repeat one another are one class each.
    """
    stored, out = store(headlines, site_labels), []
    late = F.coalesce(F.col("batch").cast("long"), F.lit(1 << 62))
    for k in sorted(r.k for r in incoming.select(late.alias("k")).distinct().collect()):
        found, stored = check_batch(stored, incoming.where(late == k))
        out.append(found)
    empty = headlines.sparkSession.createDataFrame([], "kept_id bigint, in_id bigint")
    return reduce(DataFrame.unionByName, out, empty).distinct()
