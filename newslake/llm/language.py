"""Problem 1: the language of every document and of every stretch of a mixed one, by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. Parsing a segment against it, always taking the longest
match, gives a number of phrases; the language that needs the fewest (normalised by the segment's length) wins, and the
distance to the second gives the confidence. Languages compete only with those of the same script.

The automata are dense transition tables over folded letters (missing transitions lead to the root's and carry a
phrase mark), so all segments of an Arrow batch are parsed in lockstep, one numpy gather a symbol for all languages.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import letters, site
from newslake.llm.lines import count_lines, repeated, with_found
from newslake.session import cut

#: Labelled documents a language, about, from which the automata are fitted (drawn by a hash of the id).
FIT_ROWS = 400
#: Folded symbols a language in its automaton, at most.
FIT_SYMBOLS = 24_000
#: A segment is new to an automaton if its phrases are shorter than this on average.
NOVEL = 14
CHUNK = 400
SYMBOLS = 32
#: Letters a segment needs to stand for itself; shorter ones count for no language.
LEAST_LATIN, LEAST_OTHER = 24, 8
#: Confidence from which a segment adds a language of its own to a document.
SURE = 0.2
#: A line standing at several sites and in this share of all documents is nobody's content; at most (lines a row) / share lines can be.
COMMON_SHARE = 0.0003
#: Characters classified at a time, about; bounds a worker's memory.
SLICE = 400_000
#: A segment of a script of one language is of another one if it needs this many times the phrases that 99 % of held-out text needs.
REJECT = 1.4
_PHRASE = 1 << 30

# ISO 639-1 codes with their ISO 639-2/3 codes and English names.
CODES = """
ar ara arabic; bg bul bulgarian; bn ben bengali; ca cat catalan; cs ces cze czech; da dan danish; de deu ger german; el ell gre greek;
en eng english; es spa spanish; et est estonian; fa fas per persian; fi fin finnish; fr fra fre french; he heb hebrew; hi hin hindi;
hr hrv croatian; hu hun hungarian; id ind indonesian; it ita italian; ja jpn japanese; ko kor korean; lt lit lithuanian; lv lav latvian;
ms msa may malay; nl nld dut dutch; no nor norwegian; pl pol polish; pt por portuguese; ro ron rum romanian; ru rus russian; sk slk slo slovak;
sl slv slovenian; sr srp serbian; sv swe swedish; ta tam tamil; te tel telugu; th tha thai; tr tur turkish; uk ukr ukrainian; ur urd urdu;
vi vie vietnamese; zh zho chi chinese
"""
#: Tags that tell no language.
UNTOLD = ("und", "mul", "mis", "zxx", "unk", "nan")
_NAMES = {name: names[0] for names in (x.split() for x in CODES.split(";")) for name in names}


def iso(lang: Column) -> Column:
    """The ISO 639-1 code of a language in any usual notation (`en-GB`, `eng`, `English`, `EN_us`); null for a missing one.

    The table only brings notations together: a tag of two or three letters that it lacks is a language of its own.
    """
    first = F.element_at(F.split(F.lower(F.trim(lang)), r"[-_]"), 1)
    known = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))[first]
    return F.coalesce(known, F.when(first.rlike("^[a-z]{2,3}$") & ~first.isin(*UNTOLD), first))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: symbol (0: none), script (0: none) and kind of sentence end (1: before white space, 2: anywhere)."""
    size = 0x110000
    sym, script, end = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    kinds: dict[str, int] = {"LATIN": 1, "CJK": 2, "HIRAGANA": 2, "KATAKANA": 2, "KATAKANA-HIRAGANA": 2}
    for c in [*range(0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0xFFF0), 0x1F130]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] not in "LM":
            continue
        name = unicodedata.name(ch, "").split(" ")[0]
        if not name or name == "COMBINING" or kind == "Lm" and name == "MODIFIER":
            continue
        script[c] = kinds.setdefault(name, min(250, len(kinds) + 1))
        base = unicodedata.normalize("NFD", ch.lower())[0]
        odd = {"ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "a", "œ": "o", "ı": "i", "ħ": "h", "þ": "t", "ð": "d"}.get(base, base)
        sym[c] = ord(odd) - 96 if "a" <= odd <= "z" else 1 + (ord(base) * 2654435761 >> 8) % (SYMBOLS - 1)
    for lo, hi, kind in ((0x3400, 0xA000, 2), (0x20000, 0x32000, 2), (0xAC00, 0xD7B0, kinds.setdefault("HANGUL", len(kinds) + 1))):
        script[lo:hi] = kind
        sym[lo:hi] = 1 + (np.arange(lo, hi) * 2654435761 >> 8) % (SYMBOLS - 1)
    for ch in ".!?…":
        end[ord(ch)] = 1
    for ch in "。！？؟।۔":
        end[ord(ch)] = 2
    end[10] = 3
    return sym, script, end


@dataclass
class Segments:
    """Segments of a batch of texts: text number, place in code points, letters, script and parsed symbols."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    n: np.ndarray
    script: np.ndarray
    symbols: np.ndarray
    offset: np.ndarray
    length: np.ndarray


def segments(texts: list[str], keep: list[str] | None = None) -> Segments:
    """Texts cut at sentence ends, line breaks and changes of script; `keep` has a 0 for each line to pass over."""
    sym, script, ends = _tables()
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    s, k = script[cp], ends[cp]
    if keep is not None:
        on = np.frombuffer("".join(keep).encode(), np.uint8) != 48
        s = np.where(on[np.cumsum(cp == 10) - (cp == 10)], s, 0)
    letter = s > 0
    after = np.append(letter[1:], False) | np.append((cp[1:] >= 48) & (cp[1:] <= 57), False)
    at = np.zeros(len(cp), bool)
    at[1:] = ((k >= 2) | ((k == 1) & ~after))[:-1]
    where = np.flatnonzero(letter)
    if not len(where):
        z = np.zeros(0, np.int64)
        return Segments(z, z, z, z, z, z, z, z)
    turn = where[1:][s[where[1:]] != s[where[:-1]]]
    at[turn] = True
    # A long run without an end is cut every CHUNK letters.
    seg = np.cumsum(at)[where]
    spot = np.arange(len(where))
    first = np.maximum.accumulate(np.where(np.append(True, seg[1:] != seg[:-1]), spot, 0))
    at[where[(spot > first) & ((spot - first) % CHUNK == 0)]] = True
    seg = np.cumsum(at)[where]
    new = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    n = np.diff(np.append(new, len(seg)))
    start, last = where[new], where[new + n - 1]
    # Symbols: letters, and one 0 for each gap between letters of a segment.
    gap = np.append(False, (np.diff(where) > 1) & (seg[1:] == seg[:-1]))
    place = np.arange(len(where)) + np.cumsum(gap)
    symbols = np.zeros(len(where) + int(gap.sum()), np.uint8)
    symbols[place] = sym[cp[where]]
    offset = place[new]
    length = np.diff(np.append(offset, len(symbols)))
    text = np.searchsorted(begin, start, "right") - 1
    return Segments(text, start - begin[text], last + 1 - begin[text], n, s[start].astype(np.int64), symbols, offset, length)


class Automaton:
    """A suffix automaton that grows symbol by symbol."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbols: list[int]) -> None:
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for c in symbols:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.last = last

    def phrases(self, symbols: list[int]) -> int:
        """The number of longest matches that cover a sequence."""
        nxt, root = self.next, self.next[0]
        state, n = root, 0
        for c in symbols:
            to = state.get(c)
            if to is None:
                n += 1
                to = root.get(c)
                state = root if to is None else nxt[to]
            else:
                state = nxt[to]
        return n + (state is not root)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Its transitions, state by state: how many, on which symbols, to which states."""
        nxt = self.next
        return np.array([len(x) for x in nxt], np.uint8), np.fromiter((c for x in nxt for c in x), np.uint8), np.fromiter((to for x in nxt for to in x.values()), np.int32)


class _Flat:
    """Automata of several languages: packed where they travel, one dense table where they are used.

    table[state, symbol] is the next state, or, where there is none, the root's with a phrase mark.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts
        self.sizes = [len(p[0]) for p in parts]
        self.base = np.cumsum([0] + self.sizes[:-1])
        self._flat: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_flat": None}

    @property
    def flat(self) -> np.ndarray:
        if self._flat is None:
            out = np.empty((sum(self.sizes), SYMBOLS), np.int32)
            for (count, symbols, to), n, base in zip(self.parts, self.sizes, self.base.tolist()):
                root = np.full(SYMBOLS, base | _PHRASE, np.int32)
                root[symbols[: count[0]]] = (to[: count[0]] + base) | _PHRASE
                out[base : base + n] = root
                out[base + np.repeat(np.arange(n), count), symbols] = to + base
            self._flat = out.ravel()
        return self._flat


def phrases(tables: _Flat, seg: Segments, rows: np.ndarray) -> np.ndarray:
    """(rows, languages): the number of phrases each segment needs in each language, all parsed in lockstep."""
    turn = np.argsort(-seg.length[rows], kind="stable")
    length, offset = seg.length[rows][turn], seg.offset[rows][turn]
    state = np.repeat(tables.base[None, :], len(turn), 0)
    count = np.zeros((len(turn), len(tables.base)), np.int32)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    for t, m in enumerate(live.tolist()):
        x = tables.flat[state[:m] * SYMBOLS + seg.symbols[offset[:m] + t][:, None]]
        count[:m] += x >> 30
        state[:m] = x & (_PHRASE - 1)
    count += state != tables.base[None, :]
    out = np.empty_like(count)
    out[turn] = count
    return out


@dataclass
class Model:
    """By script: its languages and their stacked automata; for a script of one language also the most phrases a symbol that are still of it."""

    langs: dict[int, list[str]]
    tables: dict[int, _Flat] = field(default_factory=dict)
    limits: dict[int, float] = field(default_factory=dict)

    def classify(self, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
        """The language ('' unless there is one for the script) and confidence of each segment."""
        lang = np.full(len(seg.n), "", object)
        sure = np.zeros(len(seg.n))
        for script, names in self.langs.items():
            rows = np.flatnonzero(seg.script == script)
            if not len(rows):
                continue
            if len(names) == 1 and script not in self.tables:
                lang[rows], sure[rows] = names[0], 1.0
                continue
            c = phrases(self.tables[script], seg, rows)
            if len(names) == 1:  # another language of the script, one without labels, needs more phrases
                rate = c[:, 0] / np.maximum(seg.length[rows], 1) / self.limits[script]
                lang[rows] = np.where((rate > 1) & (seg.n[rows] >= LEAST_LATIN), "", names[0])
                sure[rows] = np.where(seg.n[rows] >= LEAST_LATIN, np.clip(2 - 2 * rate, 0.25, 1.0), 1.0)
                continue
            two = np.argpartition(c, 1, axis=1)[:, :2]
            best = c.argmin(1)
            low = np.take_along_axis(c, two, 1)
            lang[rows] = np.array(names, object)[best]
            sure[rows] = 1 - low.min(1) / np.maximum(low.max(1), 1)
        return lang, sure


def fit(labelled: list[tuple[str, str]], budget: int = FIT_SYMBOLS) -> Model:
    """A model of (language, text) pairs, some with wrong labels.

    Every language's automaton is built of half its segments and the other half is classified, and the other way round,
    twice; only segments that clearly get their own label go into the final automata. Of the scripts with a fifth of a language's
    letters its own is the one it has most of by comparison with the other languages, so wrong labels make no script its own.
    """
    langs = [x for x, _ in labelled]
    seg = segments([t for _, t in labelled])
    label = np.array(langs, object)[seg.text] if len(seg.n) else np.zeros(0, object)
    ok = seg.n >= np.where(seg.script == 1, LEAST_LATIN, LEAST_OTHER)
    by: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    votes: dict[bytes, Counter] = defaultdict(Counter)  # the same segment under several labels belongs to the commonest
    said = {i: seg.symbols[seg.offset[i] : seg.offset[i] + seg.length[i]].tobytes() for i in np.flatnonzero(ok).tolist()}
    for i, x in said.items():
        votes[x][label[i]] += 1
    for i, x in said.items():
        if label[i] == max(votes[x].items(), key=lambda v: (v[1], v[0]))[0]:
            by[int(seg.script[i])][label[i]].append(i)
    weight: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for script, per in by.items():
        for x, rows in per.items():
            weight[x][script] += int(seg.n[rows].sum())
    share = {x: {s: n / sum(w.values()) for s, n in w.items()} for x, w in weight.items()}
    usual = {s: sum(w.get(s, 0) for w in share.values()) / len(share) for s in by}
    homes = {x: {s for s, n in w.items() if n >= 0.8 and n >= 0.9 * usual[s]} | {max((s for s, n in w.items() if n >= 0.2), key=lambda s: w[s] / usual[s], default=0)} for x, w in share.items()}
    out = Model({})
    for script, per in by.items():
        names = sorted(x for x in per if script in homes[x])
        if not names:
            continue
        out.langs[script] = names
        if len(names) == 1:
            _with_limit(out, seg, script, per[names[0]], budget)
            continue
        kept = per
        for _ in range(2):
            kept = {x: rows for x, rows in _agreeing(seg, per, kept, [x for x in names if kept[x]], budget // 2).items()}
        names = [x for x in names if kept.get(x)]
        out.langs[script] = names
        if len(names) > 1:
            out.tables[script] = _Flat([_built(seg, kept[x], budget) for x in names])
    return out


def _with_limit(out: Model, seg: Segments, script: int, rows: list[int], budget: int) -> None:
    """A script of one language: its automaton, and a limit from held-out segments of it, REJECT times the rate that 99 % of them keep to."""
    long_ = [i for i in rows if seg.n[i] >= LEAST_LATIN]
    held = np.array([i for i in long_ if seg.text[i] % 2], np.int64)
    rest = [i for i in rows if seg.text[i] % 2 == 0]
    if len(held) < 20 or not rest:
        return
    tables = _Flat([_built(seg, rest, budget)])
    rate = phrases(tables, seg, held)[:, 0] / np.maximum(seg.length[held], 1)
    out.tables[script], out.limits[script] = tables, REJECT * float(np.quantile(rate, 0.99))


def _agreeing(seg: Segments, per: dict[str, list[int]], fit_on: dict[str, list[int]], names: list[str], size: int) -> dict[str, list[int]]:
    """Of each language's segments those that need clearly fewer phrases in it than in any other, each half judged by the other."""
    out: dict[str, list[int]] = {x: [] for x in per}
    if len(names) < 2:
        return {x: per[x] if x in names else [] for x in per}
    for half in (0, 1):
        tables = _Flat([_built(seg, [i for i in fit_on[x] if seg.text[i] % 2 == half], size) for x in names])
        for k, x in enumerate(names):
            test = np.array([i for i in per[x] if seg.text[i] % 2 != half], np.int64)
            if len(test):
                c = phrases(tables, seg, test)
                other = np.delete(c, k, 1).min(1)
                own = c[:, k] <= 0.85 * other
                # A text whose other segments mostly aren't of its label is wrongly labelled as a whole.
                _, doc = np.unique(seg.text[test], return_inverse=True)
                most = np.bincount(doc, seg.n[test] * own) * 2 > np.bincount(doc, seg.n[test])
                out[x] += test[own & most[doc]].tolist()
    return {x: sorted(rows) for x, rows in out.items()}


def _built(seg: Segments, rows: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of segments in a mixed-up order, up to `size` symbols; what it already parses in long phrases is passed over."""
    out, n = Automaton(), 0
    for i in sorted(rows, key=lambda i: (i * 2654435761 & 0xFFFFFFFF, i)):
        x = seg.symbols[seg.offset[i] : seg.offset[i] + seg.length[i]].tolist()
        if out.phrases(x) * NOVEL > len(x):
            out.extend([*x, 0])
            n += len(x) + 1
        if n >= size:
            break
    return out.packed()


def labelled_sample(rows: DataFrame, label: Column, rows_a_language: int = FIT_ROWS) -> list[tuple[str, str]]:
    """About `rows_a_language` (language, text) pairs of each labelled language, drawn by a hash of the id: a bounded fit sample."""
    marked = rows.select("id", label.alias("lang"), "text").where("lang is not null and text is not null")
    shares = {r.lang: min(1.0, rows_a_language / r["count"]) for r in marked.groupBy("lang").count().collect()}  # a row a language
    if not shares:
        return []
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")]
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003)
    return sorted(tuple(r) for r in drawn.select("lang", "text").collect())


def contents(documents: DataFrame) -> DataFrame:
    """(id, lang, text, keep): texts with a mark for each line, 0 where it is its site's and not the author's.

    Left out are the lines problem 5 finds, lines that stand at many sites, and short lines naming their own site. If
    nothing else is left, all lines count.
    """
    rows = _with_text(documents)
    counts = cut(count_lines(rows.select("tbl", "id", "source", "parts")))
    everywhere = counts.where("line is not null").groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"))
    total = counts.where("line is null").agg(F.sum("n").alias("rows"))
    common = everywhere.where("sites >= 4 and n >= 6").crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("rows") * COMMON_SHARE).select("line")
    joined = with_found(rows, repeated(counts)).crossJoin(F.broadcast(common.agg(F.collect_set("line").alias("_common"))))
    name = letters(F.regexp_extract(F.coalesce(site(F.col("source")), F.lit("")), r"^(.*)\.[^.]*$", 1))

    def drop(key: Column) -> Column:
        own = (name != "") & F.contains(key, name) & (F.length(key) <= F.length(name) + 40)
        return F.coalesce(F.array_contains("_found", key), F.lit(False)) | F.array_contains("_common", key) | own | (key == "")

    keep = F.transform(F.transform("parts", letters), lambda key: F.when(drop(key), "0").otherwise("1"))
    mark = F.array_join(keep, "")
    return joined.select("id", "lang", "text", F.when(F.contains(mark, F.lit("1")), mark).otherwise(F.regexp_replace(mark, "0", "1")).alias("keep"))


def _with_text(documents: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", "\r\n", "\n")
    return documents.select(
        F.lit("documents").alias("tbl"), F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.col("lang"), F.col("text"), F.split(text, "\n", -1).alias("parts")
    )


def stretches(rows: DataFrame, model: Model) -> DataFrame:
    """(id, start, stop, lang, confidence, letters): the stretches of each text (id, text, keep), in code points.

    Neighbouring segments of one language are one stretch. Segments too short to tell join the stretch before them, or the
    one after at the start; texts with nothing else, null, empty or all in unknown scripts have none.
    """
    known = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, keep = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()
            share = np.cumsum([len(t) for t in texts]) // SLICE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(share)) + 1):
                i, j = part[0], part[-1] + 1
                yield pa.RecordBatch.from_arrays(_stretched(m, ids[i:j], texts[i:j], keep[i:j]), schema=schema)

    return rows.where("text is not null and text <> ''").select("id", "text", "keep").mapInArrow(run, "id bigint, start bigint, stop bigint, lang string, confidence double, letters bigint")


def _stretched(m: Model, ids: np.ndarray, texts: list[str], keep: list[str]) -> list[pa.Array]:
    seg = segments(texts, keep)
    lang, sure = m.classify(seg)
    latin = seg.script == 1
    clear = (seg.n >= np.where(latin, LEAST_LATIN, LEAST_OTHER)) & (lang != "") & (sure >= SURE)
    code = np.unique(lang, return_inverse=True)
    names, val = code[0], np.where(clear, code[1].reshape(-1), -1)
    # An unclear segment takes the last clear language of its text, else the first one after it; failing that its own best.
    n = len(val)
    if not n:
        return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())]
    spot = np.arange(n)
    back = np.maximum.accumulate(np.where(clear, spot, -1))
    fwd = np.minimum.accumulate(np.where(clear, spot, n)[::-1])[::-1]
    use_back = (back >= 0) & (seg.text[np.maximum(back, 0)] == seg.text)
    use_fwd = (fwd < n) & (seg.text[np.minimum(fwd, n - 1)] == seg.text)
    own = code[1].reshape(-1)
    val = np.where(clear, own, np.where(use_back, own[np.maximum(back, 0)], np.where(use_fwd, own[np.minimum(fwd, n - 1)], own)))
    # A text with no clear segment is one stretch in the best guess for its longest segment.
    lost = ~(clear | use_back | use_fwd)
    if lost.any():
        spots = np.flatnonzero(lost)
        spots = spots[np.lexsort((seg.n[spots], seg.text[spots]))]
        longest = spots[np.append(seg.text[spots][1:] != seg.text[spots][:-1], True)]
        best = dict(zip(seg.text[longest].tolist(), own[longest].tolist()))
        val[lost] = [best[x] for x in seg.text[lost].tolist()]
    good = names[val] != ""
    new = np.append(True, (seg.text[1:] != seg.text[:-1]) | (val[1:] != val[:-1]) | (good[1:] != good[:-1]))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    let = np.bincount(group, seg.n)
    weight = np.where(clear | ~(use_back | use_fwd), seg.n, 0)
    conf = np.bincount(group, weight * sure) / np.maximum(np.bincount(group, weight), 1)
    lastat = np.append(at[1:], n) - 1
    ok = good[at]
    return [pa.array(ids[seg.text[at]][ok], pa.int64()), pa.array(seg.start[at][ok], pa.int64()), pa.array(seg.stop[lastat][ok], pa.int64()), pa.array(names[val[at]][ok].tolist(), pa.string()), pa.array(conf[ok], pa.float64()), pa.array(let[ok].astype(np.int64), pa.int64())]


def by_language(found: DataFrame) -> DataFrame:
    """(id, lang, letters, confidence, main): each language of a text; `main` has the most letters, ties by code."""
    per = found.groupBy("id", "lang").agg(F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    # One pass over the texts: a text's languages, a few, are gathered rather than joined to their greatest.
    all_ = per.groupBy("id").agg(F.collect_list(F.struct("letters", "lang", "confidence")).alias("_all")).withColumn("_main", F.array_max("_all")["lang"])
    return all_.select("id", "_main", F.explode("_all").alias("x")).select("id", "x.lang", "x.letters", "x.confidence", (F.col("x.lang") == F.col("_main")).alias("main"))


def fit_model(documents: DataFrame, rows_a_language: int = FIT_ROWS) -> tuple[Model, DataFrame]:
    """(model, contents): the model fitted on the labelled documents, and their contents, kept for classifying."""
    rows = cut(contents(documents))
    return fit(labelled_sample(_kept_text(rows), iso(F.col("lang")), rows_a_language)), rows


def _kept_text(rows: DataFrame) -> DataFrame:
    marks = F.split("keep", "")
    lines = F.transform(F.split("text", "\n", -1), lambda p, i: F.when(F.get(marks, i) == "1", p))
    return rows.select("id", "lang", F.array_join(F.filter(lines, lambda p: p.isNotNull()), "\n").alias("text"))


def post_rows(posts: DataFrame) -> DataFrame:
    """(id, lang, text, keep): title and subtitle as two lines."""
    text = F.concat(F.regexp_replace(F.coalesce("title", F.lit("")), "[\r\n]", " "), F.lit("\n"), F.regexp_replace(F.coalesce("subtitle", F.lit("")), "[\r\n]", " "))
    return posts.select(F.col("row_id").cast("long").alias("id"), "lang", text.alias("text"), F.lit("11").alias("keep"))


def title_texts(titles: DataFrame) -> DataFrame:
    """(id, text, keep): titles as one line each."""
    return titles.where("title is not null").select(F.col("row_id").cast("long").alias("id"), F.regexp_replace("title", "[\r\n]", " ").alias("text"), F.lit("1").alias("keep"))


def mislabelled(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """(id, lang): the languages of each row whose label is missing or unknown, or names another than the main one, or that has several."""
    label = rows.select("id", iso(F.col("lang")).alias("_label"))
    per = langs.groupBy("id").agg(F.collect_set("lang").alias("all"), F.max(F.when(F.col("main"), F.col("lang"))).alias("_main"))
    cases = per.join(label, "id").where((F.size("all") > 1) | F.col("_label").isNull() | (F.col("_label") != F.col("_main")))
    return cases.select("id", F.explode("all").alias("lang"))


def all_stretches(documents: DataFrame, posts: DataFrame, titles: DataFrame, rows_a_language: int = FIT_ROWS) -> DataFrame:
    """(tbl, id, start, stop, lang, confidence, letters) of the three tables; places in a post are those of its title, a line feed and its subtitle."""
    model, docs = fit_model(documents, rows_a_language)
    tagged = lambda name, df: df.select(F.lit(name).alias("tbl"), "*")
    out = tagged("documents", stretches(docs, model)).unionByName(tagged("blogs_posts", stretches(post_rows(posts), model)))
    return out.unionByName(tagged("collect_headlines", stretches(title_texts(titles), model)))


def found_languages(documents: DataFrame, posts: DataFrame, titles: DataFrame, rows_a_language: int = FIT_ROWS) -> DataFrame:
    """(tbl, id, lang) of the three tables: languages that labels miss, and all titles that aren't English."""
    model, docs = fit_model(documents, rows_a_language)
    posted, lines = post_rows(posts), title_texts(titles)
    tagged = lambda name, df: df.select(F.lit(name).alias("tbl"), "id", "lang")
    doc_langs = by_language(stretches(docs, model))
    post_langs = by_language(stretches(posted, model))
    title_langs = by_language(stretches(lines, model)).where("main and lang <> 'en'")
    out = tagged("documents", mislabelled(docs, doc_langs)).unionByName(tagged("blogs_posts", mislabelled(posted, post_langs)))
    return out.unionByName(tagged("collect_headlines", title_langs))
