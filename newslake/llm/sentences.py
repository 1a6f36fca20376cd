"""Problem 10: sentences of documents in many languages and scripts, by a hidden-event n-gram language model.

Between words stand hidden events, boundary or none. The model holds how often a word (with its marks) ends in a boundary,
P(event | word), and which words follow a boundary and which don't, P(word | event), each backed off from the word to its
shape; an event also depends on the one before it, one word away. It is trained on all lines without labels: line
breaks are sure boundaries, gaps after words without an end mark sure non-boundaries. Forward-backward over the gaps of a
line gives each gap's posterior; a sentence ends where it exceeds one half.

Only gaps that can be a boundary are kept as events: after end marks and, in a script without them (Thai), at spaces.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping, Set
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.session import cut

#: Words seen fewer times than this are known by their shape only, whatever the size of the table.
LEAST_SEEN = 3
#: Up to this share of a word's appearances, what it is seen as is taken for an accident, whatever the size of the table.
ABSENT = 0.01
#: Distinct events that a task holds, about.
MOST_HELD = 200_000
MOST_BYTES = 64_000_000
RARE = 6
OFTEN = 5

_CLOSE = "”’»\"')\\]}」』）］｝〉》】“"
_OPEN = "“„‘«\"'(\\[{「『（［〈《【¿¡–—\\-"
_WIDE = "。！？።፧။។៕։།"
_END = ".!?…؟।۔;"
#: A gap: an end mark with what closes after it, then white space, or nothing after a wide mark. French marks stand apart.
_GAP = re.compile(
    rf"[{_END}{_WIDE}](?:(?<=[{_END}])[{_END}]*(?:[\s ]?»|[{_CLOSE}])*(?:[\s ]?[!?…]+)*(?:[\s ]?»|[{_CLOSE}])*(?P<space>[\s ]+)(?=\S)|(?<=[{_WIDE}])[{_WIDE}]*[{_CLOSE[:-1]}]*[\s ]*(?=[^\s{_CLOSE[:-1]}、，]))"
)
_THAI_GAP = re.compile(r"(?<=\S)([\s ]+)(?=\S)")
_THAI = re.compile(r"[฀-๿]")
_WORD = re.compile(r"\S+")
_ALNUM = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d+")
_GREEK = re.compile(r"[Ͱ-Ͽ]")
_TURN = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я](?<=[a-zß-öø-ÿα-ωа-я].)")
_OPENERS = re.compile(rf"^[{_OPEN}\s]+")


@lru_cache(maxsize=100_000)
def _left_shape(word: str) -> str:
    """The shape of a word before a gap."""
    quoted = "q" if word[:1] in "“„«‘「『\"" and word[:1] else ""
    core = word.strip(_CLOSE.replace("\\", "") + "“„«‘「『  ")
    mark = core[-1:] if core[-1:] in _END + _WIDE else ""
    shut = "c" if mark and not word.endswith(mark) else ""
    body = core.rstrip(_END + _WIDE + "  ")
    if mark in "!?؟…" and mark or body != core and core.endswith("..") or mark in "।۔;。！？" and mark:
        return f"{quoted}{'…' if core.endswith('..') else mark}{shut}"
    if _THAI.search(body):
        return f"{quoted}T{'s' if len(body) < 10 else 'l'}{mark}{shut}"
    if not body:
        return f"{quoted}-{mark}{shut}"
    if body[-1].isdigit():
        return f"{quoted}9{mark}{shut}"
    if "." in body:
        return f"{quoted}x.x{mark}{shut}"
    n = len(body)
    size = "1" if n == 1 else "2" if n <= 3 else "4" if n <= 5 else "6"
    case = "o" if body.lower() == body.upper() else "l" if body == body.lower() else "U" if body == body.upper() and n > 1 else "C"
    return f"{quoted}{case}{size}{mark}{shut}"


@lru_cache(maxsize=100_000)
def _right_shape(word: str) -> str:
    """The shape of a word after a gap."""
    core = _OPENERS.sub("", word)
    quoted = "q" if len(core) < len(word) and word[0] not in "–—-" else "d" if len(core) < len(word) else ""
    if not core:
        return "-"
    first = core[0]
    if _THAI.match(first):
        return f"{quoted}T{'a' if core.endswith('.') else 's' if len(core) < 10 else 'l'}"
    if first.isdigit():
        return f"{quoted}9"
    if not first.isalpha():
        return f"{quoted}-"
    if first.lower() == first.upper():
        return f"{quoted}o"
    if first == first.lower():
        return f"{quoted}l"
    if core.endswith("."):
        return f"{quoted}I" if len(core) == 2 else f"{quoted}C."
    return f"{quoted}C"


@lru_cache(maxsize=100_000)
def _left_key(word: str) -> str:
    if _THAI.search(word):
        return word[-6:]
    if any(c in _WIDE for c in word):
        return word[-3:]
    return _DIGIT.sub("9", word.lower())


@lru_cache(maxsize=100_000)
def _right_key(word: str) -> str:
    core = _OPENERS.sub("", word)
    if _THAI.match(core or " "):
        return core[:6]
    if core and ord(core[0]) >= 0x2E80 and not 0xAC00 <= ord(core[0]) < 0xD7B0:
        return core[:1]
    return _DIGIT.sub("9", core.rstrip(",;:"))


def caseless(line: str) -> bool:
    """Whether letter case tells nothing in a line: none of it, all of it, at every word, or at random."""
    return line.islower() or line.isupper() or line.istitle() or line.lower() == line.upper() or len(_TURN.findall(line)) > 2


@lru_cache(maxsize=100_000)
def _says(word: str) -> bool:
    return _ALNUM.search(word) is not None


def _dotted(left: str) -> bool:
    return left.rstrip("”」』»\"")[-1:] == "."


def gaps(line: str) -> list[tuple[int, int, str, str]]:
    """(end of the word before, start of the word after, word before, word after) of each gap that can be a boundary."""
    out = []
    found = []
    for m in _GAP.finditer(line):
        a = m.start(1)
        if a < 0:
            a = m.start() + len(m[0].rstrip())
        elif line[m.start()] == ";" and not _GREEK.search(line):
            continue
        found.append((a, m.end()))
    wide = not line.isascii()
    if wide and _THAI.search(line):
        have = {b for _, b in found}
        found = sorted(found + [(m.start(), m.end()) for m in _THAI_GAP.finditer(line) if m.end() not in have and (_THAI.match(line[m.end()]) or _THAI.search(line[max(0, m.start() - 3) : m.start()]))])
    hard = wide and "\xa0" in line
    for a, b in found:
        k = (max(line.rfind(" ", 0, a), line.rfind("\xa0", 0, a)) if hard else line.rfind(" ", 0, a)) + 1
        left = line[k:a]
        if left and not left[0].isalnum() and not _says(left):  # a mark set apart goes with its word
            k = max(line.rfind(" ", 0, k - 1), line.rfind("\xa0", 0, k - 1)) + 1 if k > 1 else 0
            left = line[k:a]
        if wide and (left[-2:-1] in _WIDE or left[-1:] in _WIDE or left[-3:-2] in _WIDE):
            left = left[-4:]
        e = line.find(" ", b)
        e = len(line) if e < 0 else e
        if not line[b].isalnum() and not _says(line[b:e]):
            e = line.find(" ", e + 1)
            e = len(line) if e < 0 else e
        right = line[b : e if e < b + 40 else b + 40]
        if left[-1:] in "”」』»\"" and left and right:
            # In scripts without case what follows a closed quotation is its reporting clause.
            first = _OPENERS.sub("", right)[:1]
            if first.isalpha() and first.lower() == first.upper():
                continue
        out.append((a, b, left[-40:], right))
    return out


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the cycle collector: nothing cyclic is made within, and it would walk through all that is held."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Words(Mapping):
    """Words and their values in two sorted blocks: some twenty bytes a word, so that all words of a large table can be held."""

    def __init__(self, words: pa.ChunkedArray, values: np.ndarray) -> None:
        words = words.cast(pa.large_binary()).combine_chunks()
        order = pc.array_sort_indices(words)
        words, self.values = words.take(order), values[order.to_numpy()]
        text = words.buffers()[2]
        self.text = text.to_pybytes() if text else b""
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())])
        self.ends = ends.astype(np.uint32 if len(self.text) < 2**32 else np.int64)
        self.memo: dict[str, float | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def get(self, word: str, default: float | None = None) -> float | None:
        if word in self.memo:
            v = self.memo[word]
        else:
            if len(self.memo) > MOST_HELD:
                self.memo.clear()
            v = self.memo[word] = self._find(word.encode())
        return default if v is None else v

    def _find(self, key: bytes) -> float | None:
        ends, text, low, high = self.ends, self.text, 0, len(self.ends) - 1
        while low < high:
            i = (low + high) // 2
            if text[ends[i] : ends[i + 1]] < key:
                low = i + 1
            else:
                high = i
        return float(self.values[low]) if low < len(self) and text[ends[low] : ends[low + 1]] == key else None

    def __getitem__(self, word: str) -> float:
        v = self.get(word)
        if v is None:
            raise KeyError(word)
        return v

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None

    def __iter__(self) -> Iterator[str]:
        return (self.text[self.ends[i] : self.ends[i + 1]].decode() for i in range(len(self)))

    def __len__(self) -> int:
        return len(self.ends) - 1


@dataclass
class HiddenEvents:
    """The model: log-odds of a boundary by word before and by word after, each with its shape's value to fall back on."""

    left: Mapping[str, float] = field(default_factory=dict)
    left_shape: dict[str, float] = field(default_factory=dict)
    right: Mapping[str, float] = field(default_factory=dict)
    right_any: Mapping[str, float] = field(default_factory=dict)
    right_shape: dict[str, float] = field(default_factory=dict)
    starts: Set[str] = field(default_factory=set)  # words that begin lines
    sums: tuple[float, float, float, float] = (1, 1, 1, 1)  # words that begin lines, those that don't; the same without case
    again: float = -1.5  # a boundary one word after a boundary

    def after(self, left: str, key: str, shape: str) -> float:
        """What the word after a gap says; of a word hardly known in a script without case, the mark before it says more."""
        g = self.right.get(key)
        if g is not None:
            return g
        if shape[-1:] == "o":
            return -1.0 if _dotted(left) else 1.5
        return self.right_shape.get(shape, self.right_shape.get(shape.lstrip("qd"), 0.0))

    def chance(self, key: str, shape: str, left: str) -> float:
        """The probability of a boundary by the word after a gap alone."""
        return 1 / (1 + math.exp(-self.after(left, key, shape)))

    def score(self, left: str, right: str, plain: bool) -> float:
        """The log-odds of a boundary between two words."""
        lk, ls = _left_key(left), _left_shape(left)
        f = self.left.get(lk)
        if f is None and lk[:1] in "“„«‘":
            f = self.left.get(lk.lstrip("“„«‘  ")) if "q" not in ls else None
        if f is None:
            f = self.left_shape.get(ls, self.left_shape.get(ls.lstrip("q"), 0.0))
        rk, rs = _right_key(right), _right_shape(right)
        if plain and rs[-1:] in "lCUI.":
            g = self.right_any.get(rk.lower(), 0.0)
        else:
            g = self.after(left, rk, rs)
            if rs[:1] in "qd" and rs[1:2] == "l":
                g = min(g, self.right_shape.get("l", 0.0))
        if ls.lstrip("q")[:1] == "9" and rs == "C" and rk not in self.starts:  # an ordinal or a date
            g = min(g, -5.0)
        return f + g

    def posteriors(self, scores: list[float], near: list[bool]) -> list[float]:
        """Forward-backward over the events of a line; `near[i]`: gap i is one word after gap i - 1."""
        n = len(scores)
        w = [math.exp(max(-40.0, min(40.0, s))) for s in scores]
        e = math.exp(self.again)
        fwd = [(1.0, w[0])]
        for i in range(1, n):
            a, b = fwd[-1]
            x, y = a + b, (a + b * (e if near[i] else 1.0)) * w[i]
            z = x + y
            fwd.append((x / z, y / z))
        back = (1.0, 1.0)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            a, b = fwd[i][0] * back[0], fwd[i][1] * back[1]
            out[i] = b / (a + b)
            if i:
                k = e if near[i] else 1.0
                x, y = back[0] + w[i] * back[1], back[0] + w[i] * back[1] * k
                z = x + y
                back = (x / z, y / z)
        return out

    def split(self, line: str, memo: dict[tuple[str, str, bool], float] | None = None) -> list[tuple[int, int]]:
        """The sentences of one line as (start, end), without surrounding white space. `memo` keeps scores between lines."""
        found = gaps(line)
        if not found:
            text = line.strip()
            at = len(line) - len(line.lstrip())
            return [(at, at + len(text))] if _ALNUM.search(text) else []
        plain, memo = caseless(line), {} if memo is None else memo
        scores, near, at = [], [], -40
        for a, b, left, right in found:
            key = (left, right, plain)
            w = memo.get(key)
            if w is None:
                w = memo[key] = self.score(left, right, plain)
            scores.append(w)
            near.append(a - at < 40 and left[-1:] not in "!?。！？”」" and " " not in line[at:a])
            at = b
        if True in near:
            cuts = [(x[0], x[1]) for x, p in zip(found, self.posteriors(scores, near)) if p > 0.5]
        else:  # without a transition that tells, a posterior is over one half where its log-odds are over 0
            cuts = [(x[0], x[1]) for x, w in zip(found, scores) if w > 0]
        out, at = [], 0
        for a, b in [*cuts, (len(line), len(line))]:
            start, end = at, a
            while start < end and line[start].isspace():
                start += 1
            while end > start and line[end - 1].isspace():
                end -= 1
            if start < end:
                if _ALNUM.search(line, start, end):
                    out.append((start, end))
                elif out:  # marks alone go with the sentence before
                    out[-1] = (out[-1][0], end)
            at = b
        return out


def _logit(p: float) -> float:
    p = min(max(p, 0.002), 0.998)
    return math.log(p / (1 - p))


class Events:
    """The events of distinct lines, no labels, only line breaks and marks: (kind, word, shape, word after, shape after, mark) and how often.

    Kinds: `start`, a word that begins a line; `mid`, one after a gap that can't be a boundary; `said`, the same by the Thai
    rule; `start_any`, `mid_any`, both without case; `end`, a word that ends a line; `gap`, the words around an open gap.

    Words are counted as they stand, and known by key and shape when the counts are read.
    """

    def __init__(self) -> None:
        both = lambda: {False: Counter(), True: Counter()}
        self.firsts, self.words, self.after = both(), both(), both()  # by whether case tells nothing
        self.around = {(p, t): Counter() for p in (False, True) for t in (False, True)}  # and whether the line is Thai
        self.lasts: Counter = Counter()
        self.bytes = 0  # of the words of all batches, at most; where none are set apart, a word is as long as its line

    def full(self) -> bool:
        return len(self) > MOST_HELD or self.bytes > MOST_BYTES

    def __len__(self) -> int:
        return len(self.lasts) + sum(len(n) for x in (self.firsts, self.words, self.after, self.around) for n in x.values())

    def add(self, lines: list[str]) -> None:
        """Count lines without white space around them. Words are cut and numbered in Arrow, a batch at a time."""
        if not lines:
            return
        cut_ = pc.utf8_split_whitespace(pa.array(lines, pa.string()))
        coded = cut_.flatten().dictionary_encode()
        words, codes, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut_.offsets.to_numpy() - cut_.offsets[0].as_py()
        self.bytes += coded.dictionary.nbytes
        mute = np.array([not _says(w) for w in words])
        plain = np.array([caseless(x) for x in lines])
        # Marks that stand alone, and what follows them, are no words amid a sentence; all others but the first of a line are, less those after gaps.
        said = ~mute[codes]
        amid = said.copy()
        amid[1:] &= said[:-1]
        amid[at[:-1]] = False
        long = np.diff(at) > 1
        first, last = codes[at[:-1]], codes[at[1:] - 1]
        whole, ends = ~(mute[first] & long), ~(mute[last] & long)
        for p in (False, True):
            self._count(self.firsts[p], words, first[whole & (plain == p)])
            self._count(self.words[p], words, codes[amid & np.repeat(plain == p, np.diff(at))])
        self._count(self.lasts, words, last[ends])
        # A mark that stands alone at either end goes with the word beside it.
        for i in np.flatnonzero(~whole):
            line, x, y = lines[i], words[first[i]], words[codes[at[i] + 1]]
            self.firsts[bool(plain[i])][line[: line.find(y, len(x)) + len(y)]] += 1
        for i in np.flatnonzero(~ends):
            line, x, y = lines[i], words[last[i]], words[codes[at[i + 1] - 2]]
            self.lasts[line[line.rfind(y, 0, len(line) - len(x)) :]] += 1
        odd = np.bincount(np.repeat(np.arange(len(lines)), np.diff(at)), mute[codes], len(lines)) > 0
        after: dict[bool, list] = {False: [], True: []}
        around: dict[tuple[bool, bool], list] = {k: [] for k in self.around}
        for line, p, o in zip(lines, plain.tolist(), odd.tolist()):
            cand = gaps(line)
            if not cand:
                continue
            around[p, not line.isascii() and bool(_THAI.search(line))] += [x[2:] for x in cand]
            for _, b, _, _ in cand:
                if line[b - 1].isspace() and not (o and self._apart(line, b)):
                    after[p].append(_WORD.match(line, b)[0])
        for counts, seen in ((self.after, after), (self.around, around)):
            for k, x in seen.items():
                counts[k].update(x)

    @staticmethod
    def _apart(line: str, b: int) -> bool:
        """Whether the word at `b`, or the one before it, is a mark that stands alone."""
        return not _says(_WORD.match(line, b)[0]) or not _says(line[:b].split()[-1])

    @staticmethod
    def _count(counts: Counter, words: list[str], codes: np.ndarray) -> None:
        n = np.bincount(codes, minlength=len(words))
        for i in np.flatnonzero(n).tolist():
            counts[words[i]] += int(n[i])

    def read(self) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = defaultdict(int)
        for plain, seen in self.firsts.items():
            for w, n in seen.items():
                k, s = _right_key(w[:40]), _right_shape(w[:40])
                out["start_any", k.lower(), "", "", "", ""] += n
                if not plain or s[-1:] in "oasl9T-":
                    out["start", k, s, "", "", ""] += n
        for w, n in self.lasts.items():
            w = w[-4:] if not w.isascii() and any(c in _WIDE for c in w) else w
            out["end", _left_key(w), _left_shape(w), "", "", ""] += n
        for (plain, thai), seen in self.around.items():
            for (left, right), n in seen.items():
                ls, rs, rk = _left_shape(left), _right_shape(right), _right_key(right)
                if thai and (ls[:1] == "9" or rs[-1:] == "9" or rs[:2] == "qT"):  # a number and its unit, what is said
                    out["said", rk, rs, "", "", ""] += n
                    out["mid_any", rk, "", "", "", ""] += n
                if not plain or rs[-1:] in "oasl9T-":
                    out["gap", _left_key(left), ls, rk, rs, "." if _dotted(left) else ""] += n
        for plain, seen in self.words.items():
            less = self.after[plain]
            for w, n in seen.items():
                n -= less.get(w, 0)
                if not n:
                    continue
                k = _right_key(w)
                out["mid_any", k.lower(), "", "", "", ""] += n
                if not plain:
                    out["mid", k, _right_shape(w), "", "", ""] += n
        return out


def counted(lines: Iterable[str]) -> Counter:
    """The events of some lines."""
    events = Events()
    events.add(list(lines))
    return Counter(events.read())


def line_key(line: str) -> str:
    """A site's own lines would outweigh the rest, so lines equal but for figures and case count once."""
    return _DIGIT.sub("", line.lower())


def fit(texts: list[str], least: int = LEAST_SEEN) -> HiddenEvents:
    """The model of some texts; `fit_model` makes the same of a table."""
    once: dict[str, str] = {}
    for text in texts:
        for line in text.split("\n"):
            if _ALNUM.search(line):
                once.setdefault(line_key(line.strip()), line.strip())
    n = counted(once.values())
    words: dict[str, list] = defaultdict(lambda: [0, 0, Counter(), 0, Counter()])
    anys: dict[str, list] = defaultdict(lambda: [0, 0])
    shapes: dict[str, list] = defaultdict(lambda: [0, 0, 0, 0])
    for (kind, a, s, k, ks, _), c in n.items():
        if kind in ("start", "mid", "said"):
            i = int(kind != "start")
            words[a][i] += c
            shapes[s][i] += c
            words[a][2][s] += c * (kind != "said")
        elif kind in ("start_any", "mid_any"):
            anys[a][int(kind == "mid_any")] += c
        elif kind == "gap":
            words[k][3] += c
            words[k][4][ks] += c
    most = lambda x: max(((c, s) for s, c in x.items() if c), default=(0, None))[1]
    table = [(k, s, m, most(x), t, most(y)) for k, (s, m, x, t, y) in words.items()]
    for _, s, m, x, _, _ in table:
        if x is not None and s + m <= RARE:
            shapes[x][2] += s
            shapes[x][3] += m
    out = right_model([(x, *v) for x, v in shapes.items()], (sum(v[0] for v in anys.values()), sum(v[1] for v in anys.values())))
    out.starts = {k for k, s, m, *_ in table if begins(s, m)}
    out.right = {k: v for k, s, m, _, t, y in table if (v := right_value(out, s, m, t, y, least)) is not None}
    out.right_any = {k: any_value(out, s, m) for k, (s, m) in anys.items() if s + m >= least}
    left: dict[str, list] = defaultdict(lambda: [0.0, 0.0, 0, Counter()])
    left_shape: dict[str, list] = defaultdict(lambda: [0.0, 0.0, 0])
    for (kind, a, s, k, ks, dot), c in n.items():
        if kind in ("end", "gap"):
            p = 1.0 if kind == "end" else out.chance(k, ks, dot)
            for x in (left[a], left_shape[s]):
                x[0] += p * c
                x[1] += (1 - p) * c
            left[a][2] += c
            left[a][3][s] += c * (kind == "gap")
            left_shape[s][2] += c * (kind == "gap")
    left_model(out, [(x, *v) for x, v in left_shape.items()])
    out.left = {k: left_value(out, y, z, ls) for k, (y, z, c, x) in left.items() if (ls := most(x)) is not None and c >= least}
    return out


def right_model(shapes: list[tuple], all_: tuple[float, float]) -> HiddenEvents:
    """What the shapes of words after a gap say.

    shapes: (shape, starts, mids, of its rare words: starts, mids); `all_`: the sums of starts and mids without case.
    """
    n_start, n_mid = sum(x[1] for x in shapes) + 1, sum(x[2] for x in shapes) + 1
    out = HiddenEvents(sums=(n_start, n_mid, all_[0] + 1, all_[1] + 1))
    known = sum(1 for x in shapes if x[1] + x[2])
    share = lambda x, n: (x + 0.5) / (n + 0.5 * known)
    # A shape stands in for words the counts hardly know, so it is judged by its rare words, where names are.
    for shape, s, m, rare_s, rare_m in shapes:
        b, n = (rare_s, rare_m) if rare_s + rare_m >= 20 else (s, m)
        out.right_shape[shape] = -1.0 if shape[-1:] == "o" else _clip(math.log(share(b, n_start) / share(n, n_mid)))
    return out


def begins(s: Any, m: Any) -> Any:
    """Whether a word of so many starts and mids, numbers or columns, is one that begins lines."""
    return (s >= 2) & (s >= ABSENT * (s + m))


def right_value(out: HiddenEvents, s: float, m: float, total: float, rs: str | None, least: float) -> float | None:
    """What a word after a gap says: its starts and mids, the gaps before it and its shape there. None: no more than its shape."""
    never = s + m <= ABSENT * total
    if not total or s + m < least and not (rs.endswith(("C.", "I")) and total >= least) and not (rs.endswith("C") and never and total > 1):
        return None
    n_start, n_mid = out.sums[:2]
    base = out.right_shape.get(rs, 0.0)
    v = math.log((s / n_start + math.exp(base) / n_mid) / (m / n_mid + 1 / n_mid))
    if never and rs.endswith("C"):  # after end marks again and again, never amid a sentence
        v = 1.5 if total >= OFTEN else 0.0
    if rs.endswith(("C.", "I")) and s <= ABSENT * total:  # an abbreviation that never begins a line begins no sentence
        v = min(v, -2.0)
    return _clip(v)


def any_value(out: HiddenEvents, s: float, m: float) -> float:
    """What a word after a gap says where case says nothing."""
    n_s, n_m = out.sums[2:]
    return max(-1.5, min(1.5, math.log((s / n_s + 2 / n_m) / (m / n_m + 2 / n_m))))


def left_model(out: HiddenEvents, shapes: list[tuple]) -> None:
    """What the shapes of words before a gap say: line ends, and the gaps within lines by what the word after them says.

    shapes: (shape, boundaries, others, gaps after it).
    """
    for s, b, n, gap in shapes:
        if gap:
            out.left_shape[s] = _logit((b + 0.5) / (b + n + 1))


def left_value(out: HiddenEvents, b: float, n: float, ls: str) -> float:
    """What a word before a gap says: its boundaries and others, and its shape there."""
    base = 1 / (1 + math.exp(-out.left_shape[ls]))
    return _logit((b + 3 * base) / (b + n + 3)) + 0.3 * min(0.0, out.left_shape[ls])


def _clip(x: float) -> float:
    return max(-5.0, min(5.0, x))


def fit_model(documents: DataFrame, least: int = LEAST_SEEN) -> HiddenEvents:
    """The model of all documents: `fit` as aggregations, under the same floors at any size.

    Sums by shape come to the driver, and of words above the floor their values, computed in tasks.
    """
    rows = documents.where("text is not null and text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.regexp_replace(F.lower(F.trim("line")), r"\p{Nd}+", "")
    lines = rows.groupBy(F.xxhash64(key).alias("h"), F.length(key).alias("l")).agg(F.min(F.struct("id", "pos", "line"))["line"].alias("line")).select("line")
    fields = ["kind", "a", "sa", "b", "sb", "dot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = Events()
        for b in batches:
            with _uncollected():
                events.add([x.strip() for x in b.column(0).to_pylist() if _ALNUM.search(x)])
            if events.full():
                with _uncollected():
                    held, events = _batch(events.read(), fields), Events()
                yield held
        if len(events):
            with _uncollected():
                held = _batch(events.read(), fields)
            yield held

    t = cut(lines.mapInArrow(run, ", ".join(f"{f} string" for f in fields) + ", n long").groupBy(*fields).agg(F.sum("n").alias("n")))
    # Sums of words, and of their shapes; a word's shape is its commonest.
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    most = lambda n, s: F.max(F.when(n > 0, F.struct(n.alias("n"), s.alias("s"))))["s"]
    flat = t.where("kind in ('start', 'mid', 'said', 'gap')").withColumn("w", F.when(F.col("kind") == "gap", F.col("b")).otherwise(F.col("a"))).withColumn("s", F.when(F.col("kind") == "gap", F.col("sb")).otherwise(F.col("sa")))
    per = flat.groupBy("w", "s").agg(of("start").alias("start"), of("mid", "said").alias("mid"), of("start", "mid").alias("here"), of("gap").alias("gap"))
    words = cut(per.groupBy("w").agg(F.sum("start").alias("start"), F.sum("mid").alias("mid"), most(F.col("here"), F.col("s")).alias("shape"), F.sum("gap").alias("gap"), most(F.col("gap"), F.col("s")).alias("gap_shape")))
    shapes = {r.s: [r.start, r.mid, 0, 0] for r in per.groupBy("s").agg(F.sum("start").alias("start"), F.sum("mid").alias("mid")).where("start + mid > 0").collect()}
    for r in words.where(F.col("shape").isNotNull() & (F.col("start") + F.col("mid") <= RARE)).groupBy("shape").agg(F.sum("start").alias("start"), F.sum("mid").alias("mid")).collect():
        shapes[r.shape][2:] = [r.start, r.mid]
    anys = t.where("kind in ('start_any', 'mid_any')").groupBy("a").agg(of("start_any").alias("start"), of("mid_any").alias("mid"))
    all_ = anys.agg(F.sum("start").alias("start"), F.sum("mid").alias("mid")).first()
    all_ = (all_.start or 0, all_.mid or 0)
    out, small = (right_model([(x, *v) for x, v in shapes.items()], all_) for _ in range(2))
    starts = words.where(begins(F.col("start"), F.col("mid"))).select("w").toArrow()
    out.starts = Words(starts.column(0), np.ones(starts.num_rows)).keys()
    out.right = _values(words.where("gap > 0").select("w", "start", "mid", "gap", "gap_shape"), lambda *x: right_value(small, *x, least))
    out.right_any = _values(anys.where(F.col("start") + F.col("mid") >= least).select("a", "start", "mid"), lambda s, m: any_value(small, s, m))
    right = documents.sparkSession.sparkContext.broadcast(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = right.value, {}
        for b in batches:
            kind, k, sk, dot = (b.column(i).to_pylist() for i in (0, 3, 4, 5))
            p = np.array([1.0 if x == "end" else memo[y] if (y := (w, s, d)) in memo else memo.setdefault(y, m.chance(*y)) for x, w, s, d in zip(kind, k, sk, dot)], np.float64)
            if len(memo) > MOST_HELD:
                memo.clear()
            n = b.column(6).to_numpy()
            inner = np.array([x == "gap" for x in kind], bool)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(p * n), pa.array((1 - p) * n), b.column(6), pa.array(n * inner)], names=["w", "s", "yes", "no", "n", "gap"])

    judged = t.where("kind in ('end', 'gap')").mapInArrow(judge, "w string, s string, yes double, no double, n long, gap long")
    both = cut(judged.groupBy("w", "s").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("n").alias("n"), F.sum("gap").alias("gap")))
    left = both.groupBy("w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("n").alias("n"), most(F.col("gap"), F.col("s")).alias("shape")).where(F.col("shape").isNotNull() & (F.col("n") >= least))
    left_model(small, [tuple(r) for r in both.groupBy("s").agg(F.sum("yes"), F.sum("no"), F.sum("gap")).collect()])
    out.left_shape = small.left_shape
    out.left = _values(left.select("w", "yes", "no", "shape"), lambda y, z, ls: left_value(small, y, z, ls))
    return out


def _values(rows: DataFrame, value: Callable[..., float | None]) -> Words:
    """The words of `rows`, its first column, that `value` gives a value by their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, *cols = (c.to_pylist() for c in b.columns)
            got = [(x, v) for x, v in zip(w, map(value, *cols)) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([v for _, v in got], pa.float64())], names=["w", "v"])

    t = rows.mapInArrow(run, "w string, v double").toArrow()
    return Words(t.column(0), t.column(1).to_numpy())


def _batch(n: dict[tuple[str, ...], int], fields: list[str]) -> pa.RecordBatch:
    cols = zip(*n) if n else [()] * len(fields)
    return pa.RecordBatch.from_pydict({f: pa.array(list(c), pa.string()) for f, c in zip(fields, cols)} | {"n": pa.array(list(n.values()), pa.int64())})


def sentences(documents: DataFrame, model: HiddenEvents | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos): the sentences of each text in code points from 0.

    Sentences never cross a line break. A line without letters and digits gives none, any other at least one. Null and
    empty texts give none.
    """
    model = model or fit_model(documents)
    known = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        memo: dict[str, list[tuple[int, int]]] = {}
        scores: dict[tuple[str, str, bool], float] = {}
        for b in batches:
            if len(scores) > MOST_HELD:
                scores.clear()
            ids, starts, ends = [], [], []
            with _uncollected():
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at = 0
                    for line in text.split("\n"):
                        got = memo.get(line)
                        if got is None:
                            got = m.split(line, scores)
                            if len(line) < 200:
                                if len(memo) > 50_000:
                                    memo.clear()
                                memo[line] = got
                        if len(got) == 1:
                            ids.append(doc)
                            starts.append(at + got[0][0])
                            ends.append(at + got[0][1])
                        elif got:
                            ids += [doc] * len(got)
                            starts += [at + x[0] for x in got]
                            ends += [at + x[1] for x in got]
                        at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=schema)

    rows = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, start_pos bigint, end_pos bigint")
