"""Sentence boundaries across languages and scripts: linear-chain taggers that learn from the layout of the corpus itself."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Marks.
_STOPS = ".!?。！？．｡؟۔।॥…‼⁇⁈⁉"
_CLOSE = "»”\"'’）」』】》〉)]}›"
_OPEN = "«“\"'‘（「『【《〈([{„‚‹¿¡"
_ZERO = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_HEADING = re.compile(r"\s{0,3}#{1,6}\s+\S")
_TABLE = re.compile(r"\s*\|.*\|\s*$")
_LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
_SUM = re.compile(r"\s*(?:checksum|md5|sha-?\d*|crc32)\b[\s:=]+[0-9a-fA-F]{8,}\s*$", re.I)
_LIST = re.compile(r"\s*(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")

_PLACE = re.compile(rf"[{re.escape(_STOPS)}]+[{_ZERO}]*(?:[\u00a0\u202f]?[{re.escape(_CLOSE)}*_]+)*|(?<=[\u0e00-\u0e4e\u0e5a-\u0e7f])\s+(?=[\u0e00-\u0e4e\u0e5a-\u0e7f])")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_THAI = re.compile("[\u0e00-\u0e4e\u0e5a-\u0e7f]")
_IDENT = re.compile(r"[a-z0-9]+(?:[._-][a-z0-9]+)*(?:\(\))?")
_TOKEN_END = re.compile(r"\S+$")
_LETTERS = re.compile(r"[^\W\d_]+")
#: letters of scripts that may go without marks or spaces between sentences, and what stands between their sentences otherwise
_BARE = {"thai": "\u0e00-\u0e4e\u0e5a-\u0e7f", "han": "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"}
_LETTER = {k: re.compile(f"[{v}]") for k, v in _BARE.items()}
_UNBARE = re.compile(f"[{''.join(_BARE.values())}]")

Seen = tuple[str, str, str, str, str, str, str, str]
Place = tuple[int, Seen]


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): the parts of a text between blank lines; whole ones are single units (headings, list items, fences ...)."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    i, n, open_at, item, last_whole = 0, len(lines), -1, False, True
    closing: dict[str, int] = {}
    for k in range(n):
        if f := _FENCE.match(text, *lines[k]):
            closing[f[1]] = k
    while i < n:
        s, e = lines[i]
        line = text[s:e]
        if (f := _FENCE.match(line)) and closing[f[1]] > i:
            k = i + 1
            while not ((g := _FENCE.match(text, *lines[k])) and g[1] == f[1]):
                k += 1
            if open_at >= 0:
                yield open_at, lines[i - 1][1], item
            yield s, lines[k][1], True
            open_at, item, last_whole, i = -1, False, True, k + 1
            continue
        if not line or line.isspace():
            if open_at >= 0:
                yield open_at, lines[i - 1][1], item
            open_at, item, last_whole = -1, False, True
        elif _HEADING.match(line) or _TABLE.match(line) or _LOG.match(line) or _SUM.match(line):
            if open_at >= 0:
                yield open_at, lines[i - 1][1], item
            yield s, e, True
            open_at, item, last_whole = -1, False, True
        elif _LIST.match(line) and (last_whole or item):
            if open_at >= 0:
                yield open_at, lines[i - 1][1], item
            open_at, item, last_whole = s, True, False
        elif open_at < 0:
            open_at, item, last_whole = s, False, False
        i += 1
    if open_at >= 0:
        yield open_at, len(text), item


def _next_kind(t: str, i: int, end: int, no_case: bool) -> tuple[str, bool]:
    """What follows a place, and whether white space lies between."""
    j = i
    while j < end and (t[j].isspace() or t[j] in _ZERO):
        j += 1
    gap = any(c.isspace() for c in t[i:j])
    if j >= end:
        return "end", gap
    c = t[j]
    if c.isdigit():
        return ("ident" if re.match(r"[0-9]+[a-z_]", t[j : j + 20]) else "digit"), gap
    if _CJK.match(c):
        return "cjk", gap
    if c.isupper() or unicodedata.category(c) == "Lt":
        return "upper", gap
    if c.islower():
        m = _IDENT.match(t, j, end)
        w = m[0] if m else ""
        if "_" in w or "." in w or w.endswith("()") or any(x.isdigit() for x in w):
            return "ident", gap
        return ("upper" if no_case else "lower"), gap
    if c.isalpha():
        return "other", gap
    if c in _OPEN and not (c in "\"'" and not gap):
        return "open", gap
    if c in "-–—―":
        return "dash", gap
    if c in ",;:、，；：)]}…." or c in _CLOSE:
        return "punct", gap
    return "sign", gap


def _opened(t: str, start: int, i: int, closer: str) -> str:
    """What stands before the quotation that a closing mark ends: a colon, other text, or nothing."""
    pair = {"”": "“", "」": "「", "』": "『", "»": "«", "）": "（", "》": "《", '"': '"', "“": "„", "’": "‘"}.get(closer)
    k = t.rfind(pair, start, i) if pair else -1
    if k < 0:
        return "none"
    b = t[start:k].rstrip()
    if not b:
        return "first"
    return "colon" if b[-1] in ":：,，" else "first" if b[-1] in _STOPS or b[-1] in _CLOSE else "inner"


def _word(w: str) -> str:
    """A word as a feature: itself, or its shape if it is long or a number."""
    if w.isdigit():
        return f"#{min(len(w), 3)}"
    return w if len(w) <= 12 else "long"


def _shape(w: str) -> str:
    """What kind of word stands before a place."""
    if not w:
        return "none"
    if _CJK.match(w[-1]):
        return "cjk"
    if w.isdigit():
        return "figures" if len(w) > 2 else "figure"
    if len(w) == 1 and w.isalpha():
        return "letter"
    if not w.isalpha():
        return "mixed"
    return "Word" if w[0].isupper() else "word"


def places(t: str, start: int, end: int) -> list[Place]:
    """The places of a block where a sentence may end, each with what is seen around it.

    Seen: the mark, the word before it and its shape, what closes behind it, what the closed quotation began after,
    whether white space follows, and the kind of what follows and its first word.
    """
    out: list[Place] = []
    no_case = (block := t[start:end]) == block.lower()
    for m in _PLACE.finditer(t, start, end):
        s, e = m.span()
        if t[e : e + 1] in ("“", "‘") and t.rfind("„", start, s) > t.rfind("“", start, s):
            e += 1  # German quotations end with the mark that others begin with
        g = t[s:e]
        if g.isspace():
            out.append((s, ("space", "", "thai", "", "", "gap", "thai", "")))
            continue
        marks = g.rstrip(_CLOSE + "“‘*_\u00a0\u202f" + _ZERO) or g
        closers = g[len(marks) :].strip(_ZERO + "\u00a0\u202f")
        quote = next((c for c in reversed(closers) if c in "»”\"'’」』“‘›"), "")
        mark = marks[0] if len(marks) == 1 else "?!" if any(c in "!?！？" for c in marks) else "..."
        follows, gap = _next_kind(t, e, end, no_case)
        w = _TOKEN_END.search(t, max(start, s - 30), s) if mark in ".।" else None
        before = w[0].lstrip(_OPEN + "*_") if w else t[s - 1 : s] if s > start else ""
        n = _LETTERS.search(t, e, min(end, e + 30))
        after = _word(n[0]) if n and not _UNBARE.match(n[0]) and t[e : n.start()].strip(_OPEN + _ZERO + " \t\r\n\u00a0*_") == "" else ""
        out.append((e, (mark, _word(before) if w else "", _shape(before), "q" if quote else "b" if closers else "", _opened(t, start, s, quote) if quote else "", "gap" if gap else "", follows, after)))
    return out


def _features(seen: Seen) -> tuple:
    """Features of a place: what stands before and after the mark, alone and together."""
    mark, word, shape, close, opened, gap, follows, after = seen
    return (
        ("around", mark, close, gap, follows),
        ("word", mark, word, gap) if word else ("shape", mark, shape, gap),
        ("word on", mark, word or shape, gap, follows),
        ("shape on", mark, shape, gap, follows),
        ("next", mark, gap, after),
        ("shape next", mark, shape, after),
        ("quote", close, opened, gap, follows),
    )


@dataclass
class Chain:
    """A linear chain of two tags, inside and boundary: weights of what is seen at a place, and of tag after tag."""

    emit: dict = field(default_factory=dict)
    move: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def ends(self, t: str, start: int, end: int) -> list[int]:
        """Where the sentences of a block end."""
        found = places(t, start, end)
        return sorted({end, *(p for (p, _), tag in zip(found, self.decode_seen([seen for _, seen in found]), strict=True) if tag)})

    def decode_seen(self, seen: Sequence[Seen]) -> list[bool]:
        """The best tags of places; the weight of a boundary at places of which the same is seen is added up once."""
        if len(self.known) > 200_000:
            self.known.clear()
        weight = []
        for x in seen:
            w = self.known.get(x)
            if w is None:
                w = self.known[x] = sum(self.emit.get(f, 0.0) for f in _features(x))
            weight.append(w)
        return self._best(weight)

    def decode(self, seen: Sequence[tuple]) -> list[bool]:
        """The best tags by Viterbi."""
        return self._best([sum(self.emit.get(f, 0.0) for f in fs) for fs in seen])

    def _best(self, weight: Sequence[float]) -> list[bool]:
        if not weight:
            return []
        m00, m01, m10, m11 = (self.move.get(k, 0.0) for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
        back, s0, s1 = [], 0.0, weight[0]
        for e in weight[1:]:
            b0, b1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((b0, b1))
            s0, s1 = (s1 + m10 if b0 else s0 + m00), (s1 + m11 if b1 else s0 + m01) + e
        tag = s1 > s0
        tags = [tag]
        for b in reversed(back):
            tag = b[tag]
            tags.append(tag)
        return tags[::-1]

    @staticmethod
    def train(chains: Sequence[tuple[Sequence[tuple], Sequence[bool]]], rounds: int = 20) -> Chain:
        """Averaged structured perceptron."""
        now, total, seen_at, t = defaultdict(float), defaultdict(float), defaultdict(int), 0

        def change(key, by: float) -> None:
            total[key] += now[key] * (t - seen_at[key])
            seen_at[key] = t
            now[key] += by

        model = Chain()
        for _ in range(rounds):
            wrong = 0
            for seen, truth in chains:
                t += 1
                model.emit = model.move = now
                got = model.decode(seen)
                if got == list(truth):
                    continue
                wrong += 1
                for i, (g, w) in enumerate(zip(got, truth, strict=True)):
                    if g != w:
                        for f in seen[i]:
                            change(f, 1.0 if w else -1.0)
                    if i and (got[i - 1], g) != (truth[i - 1], w):
                        change((int(truth[i - 1]), int(w)), 1.0)
                        change((int(got[i - 1]), int(g)), -1.0)
            if not wrong:
                break
        mean = {k: (total[k] + now[k] * (t - seen_at[k])) / max(t, 1) for k in list(now)}
        tags = {(a, b) for a in (0, 1) for b in (0, 1)}
        return Chain({k: v for k, v in mean.items() if k not in tags and v}, {k: v for k, v in mean.items() if k in tags})


@dataclass(frozen=True)
class Layout:
    """What the layout tells. telling: least share of a feature's uses, against what is expected, that must be at ends of
    paragraphs for its other places to count as boundaries; prior: uses that every feature is taken to have there in advance
    (so a rare feature tells nothing); beginnings: that each end is put before; estimate, rounds, bare_rounds: rounds of the
    estimate, of the chain and of the chains without marks."""

    telling: float = 0.25
    prior: float = 2.0
    beginnings: int = 3
    estimate: int = 6
    rounds: int = 10
    bare_rounds: int = 6


def _paragraphs(texts: Sequence[str]) -> list[str]:
    """The blocks of all texts that are no units of their own."""
    return [t[s:e].strip() for t in texts for s, e, whole in blocks(t) if not whole]


def _script(t: str) -> str:
    """Script of the first letter: paragraphs of one script are put after each other."""
    c = next((c for c in t if c.isalpha()), "")
    return "bare" if _UNBARE.match(c) else unicodedata.name(c, "?").split()[0] if c else ""


def laid_out(texts: Sequence[str], rules: Layout) -> list[tuple[list[Seen], list[bool]]]:
    """Per paragraph: what is seen at its places, and which of them is known for a boundary.

    No annotator and no rule says where a sentence ends. What is known is the layout: a sentence ends where a paragraph
    does. So each paragraph is put before another one of its script, and the place where they meet is a true boundary
    with a true beginning behind it.
    """
    by_script: dict[str, list[str]] = defaultdict(list)
    for p in _paragraphs(texts):
        by_script[_script(p)].append(p)
    out = []
    for ps in by_script.values():
        for i, a in enumerate(ps):
            for k in range(1, rules.beginnings + 1):
                b = ps[(i + k) % len(ps)]
                gap = "" if _CJK.match(a.rstrip(_STOPS + _CLOSE)[-1:] or "?") else " "
                own = places(a + gap + b, 0, len(a) + len(gap) + len(b))
                own = [(p, seen) for p, seen in own if p <= len(a)]
                out.append(([seen for _, seen in own], [p == len(a) for p, _ in own]))
    return out


def weak_labels(known: Sequence[tuple[list[Seen], list[bool]]], rules: Layout) -> list[list[bool]]:
    """A label for every place, from the known boundaries alone.

    If all places were boundaries, every feature (a word before the mark, a word behind it ...) would be seen at ends of
    paragraphs about as often, in proportion, as any other. A feature that is common inside paragraphs but not at their ends
    ("Dr.", a small letter behind the mark, no white space) stands where no sentence ends. A place that one feature
    explains so is not held against its others. The proportion, the labels and what explains them are estimated in turns.
    """
    at_end, inside = Counter(), Counter()
    for seen, ends in known:
        for x, e in zip(seen, ends, strict=True):
            for f in _features(x) if e else ():
                at_end[f] += 1 / rules.beginnings
            inside[x] += 0 if e else 1 / rules.beginnings
    features = {x: _features(x) for x in inside}
    total = sum(at_end.values()) / len(_features(("",) * 8))
    told, by = dict.fromkeys(inside, True), dict.fromkeys(inside)
    for _ in range(rules.estimate):
        rate = total / max(1, sum(n for x, n in inside.items() if told[x]))
        held: Counter = Counter()
        for x, n in inside.items():
            for f in features[x] if told[x] else (by[x],):
                held[f] += n
        for x, fs in features.items():
            least = {f: (at_end[f] + rules.prior) / (rate * held[f] + rules.prior) for f in fs}
            by[x] = min(least, key=least.__getitem__)
            told[x] = least[by[x]] >= rules.telling
    return [[bool(e) or told[x] for x, e in zip(seen, ends, strict=True)] for seen, ends in known]


#: Size of the weight table of characters, a power of two.
_SLOTS = 1 << 18


def _slots(codes: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Slots of the features of every place between two characters, one row per feature.

    codes: code points of a run with three zeros on both sides. wide: for each place a number of what is
    known of the run as a whole.
    """
    c = codes.astype(np.uint64)
    n = len(codes) - 6
    a3, a2, a1, b1, b2, b3 = (c[k : k + n - 1] for k in (1, 2, 3, 4, 5, 6)) if n > 1 else (c[:0],) * 6
    m = lambda k, *xs: _mixed(k, xs)
    rows = (m(1, a1), m(2, a2, a1), m(3, a3, a2, a1), m(4, b1), m(5, b1, b2), m(6, b1, b2, b3), m(7, a1, b1), m(8, a2, a1, b1, b2), m(9, a1, b1, b2), m(10, a2, a1, b1), m(11, wide.astype(np.uint64)))
    return np.vstack(rows)


def _mixed(kind: int, xs: Sequence[np.ndarray]) -> np.ndarray:
    h = np.full(len(xs[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for x in xs:
        h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(_SLOTS - 1)).astype(np.int64)


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fill(letters: int, marks: int) -> int:
    """How many letters of bare scripts there are to a mark, in steps of half a power of two: text with its marks needs few more cuts."""
    return int(2 * np.log2(max(1, letters) / (marks + 0.5))) if letters else 0


@dataclass
class Bare:
    """A chain over all characters of a run, for scripts that may go without marks and spaces: weights of what stands around a
    place, and of tag after tag."""

    weights: np.ndarray
    move: np.ndarray

    def emissions(self, run: str, wide: np.ndarray) -> np.ndarray:
        """Weight of a boundary at every place of a run; wide: see _slots."""
        z = np.zeros(3, np.uint32)
        return self.weights[_slots(np.concatenate([z, _codes(run), z]), wide)].sum(axis=0)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags by Viterbi, given the weight of a boundary at each place; the run begins and ends at boundaries."""
        (stay, cut), (after, twice) = self.move.tolist()
        if not len(e) or e.max() + max(cut, twice) + max(0.0, after) - stay <= 0 and stay >= 0:
            return np.zeros(len(e), bool)
        s0, s1, back = after, twice + float(e[0]), []
        for x in e[1:].tolist():
            b0, b1 = s1 + after > s0 + stay, s1 + twice > s0 + cut
            back.append((b0, b1))
            s0, s1 = (s1 + after if b0 else s0 + stay), (s1 + twice if b1 else s0 + cut) + x
        tag = s1 > s0
        tags = [tag]
        for b in reversed(back):
            tag = b[int(tag)]
            tags.append(tag)
        return np.array(tags[::-1], bool)

    @staticmethod
    def train(runs: Sequence[tuple[str, int, np.ndarray]], rounds: int) -> Bare:
        """Averaged structured perceptron. runs: text, what is known of it as a whole, and the true tags."""
        now, total = np.zeros(_SLOTS), np.zeros(_SLOTS)
        move, move_total = np.zeros((2, 2)), np.zeros((2, 2))
        z, t = np.zeros(3, np.uint32), 0
        slots = [_slots(np.concatenate([z, _codes(r), z]), np.full(max(0, len(r) - 1), wide)) for r, wide, _ in runs]
        model = Bare(now, move)
        order = sorted(range(len(runs)), key=lambda i: zlib.crc32(runs[i][0].encode("utf-8", "surrogatepass")))
        for _ in range(rounds):
            wrong = 0
            for i in order:
                truth, own = runs[i][2], slots[i]
                if not len(truth):
                    continue
                t += 1
                got = model.decode(now[own].sum(axis=0))
                off = np.flatnonzero(got != truth)
                if not len(off):
                    continue
                wrong += 1
                for k in off:
                    by = 1.0 if truth[k] else -1.0
                    np.add.at(now, own[:, k], by)
                    np.add.at(total, own[:, k], by * t)
                for tags, by in ((truth, 1.0), (got, -1.0)):
                    x = np.r_[1, tags.astype(int)]
                    np.add.at(move, (x[:-1], x[1:]), by)
                    np.add.at(move_total, (x[:-1], x[1:]), by * t)
            if not wrong:
                break
        t += 1
        mean = move - move_total / t
        # of equal models the one in which staying costs nothing
        return Bare((now - total / t).astype(np.float32), mean)


def stripped(paragraph: str, ends: Sequence[int], script: str, keep: Sequence[bool]) -> tuple[str, int, np.ndarray]:
    """(run, what is known of it as a whole, tags): the units of a paragraph that end at ends, put together without the marks and spaces
    between them; where keep says so a unit keeps its marks, and the run there its truth."""
    pieces, marks = [], 0
    for a, b, kept in zip([0, *ends[:-1]], ends, keep, strict=True):
        p = paragraph[a:b].strip()
        p = p if kept else p.rstrip(_STOPS + _CLOSE + _ZERO).strip()
        if p:
            pieces.append(p)
            marks += kept
    run = "".join(pieces)
    tags = np.zeros(max(0, len(run) - 1), bool)
    at = np.cumsum([len(p) for p in pieces])[:-1] - 1
    tags[at.astype(int)] = True
    return run, _fill(len(_LETTER[script].findall(run)), marks), tags


@dataclass
class Tagger:
    """marked: the chain over places with marks. bare: by script, the chain over all characters."""

    marked: Chain
    bare: dict[str, Bare]

    @staticmethod
    def train(texts: Sequence[str], rules: Layout | None = None, bare_texts: Sequence[str] = ()) -> Tagger:
        """bare_texts: more texts in scripts that may go without marks."""
        rules = rules or Layout()
        known = laid_out(texts, rules)
        labels = weak_labels(known, rules)
        once = zip(known[:: rules.beginnings], labels[:: rules.beginnings], strict=True)
        marked = Chain.train([([_features(x) for x in seen], truth) for (seen, _), truth in once], rules.rounds)
        runs: dict[str, list] = defaultdict(list)
        for p in _paragraphs(sorted({*texts, *bare_texts})):
            for script, letter in _LETTER.items():
                if 2 * len(letter.findall(p)) < len(p):
                    continue
                ends = marked.ends(p, 0, len(p))
                runs[script].append(stripped(p, ends, script, [False] * len(ends)))
                for i in range(len(ends) - 2):  # two and three sentences of it alone
                    own = p[ends[i - 1] if i else 0 : ends[i + 1 + i % 2]]
                    runs[script].append(stripped(own, [e - ends[i - 1] if i else e for e in ends[i : i + 2 + i % 2]], script, [False] * (2 + i % 2)))
                runs[script].append(stripped(p, ends, script, [zlib.crc32(p[a:].encode("utf-8", "surrogatepass")) % 2 == 0 for a in [0, *ends[:-1]]]))
                wide = _fill(len(letter.findall(p)), len(ends))
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    u = p[a:b].strip()
                    runs[script].append((u, wide, np.zeros(max(0, len(u) - 1), bool)))
        return Tagger(marked, {k: Bare.train(v, rules.bare_rounds) for k, v in runs.items()})

    def units(self, t: str | None) -> list[tuple[int, int]]:
        """[start, end) of every sentence unit of a text."""
        return self.units_of([t])[0]

    def units_of(self, texts: Sequence[str | None]) -> list[list[tuple[int, int]]]:
        """[start, end) of every sentence unit of each text."""
        parts = [self._marked_parts(t) if t else [] for t in texts]
        runs: dict[str, list] = defaultdict(list)
        for t, own in zip(texts, parts, strict=True):
            for part in own:
                if not part[2] and _UNBARE.search(t, part[0], part[1][-1]):
                    for script in self.bare:
                        runs[script] += self._runs(script, t, part)
        for script, some in runs.items():
            self._cut(self.bare[script], some)
        return [self._put(t, own) for t, own in zip(texts, parts, strict=True)]

    def _marked_parts(self, t: str) -> list[tuple[int, list[int], bool]]:
        """(start, ends, whole) of every block: its ends by the chain over places with marks, and its own."""
        return [(s, [e] if whole else self.marked.ends(t, s, e), whole) for s, e, whole in blocks(t)]

    @staticmethod
    def _runs(script: str, t: str, part: tuple[int, list[int], bool]) -> Iterator[tuple[str, int, int, list[int]]]:
        """(run, what is known of it as a whole, its place in the text, ends of its block) of every unit that is written in the script."""
        s, ends, _ = part
        letter = _LETTER[script]
        count = len(letter.findall(t, s, ends[-1]))
        wide = _fill(count, len(ends))
        for a, b in zip([s, *ends[:-1]], ends, strict=True) if count else ():
            u = t[a:b].rstrip()
            lead = len(u) - len(u.lstrip())
            u = u[lead:]
            if 2 * len(letter.findall(u)) >= len(u) > 1:
                yield u, wide, a + lead, ends

    @staticmethod
    def _cut(model: Bare, runs: Sequence[tuple[str, int, int, list[int]]], most: int = 200_000) -> None:
        """Adds the boundaries without a mark to the ends of their blocks; weighs about most characters at a time."""
        at = 0
        added = []
        while at < len(runs):
            some, size = [], 0
            while at < len(runs) and (not some or size + len(runs[at][0]) < most):
                some.append(runs[at])
                size += len(runs[at][0]) + 3
                at += 1
            e = model.emissions("\0\0\0".join(r[0] for r in some), np.repeat([r[1] for r in some], [len(r[0]) + 3 for r in some])[:-4])
            o = 0
            for run, _, place, ends in some:
                added.append((ends, place + 1 + np.flatnonzero(model.decode(e[o : o + len(run) - 1]))))
                o += len(run) + 3
        for ends, more in added:
            ends.extend(more.tolist())

    @staticmethod
    def _put(t: str | None, parts: Sequence[tuple[int, list[int], bool]]) -> list[tuple[int, int]]:
        out = []
        for a, ends, _ in parts:
            for b in sorted(set(ends)):
                s = t[a:b].rstrip()
                lead = len(s) - len(s.lstrip())
                if lead < len(s):
                    out.append((a + lead, a + len(s)))
                a = b
        return out


def trained(docs: DataFrame, text: str, sample: int = 2_000, bare_sample: int = 600, longest: int = 50_000) -> Tagger:
    """A tagger trained on ``sample`` texts of at most ``longest`` characters, chosen by hash over the whole corpus, and
    ``bare_sample`` more of those with words in Thai, Chinese or Japanese.

    The numbers bound what the driver holds; texts are tagged whatever their length.
    """
    t = docs.select(F.col(text).alias("t")).where("t is not null").where(F.length("t") <= longest).withColumn("h", F.xxhash64("t"))
    bare = F.col("t").rlike(f"[{''.join(_BARE.values())}]{{8}}")
    own = t.orderBy("h").limit(sample).withColumn("more", F.lit(False)).unionByName(t.where(bare).orderBy("h").limit(bare_sample).withColumn("more", F.lit(True)))
    rows = own.select("t", "more").collect()
    return Tagger.train(sorted({r["t"] for r in rows if not r["more"]}), bare_texts=sorted({r["t"] for r in rows if r["more"]}))


def sentence_units(docs: DataFrame, doc_id: str, text: str, tagger: Tagger) -> DataFrame:
    """``doc_id``, ``start_char``, ``end_char`` of every sentence unit, in code points, without white space around.

    Text is cut at blank lines; headings, list items, table rows, log and
    checksum lines and fenced blocks are single units. In the rest, every place
    where a sentence may end (marks with what closes behind them, spaces between
    Thai letters) is a position of a linear chain that Viterbi decodes, on what
    stands around the place. Then every character of a unit that is written in
    Thai, Chinese or Japanese is a position of the chain of its script, which was
    trained on text whose marks and spaces were taken out and cuts what has
    none, at any length. Texts are tagged where they are read; nothing is
    shuffled.

    Defined cases: null, empty and blank texts have no units; null ids are kept;
    repeated rows give their units each time; an empty table gives an empty
    table; other columns are dropped and may have any name.
    """
    d = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t is not null"), docs)
    kind = d.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = tagger.units_of(b.column("t").to_pylist())
            n = np.array([len(u) for u in units])
            bounds = np.array([x for u in units for x in u], np.int64).reshape(-1, 2)
            ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(bounds[:, 0]), pa.array(bounds[:, 1])], names=["doc_id", "start_char", "end_char"])

    return d.mapInArrow(cut, f"doc_id {kind}, start_char bigint, end_char bigint")
