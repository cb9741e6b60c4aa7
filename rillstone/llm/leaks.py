"""Evaluation texts leaking into training text: n-gram seeds join them, local alignment decides."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import spread, written

#: Cyrillic and Greek letters that look like Latin ones, and what they are read as.
_ALIKE = {
    ord(letter): latin
    for letter, latin in {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
        "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ρ": "p",
    }.items()
}
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>|&(?:nbsp|amp|quot|lt|gt);")
_CHAR = re.compile(rf"[{_CJK}]")
_LATIN = re.compile("[a-z]")


@dataclass(frozen=True)
class Passages:
    """words, chars: the least passage, in words or (Chinese, Japanese) characters. same: least share of its words
    that are kept. seed, char_seed: tokens of a seed. seeds: seeds that a document window must share with an item to be
    aligned; of the 13 trigrams of 15 words three replaced words leave at least four."""

    words: int = 15
    chars: int = 30
    same: float = 0.78
    weight: float = 0.7
    char_same: float = 0.92
    seed: int = 3
    char_seed: int = 6
    seeds: int = 4
    mismatch: float = 2.0
    gap: float = 2.0


class _Folded(dict):
    """By code point: the letter or digit in lower case without accents, nothing for other signs, a blank for white space; single
    Chinese and Japanese characters stand alone."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace():
            out = " "
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).casefold()) if x.isalnum())
            out = f" {out} " if _CHAR.match(c) else out
        self[code] = out
        return out


class _Sums(dict):
    """By word: its checksum, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) | (1 << 32 if _CHAR.match(word) else 0)
        return out


_FOLDED, _SUMS = _Folded(), _Sums()


def tokens(text: str) -> list[str]:
    """The words of a text, and its single Chinese and Japanese characters.

    A token is in lower case without accents, punctuation, markup or invisible characters, so that
    changes of typography leave it alone; a word of punctuation alone is no token.
    """
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    words = text.translate(_FOLDED).split()
    return words if text.isascii() else [w if w.isascii() or not _LATIN.search(w) else w.translate(_ALIKE) for w in words]


def grams(texts: Sequence[Sequence[str]], rules: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, places): every n-gram of the tokens of each text, longer ones where characters are the tokens; those of text i
    lie between bounds i and i + 1, each with its place among all tokens."""
    n = np.array([len(w) for w in texts], np.int64)
    c = np.array([_SUMS[x] for w in texts for x in w], np.uint64)
    end = np.repeat(np.cumsum(n), n)
    size = np.where(c >> np.uint64(32) > 0, rules.char_seed, rules.seed)
    at = np.arange(len(c))
    h = np.zeros(len(c), np.uint64)
    for k in range(max(rules.seed, rules.char_seed)):
        own = k < size
        h = np.where(own, (h ^ c[np.minimum(at + k, len(c) - 1)]) * np.uint64(0x9E3779B97F4A7C15), h) if len(c) else h
        h ^= np.where(own, h >> np.uint64(29), np.uint64(0))
    whole = at + size <= end
    return h[whole].view(np.int64), np.r_[0, np.cumsum(whole)][np.r_[0, np.cumsum(n)]], at[whole]


def align(a: np.ndarray, b: np.ndarray, rules: Passages) -> tuple[int, int, list[int]]:
    """Smith-Waterman of two arrays of token numbers: (first, last + 1) of a in the best local alignment, and a's places that match."""
    first, last, matches, _ = aligned(a, b, rules)
    return first, last, matches


def aligned(a: np.ndarray, b: np.ndarray, rules: Passages) -> tuple[int, int, list[int], list[int]]:
    """See align; also b's places that match.

    A row at a time; gaps in b come from a running maximum.
    """
    n, m = len(a), len(b)
    down = np.arange(m + 1) * rules.gap
    gain = np.where(a[:, None] == b[None, :], 1.0, -rules.mismatch)
    h, cell = np.zeros((n + 1, m + 1)), np.zeros(m + 1)
    row = cell[1:]
    for i in range(n):
        np.add(h[i, :-1], gain[i], out=row)
        np.maximum(row, h[i, 1:] - rules.gap, out=row)
        np.maximum(row, 0.0, out=row)
        np.add(cell, down, out=h[i + 1])
        np.maximum.accumulate(h[i + 1], out=h[i + 1])
        np.subtract(h[i + 1], down, out=h[i + 1])
    h[:, 0] = 0.0
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    last, matches, there = int(i), [], []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (1.0 if a[i - 1] == b[j - 1] else -rules.mismatch):
            if a[i - 1] == b[j - 1]:
                matches.append(int(i) - 1)
                there.append(int(j) - 1)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - rules.gap:
            i -= 1
        else:
            j -= 1
    return int(i), last, matches, there


class _Item:
    """A test item, ready to be looked for."""

    def __init__(self, text: str, weights: dict[str, float], rules: Passages):
        w = tokens(text)
        self.words = np.array([hash(x) for x in w], np.int64)
        self.listed = self.words.tolist()
        self.weights = np.array([weights[x] for x in w])
        self.latin = np.array([not _CHAR.match(x) for x in w], int)
        self.by_char = 2 * (len(w) - self.latin.sum()) > len(w)
        self.size = np.cumsum([0, *(len(x) for x in w)])
        g, _, at = grams([w], rules)
        by = np.argsort(g, kind="stable")
        self.grams, self.at = g[by], at[by]

    def found(self, words: np.ndarray, own: np.ndarray, places: np.ndarray, rules: Passages) -> Iterator[list[int]]:
        """Words of a text that match the item, once a passage. words, own, places: the text's words, its n-grams and their places."""
        lo, hi = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
        p = np.repeat(places, hi - lo)
        if len(p) < rules.seeds:
            return
        q = self.at[np.repeat(lo, hi - lo) + np.arange(len(p)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        diagonal = np.sort(p - q)
        slack, length = len(self.words) // 4 + 4, len(self.words)
        # hits on close diagonals make a window; a long one is taken in pieces, each passage whole in one of them
        for hits in np.split(diagonal, np.flatnonzero(np.diff(diagonal) > slack) + 1):
            if len(hits) < rules.seeds:
                continue
            start, end = max(0, int(hits[0]) - slack), int(hits[-1]) + length + slack
            step = length + slack
            piece = 3 * step  # a passage covers at most twice the item's length
            for at in range(start, max(start + 1, end - 2 * step), step):
                kept = self.passage(words, at, min(end, at + piece), rules)
                if kept:
                    yield kept
                    if kept[-1] - kept[0] + 1 == len(kept):  # without a word lost: no item can fit better there
                        return

    def possible(self, there: np.ndarray, rules: Passages) -> bool:
        """Whether some passage of the item could be kept, if every word that is there matched; what fails here can't pass the alignment."""

        def any_passage(gain: np.ndarray) -> bool:
            total = np.r_[0.0, np.cumsum(gain)]
            before = np.searchsorted(self.size, self.size - rules.chars, "right") if self.by_char else np.arange(len(total)) - rules.words + 1
            ends = np.flatnonzero(before > 0)
            return bool(len(ends)) and bool((total[ends] - np.minimum.accumulate(total)[before[ends] - 1]).max() >= -1e-9)

        return any_passage(there - rules.same) and (self.by_char or any_passage(self.weights * (there - rules.weight)))

    def passage(self, words: np.ndarray, start: int, end: int, rules: Passages) -> list[int]:
        """Words of a part of a text that match the item in a passage of it; none if there is no passage."""
        b = words[start:end]
        known = set(b.tolist())
        if not self.possible(np.array([x in known for x in self.listed]), rules):
            return []
        first, last, matches, there = aligned(self.words, b, rules)
        n = last - first
        if not n or len(matches) < rules.same * n:
            return []
        if self.by_char:
            latin = self.latin
            telling = latin[first:last].sum() > 1 and latin[matches].sum() >= rules.weight * latin[first:last].sum()
            good = self.size[last] - self.size[first] >= rules.chars and (telling or len(matches) >= rules.char_same * n)
        else:
            good = n >= rules.words and self.weights[matches].sum() >= rules.weight * self.weights[first:last].sum()
        return [start + j for j in reversed(there)] if good else []


def fitting(places: list[tuple[int, list[int]]]) -> set[int]:
    """Items of (item, words that match) that hold a place of a text: no other item matches all those words and more between them."""
    sets = [set(kept) for _, kept in places]
    out: set[int] = set()
    for (n, kept), own in zip(places, sets, strict=True):
        if n not in out and not any(m != n and own < {x for x in other if kept[0] <= x <= kept[-1]} for (m, _), other in zip(places, sets, strict=True)):
            out.add(n)
    return out


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rules: Passages | None = None, block: int = 5_000) -> DataFrame:
    """``doc_id``, ``item_id`` of every document that reproduces a passage of an item, whole or in part.

    Seeds are all n-grams of the items, however many items or documents hold them.
    Documents become arrays of hashed n-grams in one pass, which are joined with
    the seeds; a document and an item that share ``rules.seeds`` of them are
    aligned by Smith-Waterman where those lie on close diagonals. The alignment
    must cover a passage of ``rules.words`` words (``rules.chars`` characters in
    Chinese and Japanese) of which ``rules.same`` are kept, weighed by how few
    items hold a word. A passage copied into a third of all documents, or shared
    by many items, is found as well. Items of equal text are looked for once.

    Items made from one template are told apart by their place in the document:
    an item is not reproduced where another one matches all the words that it
    matches and more of those between them (its names and numbers, say). Items
    that share a passage match the same words of it and are all found.

    The seeds are sent to all tasks if they are small, so documents are not
    shuffled then; only numbers of shared seeds are, added up by task. The items
    are the query set: the texts to be aligned with go to the tasks in blocks of
    about ``block``, each with the documents that share seeds with one of it. The
    matrix of an alignment is the item's length times four of it. Documents
    never meet each other and nothing of them is collected.

    Defined cases: null or blank texts on either side leak nothing; null ids are
    ids like others; repeated rows give one row; an item shorter than a passage
    can't leak; an empty table on either side gives an empty table; other
    columns are dropped and may have any name.
    """
    rules = rules or Passages()
    hashed = F.xxhash64("text").alias("h")
    d = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"), docs)
    d = d.select(F.struct("doc_id", hashed).alias("k"), "text")
    ids = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    q = ids.select(hashed.alias("n"), "text").distinct()
    kind = d.schema["k"].dataType.simpleString()

    def seeds(of: DataFrame, column: str, kind: str) -> DataFrame:
        return of.mapInArrow(_grams(rules), f"{column} {kind}, g array<bigint>").select(column, F.explode("g").alias("g"))

    shared = seeds(d, "k", kind).join(broadcast_if_small(seeds(q, "n", "bigint")), "g")
    pairs = shared.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= rules.seeds)
    # how telling the words of an item are: the fewer items hold them, the more
    held = q.mapInArrow(_words, "n bigint, w array<string>").select("n", F.explode("w").alias("w"))
    held = held.join(held.groupBy("w").agg(F.count(F.lit(1)).alias("items")), "w")
    count = q.count()
    blocks = max(1, -(-count // block))
    part = lambda n: F.pmod(n, F.lit(blocks))
    some = pairs.groupBy("k", part(F.col("n")).alias("part")).agg(F.collect_list("n").alias("ns"))
    some = written(some) if blocks > 1 else some
    place = f"k {kind}, n bigint, kept array<int>"
    places = d.sparkSession.createDataFrame([], place)
    for b in range(blocks):
        rows = {r["n"]: r["text"] for r in q.where(part(F.col("n")) == b).collect()}
        weights = {r["w"]: float(np.log((count + 1) / r["items"])) for r in held.where(part(F.col("n")) == b).select("w", "items").distinct().collect()}
        own = d.join(some.where(F.col("part") == b), "k").select("k", "text", "ns")
        places = places.unionByName(own.mapInArrow(_search(rows, weights, rules), place))
    out = places.groupBy("k").agg(F.collect_list(F.struct("n", "kept")).alias("places")).mapInArrow(_fitting, f"k {kind}, n bigint")
    return out.join(ids.select("item_id", hashed.alias("n")), "n").select("k.doc_id", "item_id").distinct()


def _grams(rules: Passages):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, bounds, _ = grams([tokens(t) for t in b.column("text").to_pylist()], rules)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found))], names=[b.schema.names[0], "g"])

    return over


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([sorted(set(tokens(t))) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["n", "w"])


def _search(rows: dict[int, str], weights: dict[str, float], rules: Passages):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, _Item] = {}
        for b in batches:
            pick, found, places = [], [], []
            for r, (t, ns) in enumerate(zip(b.column("text").to_pylist(), b.column("ns").to_pylist(), strict=True)):
                w = tokens(t)
                (own, _, at), words = grams([w], rules), np.array([hash(x) for x in w], np.int64)
                for n in ns:
                    if n not in items:
                        items[n] = _Item(rows[n], weights, rules)
                    for kept in items[n].found(words, own, at, rules):
                        pick.append(r)
                        found.append(n)
                        places.append(kept)
            columns = [b.column("k").take(pa.array(pick, pa.int64())), pa.array(found, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "kept"])

    return over


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pick, ns = [], []
        for r, places in enumerate(b.column("places").to_pylist()):
            for n in sorted(fitting([(x["n"], x["kept"]) for x in places])):
                pick.append(r)
                ns.append(n)
        yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(pick, pa.int64())), pa.array(ns, pa.int64())], names=["k", "n"])
