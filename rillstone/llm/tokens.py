"""Texts to the ids of a public byte-level BPE vocabulary and back, in the JVM."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: White space, and the pattern that cuts a text into words before merging, for Java's regular expressions.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = 2**31 - 1
#: Bytes of a piece that are merged at once; longer ones are merged in stretches that are then fitted together.
STRETCH = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _plain(b: bytes) -> str:
    """A byte string as text of one character per byte."""
    return b.decode("latin-1")


def rank_map(ranks: dict[bytes, int], buckets: int = 16_384) -> Column:
    """The vocabulary as one literal: an array of small maps from piece to rank, by checksum of the piece.

    The engine searches a map literal from its start; the array makes that a search among a few pieces.
    """
    rows: list[dict[str, int]] = [{} for _ in range(buckets)]
    for b, r in ranks.items():
        p = _plain(b)
        rows[zlib.crc32(p.encode()) % buckets][p] = r
    return F.from_json(F.lit(json.dumps(rows)), "array<map<string,int>>")


def _rank(piece: Column, table: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(table, F.crc32(piece) % buckets), piece)


def _let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def joining_bytes(ranks: dict[bytes, int]) -> np.ndarray:
    """By two bytes (first times 256 plus second), whether any entry has them side by side. Between others no merge can ever cross."""
    out = np.zeros(1 << 16, bool)
    for piece in ranks:
        b = np.frombuffer(piece, np.uint8).astype(np.int64)
        out[b[:-1] * 256 + b[1:]] = True
    return out


def _pieces(joins: np.ndarray, most: int):
    """Rows of words to rows of chunks: the keys, the distinct pieces of all their words, and per key the numbers of its pieces.

    Words are cut where no merge can cross. Kernels over the bytes of a whole batch, no loop over words.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            rows, words = lists.offsets.to_numpy().astype(np.int64), lists.values
            bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
            size = bounds[rows]  # bytes up to each row
            at = 0
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
                lo, hi = int(size[at]), int(size[end])
                data = np.frombuffer(words.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
                new = np.ones(len(data), bool)
                new[1:] = ~joins[data[:-1].astype(np.int64) * 256 + data[1:]]
                of = bounds[rows[at] : rows[end]] - lo
                new[of[of < len(data)]] = True
                starts = np.flatnonzero(new)
                cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(data.tobytes())]).dictionary_encode()
                codes = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, size[at : end + 1] - lo), pa.int32()), cut.indices)
                distinct = pa.array([_plain(p) for p in cut.dictionary.to_pylist()], pa.string())
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(batch.column("k").slice(at, end - at)), one(codes), one(distinct)], names=["k", "codes", "pieces"])
                at = end

    return over


def _merged(word: Column, table: Column, buckets: int) -> Column:
    """A byte string as the array of its tokens.

    A fold merges, at each step, the adjacent pair of the lowest rank (the first of equal ones). The state
    keeps the rank of every adjacent pair, so a step looks up two pieces, not all.
    """
    rank = lambda p: _rank(p, table, buckets)
    none = F.lit(_NONE)
    start = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    pairs = lambda p: F.transform(p, lambda x, i: F.coalesce(rank(F.concat(x, F.get(p, i + 1))), none))
    state = _let(start, lambda p: F.struct(p.alias("p"), pairs(p).alias("r")))

    def step(s: Column, _: Column) -> Column:
        def at(x: Column) -> Column:
            p, r, i = s["p"], s["r"], x["i"]  # i: place of the pair, from 1
            m = F.concat(F.get(p, i - 1), F.get(p, i))
            n = F.size(p)

            def put(m: Column) -> Column:
                before = F.when(i > 1, F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.array(F.coalesce(rank(F.concat(F.get(p, i - 2), m)), none)))).otherwise(F.array().cast("array<int>"))
                after = F.array(F.when(i + 1 < n, F.coalesce(rank(F.concat(m, F.get(p, i + 1))), none)).otherwise(none))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, n)).alias("p"),
                    F.concat(before, after, F.slice(r, i + 2, n)).alias("r"),
                )

            return _let(m, put)

        least = F.array_min(s["r"])
        return F.when(least == none, s).otherwise(_let(F.struct(F.array_position(s["r"], least).cast("int").alias("i")), at))

    # a byte alone has nothing to be merged with
    return F.when(F.length(word) < 2, F.array(word)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), state, step)["p"])


def _fitted(word: Column, table: Column, buckets: int) -> Column:
    """A long byte string as the array of its tokens, in time in proportion to its length.

    Stretches are merged on their own. Tokens in a row are those of their text if each two neighbours are the tokens of
    theirs; where two stretches don't meet so, both are merged anew together, and should that not fit what stands before, with
    more and more of it.
    """
    merged = lambda p: _let(p, lambda w: _merged(w, table, buckets))
    first, last = (lambda a: F.element_at(a, 1)), (lambda a: F.element_at(a, -1))
    fit = lambda a, b: _let(merged(F.concat(a, b)), lambda m: (F.size(m) == 2) & (first(m) == a))
    stretch = lambda i: F.substring(word, i * STRETCH + 1, F.lit(STRETCH))
    joined = lambda a: F.array_join(a, "")
    none = F.array().cast("array<array<string>>")
    state = F.struct(none.alias("done"), merged(stretch(F.lit(0))).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        done, tail = s["done"], s["tail"]

        def meet(new: Column) -> Column:
            kept = F.size(done)

            def mend(found: Column, back: Column) -> Column:
                """The last stretches before and this one merged together, unless that was done or doesn't fit what stands before."""
                own = F.greatest(kept - back, F.lit(0))
                some = F.concat(joined(F.flatten(F.slice(done, own + 1, back))), joined(tail), joined(new))
                fits = lambda m: (own == 0) | fit(last(F.get(done, own - 1)), first(m))
                changed = lambda m: F.struct(F.slice(done, F.lit(1), own).alias("done"), m.alias("tail"), F.lit(True).alias("ok"))
                return F.when(found["ok"], found).otherwise(_let(merged(some), lambda m: F.when(fits(m), changed(m)).otherwise(found)))

            good = F.struct(F.concat(done, F.array(tail)).alias("done"), new.alias("tail"))
            start = F.struct(done.alias("done"), tail.alias("tail"), F.lit(False).alias("ok"))
            mended = F.aggregate(F.array(*[F.lit(k) for k in (0, 4, 64, _NONE)]), start, mend, lambda x: F.struct(x["done"].alias("done"), x["tail"].alias("tail")))
            return F.when(fit(last(tail), first(new)), good).otherwise(mended)

        return _let(merged(stretch(i)), meet)

    count = F.ceil(F.length(word) / STRETCH).cast("int")
    return _let(F.aggregate(F.sequence(F.lit(1), count - 1), state, step), lambda s: F.concat(F.flatten(s["done"]), s["tail"]))


def _encoded(word: Column, table: Column, buckets: int) -> Column:
    rank = lambda p: _rank(p, table, buckets)
    parts = F.when(F.length(word) <= STRETCH, _merged(word, table, buckets)).otherwise(_fitted(word, table, buckets))
    return _let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(parts, rank)))


def encode_texts(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], chunk: int = 8 << 20, buckets: int = 16_384) -> DataFrame:
    """A row per row: the key and the ``ids`` of its text, no special tokens; text like a special token is plain text.

    Texts are cut into words by the engine. Where they are read, texts of about ``chunk``
    bytes together become one row: the distinct pieces of their words, cut where no
    entry of the vocabulary reaches across, and for each text the numbers of its
    pieces. Folds over byte arrays then merge every distinct piece by rank, and
    each text picks its ids by number. Nothing is shuffled, and a word
    that occurs in every text costs no more than another.

    Defined cases: an empty and a null text give an empty list; a null key is a
    key like others; repeated rows give their ids each time; an empty table
    gives an empty table; other columns are dropped and may have any name.
    """
    words = F.coalesce(F.regexp_extract_all("_t", F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    docs = spread(df.select(F.col(key).alias("k"), F.col(text).alias("_t")), df).select("k", words.alias("w"))
    kind = docs.schema["k"].dataType.simpleString()
    chunks = docs.mapInArrow(_pieces(joining_bytes(ranks), chunk), f"k array<{kind}>, codes array<array<int>>, pieces array<string>")
    # the vocabulary stands in the plan once
    ids = _let(rank_map(ranks, buckets), lambda table: F.transform("pieces", lambda p: _encoded(p, table, buckets)))
    picked = _let(ids, lambda found: F.transform("codes", lambda c: F.flatten(F.transform(c, lambda i: F.get(found, i)))))
    return chunks.select(F.inline(F.arrays_zip(F.col("k").alias("k"), picked.alias("ids")))).toDF(key, "ids")


def decode_ids(df: DataFrame, key: str, ids: str, ranks: dict[bytes, int]) -> DataFrame:
    """A row per row: the key and ``text``, the binary pieces put together (in parts, so that long texts aren't copied a token at a
    time). An unknown id is an error; a null list is an empty text."""
    pieces = [""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        pieces[r] = base64.b64encode(b).decode()
    table, none = F.from_json(F.lit(json.dumps(pieces)), "array<string>"), F.unhex(F.lit(""))
    all_ids = F.coalesce(F.col(ids), F.array().cast("array<int>"))

    def put_together(x: Column) -> Column:
        n, table = F.size(x["ids"]), x["table"]
        part = F.ceil(F.sqrt(n)).cast("int")
        one = lambda i: F.aggregate(F.slice(x["ids"], i * part + 1, part), none, lambda done, k: F.concat(done, F.unbase64(F.element_at(table, k + 1))))
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / part).cast("int") - 1), one)
        return F.when(n == 0, none).otherwise(F.aggregate(parts, none, lambda done, p: F.concat(done, p)))

    joined = _let(F.struct(all_ids.alias("ids"), table.alias("table")), put_together)
    return df.select(F.col(key), F.decode(joined, "UTF-8").alias("text"))
