"""Texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def pieces(text: str) -> list[str]:
    """White-space tokens, each with the white space before it; a plain tokenizer that needs no vocabulary."""
    return re.findall(r"\s*\S+|\s+$", text)


def token_chunks(text: str, least: int, most: int, cut: Callable[[str], list[str]] = pieces) -> list[str]:
    """Chunks of at most ``most`` tokens; a chunk ends behind its last . ? ! or line end, at a token's end, if that lies beyond three times ``least`` characters."""
    toks, out, at = cut(text), [], 0
    while at < len(toks):
        took = toks[at : at + most]
        n = len(took)
        if at + n < len(toks):
            size, ends = 0, []
            for i, t in enumerate(took):
                size += len(t)
                after = toks[at + i + 1]
                line_end = "\n" in after[: len(after) - len(after.lstrip())]
                if size > 3 * least and (t.rstrip()[-1:] in ".?!" or line_end):
                    ends.append(i + 1)
            n = ends[-1] if ends else n
        out.append("".join(toks[at : at + n]))
        at += n
    return out


def recursive_chunks(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS, length: Callable[[str], int] = len) -> list[str]:
    """Chunks of at most ``size``, cut at the coarsest separator that does it and packed again, ``overlap`` being repeated."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep in separators else ()
    parts = list(text) if sep == "" else [p for p in text.split(sep)]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            joined = sep.join(held).strip()
            if joined:
                out.append(joined)

    for p in parts:
        if length(p) > size and finer:
            flush()
            held = []
            out += recursive_chunks(p, size, overlap, finer, length)
            continue
        if held and length(sep.join([*held, p])) > size:
            flush()
            while held and (length(sep.join(held)) > overlap or length(sep.join([*held, p])) > size):
                held.pop(0)
        held.append(p)
    flush()
    return out


def split_texts(df: DataFrame, text: str, chunker: Callable[[str], list[str]], name: str = "chunk") -> DataFrame:
    """A row per chunk, with its place in ``chunk_no``. Null texts have none."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else chunker(t))

    return df.select(*df.columns, F.posexplode(cut(F.col(text))).alias("chunk_no", name))


def null_chunks(df: DataFrame, text: str, name: str = "chunk") -> DataFrame:
    """The whole text as one chunk."""
    return df.withColumns({"chunk_no": F.lit(0), name: F.col(text)})


def parse_utf8(data: Column) -> Column:
    """Bytes as text, broken sequences replaced."""
    return F.decode(data, "UTF-8")


def combine_metadata(df: DataFrame, text: str = "text", metadata: str = "metadata") -> DataFrame:
    """A column text of struct (text, metadata) joined with the row's own metadata (Json texts; the text's fields win)."""
    a, b = F.from_json(metadata, "map<string,string>"), F.from_json(F.col(text)["metadata"], "map<string,string>")
    own = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(b, F.create_map().cast("map<string,string>"))), k))
    return df.withColumn(metadata, F.to_json(F.map_concat(own, F.coalesce(b, F.create_map().cast("map<string,string>"))))).withColumn(text, F.col(text)["text"])


def rerank_top(docs: Column, scores: Column, k: int) -> Column:
    """The k documents of an array with the greatest scores, best first."""
    z = F.zip_with(docs, scores, lambda d, s: F.struct((-s).alias("s"), d.alias("d")))
    return F.transform(F.slice(F.array_sort(z), 1, k), lambda x: x["d"])
