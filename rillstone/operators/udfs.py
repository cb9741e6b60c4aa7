"""Python functions over columns: plain and asynchronous, with retries, timeouts and caches, in Arrow batches."""

from __future__ import annotations

import asyncio
import functools
import hashlib
import inspect
import pickle
import sqlite3
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NoRetry:
    def pauses(self) -> Iterator[float]:
        return iter(())


@dataclass(frozen=True)
class FixedDelay:
    max_retries: int = 3
    delay_ms: int = 1000

    def pauses(self) -> Iterator[float]:
        for _ in range(self.max_retries):
            yield self.delay_ms / 1000


@dataclass(frozen=True)
class ExponentialBackoff:
    max_retries: int = 3
    initial_delay_ms: int = 1000
    factor: float = 2.0

    def pauses(self) -> Iterator[float]:
        for i in range(self.max_retries):
            yield self.initial_delay_ms / 1000 * self.factor**i


@dataclass
class InMemoryCache:
    """Results kept in each Python worker, the least recently used ones going first."""

    size: int = 100_000
    held: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key):
        self.held.move_to_end(key)
        return self.held[key]

    def put(self, key, value) -> None:
        self.held[key] = value
        if len(self.held) > self.size:
            self.held.popitem(last=False)

    def __contains__(self, key) -> bool:
        return key in self.held


@dataclass
class DiskCache:
    """Results kept in an SQLite file on each machine."""

    path: str

    def _db(self):
        db = sqlite3.connect(self.path, timeout=60)
        db.execute("CREATE TABLE IF NOT EXISTS held (k TEXT PRIMARY KEY, v BLOB)")
        return db

    def get(self, key):
        with self._db() as db:
            return pickle.loads(db.execute("SELECT v FROM held WHERE k = ?", (self._key(key),)).fetchone()[0])

    def put(self, key, value) -> None:
        with self._db() as db:
            db.execute("INSERT OR REPLACE INTO held VALUES (?, ?)", (self._key(key), pickle.dumps(value)))

    def __contains__(self, key) -> bool:
        with self._db() as db:
            return db.execute("SELECT 1 FROM held WHERE k = ?", (self._key(key),)).fetchone() is not None

    @staticmethod
    def _key(key) -> str:
        return hashlib.sha256(pickle.dumps(key)).hexdigest()


def with_retries(fun: Callable, strategy) -> Callable:
    """fun, called again after each pause of the strategy when it fails."""
    if inspect.iscoroutinefunction(fun):

        @functools.wraps(fun)
        async def again(*args):
            pauses = strategy.pauses()
            while True:
                try:
                    return await fun(*args)
                except Exception:
                    pause = next(pauses, None)
                    if pause is None:
                        raise
                    await asyncio.sleep(pause)

        return again

    @functools.wraps(fun)
    def again_now(*args):
        pauses = strategy.pauses()
        while True:
            try:
                return fun(*args)
            except Exception:
                pause = next(pauses, None)
                if pause is None:
                    raise
                time.sleep(pause)

    return again_now


def with_cache(fun: Callable, cache) -> Callable:
    if inspect.iscoroutinefunction(fun):

        @functools.wraps(fun)
        async def kept(*args):
            if args not in cache:
                cache.put(args, await fun(*args))
            return cache.get(args)

        return kept

    @functools.wraps(fun)
    def kept_now(*args):
        if args not in cache:
            cache.put(args, fun(*args))
        return cache.get(args)

    return kept_now


def _batch_runner(fun: Callable, capacity: int | None, timeout: float | None, propagate_none: bool):
    """Values of fun for rows of arguments; a coroutine function runs for many rows at once."""
    is_async = inspect.iscoroutinefunction(fun)

    def run(rows: list[tuple]) -> list:
        if not is_async:
            return [None if propagate_none and None in r else fun(*r) for r in rows]

        async def every():
            gate = asyncio.Semaphore(capacity or 1_000_000)

            async def one(r):
                if propagate_none and None in r:
                    return None
                async with gate:
                    return await (asyncio.wait_for(fun(*r), timeout) if timeout else fun(*r))

            return await asyncio.gather(*[one(r) for r in rows])

        return asyncio.run(every())

    return run


def udf(fun: Callable, kind: str, *, deterministic: bool = True, propagate_none: bool = False, retries=None, cache=None, capacity: int | None = None, timeout: float | None = None) -> Callable[..., Column]:
    """A column function from a plain or asynchronous Python function. Rows come in Arrow batches."""
    if retries:
        fun = with_retries(fun, retries)
    if cache is not None:
        fun = with_cache(fun, cache)
    run = _batch_runner(fun, capacity, timeout, propagate_none)

    @F.pandas_udf(kind)
    def call(*cols: pd.Series) -> pd.Series:
        rows = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in r) for r in zip(*cols, strict=True)]
        return pd.Series(run(rows), dtype=object)

    return call if deterministic else call.asNondeterministic()


def apply_all_rows(df: DataFrame, fun: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 1_000_000) -> DataFrame:
    """A function of the whole table, run in one task; a table of more than ``most`` rows is an error."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = 0, []
        for f in frames:
            rows += len(f)
            if rows > most:
                raise ValueError(f"more than {most} rows for a function of the whole table")
            held.append(f)
        if held:
            yield fun(pd.concat(held, ignore_index=True))

    return df.repartition(1).mapInPandas(over, schema)


class AsyncTransformer:
    """Rows through an asynchronous function that gives a dict of result columns; failures are kept apart.

    Override invoke. finished has every row with ``status`` and the result
    columns (null where it failed); successful and failed are its parts.
    """

    def __init__(self, df: DataFrame, schema: str, capacity: int = 256, timeout: float | None = None, retries=None):
        call = with_retries(self.invoke, retries) if retries else self.invoke
        out = df.sparkSession.createDataFrame([], schema).schema
        names = out.fieldNames()
        arrow = [(c, df.schema[c].dataType.simpleString()) for c in df.columns]

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(out)
            for b in batches:

                async def every(rows):
                    gate = asyncio.Semaphore(capacity)

                    async def one(r):
                        async with gate:
                            try:
                                return await (asyncio.wait_for(call(**r), timeout) if timeout else call(**r)), "success"
                            except Exception:  # noqa: BLE001
                                return {}, "failure"

                    return await asyncio.gather(*[one(r) for r in rows])

                got = asyncio.run(every(b.to_pylist()))
                cols = [pa.array([g.get(n) for g, _ in got], kinds.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array([s for _, s in got])], names=[*b.schema.names, *names, "status"])

        kinds = ", ".join(f"`{c}` {t}" for c, t in [*arrow, *[(f.name, f.dataType.simpleString()) for f in out], ("status", "string")])
        self.finished = df.mapInArrow(over, kinds)
        self.successful = self.finished.where("status = 'success'").drop("status")
        self.failed = self.finished.where("status = 'failure'").drop("status", *names)

    async def invoke(self, **row) -> dict:
        raise NotImplementedError
