"""Threaded maps for functions that wait on input and output, inside mapInPandas and mapInArrow."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame

THREADS = 16


def thread_map(f: Callable, items: Iterable, *args: Any, num_threads: int | None = THREADS, star: bool = False, flat: bool = False, **kwargs: Any) -> Iterator:
    """f of each item, in order; up to num_threads at once (None: a plain map). star spreads tuples, flat chains what f returns."""
    call = (lambda x: f(*x, *args, **kwargs)) if star else (lambda x: f(x, *args, **kwargs))
    whole = (lambda x: list(call(x))) if flat else call
    if num_threads is None:
        out: Iterator = map(whole, items)
    else:
        out = _pooled(whole, items, num_threads)
    return itertools.chain.from_iterable(out) if flat else out


def _pooled(f: Callable, items: Iterable, num_threads: int) -> Iterator:
    """At most two rounds of items are held, so an endless input is fine."""
    with ThreadPoolExecutor(num_threads) as pool:
        waiting: list = []
        for x in items:
            waiting.append(pool.submit(f, x))
            if len(waiting) >= 2 * num_threads:
                yield waiting.pop(0).result()
        for w in waiting:
            yield w.result()


def thread_map_batches(df: DataFrame, f: Callable, schema: str, num_threads: int | None = THREADS) -> DataFrame:
    """mapInPandas with f on several batches of a partition at once."""

    def run(batches: Iterable) -> Iterator:
        return thread_map(f, batches, num_threads=num_threads)

    return df.mapInPandas(run, schema)
