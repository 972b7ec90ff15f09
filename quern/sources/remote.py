"""Remote sources: pages of an index as partitions, and lookups that tasks send side by side.

What fetches is named by module and function, so that executors import it
and no connection is made on the driver.
"""

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def persistent(fetch: Callable, tries: int, deadline: float, pause: float = 0.05) -> Callable:
    """``fetch``, called again after an OSError, with growing pauses, ``tries`` times or until ``deadline`` seconds are over."""

    def call(*args):
        began = time.monotonic()
        for k in range(tries):
            try:
                return fetch(*args)
            except OSError:
                wait = pause * 2**k
                if k + 1 == tries or time.monotonic() - began + wait > deadline:
                    raise
                time.sleep(wait)

    return call


class PagedIndex(DataSource):
    """Rows of a remote index, a partition per page.

    Options: fetch (``module:function``, called with offset and limit, gives
    tuples in the order of the schema), total, page, tries and deadline. The
    schema is the reader's. A page that still fails ends the job: no page is
    left out in silence.
    """

    @classmethod
    def name(cls) -> str:
        return "pagedindex"

    def reader(self, schema: T.StructType) -> "PagedIndexReader":
        return PagedIndexReader(dict(self.options))


class PagedIndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.fetch, self.total, self.page = options["fetch"], int(options["total"]), int(options["page"])
        self.tries, self.deadline = int(options.get("tries", 5)), float(options.get("deadline", 600))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, self.total, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch = persistent(getattr(import_module(module), name), self.tries, self.deadline)
        yield from fetch(partition.value, min(self.page, self.total - partition.value))


def squares(offset: int, limit: int) -> list[tuple[int, int]]:
    """An index that needs no network, for tests: (k, k * k modulo 97)."""
    return [(k, k * k % 97) for k in range(offset, offset + limit)]


def looked_up(names: DataFrame, column: str, lookup: Callable[[str], int | None], threads: int = 8, tries: int = 5, deadline: float = 600) -> DataFrame:
    """(column, key) of each distinct name, looked up by ``threads`` at a time in every task.

    A key that several names claim is no name's: it is null for all of them.
    A null name is left out.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                keys = list(pool.map(persistent(lookup, tries, deadline), batch.column(0).to_pylist()))
                yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64())], names=["name", "key"])

    found = names.select(F.col(column).alias("name")).where("name is not null").distinct().mapInArrow(ask, "name string, key long")
    claims = found.groupBy("key").agg(F.count(F.lit(1)).alias("claims"))
    own = F.when(F.col("claims") == 1, F.col("key")).alias("key")
    return found.join(claims, "key", "left").select(F.col("name").alias(column), own)
