"""Readers of paged interfaces: listings and change feeds as Spark data sources.

How a page is fetched is a function that the caller gives, so readers hold no
address or credential. Each source (an account, a drive) is a partition of its
own; pages of one follow each other, since each names the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: (source, cursor) -> (rows, next cursor); a cursor is None for the first page, and the next one None after the last.
FetchPage = Callable[[str, str | None], tuple[list[tuple], str | None]]
#: source -> token of the present; (source, token) -> (rows, next token, whether the feed ends here).
FetchToken = Callable[[str], str]
FetchChanges = Callable[[str, str], tuple[list[tuple], str, bool]]


class _Of(InputPartition):
    def __init__(self, source: str):
        self.source = source


def _sources(options: dict) -> list[str]:
    return [s for s in options.get("sources", "").split(",") if s]


def register_listing(spark: SparkSession, name: str, schema: str, fetch: FetchPage, token: FetchToken | None = None, most: int = 1000) -> None:
    """Register a source whose rows are (source, *schema) of all pages, at most ``most`` a source.

    With ``token``, a column token comes first after the source: it is taken before the
    first page, so a feed that starts there misses nothing that changes meanwhile.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [_Of(s) for s in _sources(self.options)]

        def read(self, partition: _Of | None) -> Iterator[tuple]:
            if partition is None:  # no sources: one empty partition
                return
            mark = (token(partition.source),) if token else ()
            cursor, left = None, most
            while left > 0:
                rows, cursor = fetch(partition.source, cursor)
                for r in rows[:left]:
                    yield (partition.source, *mark, *r)
                left -= len(rows)
                if cursor is None:
                    return

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "source string, " + ("token string, " if token else "") + schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Listing)


def register_feed(spark: SparkSession, name: str, schema: str, start: FetchToken, changes: FetchChanges) -> None:
    """Register a stream of changes (source, token, place, *schema) of one source; its offset is the token.

    A batch holds the pages from one token up to the end of the feed, and the
    offset moves there only then: a batch that fails is read again from its token.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            (self.source,) = _sources(options)

        def initialOffset(self) -> dict:
            return {"token": start(self.source)}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, token = self._from(start["token"])
            return iter(rows), {"token": token}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(self._from(start["token"], end["token"])[0])

        def commit(self, end: dict) -> None:
            pass

        def _from(self, token: str, end: str | None = None) -> tuple[list[tuple], str]:
            out, done = [], False
            while not done and token != end:
                at = token
                rows, token, done = changes(self.source, at)
                out += [(self.source, at, i, *r) for i, r in enumerate(rows)]
            return out, token

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"source string, token string, place int, {schema}"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader(self.options)

    spark.dataSource.register(Feed)
