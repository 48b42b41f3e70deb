"""Route utterances as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wayfind.operators import rowscore
from wayfind.operators import similarity as S
from wayfind.operators.features import Encoding
from wayfind.streaming.io import drain, replace_batch


class StoredCatalog:
    """The encoded catalog of a stream, stored once per version and read again only when the version changes.

    A catalog that is small by count is held as an index, against which each
    query is scored in its own row; a larger one is joined as it is stored.
    """

    def __init__(self, catalog: Callable[[], DataFrame], encoding: Encoding, key: str, folder: str, version: Callable[[], object] = lambda: 0):
        self.catalog, self.encoding, self.key, self.folder, self.version = catalog, encoding, key, folder, version
        self.held: object = None
        self.encoded = 0

    def _renew(self, now: object) -> None:
        made = self.catalog()
        path = f"{self.folder}/encoded={self.encoded}"
        made.write.mode("overwrite").parquet(path)
        self.stored = made.sparkSession.read.schema(made.schema).parquet(path)
        self.index = rowscore.query_side(self.stored, self.key, self.encoding)
        self.held, self.encoded = now, self.encoded + 1

    def route(self, queries: DataFrame, query_key: str, k: int) -> DataFrame:
        now = self.version()
        if not self.encoded or now != self.held:
            self._renew(now)
        if self.index is not None:
            return rowscore.best_entries(self.index, queries, self.encoding, query_key, k, self.stored.schema[self.key].dataType)
        return S.top_k(queries, self.stored, self.encoding, query_key, self.key, k)


def route_stream(queries: DataFrame, catalog: Callable[[], DataFrame], encoding: Encoding, query_key: str, catalog_key: str, k: int,
                 folder: str, version: Callable[[], object] = lambda: 0) -> str:
    """Score every micro-batch against a catalog; returns the output path.

    ``catalog`` makes the encoded catalog; it is called at the start and when
    ``version`` gives something new at the start of a batch.
    """
    out = f"{folder}/routes"
    stored = StoredCatalog(catalog, encoding, catalog_key, f"{folder}/catalog", version)
    drain(queries, folder, lambda batch, number: replace_batch(stored.route(batch, query_key, k), number, out))
    return out
