"""Sources that are asked venue by venue while a job runs, and may fail for any of them.

A source is a function ``fetch(name, city)`` that gives items with ``snippet`` and perhaps ``url`` and
``reliability``. An error of one call is the error of its venue and source; other venues, and other sources, go on.
What came back is written once, so that evidence and errors are from the same calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.functions import rules as R
from venuesift.functions import text as X
from venuesift.operators.calls import Retry, in_order
from venuesift.session import cut_lineage
from venuesift.sources.catalog import EvidenceSource

Fetch = Callable[[str, str], Iterable[Mapping[str, str | None]]]

#: Calls of one task at once.
IN_FLIGHT = 4
_FETCHED = pa.schema([
    ("match_key", pa.string()), ("item_pos", pa.int64()), ("url", pa.string()), ("snippet", pa.string()),
    ("reliability", pa.string()), ("error", pa.string()),
])


def _rows(fetch: Fetch, name: str, city: str) -> list[tuple]:
    """Items as rows; an item without a text snippet is an error of the source."""
    rows = []
    for at, item in enumerate(fetch(name, city)):
        snippet, url, reliability = (item.get(part) for part in ("snippet", "url", "reliability"))
        if not isinstance(snippet, str):
            raise ValueError("item without a text snippet")
        rows.append((at, url, snippet, reliability))
    return rows


def fetched_source(
    venues: DataFrame, name: str, source_type: str, make_fetch: Callable[[], Fetch], in_flight: int = IN_FLIGHT,
    retry: Retry = Retry(), tasks: int | None = None,  # noqa: B008
) -> EvidenceSource:
    """Ask a source for each different venue (``name, city``).

    ``make_fetch`` builds the client once for each task, which has up to ``in_flight`` calls running; ``tasks`` bounds how many
    tasks ask at once. Reliability is the default of the kind where an item has none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make_fetch()
        for batch in batches:
            keys, names, cities = (column.to_pylist() for column in batch.columns)
            found = []
            asked = ((fetch, *venue) for venue in zip(names, cities, strict=True))
            for key, (rows, error) in zip(keys, in_order(_rows, asked, in_flight, retry), strict=True):
                found += [(key, *row, None) for row in rows] if error is None else [(key, None, None, None, None, error)]
            if found:
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), _FETCHED.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_FETCHED)

    each = venues.select("name", "city").distinct()
    asked = (each if tasks is None else each.repartition(tasks)).select(
        X.lookup_key(F.col("name"), F.col("city")).alias("match_key"), "name", "city"
    )
    told = cut_lineage(
        asked.mapInArrow(run, "match_key string, item_pos long, url string, snippet string, reliability string, error string"),
        "fetched",
    )
    kind = F.lit(source_type)
    rows = told.filter("error IS NULL").select(
        F.lit("lookup").alias("key_kind"), "match_key", F.lit(name).alias("source_name"), kind.alias("source_type"),
        "item_pos", "url", "snippet", F.coalesce("reliability", R.default_reliability(kind)).alias("reliability"),
    )
    errors = told.filter("error IS NOT NULL").select(F.lit("lookup").alias("key_kind"), "match_key", "error")
    return EvidenceSource(name, rows, errors)
