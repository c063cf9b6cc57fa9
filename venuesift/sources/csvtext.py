"""CSV files of any size in many tasks, with line breaks inside quoted cells and a header for each file.

Spark reads the lines of a file in byte ranges. Whether a range begins inside quotes depends on all before it, so each
range is first reduced to what it does to the state: where it ends, and how many records begin in it, if it is
entered outside and if it is entered inside quotes. These few numbers are combined along each file. Then every
range is parsed by itself from its first record on. A record that leaves its range is put together from its
pieces, and nothing else is moved.

A quote opens a cell only as its first character; after the closing quote the rest of a cell is plain text. Lines end
with LF, CR LF or CR; blank lines are no records. The ranges of both passes have to be the same, so files must not
change in between; a range that was not seen before stops the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage

#: Ranges and files up to these numbers are sent to all tasks, which is a few megabytes; beyond, they are joined.
MOST_RANGES, MOST_FILES = 200_000, 50_000
_CELLS_AT_ONCE = 1024
_NEXT = re.compile("[,\r]")
_QUOTED = re.compile('"((?:[^"]|"")*+)(?:"|$)')


def line_effect(line: str, inside: bool) -> tuple[list[int], bool]:
    """Places inside the line where a record ends, and whether the line ends inside quotes."""
    cuts: list[int] = []
    if '"' not in line:
        if not inside and "\r" in line[:-1]:
            cuts = [i + 1 for i, c in enumerate(line[:-1]) if c == "\r"]
        return cuts, inside
    at, first = 0, not inside
    while True:
        if inside:
            end = line.find('"', at)
            if end < 0:
                return cuts, True
            if line.startswith('"', end + 1):
                at = end + 2
            else:
                inside, first, at = False, False, end + 1
        elif first and line.startswith('"', at):
            inside, at = True, at + 1
        else:
            found = _NEXT.search(line, at)
            if not found:
                return cuts, False
            at, first = found.end(), True
            if found[0] == "\r" and at < len(line):
                cuts.append(at)


def cells_of(record: str) -> list[str]:
    """The cells of one record."""
    if '"' not in record:
        return record.split(",")
    cells, at = [], 0
    while True:
        value = ""
        if record.startswith('"', at):
            quoted = _QUOTED.match(record, at)
            value, at = quoted[1].replace('""', '"'), quoted.end()
        end = record.find(",", at)
        cells.append(value + record[at:end if end >= 0 else len(record)])
        if end < 0:
            return cells
        at = end + 1


class _Entered:
    """What a range does when it is entered outside or inside quotes."""

    def __init__(self, inside: bool):
        self.inside, self.begun, self.open = inside, 0, inside

    def line(self, line: str) -> list[str]:
        """Pieces of the line, one for each record that begins or goes on in it."""
        cuts, after = line_effect(line, self.inside)
        pieces = [line[a:b] for a, b in zip([0, *cuts], [*cuts, len(line)], strict=True)]
        for i, piece in enumerate(pieces):
            if (i or not self.inside) and piece.strip(" \t\r"):
                self.begun += 1
        self.inside = after
        return pieces


_RANGES = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("out_inside", pa.bool_()), ("out_begun", pa.int64()),
    ("in_inside", pa.bool_()), ("in_begun", pa.int64()), ("head", pa.string()),
])


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.RecordBatch]]:
    """Slices of the batches, each of one range, with the number of the range's change in the task."""
    current, number = None, 0
    for batch in batches:
        files, starts, at = batch.column("file").to_pylist(), batch.column("start").to_pylist(), 0
        while at < len(files):
            here = files[at], starts[at]
            end = next((i for i in range(at, len(files)) if (files[i], starts[i]) != here), len(files))
            if here != current:
                current, number = here, number + 1
            yield *here, number, batch.slice(at, end - at)
            at = end


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(file: str, start: int, ways: list[_Entered], head: list[str] | None, whole: bool) -> pa.RecordBatch:
        text = "\n".join(head) if head and whole else None
        values = (file, start, ways[0].inside, ways[0].begun, ways[1].inside, ways[1].begun, text)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _RANGES.types, strict=True)], schema=_RANGES)

    last, state = 0, None
    for file, start, number, part in _by_range(batches):
        if number != last:
            if state:
                yield row(*state)
            last, state = number, [file, start, [_Entered(False), _Entered(True)], [] if start == 0 else None, False]
        _, _, ways, head, _ = state
        for line in part.column("value").to_pylist():
            pieces = ways[0].line(line)
            ways[1].line(line)
            if head is not None and not state[4] and ways[0].begun:
                begun = next((p for p in pieces if p.strip(" \t\r")), pieces[0]) if not head else pieces[0]
                head.append(begun)
                state[4] = ways[0].begun > 1 or not ways[0].inside
    if state:
        yield row(*state)


_ROWS = pa.schema([
    ("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("owner", pa.int64()),
    ("start", pa.int64()), ("piece", pa.string()),
])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the ranges; those that leave their range as pieces, under the range in which they begin."""
    held: list[tuple] = []

    def sent(least: int) -> Iterator[pa.RecordBatch]:
        if len(held) >= least:
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*held, strict=True), _ROWS.types, strict=True)], schema=_ROWS
            )
            held.clear()

    def ended(state: dict) -> None:
        """The last record of a range: whole, or a piece of one that goes on."""
        if not state["lines"]:
            return
        text = "\n".join(state["lines"])
        if state["inside"] or state["owner"] != state["start"]:
            held.append((state["file"], state["row"], None, state["owner"], state["start"], text))
        else:
            held.append((state["file"], state["row"], cells_of(text.removesuffix("\r")), None, None, None))
        state["lines"] = []

    last, state = 0, {"lines": []}
    for file, start, number, part in _by_range(batches):
        if number != last:
            ended(state)
            inside, owner, base = (part.column(name)[0].as_py() for name in ("inside", "owner", "base"))
            if inside is None:
                raise ValueError(f"{file}: a range that was not there before; files may not change while they are read")
            last = number
            state = {"file": file, "start": start, "inside": inside, "owner": owner, "row": base - 1, "lines": []}
        for line in part.column("value").to_pylist():
            cuts, after = line_effect(line, state["inside"])
            bounds = [0, *cuts, len(line)]
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                piece = line[a:b]
                if i or not state["inside"]:
                    was = state["inside"]
                    state["inside"] = False
                    ended(state)
                    state["inside"] = was
                    if not piece.strip(" \t\r"):
                        continue
                    state["owner"], state["row"] = start, state["row"] + 1
                state["lines"].append(piece)
            state["inside"] = after
        yield from sent(_CELLS_AT_ONCE)
    ended(state)
    yield from sent(1)


_WHOLE = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(p["piece"] for p in pieces) for pieces in batch.column("pieces").to_pylist()]
        cells = [cells_of(text.removesuffix("\r")) for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(cells, _WHOLE.types[2])], schema=_WHOLE)


def _ranges(lines: DataFrame) -> DataFrame:
    """``file, start, inside, owner, base`` of each range, and ``head``, the header if it is whole in the range.

    ``owner`` is the start of the range in which the record begins that the range goes on with; ``base`` counts the records
    that begin before the range.
    """
    surveyed = cut_lineage(
        lines.mapInArrow(
            _survey,
            "file string, start long, out_inside boolean, out_begun long, in_inside boolean, in_begun long, head string",
        ), "csv-ranges",
    )
    # A range either ends in one state whatever comes in, or keeps or swaps the state. After the last range that fixes it
    # the state is its end, swapped as often as ranges since then swap.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out_inside") == F.col("in_inside")
    swaps = F.sum(F.when(~fixed & F.col("out_inside"), 1).otherwise(0)).over(before)
    marked = surveyed.withColumn("swaps", F.coalesce(swaps, F.lit(0))).withColumn(
        "here", F.col("swaps") + F.when(~fixed & F.col("out_inside"), 1).otherwise(0)
    )
    seen = F.last(F.when(fixed, F.struct("out_inside", "here")), ignorenulls=True).over(before)
    entered = marked.withColumn("seen", seen).withColumn(
        "inside",
        (F.coalesce(F.col("seen.out_inside"), F.lit(False)).cast("int") + F.col("swaps") - F.coalesce(F.col("seen.here"), F.lit(0))) % 2 == 1,
    )
    begun = F.when(F.col("inside"), F.col("in_begun")).otherwise(F.col("out_begun"))
    owner = F.last(F.when(F.col("begun") > 0, F.col("start")), ignorenulls=True).over(before)
    return entered.withColumn("begun", begun).select(
        "file", "start", "inside", F.coalesce(owner, F.lit(0).cast("long")).alias("owner"),
        F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("base"), "head",
    )


def read_cells(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Records as ``file, row, cells`` (row 0 is the header), and the headers as ``file, header``."""
    raw = spark.read.text(path, lineSep="\n")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges = cut_lineage(_ranges(lines), "csv-states")
    told = ranges.select("file", "start", "inside", "owner", "base")
    if ranges.count() <= MOST_RANGES:
        met = lines.join(F.broadcast(told), ["file", "start"], "left")
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        met = numbered.join(told, ["file", "start"], "left").sortWithinPartitions("file", "start", "at")
    parsed = met.select("file", "start", "value", "inside", "owner", "base").mapInArrow(
        _parse, "file string, row long, cells array<string>, owner long, start long, piece string"
    )
    # Pieces are few: at most two for each range.
    pieces = parsed.filter("cells IS NULL").groupBy("file", "owner").agg(
        F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces")
    ).select("file", "row", "pieces").mapInArrow(_parse_pieces, "file string, row long, cells array<string>")
    records = parsed.filter("cells IS NOT NULL").select("file", "row", "cells").unionByName(pieces)
    split = ranges.filter("start = 0 AND head IS NULL").select("file")
    heads = ranges.filter("head IS NOT NULL").select("file", "head").mapInArrow(_header_cells, "file string, header array<string>")
    if not split.isEmpty():  # a header that is longer than its range
        longer = records.filter("row = 0").join(split, "file").select("file", F.col("cells").alias("header"))
        heads = heads.unionByName(longer)
    return records, cut_lineage(heads, "csv-headers")


def _header_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [cells_of(head.removesuffix("\r")) for head in batch.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(cells, pa.list_(pa.string()))], names=["file", "header"])


def read_columns(spark: SparkSession, path: str | list[str], names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``file, row`` (from 0, without headers) and the named columns; and the files.

    A column a file does not name, and a cell a record does not have, is null; of equal names the first counts.
    """
    records, headers = read_cells(spark, path)
    bare = F.transform("header", lambda name, i: F.when(i == 0, F.ltrim(name, F.lit("﻿"))).otherwise(name))
    places = headers.select("file", *[F.array_position(bare, name).cast("int").alias(f"at_{name}") for name in names])
    data = records.filter("row > 0")
    if headers.count() <= MOST_FILES:
        met = data.join(F.broadcast(places), "file")
    else:
        met = lookup_join(data, places, ["file"], spread=["row"])
    return met.select(
        "file", (F.col("row") - 1).alias("row"), *[F.get("cells", F.col(f"at_{name}") - 1).alias(name) for name in names]
    ), headers.select("file")
