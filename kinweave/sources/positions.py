"""CSV files with the place of each row, read in pieces.

A line end inside quotes ends no record, and whether a piece begins inside quotes depends on all before it. So pieces are
read twice: first each counts its quotes, and its record ends for either case; sums over these few numbers tell, for each
piece, whether it begins inside quotes and the number of its first record. Then each piece gives the records that begin in
it, reading on past its end for the last one. No task holds more than a piece and one record.

A row is known by its file's address (``_file``) and its number in it (``_row``, the header being 0): the order of rows
as they stand, which no plain scan keeps. Records end with a line feed, a carriage return before it is left out; quotes are
doubled inside quotes. Empty lines make no rows but count; cells that are missing are empty, cells too many are dropped.
Executors read through pyarrow: a local or shared mount, S3, GCS or HDFS.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece. A task holds several times that: the bytes, the places of quotes and line ends, the record ends.
PIECE = 8 << 20
#: Bytes read at a time beyond a piece's end.
BEYOND = 1 << 20
#: Rows of a batch.
ROWS = 10_000
POSITION = ("_file", "_row")


def _open(address: str):
    """(file system, path) of an address."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), os.path.abspath(address))


def _files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the file, or of the files in a folder, by name; names that begin with a dot or underscore aren't data."""
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.path)
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._"]


def _read(address: str, start: int, end: int) -> bytes:
    system, at = _open(address)
    with system.open_input_file(at) as f:
        return f.read_at(max(0, end - start), start)


def _ends(data: bytes, quotes: int) -> np.ndarray:
    """Places of the line feeds that end a record, where ``quotes`` stand before the data."""
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 10)
    inside = (np.searchsorted(np.flatnonzero(raw == 34), feeds) + quotes) & 1
    return feeds[inside == 0]


def _records(data: bytes) -> Iterator[list[str]]:
    """Cells of each record, an empty line's none."""
    csv.field_size_limit(1 << 31)
    yield from csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8", errors="replace", newline=""))


def _header(address: str, size: int) -> list[str]:
    data, at = b"", 0
    while at < size and not len(_ends(data, 0)):
        data, at = data + _read(address, at, min(size, at + BEYOND)), min(size, at + BEYOND)
    ends = _ends(data, 0)
    return next(_records(data[: ends[0] + 1] if len(ends) else data).__iter__(), []) if data else []


def read_positioned(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """All columns of the files as text, and POSITION. All files have the first one's header."""
    files = _files(path)
    names = [n.removeprefix("﻿") for n in next((_header(f, s) for f, s in files if s), [])]
    schema = ", ".join([*(f"`{n}` string" for n in names), "_file string", "_row bigint"])
    pieces = [(i, f, k, a, min(s, a + piece), s) for i, (f, s) in enumerate(files) for k, a in enumerate(range(0, s, piece))]
    if not pieces:
        return spark.createDataFrame([], schema)
    asked = spark.createDataFrame(pieces, "number int, file string, k int, start bigint, stop bigint, size bigint").repartition(len(pieces))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                # From the byte before the piece: a record begins in the piece where one ends in front of it.
                data = _read(r["file"], max(0, r["start"] - 1), r["stop"] - 1)
                out = [r["number"], r["k"], data.count(b'"'), len(_ends(data, 0)), len(_ends(data, 1))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], names=["number", "k", "quotes", "ends", "ends_inside"])

    counts = {(r.number, r.k): r for r in asked.mapInArrow(count, "number bigint, k bigint, quotes bigint, ends bigint, ends_inside bigint").collect()}  # a row a piece
    known, quotes, first = [], 0, 0
    for number, file, k, start, stop, size in pieces:
        quotes, first = (0, 0) if k == 0 else (quotes, first)
        known.append((file, start, stop, size, quotes & 1, first if k else 0))
        r = counts[number, k]
        first += (1 if k == 0 else 0) + (r.ends_inside if quotes & 1 else r.ends)
        quotes += r.quotes
    width = len(names)

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                at, stop, inside = max(0, r["start"] - 1), r["stop"], r["quotes"]
                data = _read(r["file"], at, stop)
                ends = _ends(data, inside)
                begin = 0 if r["start"] == 0 else next((int(x) + 1 for x in ends if x < stop - 1 - at), None)
                if begin is None:
                    continue
                while not (len(ends) and ends[-1] >= r["stop"] - 1 - at) and stop < r["size"]:  # on to the end of the last record
                    more = min(r["size"], stop + BEYOND)
                    ends_ = _ends(part := _read(r["file"], stop, more), inside + data.count(b'"'))
                    data, ends, stop = data + part, np.concatenate((ends, ends_ + len(data))), more
                last = next((int(x) for x in ends[np.searchsorted(ends, r["stop"] - 1 - at) :]), len(data) - 1)
                held: list[list[str]] = []
                places: list[int] = []

                def told():
                    cells = [pa.array([row[i] for row in held], pa.string()) for i in range(width)]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*cells, pa.array([r["file"]] * len(held)), pa.array(places, pa.int64())], names=[*names, *POSITION])  # noqa: B023

                for place, row in enumerate(_records(data[begin : last + 1]), r["first"]):
                    if place and row:
                        held.append((row + [""] * (width - len(row)))[:width])
                        places.append(place)
                    if len(held) == ROWS:
                        yield told()
                        held, places = [], []
                if held:
                    yield told()

    rows = spark.createDataFrame(known, "file string, start bigint, stop bigint, size bigint, quotes int, first bigint").repartition(len(known))
    return rows.mapInArrow(parse, schema)


def first_rows(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Of rows with one key, the first as they stand in their files; without POSITION."""
    from kinweave.operators.pairs import first_by_key

    return first_by_key(df, key, [F.col(c) for c in POSITION]).drop(*POSITION)
