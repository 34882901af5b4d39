"""Large JSON documents read by many tasks.

A document of any size is cut into byte blocks. Whether a block starts inside a string, and how deep, follows from the blocks before it:

1. every task reports for its blocks how many unescaped quotes they hold (odd or even) and how the depth changes, for either kind of start,
2. running totals over the blocks of a file (one small row each) give every block its start,
3. every task reads its blocks again and emits the entries that begin in them; an entry that passes the end of its block is read on to its own end.

So no file is one task, and nothing but block rows is gathered. Values go out as JSON text for ``from_json``. Files are opened with Arrow's file systems
(local paths, HDFS, S3); a file may hold one document, several one after another, or an array of documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from campuspulse.session import materialise

BLOCK_BYTES = 4 << 20
_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"[ \t\r\n]*:[ \t\r\n]*\Z')
_LOOK_BACK = 4096


class Opened:
    """Byte ranges of one file."""

    def __init__(self, uri: str):
        system, path = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, end - start))

    def backslashes_before(self, at: int) -> int:
        step = 64
        while True:
            low = max(0, at - step)
            piece = self.read(low, at)
            run = len(piece) - len(piece.rstrip(b"\\"))
            if run < len(piece) or low == 0:
                return run
            step *= 8

    def key_before(self, at: int) -> str | None:
        """The name that leads to the value starting at ``at``."""
        found = _KEY.search(self.read(max(0, at - _LOOK_BACK), at))
        return json.loads(b'"' + found[1] + b'"', strict=False) if found else None


def structure(data: np.ndarray, run: int, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of brackets outside strings, +1 or -1 for each, inside at the end); ``run`` backslashes stand right before the data."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), inside
    slash = data == _BACKSLASH
    at = np.arange(len(data), dtype=np.int32)
    last = np.maximum.accumulate(np.where(slash, np.int32(-1 - run), at))
    before = np.concatenate([[np.int32(-1 - run)], last[:-1]])
    quote = (data == _QUOTE) & ((at - before) % 2 == 1)
    within = (np.cumsum(quote, dtype=np.int32) + int(inside)) % 2
    places = np.flatnonzero((_STEP[data] != 0) & (within == 0))
    return places, _STEP[data[places]].astype(np.int64), bool(within[-1])


# --- starts of blocks ------------------------------------------------------------------


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            file = Opened(r["path"])
            data = np.frombuffer(file.read(r["start"], r["end"]), np.uint8)
            run = file.backslashes_before(r["start"])
            _, outer, odd = structure(data, run, False)
            _, inner, _ = structure(data, run, True)
            text = data[:64].tobytes().lstrip()
            rows.append({**r, "odd": int(odd), "outer": int(outer.sum()), "inner": int(inner.sum()), "wrapped": int(r["start"] == 0 and text[:1] == b"[")})
        yield pa.RecordBatch.from_pylist(rows, _SUMMARY)


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("odd", pa.int32()), ("outer", pa.int64()), ("inner", pa.int64()), ("wrapped", pa.int32())])


def blocks(spark: SparkSession, path: str, size: int = BLOCK_BYTES) -> DataFrame:
    """(path, start, end, inside, depth): byte blocks of all files with the state each starts in; depth 0 is outside a document."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = materialise(cut.select("path", "start", F.least(F.col("start") + size, "length").alias("end")))
    # One block a task until there are more blocks than tasks to use.
    tasks = max(1, min(ranges.count(), 10_000))
    dealt = ranges.repartitionById(tasks, F.pmod(F.xxhash64("path") + F.floor(F.col("start") / size), F.lit(tasks)).cast("int"))
    found = materialise(dealt.mapInArrow(_summaries, "path string, start long, end long, odd int, outer long, inner long, wrapped int"))
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    inside = F.pmod(F.coalesce(F.sum("odd").over(ahead), F.lit(0)), F.lit(2)).cast("int")
    placed = found.withColumn("inside", inside).withColumn("_wrapped", F.max("wrapped").over(whole))
    change = F.when(F.col("inside") == 1, F.col("inner")).otherwise(F.col("outer"))
    depth = F.coalesce(F.sum(change).over(ahead), F.lit(0)) - F.col("_wrapped")
    return materialise(placed.select("path", "start", "end", "inside", depth.cast("int").alias("depth")))


# --- entries ---------------------------------------------------------------------------


def _to_end(file: Opened, at: int, size: int) -> bytes:
    """The bracketed value that starts at ``at``, read on until it closes."""
    parts, level, inside, run, here = [], 0, False, 0, at
    while here < file.size:
        piece = file.read(here, here + size)
        places, steps, inside = structure(np.frombuffer(piece, np.uint8), run, inside)
        ends = np.flatnonzero(level + np.cumsum(steps) == 0)
        if len(ends):
            return b"".join(parts) + piece[: int(places[ends[0]]) + 1]
        level += int(steps.sum())
        tail = len(piece) - len(piece.rstrip(b"\\"))
        run = tail if tail < len(piece) else run + tail
        parts.append(piece)
        here += len(piece)
    return b"".join(parts)


def _entries(depth: int, size: int, only: str | None = None):
    """Values that open at ``depth``, each with the name of the field it stands in: its own at depth 1, that of its array at depth 2."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                file = Opened(r["path"])
                body = file.read(r["start"], r["end"])
                places, steps, _ = structure(np.frombuffer(body, np.uint8), file.backslashes_before(r["start"]), bool(r["inside"]))
                after = r["depth"] + np.cumsum(steps)
                opening = np.flatnonzero((steps > 0) & (after - 1 == depth))
                closing = places[(steps < 0) & (after == depth)]
                fields, values = [], []
                # An array that was open at the block's start is named by the reader of its first entry: look it up once.
                name = r["field"]
                outer = iter(places[(steps > 0) & (after - 1 == 1)].tolist() if depth == 2 else [])
                next_outer = next(outer, None)
                for k in opening.tolist():
                    at = int(places[k])
                    if depth == 1:
                        name = file.key_before(r["start"] + at)
                    else:
                        while next_outer is not None and next_outer < at:
                            name, next_outer = file.key_before(r["start"] + next_outer), next(outer, None)
                    if only is not None and name != only:
                        continue
                    stop = np.searchsorted(closing, at)
                    value = body[at: int(closing[stop]) + 1] if stop < len(closing) else _to_end(file, r["start"] + at, size)
                    fields.append(name)
                    values.append(value.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(values, pa.string())], names=["field", "value"])

    return emit


def _last_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of the last array or object that opens at depth 1 in each block."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            file = Opened(r["path"])
            data = np.frombuffer(file.read(r["start"], r["end"]), np.uint8)
            places, steps, _ = structure(data, file.backslashes_before(r["start"]), bool(r["inside"]))
            opening = places[(steps > 0) & (r["depth"] + np.cumsum(steps) == 2)]
            rows.append({"path": r["path"], "start": r["start"], "name": file.key_before(r["start"] + int(opening[-1])) if len(opening) else None})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("name", pa.string())]))


def _spread(known: DataFrame) -> DataFrame:
    tasks = max(1, min(known.count(), 10_000))
    return known.repartitionById(tasks, F.pmod(F.xxhash64("path") + F.floor(F.col("start") / F.greatest(F.col("end") - F.col("start"), F.lit(1))), F.lit(tasks)).cast("int"))


def named_values(known: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(field, value): the arrays and objects of each document by name."""
    return _spread(known).withColumn("field", F.lit(None).cast("string")).mapInArrow(_entries(1, size), "field string, value string")


def array_records(known: DataFrame, size: int = BLOCK_BYTES, only: str | None = None) -> DataFrame:
    """(field, value): the objects and arrays held by the arrays of each document (by one of them with ``only``), with the name of their array."""
    names = known.mapInArrow(_last_names, "path string, start long, name string")
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = names.select("path", "start", F.last("name", ignorenulls=True).over(ahead).alias("field"))
    return _spread(known.join(carried, ["path", "start"])).mapInArrow(_entries(2, size, only), "field string, value string")


def parsed(entries: DataFrame, field: str | None, kind: StructType | DataType) -> DataFrame:
    """Entries of one field as columns of ``kind``."""
    own = entries.where(F.col("field") == field) if field is not None else entries
    return own.select("field", F.from_json("value", kind).alias("r"))
