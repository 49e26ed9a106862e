"""CSV with quoted line breaks, read in byte ranges: one large file is many tasks.

The text source cuts files into ranges and deals whole lines to them. A line break ends a record only if the quotes before
it, counted from the file's start, are even in number. So a first scan counts the quotes of each range; running sums over
a file's ranges tell in which state each range begins; a second scan, starting from that state, joins the lines of each
record. Records that cross ranges leave a fragment in each, which are put together afterwards: two rows per range at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, COMMA = b'",'
ODD_QUOTES = "a quote stands inside a field that is not quoted, or the last quote is not closed; read the file whole"


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, line) in the order of the file within each range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _quotes(column: str):
    return F.octet_length(column) - F.octet_length(F.replace(column, F.lit('"'), F.lit("")))


def _states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, returns), one row per range: whether it begins inside quotes, and whether the file's line
    breaks are \\r\\n, as its first line has it."""
    # a range is read in order by one task
    ranges = lines.groupBy("file", "start").agg(F.sum(_quotes("line")).alias("quotes"), F.first(F.col("line").endswith("\r")).alias("returns"))
    order = Window.partitionBy("file").orderBy("start")
    before = F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"),
                         F.first("returns").over(order).alias("returns"))


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lines' bytes end to end, and where each line starts."""
    lines = lines.cast(pa.large_string())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def _well_formed(flat: np.ndarray, at: np.ndarray, inside: bool) -> bool:
    """Whether quotes enclose whole fields: one that opens stands at a field's start, one that closes at its end, or both
    beside another quote."""
    quotes = np.flatnonzero(flat == QUOTE)
    if not len(quotes):
        return True
    opens = (np.arange(len(quotes)) + inside) % 2 == 0
    starts, ends = np.zeros(len(flat) + 1, bool), np.zeros(len(flat) + 1, bool)
    starts[at[:-1]], ends[at[1:]] = True, True
    before, after = flat[np.maximum(quotes - 1, 0)], flat[np.minimum(quotes + 1, len(flat) - 1)]
    good = np.where(opens, starts[quotes] | (before == COMMA) | (before == QUOTE),
                    ends[quotes + 1] | (after == COMMA) | (after == QUOTE))
    return bool(good.all())


def _records(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """(file, start, part, first, record): whole records (part 0) or, with ``edges``, what a range has of a record that
    came in from the range before (1) or goes on in the next one (2). ``first`` marks the record at a file's start, its
    header."""
    at, inside, first, began_here, held = None, False, False, True, b""

    def out(part: int, records: pa.Array, first: bool = False) -> pa.RecordBatch:
        n = len(records)
        return pa.record_batch([pa.repeat(pa.scalar(at[0]), n), pa.repeat(pa.scalar(at[1], pa.int64()), n), pa.repeat(pa.scalar(part, pa.int32()), n),
                                pa.repeat(first, n), records], ["file", "start", "part", "first", "record"])

    def one(part: int, record: bytes) -> pa.RecordBatch:
        return out(part, pa.array([record], pa.binary()).cast(pa.string()), first)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(0), batch.column(1).to_numpy()
        same = np.zeros(batch.num_rows, bool)
        same[1:] = (starts[1:] == starts[:-1]) & pc.equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(~same).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (files[a].as_py(), int(starts[a]))
            if key != at:
                if held and edges:
                    yield one(2 if began_here else 1, held)
                at, inside, first, held = key, batch.column(3)[a].as_py(), key[1] == 0, b""
                began_here = not inside
            lines = batch.column(2).slice(a, b - a)
            if batch.column(4)[a].as_py():
                lines = pc.replace_substring_regex(lines, r"\r\z", "")
            if not edges and not _well_formed(*_bytes(lines), inside):
                raise ValueError(f"{at[0]}: {ODD_QUOTES}")
            odd = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + inside) % 2 == 1
            inside = bool(odd[-1])
            ends = np.flatnonzero(~odd)
            if edges and len(ends):
                if not began_here:
                    begun = pc.binary_join_element_wise(lines[:ends[0] + 1], pc.if_else(pa.array(odd[:ends[0] + 1]), "\n", ""), "")
                    yield one(1, held + _bytes(begun)[0].tobytes())
                lines, odd, first = lines[ends[-1] + 1:], odd[ends[-1] + 1:], False
                began_here, held, ends = True, b"", ends[:0]
            # the line breaks inside quotes are put back; what stands between two ends is a record
            flat, offsets = _bytes(pc.binary_join_element_wise(lines, pc.if_else(pa.array(odd), "\n", ""), ""))
            bounds = offsets[[0, *(ends + 1)]]
            if len(bounds) > 1:
                begun = held + flat[:bounds[1]].tobytes()
                if begun and began_here:
                    yield one(0, begun)
                    first = False
                began_here, held = True, b""
                whole = pa.LargeStringArray.from_buffers(len(bounds) - 2, pa.py_buffer(bounds[1:].tobytes()), pa.py_buffer(flat.tobytes()))
                whole = whole.filter(pc.greater(pc.binary_length(whole), 0)).cast(pa.string())
                if len(whole) and first:
                    yield out(0, whole[:1], True)
                    first, whole = False, whole[1:]
                if len(whole):
                    yield out(0, whole)
            held += flat[bounds[-1]:].tobytes()
    if held and edges:
        yield one(2 if began_here else 1, held)


def records(spark: SparkSession, path) -> DataFrame:
    """(file, record): every record of the files but their first, the header. Empty lines are no records.

    Ranges are the text source's splits. Should they change between the two scans (the number of cores is part of what
    sizes them), the job fails rather than read wrongly.
    """
    lines = _lines(spark, path)
    # a row per range, that is per spark.sql.files.maxPartitionBytes of input
    state = F.broadcast(_states(lines))
    known = lines.join(state, ["file", "start"], "left").select(
        "file", "start", "line", F.coalesce("inside", F.raise_error(F.lit("file ranges changed while they were read")).cast("boolean"))
        .alias("inside"), "returns")
    found = [known.mapInArrow(partial(_records, edges=e), "file string, start long, part int, first boolean, record string")
             for e in (False, True)]
    whole, pieces = found[0].where(~F.col("first")).select("file", "record"), found[1]
    # a record begins with a part 2 and goes on with parts 1 of the ranges after it
    chain = F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "part"))
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("p"), F.bool_or("first").alias("first"))
    crossing = joined.where("not first").select("file", F.array_join("p.record", "").alias("record"))
    even = _quotes("record") % 2 == 0
    checked = F.when(even, F.col("record")).otherwise(F.raise_error(F.lit(ODD_QUOTES)))
    return whole.unionByName(crossing.select("file", checked.alias("record")))


def read_csv(spark: SparkSession, path, options: dict[str, str]) -> DataFrame:
    """The rows of a CSV file or folder with headers, every column as text, as Spark's own reader gives them with
    ``multiLine``, but read in ranges. Line breaks are those of a file's first line, \\n or \\r\\n, the latter read as \\n
    inside quotes too. A file whose quotes are not well formed is an error.
    """
    names = spark.read.options(**options).csv(path).columns   # reads the first record alone
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    per_row = {k: v for k, v in options.items() if k not in ("header", "encoding")}
    row = F.from_csv("record", schema, per_row).alias("row")
    return records(spark, path).select(row).select("row.*").toDF(*names)
