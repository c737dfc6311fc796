"""Delimited text files: separator, encoding and quoting per file, tolerant reading."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulight.functions.columns import col
from tabulight.sources.cleaning import null_sentinels

SEPARATORS = ["\t", ",", ";", "|"]   # order decides ties
SNIFF_LINES, SNIFF_BYTES = 15, 4096
_BROKEN, _PATH = "_broken_line", "_file_path"


def best_separator(head: str) -> str:
    """The separator that the text has most of, tab when it has none."""
    counts = {s: head.count(s) for s in SEPARATORS}
    return max(SEPARATORS, key=lambda s: counts[s])


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Most frequent separator in the first 15 lines and 4 KB of one file: the prefix is the rule, not a shortcut."""
    lines = [r[0] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    return best_separator("\n".join(lines)[:SNIFF_BYTES])


def _encoding() -> Column:
    return F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1").alias("encoding")


def detect_encoding(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, encoding): UTF-8 when every line of the file is valid UTF-8, else ISO-8859-1.

    Files are read line by line as bytes, so a large file is split like any text source and
    never held as one value.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value"))
    return lines.groupBy("path").agg(_encoding())


@dataclass(frozen=True)
class Layout:
    """What files must share to be read together."""

    encoding: str
    header: bytes
    separator: str
    multi_line: bool


def header_separator(header: bytes, encoding: str, ext: str) -> str:
    outside = "".join(header.decode(encoding, "replace").split('"')[::2])            # separators inside quotes do not count
    return "\t" if ext.lower() == "tsv" else best_separator(outside) if any(s in outside for s in SEPARATORS) else ","


def _cell_signs(separator: str) -> tuple[str, str]:
    """Patterns of a cell's edge, and of what follows the opening quote of a cell up to that edge.

    A quote opens a cell only at its start: that in ``5" pipe`` is a plain sign. Doubled quotes belong to the cell; what stands between
    the closing quote and the next separator does too.
    """
    edge = {"\t": "\\t", "|": "\\|"}.get(separator, separator)
    return rf"(^|{edge})", rf'[^"]*+(?:""[^"]*+)*+"[^{edge}]*+'


def _leaves_open(separator: str, line: str | Column = "value") -> Column:
    """Whether a line that starts outside quotes has a quoted cell that does not end in it."""
    edge, rest = _cell_signs(separator)
    return F.regexp_replace(line, f'{edge}"{rest}', "$1").rlike(f'{edge}"')


def _stays_open(separator: str, line: str | Column = "value") -> Column:
    """Whether a line that starts within a quoted cell ends within one."""
    _, rest = _cell_signs(separator)
    return ~F.rlike(line, F.lit(f"^{rest}")) | _leaves_open(separator, F.regexp_replace(line, f"^{rest}", ""))


def layouts(spark: SparkSession, path: str, ext: str = "csv") -> dict[Layout, list[str]]:
    """The files by layout, in the order of their names (the driver gets one row per file).

    A file has several lines in a cell if one of its lines leaves a quoted cell open, with the separator of its header.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value", F.struct(
        F.input_file_block_start(), F.monotonically_increasing_id()).alias("place"))
    quoted = F.contains("value", F.lit('"'))
    files = lines.groupBy("path").agg(
        _encoding(), F.min_by(F.col("value").cast("binary"), "place").alias("header"),
        *[F.bool_or(F.when(quoted, _leaves_open(s)).otherwise(False)).alias(f"open_{i}") for i, s in enumerate(SEPARATORS)])
    found: dict[Layout, list[str]] = {}
    for r in sorted(files.collect(), key=lambda r: r["path"]):
        header = bytes(r["header"]).removeprefix(b"\xef\xbb\xbf").rstrip(b"\r")
        separator = header_separator(header, r["encoding"], ext)
        found.setdefault(Layout(r["encoding"], header, separator, r[f"open_{SEPARATORS.index(separator)}"]), []).append(unquote(r["path"]))
    return found


def read_delimited(
    spark: SparkSession, path: str, ext: str = "csv", sentinels: bool = True
) -> DataFrame:
    """CSV, TSV or TXT with a header row, every column as text.

    Quoted cells may hold separators, doubled quotes and line breaks. Files of a folder may differ in encoding,
    separator and columns: they are united by column name. Lines with too many fields are dropped
    (``rejected_lines`` returns them), lines with too few are padded with NULL, and missing-value tokens
    become NULL. Files with line breaks in cells are read split by split as well (``records``).
    """
    parts = []
    for layout, paths in layouts(spark, path, ext).items():
        raw, names, broken = _raw(spark, paths, layout)
        parts.append(raw.where(~broken).select(*[col(n) for n in names]))
    if not parts:
        return spark.read.option("header", True).csv(path)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return null_sentinels(df) if sentinels else df


def rejected_lines(spark: SparkSession, path: str, ext: str = "csv") -> DataFrame:
    """(path, line): the lines that ``read_delimited`` drops since they have too many fields."""
    parts = []
    for layout, paths in layouts(spark, path, ext).items():
        raw, _, broken = _raw(spark, paths, layout)
        parts.append(raw.where(broken).select(F.col(_PATH).alias("path"), F.col(_BROKEN).alias("line")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, line string")


def _raw(spark: SparkSession, paths: list[str], layout: Layout) -> tuple[DataFrame, list[str], Column]:
    """All records of the files, their column names, and the test for a record with too many fields."""
    sep = layout.separator
    reader = spark.read.options(sep=sep, encoding=layout.encoding, header=True, escape='"', multiLine=layout.multi_line)
    names = reader.csv(paths).columns
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    schema = f"{fields}, `{_BROKEN}` string"
    if layout.multi_line:
        cells = F.from_csv("record", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
        raw = records(spark, paths, layout).select(F.col("path").alias(_PATH), cells.alias("cells")).select(_PATH, "cells.*")
    else:
        raw = (
            reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
            .option("enforceSchema", True).option("columnPruning", False)      # else unread cells are not counted
            .schema(schema).csv(paths).withColumn(_PATH, F.input_file_name())
        )
    # a broken line is short or long; separators inside quotes do not count
    outside_quotes = F.regexp_replace(F.col(_BROKEN), r'"[^"]*"', "")
    separators = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(sep), F.lit("")))
    # Spark refuses to read broken lines alone, so the test reads a cell too
    cell = F.coalesce(F.length(col(names[0])), F.lit(0)) >= 0
    return raw, names, F.coalesce(separators >= len(names), F.lit(False)) & cell


def _split_runs(path: pa.Array, block: pa.Array) -> list[tuple[int, int]]:
    """The rows of each file split in a batch, as (first, end)."""
    if len(path) == 0:
        return []
    path, block = path.dictionary_encode().indices.to_numpy(), block.to_numpy()
    edges = (np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
    return list(zip([0, *edges], [*edges, len(path)], strict=True))


def _states(outside: np.ndarray, inside: np.ndarray, start: int) -> np.ndarray:
    """Whether each line starts within a cell (one more for the end), given where a line leads from outside and from inside.

    A line leads to one state whatever was before, or keeps it, or turns it: the last line of the first kind and the number of
    turns since then decide.
    """
    fixed, turns = outside == inside, np.concatenate([[0], np.cumsum(outside & ~inside)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, len(fixed) + 1), 0)]))
    base = np.where(last > 0, np.append(bool(start), outside)[last], bool(start))
    return base ^ ((turns - turns[last]) % 2 == 1)


def records(spark: SparkSession, paths: list[str], layout: Layout) -> DataFrame:
    """(path, record): the records of files with line breaks in cells, read split by split.

    Each line leads from outside quotes, and from inside, to a state. The first pass joins these for every split, and the driver, which
    gets two bits a split, follows them through each file. So the second pass knows how its splits begin; lines of one record
    are joined where they lie. Only pieces of records cut by a split's end are shuffled, by the split where the record begins.
    The first record of a file is its header, and empty lines are no records.
    """
    sep = layout.separator
    lines = spark.read.options(encoding=layout.encoding, lineSep="\n").text(paths).select(
        F.input_file_name().alias("path"), F.input_file_block_start().alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))
    quoted = F.contains("value", F.lit('"'))
    states = [F.when(quoted, _leaves_open(sep)).otherwise(False).alias("outside"), F.when(quoted, _stays_open(sep)).otherwise(True).alias("inside")]

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool, bool]] = {}           # a few splits a task
        for batch in batches:
            path, block, *ways = batch.columns
            outside, inside = (w.to_numpy(zero_copy_only=False) for w in ways)
            for first, end in _split_runs(path, block):
                name = path[first].as_py(), block[first].as_py()
                a, b, ended = ends.get(name, (False, True, False))
                a, b = (_states(outside[first:end], inside[first:end], s)[1:] for s in (a, b))
                ends[name] = bool(a[-1]), bool(b[-1]), ended or not b.all()
        yield pa.RecordBatch.from_pylist([dict(zip(split.names, [*name, *way], strict=True)) for name, way in ends.items()], split)

    split = pa.schema([("path", pa.string()), ("block", pa.int64()), *((n, pa.bool_()) for n in ("outside", "inside", "ended"))])
    splits = lines.select("path", "block", *states).mapInArrow(followed, "path string, block long, outside boolean, inside boolean, ended boolean")
    begun: dict[tuple[str, int], int] = {}                                  # where the record began that is open when a split starts
    here, state, origin = None, False, 0
    for path, block, outside, inside, ended in sorted(map(tuple, splits.collect())):
        if path != here:
            here, state = path, False
        begun[path, block] = origin if state else -1
        if not state or ended:
            origin = block
        state = inside if state else outside

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, open_now, origin, header = None, [], False, -1, False   # ``held``: lines of a record that has not ended, begun in ``origin``
        for batch in batches:
            out = []

            def give(ended: bool) -> None:
                nonlocal held, header, origin
                text = "\n".join(held)
                out.append((name[0], text, ended and origin == name[1], origin, name[1], header and text != ""))  # noqa: B023
                held, header, origin = [], header and text == "", name[1]

            path, block, value, *ways = batch.columns
            outside, inside = (w.to_numpy(zero_copy_only=False) for w in ways)
            for first, end in _split_runs(path, block):
                if (path[first].as_py(), block[first].as_py()) != name:
                    if held:
                        give(False)
                    name = path[first].as_py(), block[first].as_py()
                    open_now, header = begun[name] >= 0, name[1] == 0
                    origin = begun[name] if open_now else name[1]
                at = _states(outside[first:end], inside[first:end], open_now)
                open_now = bool(at[-1])
                for line, goes_on in zip(value.slice(first, end - first).to_pylist(), at[1:].tolist(), strict=True):
                    held.append(line)
                    if not goes_on:
                        give(True)
            yield pa.RecordBatch.from_pylist([dict(zip(piece.names, row, strict=True)) for row in out], piece)
        if held:
            last = (name[0], "\n".join(held), False, origin, name[1], header)
            yield pa.RecordBatch.from_pylist([dict(zip(piece.names, last, strict=True))], piece)

    piece = pa.schema([("path", pa.string()), ("record", pa.string()), ("whole", pa.bool_()), ("origin", pa.int64()), ("block", pa.int64()), ("header", pa.bool_())])
    found = lines.select("path", "block", "value", *states).mapInArrow(
        joined, "path string, record string, whole boolean, origin long, block long, header boolean")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda part: part["record"])
    cut = found.where("not whole").groupBy("path", "origin").agg(F.array_join(in_order, "\n").alias("record"), F.bool_or("header").alias("header"))
    return found.where("whole").select("path", "record", "header").unionByName(cut.select("path", "record", "header")).where(
        "not header and record <> ''").select("path", "record")
