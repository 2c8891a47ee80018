"""CSV files in mixed encodings, and text sinks.

A file is read in ranges of bytes, each by the task it is dealt to, which opens
the file where it lies.  A range begins after the first line break in it and
ends with the first one after it, so that it holds whole characters in every
encoding.  The first pass tries the encodings on each range and counts quotes;
what a file's ranges found is put together in a DataFrame: its encoding, and
whether a range begins inside a quoted field.  The second pass parses the
records that begin in a range.  No file is held whole, and none is listed on
the driver.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablerecon.functions.names import col
from tablerecon.sources.files import listed, opened

# The order in which encodings are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16")

#: Bytes of a range, of what is read at once, and of a header at most.
RANGE_BYTES, _CHUNK, _HEAD = 64 << 20, 1 << 20, 1 << 20
_BATCH_ROWS = 5_000

BOM = "\ufeff"
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


class EncodingError(ValueError):
    """Files none of the encodings can read."""


def _mark(f) -> tuple[int, str | None]:
    """Length of the byte order mark and the encoding it stands for."""
    f.seek(0)
    start = f.read(3)
    return next(((len(m), e) for m, e in _MARKS if start.startswith(m)), (0, None))


def _units(chunk: bytes, mark: str | None) -> np.ndarray:
    """Bytes, or the two-byte units of UTF-16."""
    kind = {"utf-16-le": "<u2", "utf-16-be": ">u2"}.get(mark, "u1")
    return np.frombuffer(chunk, kind, len(chunk) // np.dtype(kind).itemsize)


def _after_break(f, at: int, length: int, mark: str | None) -> int:
    """The place after the first line break at or behind ``at``."""
    f.seek(at)
    while at < length and (chunk := f.read(_CHUNK)):
        units = _units(chunk, mark)
        found = np.flatnonzero(units == 10)
        if len(found):
            return at + (int(found[0]) + 1) * units.itemsize
        at += len(chunk)
    return length


def _bounds(f, part: int, length: int, range_bytes: int) -> tuple[int, int, str | None]:
    """Begin and end of a range, and the encoding a mark gives."""
    skip, mark = _mark(f)
    begin = _after_break(f, part * range_bytes, length, mark) if part else skip
    last = (part + 1) * range_bytes >= length
    return begin, max(begin, length if last else _after_break(f, (part + 1) * range_bytes, length, mark)), mark


def _decoder(encoding: str, mark: str | None):
    if encoding == "utf-16":
        return codecs.getincrementaldecoder(mark)() if mark and mark != "utf-8" else None
    return None if mark and mark != "utf-8" else codecs.getincrementaldecoder(encoding)()


def _scan(f, part: int, length: int, range_bytes: int, encodings: Sequence[str]) -> dict:
    """What one range says: which encodings read it, its quotes, and line breaks after an even and an odd number of them."""
    begin, end, mark = _bounds(f, part, length, range_bytes)
    tried = {e: _decoder(e, mark) for e in encodings}
    fits = {e: d is not None for e, d in tried.items()}
    quotes, breaks, at = 0, [0, 0], begin
    head = b""
    f.seek(begin)
    while at < end and (chunk := f.read(min(_CHUNK, end - at))):
        at += len(chunk)
        head += chunk[: _HEAD - len(head)] if part == 0 else b""
        for e in encodings:
            try:
                if fits[e]:
                    tried[e].decode(chunk, at >= end)
            except UnicodeDecodeError:
                fits[e] = False
        units = _units(chunk, mark)
        seen = quotes + np.cumsum(units == 34)
        odd = int((seen[units == 10] & 1).sum())
        breaks[1] += odd
        breaks[0] += int((units == 10).sum()) - odd
        quotes = int(seen[-1]) if len(seen) else quotes
    return {"begin": begin, "end": end, "quotes": quotes, "breaks": breaks, "fits": [fits[e] for e in encodings], "head": head, "mark": mark}


def _ranges(spark: SparkSession, paths: Sequence[str], encodings: Sequence[str], range_bytes: int, through_spark: bool | None) -> DataFrame:
    """One row per range: file, part, length, begin, end, head, mark, ``inside`` (a quoted field), ``encoding`` and ``multiline``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length, part, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "part", "content"))):
                with opened(path, content) as f:
                    rows.append({"file": path, "length": length, "part": part, "content": content} | _scan(f, part, length, range_bytes, encodings))
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = listed(spark, paths, through_spark)
    # A file that came along as a cell is one range, as it is held whole already.
    last = F.when(F.col("content").isNull(), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / range_bytes)).otherwise(F.lit(0))
    parts = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part"))
    types = {"file": pa.string(), "length": pa.int64(), "part": pa.int64(), "content": pa.binary(), "begin": pa.int64(), "end": pa.int64(), "quotes": pa.int64()}
    types |= {"breaks": pa.list_(pa.int64()), "fits": pa.list_(pa.bool_()), "head": pa.binary(), "mark": pa.string()}
    schema = pa.schema(list(types.items()))
    ddl = (
        "file string, length long, part long, content binary, begin long, end long, quotes long, breaks array<long>, fits array<boolean>, head binary, mark string"
    )
    scanned = parts.repartition(_tasks(spark), "path", "part").mapInArrow(run, ddl)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    chosen = F.lit(None).cast("string")
    for i, e in reversed(list(enumerate(encodings))):
        chosen = F.when(F.bool_and(F.get("fits", F.lit(i))).over(whole), F.lit(e)).otherwise(chosen)
    placed = scanned.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).withColumn("encoding", chosen)
    quoted = F.get("breaks", F.when(F.col("inside"), 0).otherwise(1))
    return placed.withColumn("multiline", F.sum(quoted).over(whole) > 0).drop("fits", "breaks", "quotes")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def probe_encodings(
    spark: SparkSession, paths: Sequence[str], encodings: Sequence[str] = ENCODINGS, range_bytes: int = RANGE_BYTES, through_spark: bool | None = None
) -> DataFrame:
    """The first encoding that reads the whole of each file.

    Gives ``file``, ``encoding`` (null if none fits) and ``multiline``: does a
    quoted field hold a line break?  A UTF-16 file starts with a byte order
    mark, and no other encoding reads such a file.
    """
    return _ranges(spark, paths, encodings, range_bytes, through_spark).where("part = 0").select("file", "encoding", "multiline")


def _lines(f, begin: int, encoding: str, mark: str | None) -> Iterator[tuple[str, int]]:
    """Lines with their line breaks, and their lengths in bytes."""
    f.seek(begin)
    if encoding != "utf-16":
        for raw in f:
            yield raw.decode(encoding), len(raw)
        return
    decoder, rest = codecs.getincrementaldecoder(mark)(), ""
    while chunk := f.read(_CHUNK):
        *whole, rest = (rest + decoder.decode(chunk)).split("\n")
        yield from ((line + "\n", len((line + "\n").encode(mark))) for line in whole)
    if rest:
        yield rest, len(rest.encode(mark))


def _records(f, begin: int, end: int, inside: bool, encoding: str, mark: str | None) -> Iterator[str]:
    """The records that begin in a range; the last one may reach beyond it."""
    at, open_quote, held = begin, inside, []
    skipping = inside
    for line, size in _lines(f, begin, encoding, mark):
        if at >= end and not held and not skipping:
            return
        at += size
        open_quote ^= line.count('"') % 2 == 1
        if skipping:
            skipping = open_quote
            if not skipping and at >= end:
                return
            continue
        held.append(line)
        if not open_quote:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def _fields(records: Iterator[str]) -> Iterator[list[str]]:
    return csv.reader(line for record in records for line in io.StringIO(record, newline=""))


def read_csv_text(
    spark: SparkSession,
    paths: Sequence[str],
    encodings: Sequence[str] = ENCODINGS,
    header_from: str | None = None,
    range_bytes: int = RANGE_BYTES,
    through_spark: bool | None = None,
) -> DataFrame:
    """CSV files as text columns, whatever their encodings.

    The header of the first file given (or of ``header_from``) names the
    columns of all files by position, nothing is taken for null, and ``_file`` says
    where a row comes from.  ``through_spark`` has the files read by Spark
    instead of Python (by default where Python has no access to the store).
    """
    ranges = _ranges(spark, paths, encodings, range_bytes, through_spark)
    first = ranges.where("part = 0")
    unread = [r["file"] for r in first.where("encoding IS NULL").select("file").limit(20).collect()]
    if unread:
        raise EncodingError(f"no encoding of {', '.join(encodings)} reads {', '.join(unread)}")
    last_part = (header_from or paths[0]).rstrip("/").rsplit("/", 1)[-1]
    wanted = F.element_at(F.split("file", "/"), -1) != last_part
    top = first.orderBy(wanted, "file").select("head", "encoding", "mark").first()
    names = _header(bytes(top["head"]), top["encoding"], top["mark"], blank=True) if top else []
    schema = pa.schema([(f"c{i}", pa.string()) for i in range(len(names) + 1)])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = ("file", "part", "begin", "end", "inside", "encoding", "mark", "content")
        for batch in batches:
            for path, part, begin, end, inside, encoding, mark, content in zip(*(batch.column(c).to_pylist() for c in needed)):
                with opened(path, content) as f:
                    rows: list[list[str]] = []
                    for i, fields in enumerate(r for r in _fields(_records(f, begin, end, inside, encoding, mark)) if r):
                        if i or part:
                            rows.append([*fields[: len(names)], *[""] * (len(names) - len(fields)), path])
                        if len(rows) == _BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    dealt = ranges.drop("head").repartition(_tasks(spark), "file", "part")
    loaded = dealt.mapInArrow(load, ", ".join(f"c{i} string" for i in range(len(names) + 1)))
    return loaded.toDF(*names, "_file")


def _header(head: bytes, encoding: str, mark: str | None, blank: bool = False) -> list[str]:
    """Column names from the beginning of a file; blank ones only if asked for."""
    text = head.decode(mark if encoding == "utf-16" else encoding, "ignore")
    names = next(csv.reader(io.StringIO(text, newline="")), [])
    return [n for n in names if blank or n.strip()]


def csv_catalog(
    spark: SparkSession, paths: Sequence[str], encodings: Sequence[str] = ENCODINGS, through_spark: bool | None = None
) -> DataFrame:
    """Every CSV file with its encoding and its non-blank header columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("head", "encoding", "mark")))
            names = pa.array([_header(h, e, m) for h, e, m in heads], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("encoding"), names], names=["file", "encoding", "columns"])

    first = _ranges(spark, paths, encodings, RANGE_BYTES, through_spark).where("part = 0 AND encoding IS NOT NULL")
    return first.select("file", "encoding", "mark", "head").mapInArrow(run, "file string, encoding string, columns array<string>")


# How rows become lines.
_LINE_OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def _csv_line(values: Sequence[Column]) -> Column:
    texts = F.struct(*[v.cast("string").alias(f"c{i}") for i, v in enumerate(values)])
    return F.to_csv(texts, _LINE_OPTIONS)


def write_csv_bom(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One CSV with a byte order mark and one header, as part files in order.

    The first part holds the mark and the header and no other has either, so
    the parts, one after the other, are the file; nothing is gathered for it.
    ``single_file`` writes it with one task.  Read it with ``read_csv_parts``.
    """
    header = df.sparkSession.range(1, numPartitions=1).select(F.concat(F.lit(BOM), _csv_line([F.lit(c) for c in df.columns])).alias("value"))
    lines = header.unionAll(df.select(_csv_line([col(c) for c in df.columns]).alias("value")))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def read_csv_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv_bom`` wrote, as text columns: the header stands in the first part only."""
    rows = spark.read.option("escape", '"').option("multiLine", True).option("nullValue", "\0")
    rows = rows.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    name, file = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    first = spark.read.text(path).agg(F.min_by(file, name)).first()[0]
    names = [n.removeprefix(BOM) for n in rows.option("header", True).csv(first).columns]
    rows = rows.schema(", ".join(f"`c{i}` string" for i in range(len(names)))).option("enforceSchema", True)
    rest = rows.option("header", False).csv(path).where(file != first)
    return rows.option("header", True).csv(first).unionAll(rest).na.fill("").toDF(*names)


def write_statements(df: DataFrame, path: str, name: str = "statement") -> None:
    """Text files with one statement per row, replacing earlier ones."""
    df.select(F.col(name).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_parts(
    df: DataFrame, path: str, part: str = "part", fmt: str = "parquet", rows_per_file: int = 0, rebalance: bool = True
) -> None:
    """One folder per part; ``rows_per_file`` limits the size of single files.

    Rebalancing brings the rows of a part together, so that thousands of
    tasks do not each leave a small file in every folder; adaptive execution
    cuts a part that holds too many rows into several tasks again.  Switch it
    off to write without a shuffle when there are few parts.
    """
    writer = (df.hint("rebalance", part) if rebalance else df).write.mode("overwrite").partitionBy(part)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.format(fmt).save(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement text, one line per row, in the column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")
