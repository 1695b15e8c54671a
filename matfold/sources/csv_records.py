"""CSV records of files of any size, with quoted line breaks, many tasks per file.

A quoted field may hold line breaks, so where a record begins depends on all
quotes before it, and Spark's ``multiLine`` mode gives a whole file to one task.
Here the file's blocks are read as physical lines by the splittable text source:

1. Every block reports, for both cases of its start (outside or inside a quoted
   field), in which state it ends, and whether all its bytes are UTF-8.
2. Those reports, one small row per block, are chained per file: each block then
   knows its start state and the file's encoding.
3. Blocks are cut into records.  What is left of a record at the two ends of a
   block is put together by (file, number of the record that is open).

The states follow the quoting rules of the CSV reader: a quote opens a field only
at its start, a doubled quote inside is a quote, text behind a closing quote runs
to the next separator.  Lines end with LF or CRLF.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matfold.session import ensure_checkpoint_dir, ship_package

#: Rows of the block table (one per block of a file) up to which it is broadcast to the cutting tasks.
BROADCAST_BLOCKS = 500_000
BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open behind ``line``, given whether one is before it."""
    i, n = 0, len(line)
    while True:
        if inside:
            i = line.find(b'"', i)
            if i < 0:
                return True
            if line[i + 1:i + 2] == b'"':
                i += 2
                continue
            inside = False
        elif line[i:i + 1] == b'"':
            inside = True
            i += 1
            continue
        i = line.find(sep, i)
        if i < 0 or i == n:
            return False
        i += len(sep)


def _lines(spark: SparkSession, path: str | Sequence[str], glob: str | None) -> DataFrame:
    r = spark.read.option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # names come with escapes
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"), name.alias("name"), F.col("_metadata.file_block_start").alias("block"))


def _block_reports(lines: DataFrame, sep: str) -> DataFrame:
    """(file, name, block, out, in, utf8, crlf): the state behind each block when it starts outside or inside a quoted field,
    whether its bytes are UTF-8 and its first line ends with CRLF."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []
        for b in batches:
            quoted = pc.greater(pc.count_substring(b.column("line"), '"'), 0).to_pylist()
            ends = b.column("file").to_pylist(), b.column("block").to_pylist()
            ok, name, line = b.column("ok").to_pylist(), b.column("name"), b.column("line")
            for r, (file, block) in enumerate(zip(*ends, strict=True)):
                if now is None or now[0] != file or now[2] != block:
                    if now is not None:
                        done.append(now)
                    now = [file, name[r].as_py(), block, False, True, True, line[r].as_py()[-1:] == b"\r"]
                now[5] = now[5] and ok[r]
                if quoted[r]:
                    raw = line[r].as_py()
                    same = now[3] == now[4]
                    now[3] = ends_inside(raw, now[3], mark)
                    now[4] = now[3] if same else ends_inside(raw, now[4], mark)
        if now is not None:
            done.append(now)
        if done:
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.bool_()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)],
                                             ["file", "name", "block", "out", "in", "utf8", "crlf"])

    src = lines.select("file", "name", "block", F.col("value").cast("binary").alias("line"), F.expr("is_valid_utf8(value)").alias("ok"))
    return src.mapInArrow(run, "file string, name string, block long, `out` boolean, `in` boolean, utf8 boolean, crlf boolean")


def _chained(reports: DataFrame) -> DataFrame:
    """(file, name, block, inside, utf8, crlf): each block's start state, whether its whole file is UTF-8 and its first line ends with CRLF."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        state, starts = False, []
        for out, into in zip(t["out"].to_pylist(), t["in"].to_pylist(), strict=True):
            starts.append(state)
            state = into if state else out
        utf8 = pc.all(t["utf8"]).as_py()
        return pa.table({"file": t["file"], "name": t["name"], "block": t["block"], "inside": pa.array(starts, pa.bool_()),
                         "utf8": pa.array([utf8] * t.num_rows, pa.bool_()), "crlf": pa.array([t["crlf"][0].as_py()] * t.num_rows, pa.bool_())})

    return reports.groupBy("file").applyInArrow(run, "file string, name string, block long, inside boolean, utf8 boolean, crlf boolean")


#: Kinds of cut pieces: a whole record, what is left of one that began in an earlier block, a record that goes on in the next.
WHOLE, REST, OPEN = 0, 1, 2


def _cut(lines: DataFrame, sep: str, encoding: str | None) -> DataFrame:
    """(file, name, block, kind, first, text) of every piece; ``first`` marks the piece that begins the file's first record.

    In files whose lines end with CRLF, breaks inside quotes become LF, as in Spark's reader.
    """
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = block = name = inside = None
        codec, kind, first, crlf = "", WHOLE, False, False
        held: list[bytes] = []
        out: list[tuple] = []

        def add(how: int) -> None:
            nonlocal first
            raw = b"\n".join(x.removesuffix(b"\r") for x in held) if crlf else b"\n".join(held)
            held.clear()
            if how == WHOLE and not raw:  # blank lines are no records
                return
            out.append((file, name, block, how, first, raw.decode(codec, "replace")))
            first = False

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int8(), pa.bool_(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "name", "block", "kind", "first", "text"])
            out.clear()
            return b

        for b in batches:
            quoted = pc.greater(pc.count_substring(b.column("line"), '"'), 0).to_pylist()
            columns = (b.column(c).to_pylist() for c in ("file", "name", "block", "inside", "utf8", "crlf", "line"))
            for has_quote, (f, n, k, starts_inside, utf8, ends_crlf, line) in zip(quoted, zip(*columns, strict=True), strict=True):
                if f != file or k != block:
                    if held:
                        add(REST if kind == REST else OPEN)
                    if starts_inside is None:
                        raise RuntimeError(f"blocks of {f} changed between the two passes over it")
                    file, name, block, inside, crlf = f, n, k, starts_inside, ends_crlf
                    kind, first = REST if inside else WHOLE, k == 0
                    codec = encoding or ("utf-8" if utf8 else "iso-8859-1")
                    if k == 0 and line.startswith(BOM) and codec.lower().replace("-", "") == "utf8":
                        line = line[len(BOM):]
                held.append(line)
                if has_quote:
                    inside = ends_inside(line, inside, mark)
                if not inside:
                    add(kind)
                    kind = WHOLE
            if out:
                yield batch()
        if held:
            add(REST if kind == REST else OPEN)
        yield batch()

    return lines.mapInArrow(run, "file string, name string, block long, kind byte, first boolean, text string")


def csv_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str | None = None,
                glob: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(file, name, first, text): every record of the files at ``path``; ``first`` marks a file's first one (its header).

    ``encoding`` None: UTF-8 for a file whose bytes are all valid, ISO-8859-1 for
    any other, file by file.  Blank lines are no records.  A file whose last
    quoted field is never closed ends with that record.  Names in ``exclude``
    are left out whatever their case.
    """
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    lines = _lines(spark, path, glob)
    if exclude:
        lines = lines.where(~F.lower("name").isin([e.lower() for e in exclude]))
    starts = _chained(_block_reports(lines, sep)).checkpoint()
    side = F.broadcast(starts) if starts.count() <= BROADCAST_BLOCKS else starts
    placed = (lines.select("file", "block", F.col("value").cast("binary").alias("line"), F.monotonically_increasing_id().alias("pos"))
              .join(side, ["file", "block"], "left"))
    if side is starts:  # joined by a shuffle: blocks whole and in order again
        placed = placed.repartition("file", "block").sortWithinPartitions("file", "block", "pos")
    pieces = _cut(placed.select("file", "name", "block", "inside", "utf8", "crlf", "line"), sep, encoding)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "name", "first", "text")
    order = Window.partitionBy("file").orderBy("block", "kind")
    broken = (pieces.where(F.col("kind") != WHOLE)
              .withColumn("open", F.count(F.when(F.col("kind") == OPEN, 1)).over(order))
              .groupBy("file", "open").agg(F.max("name").alias("name"), F.max("first").alias("first"),
                                           F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p"))
              .select("file", "name", "first", F.array_join(F.col("p.text"), "\n").alias("text")))
    return whole.unionByName(broken)


def cells(text: str, n: int, sep: str = ","):
    """The record as an array of ``n`` cells (null: empty or missing)."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    parsed = F.from_csv(F.col(text), schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxColumns": str(max(n + 1, 20480)), "maxCharsPerColumn": "-1"})
    return F.array(*[parsed[f"c{i}"] for i in range(n)])
