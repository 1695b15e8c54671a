"""Readers (S1-S5, S10, S11).

Raw files are read as strings (no schema inference pass) and repaired by the
schema operators.  CSV files are cut into records by ``csv_records``, so a file
is read by as many tasks as it has blocks, each file in its own encoding.  A
folder of files with different headers is one read: headers become a table of
(file, position, name) that is resolved to one list of positions per file and
joined to the records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matfold.functions.text import py_strip
from matfold.sources.csv_records import cells, csv_records


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str | None = "UTF-8",
             schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV as all-string columns (or an explicit schema); quoted fields may
    span lines and files are split.  ``encoding`` None: found per file.

    Columns are those of the schema, else of the first file's header; records
    that are shorter get nulls, cells beyond the last column are dropped.
    """
    records = csv_records(spark, path, sep, encoding)
    if schema is None:
        plain = spark.read.option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"')
        schema = plain.option("encoding", encoding or "UTF-8").csv(path).schema
    if header:
        records = records.where(~F.col("first"))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    return records.select(F.from_csv("text", _ddl(schema), options).alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv_if_exists(spark: SparkSession, path: str, schema: T.StructType | None = None,
                       **kw) -> DataFrame | None:
    """The table, or ``None`` (or an empty typed table when a schema is given)
    when nothing exists at ``path``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema) if schema is not None else None
    return read_csv(spark, path, schema=schema, **kw)


def needs_latin1(spark: SparkSession, path: str) -> bool:
    """True when some line of the file is not valid UTF-8 (stops at the first)."""
    txt = spark.read.text(path)
    return txt.where(~F.expr("is_valid_utf8(value)")).limit(1).count() > 0


def read_csv_any_encoding(spark: SparkSession, path: str, **kw) -> DataFrame:
    """UTF-8 first; ISO-8859-1 for a file whose bytes are not valid UTF-8."""
    return read_csv(spark, path, encoding=None, **kw)


# ------------------------------------------------------------- folders of files

@dataclass(frozen=True)
class Pick:
    """How a target column is found in a header: the first name of ``names``
    that is there (as it stands, else by its header key), else the first name
    that ``pattern`` finds (any case), else the first column."""
    names: Sequence[str] = ()
    pattern: str | None = None
    else_first: bool = False


def header_key(name: Column) -> Column:
    """Spelling-free form of a header: its letters and digits in lower case
    (``Mw, g*mol-1`` and ``Mw. g*mol-1`` are one); the name itself if it has none."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    return F.when(key == "", py_strip(name)).otherwise(key)


def folder_headers(records: DataFrame, sep: str = ",") -> tuple[DataFrame, int]:
    """((file, file_name, position, header, key) of every file's header cells, the widest header's width).

    One row per header cell; only the width comes to the driver.
    """
    first = records.where("first")
    width = first.agg(F.max(F.length("text") - F.length(F.replace(F.col("text"), F.lit(sep), F.lit(""))) + 1)).first()[0] or 0
    if not width:
        return first.select("file", F.col("name").alias("file_name"), F.lit(0).alias("position"), F.lit("").alias("header"), F.lit("").alias("key")).limit(0), 0
    heads = first.select("file", F.col("name").alias("file_name"), F.posexplode(cells("text", width, sep)).alias("position", "header"))
    return heads.where("header IS NOT NULL").withColumn("key", header_key(F.col("header"))), width


def _choice(pick: Pick) -> Column:
    """Order of preference of a header cell for a target; null: not a candidate."""
    rank = F.lit(None).cast("long")
    if pick.else_first:
        rank = F.when(F.col("position") == 0, F.lit(1 << 40))
    if pick.pattern:
        rank = F.when(F.col("header").rlike("(?i)" + pick.pattern), (1 << 30) + F.col("position").cast("long")).otherwise(rank)
    exact = py_strip(F.col("header"))
    for i, name in reversed(list(enumerate(pick.names))):
        same_key = F.col("key") == header_key(F.lit(name))
        rank = F.when(exact == name, F.lit(2 * i)).when(same_key, F.least(rank, F.lit(2 * i + 1))).otherwise(rank)
    return rank


def read_csv_dir(spark: SparkSession, directory: str, glob: str = "*.csv", exclude: Sequence[str] = (),
                 lineage_col: str = "source_file", sep: str = ",", encoding: str | None = None,
                 targets: Mapping[str, Pick] | None = None) -> DataFrame | None:
    """All CSV files of a folder as one table of strings, with the file name.

    Without ``targets`` the columns are the headers by their key, in the order of
    the first file (by name) that has them and in its spelling; cells of one file
    whose headers share a key are coalesced.  With ``targets`` (column -> Pick)
    each file's columns are resolved by its own header, a target that a file
    lacks is null there.  None when no file matches.
    """
    records = csv_records(spark, directory, sep, encoding, glob, exclude)
    heads, width = folder_headers(records, sep)
    if not width:
        return None
    if targets is None:
        names = (heads.groupBy("key").agg(F.min(F.struct("file_name", "position", "header")).alias("at")).orderBy("at.file_name", "at.position")
                 .select("key", F.trim("at.header").alias("name")).collect())  # the schema: one row per column, whatever the number of files
        columns = [r["name"] for r in names]
        slots = [F.sort_array(F.collect_list(F.when(F.col("key") == r["key"], F.col("position")))) for r in names]
    else:
        columns = list(targets)
        slots = []
        for pick in targets.values():
            rank = _choice(pick)
            best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("position").alias("position"))))
            slots.append(F.when(best.isNotNull(), F.array(best["position"])).otherwise(F.array().cast("array<int>")))
    files = heads.groupBy("file").agg(*[s.alias(f"s{i}") for i, s in enumerate(slots)])
    body = records.where(~F.col("first")).select("file", "name", cells("text", width, sep).alias("c")).join(files, "file")

    def cell(i: int) -> Column:
        held = F.transform(F.col(f"s{i}"), lambda p: F.get(F.col("c"), p))
        return F.get(F.filter(held, lambda x: x.isNotNull()), F.lit(0))

    return body.select(*[cell(i).alias(c) for i, c in enumerate(columns)], F.col("name").alias(lineage_col))


# ----------------------------------------------------------- dimension loaders

def load_dimension(spark: SparkSession, path: str, schema: T.StructType, **kw) -> DataFrame:
    """An optional lookup table: empty, with the schema's columns, when nothing exists at ``path``."""
    return read_csv_if_exists(spark, path, schema=schema, **kw)


def load_master(spark: SparkSession, path: str, clean, name_cols: Sequence[str] = ("Material_Raw", "Material_Name"),
                clean_col: str = "Clean_Name", **kw) -> DataFrame | None:
    """A master table of strings; the clean name is added from the first of
    ``name_cols`` that exists (else of empty text) when the table lacks it."""
    df = read_csv_if_exists(spark, path, **kw)
    if df is None or clean_col in df.columns:
        return df
    source = next((F.col(c) for c in name_cols if c in df.columns), F.lit(""))
    return df.withColumn(clean_col, clean(source))


def read_documents(spark: SparkSession, path: str, id_field: str = "material_id", order_field: str = "ord") -> DataFrame:
    """(id, ord, doc) of staged JSON documents, one object per line and each of its own shape.

    ``doc`` is a VARIANT, so no schema is inferred or enforced over the
    documents; lines that are no JSON objects, or have no id, are left out.
    ``ord`` orders the documents of an id (null: last, by the text).
    """
    doc = F.try_parse_json("value")
    return (spark.read.text(path).select("value", doc.alias("doc"))
            .select(F.try_variant_get("doc", f"$.{id_field}", "string").alias(id_field),
                    F.try_variant_get("doc", f"$.{order_field}", "long").alias("ord"), "doc", "value")
            .where(F.col(id_field).isNotNull()))


def write_documents(df: DataFrame, path: str) -> None:
    """Stage one column of JSON texts as lines."""
    df.toDF("value").write.text(path)
