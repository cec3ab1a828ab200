"""Sources of tables: text formats with their null rules, logs, file trees, and directories found by pattern."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strophe.operators.relational import nan_to_null

#: What a text cell of a file may hold for "nothing".
NA_TOKENS = ("", "NA", "N/A", "nan", "NaN", "NULL", "null", "None", "#N/A")


def _exists(spark: SparkSession, path: str) -> bool:
    """True if the path, which may be a pattern, matches anything on its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, keep_tokens: bool = False, encoding: str = "UTF-8", columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV file or pattern with a given schema; an empty table of that schema where nothing matches.

    All cells are read as text and cast, so that every spelling of nothing becomes null (not with keep_tokens). A byte order
    mark before the first name is dropped (S-01 to S-04, S-06, S-07). Cells that do not fit their type are null. Columns are found by name where there is a header.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).select(*(columns or schema.names))
    r = spark.read.option("header", header).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("sep", sep).option("enforceSchema", False)
    if header:
        raw = r.csv(path)
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    else:
        raw = r.schema(T.StructType([T.StructField(n, T.StringType()) for n in schema.names])).csv(path)
    have = set(raw.columns)
    cell = lambda c: F.col(f"`{c}`") if keep_tokens else F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`"))
    typed = raw.select(*[(cell(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    return nan_to_null(typed).select(*(columns or schema.names))


def read_csv_any_encoding(spark: SparkSession, path: str, schema: T.StructType | str, otherwise: str = "gb18030", **options) -> DataFrame:
    """UTF-8 where all lines are valid in it (one pass over the bytes decides), else the other encoding, which Spark's own reader does
    not know: then each file is decoded and parsed as a whole in a worker (S-05)."""
    if spark.read.text(path).where("not is_valid_utf8(value)").isEmpty():
        return read_csv(spark, path, schema, **options)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                t = pd.read_csv(io.StringIO(bytes(data).decode(otherwise)), dtype=str, keep_default_na=False)
                yield t.reindex(columns=schema.names)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))
    return raw.select(*[F.when(~F.col(f"`{f.name}`").isin(*NA_TOKENS), F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; lines that do not parse are dropped, or with strict an error (S-11)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document: an array of objects or one object (S-10)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _cells(data: bytes, sheet: int) -> Iterator[list[str | None]]:
    """Rows of texts of one sheet of a workbook, read from its parts."""
    import zipfile
    from xml.etree import ElementTree as ET

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        names = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        root = ET.fromstring(z.read(names[sheet]))
    for row in (e for e in root.iter() if local(e) == "row"):
        out: list[str | None] = []
        for c in (e for e in row if local(e) == "c"):
            at = 0
            for ch in c.get("r", "").rstrip("0123456789"):
                at = at * 26 + ord(ch) - 64
            out += [None] * (at - 1 - len(out))
            raw = next((e.text for e in c if local(e) == "v"), None)
            kind = c.get("t")
            out.append(shared[int(raw)] if kind == "s" else text(c) if kind == "inlineStr" else raw)
        yield out


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str, sheet: int = 0, file_column: str | None = None) -> DataFrame:
    """Workbooks, each read by a worker, with a given schema (S-09). The first row names the columns, which are found by name; cells of
    no value are null. file_column: a column for the name of the file without its ending, where that is a value of its own."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [*schema.names, *([file_column] if file_column else [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                rows = _cells(bytes(data), sheet)
                head = next(rows, [])
                got = [dict(zip(head, r)) for r in rows]
                out = pd.DataFrame([[r.get(n) for n in schema.names] for r in got], columns=schema.names, dtype=object)
                if file_column:
                    out[file_column] = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield out

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    typed = [F.when(~F.col(f"`{f.name}`").isin(*NA_TOKENS), F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema]
    return raw.select(*typed, *([file_column] if file_column else []))


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Arrow IPC files or streams: read file by file in the workers, only the columns asked for. The schema comes from the first file (S-12)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def open_(data: bytes) -> pa.RecordBatchReader:
        try:
            return pa.ipc.open_file(pa.py_buffer(data))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.py_buffer(data))

    files = spark.read.format("binaryFile").load(path).select("content")
    first = open_(bytes(files.first()[0])).schema
    schema = pa.schema([f for f in first if columns is None or f.name in columns])

    def rows(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                t = open_(data).read_all().select(schema.names)
                yield from t.to_batches()

    return files.mapInArrow(rows, from_arrow_schema(schema))


def read_records(spark: SparkSession, path: str, names: Sequence[str], sep: str = r"\s+") -> DataFrame:
    """Lines of fields parted by white space or a mark; lines of another number of fields are dropped (S-18)."""
    parts = F.split(F.trim("value"), sep)
    t = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(names))
    return t.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def read_tree(spark: SparkSession, root: str, levels: Sequence[str], glob: str = "*") -> DataFrame:
    """A file tree as a table: path, the last folders as columns, file name, suffix and size. Contents are not read (S-13, D15)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    p = F.split("path", "/")
    n = len(levels)
    cols = [F.try_element_at(p, F.lit(-(n - i) - 1)).alias(x) for i, x in enumerate(levels)]
    name = F.element_at(p, -1)
    return f.select("path", *cols, name.alias("file"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), F.col("length").alias("bytes"))


def discover(spark: SparkSession, root: str, pattern: str, read, label: str = "round") -> DataFrame:
    """The union of all folders root/<pattern><number>, with the number as a column; folders are listed on the file system (S-25)."""
    import re

    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    hits = sorted((int(m[1]), str(s.getPath())) for s in found if (m := re.search(re.escape(pattern) + r"(\d+)$", str(s.getPath()))))
    if not hits:
        raise FileNotFoundError(f"{root}/{pattern}*")
    frames = [read(spark, path).withColumn(label, F.lit(n)) for n, path in hits]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_npz(spark: SparkSession, path: str, arrays: dict[str, str]) -> DataFrame:
    """``(file, frame, ...)``: archives of equally long frame arrays, each read by a worker (S-20). arrays: name to column type. Every
    array is cut to the shortest of its file; a file that lacks one is an error."""
    import numpy as np

    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("frame", T.IntegerType()), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in arrays.items()]])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    got = {n: z[n] for n in arrays}
                n = min(len(v) for v in got.values())
                yield pd.DataFrame({"file": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "frame": np.arange(n, dtype="int32"), **{k: v[:n] for k, v in got.items()}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return nan_to_null(files.mapInPandas(rows, out))


def read_pickle(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Record stores: pickled lists of dictionaries of plain values (S-21). Nothing but plain values is loaded: a pickle that names any
    class or function is an error, so a file cannot run code."""
    import pickle

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    class Plain(pickle.Unpickler):
        def find_class(self, module: str, name: str):
            raise pickle.UnpicklingError(f"{module}.{name} is not a plain value")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                got = Plain(io.BytesIO(bytes(data))).load()
                yield pd.DataFrame([[r.get(n) for n in schema.names] for r in got], columns=schema.names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def align_frames(series: dict[str, DataFrame], item: str, frame: str) -> DataFrame:
    """Frame series of several sources on (item, frame); only frames that all of them have, so each item ends with its shortest (S-20)."""
    return reduce(lambda a, b: a.join(b, [item, frame]), series.values())
