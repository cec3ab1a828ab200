"""Sinks: tables, partitioned exports, logs, reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strophe.functions.columns import slug
from strophe.operators.relational import replace_by_key


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A parquet table (K-01, S-08, S-21)."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], one_file: bool = False, header: bool = True) -> None:
    """Fixed column order and a header. One file only where that is asked for, for small results (K-02)."""
    out = df.select(*columns)
    w = (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", header).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_partitioned(df: DataFrame, path: str, key: str, fmt: str = "parquet", per_file: int = 1_000_000) -> None:
    """A folder per slugged value of the key. Rows are parted by the key and a hash, so a hot value is written by many tasks; files are capped in rows (K-03)."""
    part = F.coalesce(slug(F.col(key)), F.lit("none"))
    x = df.withColumn("__part", part).withColumnRenamed("__part", f"{key}_slug")
    x.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("header", True).partitionBy(f"{key}_slug").format(fmt).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log (K-04, D14)."""
    df.write.mode("append").parquet(path)


def rewrite_keys(df: DataFrame, old: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Old rows of keys that are written anew are dropped; the result goes to a new path, so reading and writing never meet (K-05)."""
    replace_by_key(old, df, keys).write.mode("errorifexists").parquet(path)


def nested_report(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(group, report)``: one JSON text per group with its rows as a sorted list (K-07, D18)."""
    g = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"), F.count("*").alias("n"))
    return g.select(group, F.to_json(F.struct(F.col(group), "n", "rows")).alias("report"))


def small_rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows of a report on the driver; more than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_json_report(rows: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=1, default=str)


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *["| " + " | ".join(_cell(r[c]).replace("|", "\\|") for c in names) + " |" for r in rows]]) + "\n"


def latex_macros(numbers: Mapping[str, object], prefix: str = "num") -> str:
    """One macro per named number (K-08)."""
    safe = lambda k: "".join(p.capitalize() for p in "".join(ch if ch.isalpha() else " " for ch in k).split())
    return "".join(f"\\newcommand{{\\{prefix}{safe(k)}}}{{{_cell(v)}}}\n" for k, v in numbers.items())


def fill_template(text: str, values: Mapping[str, object]) -> str:
    """Replaces ``{KEY}``; a key without a value is an error (K-09)."""
    import re

    return re.sub(r"\{([A-Z][A-Z0-9_]*)\}", lambda m: _cell(values[m[1]]), text)


def manifest_rows(items: DataFrame, layers: Sequence[str], exists: Column) -> DataFrame:
    """Item x layer and whether the file is there."""
    return items.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers]))).withColumn("present", exists)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on whatever file system the path names (K-10)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def svg_bars(rows: Sequence[tuple[str, float]], width: int = 400, bar: int = 20) -> str:
    """A bar chart as SVG text, bars in the order given, the longest over the whole width (K-12)."""
    top = max((v for _, v in rows), default=0) or 1
    lines = [f'<rect x="0" y="{i * bar}" width="{int(v * width / top)}" height="{bar - 2}"><title>{n}: {_cell(v)}</title></rect>' for i, (n, v) in enumerate(rows)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{len(rows) * bar}">{"".join(lines)}</svg>'
