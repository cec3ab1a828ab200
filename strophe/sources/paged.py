"""Sources behind an interface: pages fetched with a pause and retries, and programs run on single values."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pace:
    """At least ``pause`` seconds between two calls, and longer after a failure: the wait doubles with every one in a row (T-05)."""

    def __init__(self, pause: float, most: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.pause, self.most, self.clock, self.sleep = pause, most, clock, sleep
        self.ready, self.failures = 0.0, 0

    def wait(self) -> None:
        if (left := self.ready - self.clock()) > 0:
            self.sleep(left)

    def done(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        self.ready = self.clock() + min(self.most, self.pause * 2**self.failures)


def fetch(get: Callable[[], bytes], pace: Pace, attempts: int) -> bytes:
    """The first answer; an error after so many attempts is the last one's."""
    for n in range(attempts):
        pace.wait()
        try:
            data = get()
            pace.done(True)
            return data
        except OSError:
            pace.done(False)
            if n + 1 == attempts:
                raise
    raise ValueError("no attempt allowed")


class PagedSource(DataSource):
    """``spark.read.format("paged")``: (page, hit) of the pages folder/page-<n>.json, which each hold ``pages`` and a list ``hits`` (S-23).

    The first page says how many there are. Each partition fetches a run of pages one after the other at its own pace. Options:
    path (of any file system that pyarrow opens), attempts, pause, lanes (partitions, which fetch side by side).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, hit string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def open_bytes(uri: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    with system.open_input_stream(path) as f:
        return f.read()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.attempts = options["path"].rstrip("/"), int(options.get("attempts", 3))
        self.pause, self.lanes = float(options.get("pause", 0)), int(options.get("lanes", 4))

    def page(self, n: int, pace: Pace) -> dict:
        import json

        uri = f"{self.path}/page-{n}.json"
        return json.loads(fetch(lambda: open_bytes(uri), pace, self.attempts))

    def partitions(self) -> list[InputPartition]:
        pages = self.page(1, Pace(self.pause))["pages"]
        return [InputPartition((lane, pages)) for lane in range(min(self.lanes, pages))]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        import json

        lane, pages = partition.value
        pace = Pace(self.pause)
        for n in range(lane + 1, pages + 1, self.lanes):
            for hit in self.page(n, pace)["hits"]:
                yield n, json.dumps(hit, ensure_ascii=False)


def probe(df: DataFrame, key: str, value: str, argv: list[str], timeout: float = 60.0) -> DataFrame:
    """``(key, code, output)``: a program run once per row with the value as its input; code is null where it did not end in time or is
    not there (S-24). One process a row, so it is for tables of files, not for rows by the million."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, outs = [], []
            for v in b["v"]:
                try:
                    p = subprocess.run(argv, input=(v or "").encode(), capture_output=True, timeout=timeout, check=False)
                    codes.append(p.returncode)
                    outs.append(p.stdout.decode("utf-8", "replace").strip())
                except (subprocess.TimeoutExpired, FileNotFoundError):
                    codes.append(None)
                    outs.append(None)
            yield pd.DataFrame({"k": b["k"], "code": pd.Series(codes, dtype="Int32"), "output": outs})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v"))
    return rows.mapInPandas(run, f"k {kind}, code int, output string").withColumnRenamed("k", key)
