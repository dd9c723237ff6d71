"""Reading JSON records, and harvesting records from outside with retries."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped, a broken line is a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of files that hold one array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_by_id(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value) of files that hold one object keyed by id; keys that begin with an underscore are about the file and dropped.

    value: the fields of the values, as DDL. A value of another shape is null or has null fields."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "raw")).filter(~F.col("id").startswith("_"))
    return entries.select("id", F.from_json("raw", value).alias("value"))


def judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """(judge, id, type, faithfulness, citation, coverage, reason) of files {"_judge": ..., "scores": [...]}; scores stay text.

    A file without _judge is named by its file name."""
    score = "struct<id: string, type: string, faithfulness: string, citation: string, coverage: string, reason: string>"
    files = spark.read.schema(f"_judge string, scores array<{score}>").option("multiLine", True).json(path)
    named = files.select(F.coalesce("_judge", F.regexp_extract("_metadata.file_name", r"_by_([^.]+)\.", 1)).alias("judge"), F.explode("scores").alias("s"))
    return named.select("judge", "s.*")


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def http_json(url: str, timeout: float = 30.0, headers: dict[str, str] | None = None) -> object:
    """The JSON at an http or https address; any other scheme is refused before anything is opened."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not an http address: {url}")
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:  # noqa: S310
        return json.load(r)


class HttpJson(DataSource):
    """spark.read.format("http_json").option("urls", "https://a https://b").load(): (url, payload, error), a row per address.

    Register it with spark.dataSource.register(HttpJson). Each address is a partition of its own. Addresses of any other
    scheme are refused before anything is opened; an address that can't be read gives its error and no payload."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, payload string, error string"

    def reader(self, schema) -> "HttpJsonReader":
        return HttpJsonReader(self.options.get("urls", "").split(), float(self.options.get("timeout", 30)))


class HttpJsonReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float) -> None:
        for url in urls:
            if urlsplit(url).scheme not in ("http", "https"):
                raise ValueError(f"not an http address: {url}")
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(url) for url in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield partition.value, json.dumps(http_json(partition.value, self.timeout), ensure_ascii=False), None
        except Exception as e:  # noqa: BLE001
            yield partition.value, None, f"{type(e).__name__}: {e}"


def harvest(entities: DataFrame, fetch: Callable[[str], object], *, retries: int = 2, pause: float = 0.0) -> DataFrame:
    """(id, payload, error) of each distinct entity: its record as JSON, or why it couldn't be fetched after the retries.

    A failure never ends the job. Entities are compared as text; null ones are left out."""
    ids = entities.select(F.col(entities.columns[0]).cast("string").alias("id")).filter("id is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                payload, error = None, None
                for k in range(retries + 1):
                    try:
                        payload, error = json.dumps(fetch(i), ensure_ascii=False), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if pause and k < retries:
                            time.sleep(pause)
                out.append((i, payload, error))
            yield pd.DataFrame(out, columns=["id", "payload", "error"])

    return ids.mapInPandas(run, "id string, payload string, error string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
