"""A data source of one price file an asset that outlasts failures: every partition retries with growing waits, then gives up empty.

    spark.dataSource.register(PriceFiles)
    spark.read.format("price_files").option("assets", json.dumps([["A", "hdfs://.../A"], ...])).load()

A path is a CSV file with a header, or a folder of such files.  An asset's files are read whole before the first row is handed on, so an
asset is there in full or not at all; other assets are not touched by its failure.
"""

from __future__ import annotations

import csv
import io
import json
import re
import time
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "dt date, asset string, price double"


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat((text or "")[:10])
    except ValueError:
        return None


def read_prices(path: str, date_col: str = "date", price_col: str = "close") -> list[tuple[date, float | None]]:
    """(day, price) of all rows with a day; unparsable prices are None.  Files without rows or without these columns are errors."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    info = system.get_file_info(place)
    files = [place] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and not f.base_name.startswith(("_", ".")))
    out = []
    for f in files:
        with system.open_input_stream(f) as stream:
            rows = csv.DictReader(io.StringIO(stream.read().decode("utf-8"), newline=""))
            if not {date_col, price_col} <= set(rows.fieldnames or ()):
                raise ValueError(f"{f} lacks {date_col} or {price_col}")
            out += [(day, _number(r[price_col])) for r in rows if (day := _day(r[date_col]))]
    if not out:
        raise ValueError(f"no data in {path}")
    return out


class AssetPartition(InputPartition):
    def __init__(self, asset: str, path: str):
        self.asset, self.path = asset, path


class PriceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.assets = json.loads(options["assets"])
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 0.5))
        self.columns = options.get("dateCol", "date"), options.get("priceCol", "close")

    def partitions(self) -> list[InputPartition]:
        return [AssetPartition(a, p) for a, p in self.assets]

    def read(self, partition: AssetPartition) -> Iterator[tuple]:
        for attempt in range(self.retries):
            try:
                rows = read_prices(partition.path, *self.columns)
            except Exception:  # noqa: BLE001  whatever a store or a file comes up with
                time.sleep(self.wait * (attempt + 1))
            else:
                return ((day, partition.asset, price) for day, price in rows)
        return iter(())


class PriceFiles(DataSource):
    """Options: assets (JSON list of [asset, path]), retries (3), wait (0.5 s, growing by the attempt), dateCol, priceCol."""

    @classmethod
    def name(cls) -> str:
        return "price_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PriceReader(dict(self.options))


def load(spark: SparkSession, assets: list[tuple[str, str]], retries: int = 3, wait: float = 0.5) -> DataFrame:
    """(dt, asset, price) of the assets whose files can be read; none at all is an error only when the result is used."""
    spark.dataSource.register(PriceFiles)
    return spark.read.format("price_files").option("assets", json.dumps(assets)).option("retries", retries).option("wait", wait).load()


def wide(prices: DataFrame, assets: list[str]) -> DataFrame:
    """(dt, one column an asset in the given order): assets without rows are null columns."""
    return prices.groupBy("dt").pivot("asset", assets).agg(F.last("price", ignorenulls=True))


def export(panel: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write (dt, asset, price) as a folder of CSV files an asset; (asset, path) of each.  A row's asset never goes through the driver, its name does."""
    rows = panel.select("asset", F.col("dt").cast("string").alias("date"), F.col("price").alias("close"))
    rows.repartition("asset").write.option("header", True).partitionBy("asset").csv(folder)
    return [(r.asset, f"{folder}/asset={r.asset}") for r in rows.select("asset").distinct().orderBy("asset").collect()]
