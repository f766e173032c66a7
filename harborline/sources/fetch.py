"""Download jobs for a landing folder: windows, addresses, retries. They run beside queries, never inside them.

Nothing here opens a connection by itself: `get` (address -> text) is passed in, so a job can add proxies, keys or limits and
tests need no network. Windows are independent; they are fetched in parallel tasks and written as one file each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

TIDES = "https://api.tidesandcurrents.noaa.gov/api/prod/datagetter"


def windows(begin: date, end: date, days: int = 30) -> Iterator[tuple[date, date]]:
    """Inclusive windows of at most `days` days; none if end lies before begin."""
    while begin <= end:
        last = min(begin + timedelta(days=days - 1), end)
        yield begin, last
        begin = last + timedelta(days=1)


def tides_url(station: str, begin: date, end: date, product: str = "water_level", datum: str = "MLLW", interval: str = "h") -> str:
    """Address of one window of a product as CSV, in GMT and metric units."""
    if (end - begin).days > 31:
        raise ValueError("a request covers at most 31 days")
    q = {"station": station, "begin_date": f"{begin:%Y%m%d}", "end_date": f"{end:%Y%m%d}", "product": product, "units": "metric", "time_zone": "gmt", "format": "csv", "application": "harborline"}
    if product == "water_level":
        q |= {"datum": datum, "interval": interval}
    return f"{TIDES}?{urlencode(q)}"


def boxes(lon0: float, lon1: float, lat0: float, lat1: float, size: float) -> Iterator[tuple[float, float, float, float]]:
    """A bounding box cut into cells of at most `size` degrees; lon0 > lon1 crosses ±180."""
    spans = [(lon0, lon1)] if lon0 <= lon1 else [(lon0, 180.0), (-180.0, lon1)]
    for a, b in spans:
        x = a
        while x < b:
            y = lat0
            while y < lat1:
                yield x, min(x + size, b), y, min(y + size, lat1)
                y += size
            x += size


def land(spark: SparkSession, addresses: list[str], get: Callable[[str], str], path: str, tries: int = 3) -> DataFrame:
    """Fetch every address in its own task and append (address, body, error) to the landing table; what is there already is kept.

    A failed address has a null body and its error; a later call tries it again.
    """
    asked = spark.createDataFrame([(a,) for a in dict.fromkeys(addresses)], "address string")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        asked = asked.join(spark.read.parquet(path).where("body IS NOT NULL"), "address", "left_anti")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for a in b["address"]:
                body, error = None, None
                for _ in range(tries):
                    try:
                        body, error = get(a), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure is recorded
                        error = str(e)[:500]
                out.append((a, body, error))
            yield pd.DataFrame(out, columns=["address", "body", "error"])

    asked.repartition(max(1, min(len(addresses), 64))).mapInPandas(run, "address string, body string, error string").write.mode("append").parquet(path)
    return spark.read.parquet(path)
