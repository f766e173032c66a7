"""Live feeds by Structured Streaming: de-duplication, hourly levels, nowcasts and rolling health by station.

The nowcast keeps one Kalman state a station in the state store: coefficients, their covariance, a surge level and the last time.
State is bounded: it never holds readings, but for the health window's last errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harborline.functions import astro
from harborline.operators.fitting import CANDIDATES
from harborline.plans.steps import with_steps

FEED = "station string, t timestamp, height double"


def feed(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A folder of station,time,height CSV files as a stream; unreadable rows are dropped."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).option("mode", "DROPMALFORMED").csv(path).where("station IS NOT NULL AND t IS NOT NULL AND height IS NOT NULL AND NOT isnan(height)")


def first_wins(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """One reading per station and instant; what comes later than the watermark is dropped."""
    return stream.withWatermark("t", late).dropDuplicatesWithinWatermark(["station", "t"])


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count, mean, lowest and highest by station and hour, emitted once the watermark has passed the hour."""
    got = stream.withWatermark("t", late).groupBy("station", F.window("t", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("height").alias("mean"), F.min("height").alias("low"), F.max("height").alias("high"))
    return got.select("station", F.col("w.start").alias("hour"), "n", "mean", "low", "high")


class Nowcast:
    """Recursive update of harmonic coefficients by station: random-walk coefficients, innovations smoothed to a surge level."""

    OUT = "station string, us long, forecast double, se double, innovation double, surge double"
    STATE = "coef array<double>, cov array<double>, surge double, last_us long, n long"

    def __init__(self, models: list[tuple], names: list[str] = CANDIDATES, q_mean: float = 1e-8, q_coef: float = 1e-10, r: float = 4e-4, phi: float = 0.9) -> None:
        """models: (station, coef, covariance or None, sigma2 or None) of fitted or published constants, one per station."""
        self.names, self.q_mean, self.q_coef, self.r, self.phi = names, q_mean, q_coef, r, phi
        self.models = {m[0]: m[1:] for m in models}

    def start(self, station: str) -> tuple:
        p = 1 + 2 * len(self.names)
        coef, cov, _ = self.models.get(station, (None, None, None))
        x = np.zeros(p) if coef is None else np.asarray(coef, float)
        c = np.diag(np.maximum(x**2, 0.01)) if cov is None else np.asarray(cov, float).reshape(p, p)
        return x, c, 0.0, None, 0

    def step(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Readings at or before the last one taken in are replays and are skipped; the others go in by time."""
        station = key[0]
        if state.exists:
            c, p, surge, last, n = state.get
            x, cov = np.asarray(c, float), np.asarray(p, float).reshape(len(c), -1)
        else:
            x, cov, surge, last, n = self.start(station)
        r = float((self.models.get(station) or (None, None, None))[2] or self.r)
        rows = pd.concat(list(parts)).sort_values("us", kind="stable")
        columns = ["one", *(f"{k}_{m}" for m in self.names for k in "cs")]
        out = []
        for us, y, h in zip(rows["us"].tolist(), rows["height"].tolist(), rows[columns].to_numpy(float), strict=True):
            if last is not None and us <= last:
                continue
            dt = 0.0 if last is None else (us - last) / 3.6e9
            cov = cov + np.diag([self.q_mean * dt, *[self.q_coef * dt] * (len(x) - 1)])
            forecast = float(h @ x) + surge * self.phi**dt
            g = cov @ h
            s = float(h @ g + r)
            innovation = y - float(h @ x)
            out.append((station, us, forecast, float(np.sqrt(s)), innovation, surge := self.phi * surge + (1 - self.phi) * innovation))
            x, cov, last, n = x + g * innovation / s, cov - np.outer(g, g) / s, us, n + 1
        if last is not None:
            state.update((x.tolist(), cov.ravel().tolist(), float(surge), int(last), int(n)))
        yield pd.DataFrame(out, columns=["station", "us", "forecast", "se", "innovation", "surge"])

    def over(self, stream: DataFrame) -> DataFrame:
        """stream(station, t, height) -> the forecast made just before each reading, its error and the surge level after it."""
        basis = with_steps(stream.select("station", F.unix_micros("t").alias("us"), "height", F.lit(1.0).alias("one")), astro.basis_steps([astro.BY_NAME[n] for n in self.names]))
        columns = [f"{k}_{m}" for m in self.names for k in "cs"]
        return basis.select("station", "us", "height", "one", *columns).groupBy("station").applyInPandasWithState(self.step, self.OUT, self.STATE, "append", GroupStateTimeout.NoTimeout)


class Health:
    """Rolling coverage, RMSE and bias of the last WINDOW forecasts of each station, and whether a refit is due."""

    WINDOW, LEAST_COVERAGE, MOST_RATIO, MOST_BIAS = 168, 0.80, 2.0, 0.15
    OUT = "station string, n long, coverage double, rmse double, bias double, needs_refit boolean"
    STATE = "errors array<double>, inside array<boolean>"

    def __init__(self, baseline_rmse: float | None = None, z: float = 1.96) -> None:
        self.baseline, self.z = baseline_rmse, z

    def step(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, inside = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(parts)).sort_values("us", kind="stable")
        errors = (errors + rows["error"].tolist())[-self.WINDOW :]
        inside = (inside + (rows["error"].abs() <= self.z * rows["se"]).tolist())[-self.WINDOW :]
        state.update((errors, inside))
        e = np.array(errors)
        coverage, rmse, bias = float(np.mean(inside)), float(np.sqrt(np.mean(e**2))), float(e.mean())
        due = coverage < self.LEAST_COVERAGE or abs(bias) > self.MOST_BIAS or (self.baseline is not None and rmse > self.MOST_RATIO * self.baseline)
        yield pd.DataFrame([(key[0], len(e), coverage, rmse, bias, due)], columns=["station", "n", "coverage", "rmse", "bias", "needs_refit"])

    def over(self, stream: DataFrame) -> DataFrame:
        """stream(station, us, error, se) -> a report per station and batch."""
        return stream.groupBy("station").applyInPandasWithState(self.step, self.OUT, self.STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into parquet and stop; a rerun goes on where the last one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
