"""The core modules whose QUERIES and SQL make up the query catalogue."""

from __future__ import annotations

from harborline.operators import analysis, bad_rows, corrections, fitting, lineage, near, network, quality, regular_grid, scores, series, spikes, tides, time_texts, world
from harborline.sources import queries as files
from harborline.streaming import queries as streams


def core_modules() -> list:
    return [near, time_texts, regular_grid, bad_rows, spikes, quality, tides, series, scores, fitting, network, lineage, analysis, corrections, world, files, streams]


def flagship(spark, d: str):
    return regular_grid.p4_series(spark, d)
