"""NetCDF-3 classic files: a reader of the format, a data source for harmonic grids, a writer of station records.

Written from the public format description. Variables are read by memory map, so a task touches only its own rows; the
data source `harmonic_grid` splits a file into bands of rows. Paths must be readable by every executor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    dtype: np.dtype
    begin: int
    vsize: int
    record: bool


class File:
    """The header of a classic file (32- or 64-bit offsets) and access to its variables."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02"):
                raise ValueError(f"{path}: not a NetCDF-3 classic file")
            self._wide = magic[3:] == b"\x02"
            self.records = self._int()
            self.dims = [(self._name(), self._int()) for _ in range(self._list(_DIMENSION))]
            self.attributes = self._attributes()
            self.variables = {}
            for _ in range(self._list(_VARIABLE)):
                v = self._variable()
                self.variables[v.name.lower()] = v
        recs = [v for v in self.variables.values() if v.record]
        # A single record variable is not padded between its records.
        self._step = recs[0].dtype.itemsize * int(np.prod([self.dims[d][1] for d in recs[0].dims[1:]])) if len(recs) == 1 else sum(v.vsize for v in recs)

    def _int(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _name(self) -> str:
        n = self._int()
        return self._f.read(n + -n % 4)[:n].decode("utf-8")

    def _list(self, kind: int) -> int:
        tag, n = self._int(), self._int()
        if tag not in (0, kind):
            raise ValueError(f"{self.path}: bad header")
        return n if tag else 0

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(_ATTRIBUTE)):
            name, kind, n = self._name(), self._int(), self._int()
            dtype = np.dtype(_TYPES[kind])
            raw = self._f.read(n * dtype.itemsize + -(n * dtype.itemsize) % 4)[: n * dtype.itemsize]
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype)
        return out

    def _variable(self) -> Variable:
        name = self._name()
        dims = tuple(self._int() for _ in range(self._int()))
        attributes, kind, size = self._attributes(), self._int(), self._int()
        begin = struct.unpack(">q", self._f.read(8))[0] if self._wide else self._int()
        return Variable(name, dims, attributes, np.dtype(_TYPES[kind]), begin, size, bool(dims) and self.dims[dims[0]][1] == 0)

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims)

    def read(self, name: str, rows: slice = slice(None)) -> np.ndarray:
        """Values (a slice of the first dimension) as doubles: fill values NaN, then scaled and shifted."""
        v = self.variables[name.lower()]
        shape = self.shape(v)
        if v.record:
            one = v.dtype.itemsize * int(np.prod(shape[1:]))
            raw = np.memmap(self.path, np.uint8, "r", v.begin, ((shape[0] - 1) * self._step + one,)) if shape[0] else np.zeros(0, np.uint8)
            picked = range(shape[0])[rows]
            data = np.stack([raw[k * self._step : k * self._step + one].view(v.dtype).reshape(shape[1:]) for k in picked]) if len(picked) else np.zeros((0, *shape[1:]))
        else:
            data = np.memmap(self.path, v.dtype, "r", v.begin, shape or (1,))[rows]
        out = np.asarray(data, float)
        for fill in ("_FillValue", "missing_value"):
            if fill in v.attributes:
                out = np.where(np.asarray(data) == v.attributes[fill][0], np.nan, out)
        return out * float(v.attributes.get("scale_factor", [1.0])[0]) + float(v.attributes.get("add_offset", [0.0])[0])


LON, LAT, MASK = ("lon_z", "lon", "longitude", "nav_lon", "x"), ("lat_z", "lat", "latitude", "nav_lat", "y"), ("mask_z", "mask", "wet", "land_mask")
AMPLITUDE, PHASE = ("h_am_{}", "ha_{}", "amp_{}", "{}_amp", "amplitude_{}"), ("h_pu_{}", "hg_{}", "pha_{}", "{}_pha", "phase_{}")
GRID = "lon double, lat double, constituent string, amplitude double, phase double, water boolean"


def _pick(names: dict, candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in names), None)


@dataclass
class _Band(InputPartition):
    first: int
    last: int


class _GridReader(DataSourceReader):
    """options: path; constituents (comma-separated); bbox 'lon0,lon1,lat0,lat1', lon0 > lon1 crossing ±180; rows per task."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.codes = [c.strip() for c in options.get("constituents", "M2,S2,N2,K2,K1,O1,P1,Q1").split(",")]
        self.bbox = [float(x) for x in options["bbox"].split(",")] if "bbox" in options else None
        self.rows = int(options.get("rows", 64))

    def partitions(self) -> list[_Band]:
        f = File(self.path)
        n = f.shape(f.variables[self._fields(f)[0][1]])[0]
        return [_Band(a, min(a + self.rows, n)) for a in range(0, n, self.rows)]

    def _fields(self, f: File) -> list[tuple[str, str, str]]:
        found = [(c, _pick(f.variables, tuple(x.format(c.lower()) for x in AMPLITUDE)), _pick(f.variables, tuple(x.format(c.lower()) for x in PHASE))) for c in self.codes]
        some = [x for x in found if x[1] and x[2]]
        if not some:
            raise ValueError(f"{self.path}: none of {self.codes}")
        return some

    def read(self, band: _Band) -> Iterator[tuple]:
        f = File(self.path)
        lon_name, lat_name, mask_name = (_pick(f.variables, x) for x in (LON, LAT, MASK))
        if lon_name is None or lat_name is None:
            raise ValueError(f"{self.path}: no longitudes or latitudes")
        part = slice(band.first, band.last)
        flat = len(f.shape(f.variables[lon_name])) == 1
        if flat:
            lon, lat = np.meshgrid(f.read(lon_name), f.read(lat_name, part))
        else:
            lon, lat = f.read(lon_name, part), f.read(lat_name, part)
        lon = (lon + 180) % 360 - 180
        keep = np.ones(lon.shape, bool)
        if self.bbox:
            a, b, south, north = self.bbox
            keep = (lat >= south) & (lat <= north) & ((lon >= a) & (lon <= b) if a <= b else (lon >= a) | (lon <= b))
        wet = f.read(mask_name, part) != 0 if mask_name else np.ones(lon.shape, bool)
        for code, am, ph in self._fields(f):
            amplitude, phase = f.read(am, part), f.read(ph, part)
            for j, i in zip(*np.nonzero(keep & ~np.isnan(amplitude) & ~np.isnan(phase)), strict=True):
                yield round(float(lon[j, i]), 6), round(float(lat[j, i]), 6), code, float(amplitude[j, i]), float(phase[j, i]), bool(wet[j, i])


class HarmonicGrid(DataSource):
    """spark.dataSource.register(HarmonicGrid); spark.read.format('harmonic_grid').option('path', ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "harmonic_grid"

    def schema(self) -> str:
        return GRID

    def reader(self, schema: object) -> _GridReader:
        return _GridReader(self.options)


def encode(dims: list[tuple[str, int]], variables: list[tuple[str, list[str], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A classic file of fixed-size double variables: variables are (name, dimension names, values, attributes)."""
    word = lambda x: struct.pack(">i", x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: word(len(s.encode())) + pad(s.encode())

    def attrs(a: dict) -> bytes:
        if not a:
            return word(0) * 2
        one = lambda k, v: text(k) + (word(2) + word(len(v.encode())) + pad(v.encode()) if isinstance(v, str) else word(6) + word(1) + struct.pack(">d", v))
        return word(_ATTRIBUTE) + word(len(a)) + b"".join(one(k, v) for k, v in a.items())

    at = {n: k for k, (n, _) in enumerate(dims)}
    head = b"CDF\x01" + word(0) + word(_DIMENSION) + word(len(dims)) + b"".join(text(n) + word(s) for n, s in dims) + attrs(attributes or {}) + word(_VARIABLE) + word(len(variables))
    bodies = [np.ascontiguousarray(v, ">f8").tobytes() for _, _, v, _ in variables]
    entries = [text(n) + word(len(d)) + b"".join(word(at[x]) for x in d) + attrs(a) + word(6) + word(len(body)) for (n, d, _, a), body in zip(variables, bodies, strict=True)]
    begin = len(head) + sum(len(e) + 4 for e in entries)
    for e, body in zip(entries, bodies, strict=True):
        head += e + word(begin)
        begin += len(body)
    return head + b"".join(bodies)


def station_records(curves: DataFrame) -> DataFrame:
    """curves(station, us, mean, lower, upper) -> (station, content): one file of time, height, lower, upper a station."""
    import pandas as pd

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("us")
        hours = (part["us"].to_numpy() - 946_684_800_000_000) / 3.6e9  # since 2000-01-01
        meta = {"units": "hours since 2000-01-01T00:00:00Z"}
        columns = [("time", ["time"], hours, meta), *((n, ["time"], part[c].to_numpy(), {"units": "m"}) for n, c in (("height", "mean"), ("lower", "lower"), ("upper", "upper")))]
        return pd.DataFrame({"station": [part["station"].iloc[0]], "content": [encode([("time", len(part))], columns, {"station": str(part["station"].iloc[0])})]})

    return curves.groupBy("station").applyInPandas(one, "station string, content binary")
