"""OME-Zarr images as a Python data source, and a writer.

Arrays of zarr format 2 and 3 with raw, zlib or gzip chunks are read chunk by chunk: metadata on the driver, one input
partition a chunk. ``spark.read.format("ome_zarr").load(path)`` gives rows of the chunks table; option ``level`` reads one
resolution level only.
"""

from __future__ import annotations

import gzip
import json
import os
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.schema import CHUNKS, LEVELS

AXES = ("t", "c", "z", "y", "x")


def _load(*parts: str) -> dict | None:
    path = os.path.join(*parts)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def multiscales(path: str) -> dict:
    """The first multiscales entry: of ``ome`` in format 3, of the group's attributes in format 2."""
    group = _load(path, "zarr.json")
    attrs = group.get("attributes", {}) if group else _load(path, ".zattrs") or {}
    found = attrs.get("ome", attrs).get("multiscales")
    if not found:
        raise ValueError(f"{path} has no multiscales metadata")
    return found[0]


class ArrayInfo:
    """Shape, chunks, kind and codec of one array."""

    def __init__(self, path: str) -> None:
        self.path = path
        if (new := _load(path, "zarr.json")) is not None:
            self.shape, self.chunks = new["shape"], new["chunk_grid"]["configuration"]["chunk_shape"]
            order = next((c.get("configuration", {}).get("endian", "little") for c in new["codecs"] if c["name"] == "bytes"), "little")
            self.dtype = np.dtype(new["data_type"]).newbyteorder("<" if order == "little" else ">")
            self.codecs = [c["name"] for c in new["codecs"] if c["name"] != "bytes"]
            encoding = new.get("chunk_key_encoding", {})
            self.key = lambda i: "/".join(["c", *map(str, i)]) if encoding.get("name", "default") == "default" else ".".join(map(str, i))
            self.fill = new.get("fill_value") or 0
        elif (old := _load(path, ".zarray")) is not None:
            self.shape, self.chunks, self.dtype = old["shape"], old["chunks"], np.dtype(old["dtype"])
            self.codecs = [old["compressor"]["id"]] if old.get("compressor") else []
            self.key = lambda i: old.get("dimension_separator", ".").join(map(str, i))
            self.fill = old.get("fill_value") or 0
        else:
            raise ValueError(f"{path} is not a zarr array")
        if bad := set(self.codecs) - {"zlib", "gzip"}:
            raise ValueError(f"chunks packed with {sorted(bad)} cannot be read here")

    def grid(self) -> list[int]:
        return [-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True)]

    def read(self, index: tuple[int, ...]) -> np.ndarray:
        """A chunk without its padding; a missing one is all fill value."""
        path = os.path.join(self.path, self.key(index))
        size = [min(c, s - i * c) for i, c, s in zip(index, self.chunks, self.shape, strict=True)]
        if not os.path.exists(path):
            return np.full(size, self.fill, self.dtype)
        with open(path, "rb") as f:
            raw = f.read()
        for codec in reversed(self.codecs):
            raw = zlib.decompress(raw) if codec == "zlib" else gzip.decompress(raw)
        return np.frombuffer(raw, self.dtype).reshape(self.chunks)[tuple(slice(0, s) for s in size)]


class _Chunk(InputPartition):
    def __init__(self, level: int, path: str, index: tuple[int, ...], axes: list[str]) -> None:
        self.level, self.path, self.index, self.axes = level, path, index, axes


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.view = options["path"], int(options.get("view_id", 0))
        self.level = int(options["level"]) if "level" in options else None

    def partitions(self) -> list[InputPartition]:
        meta = multiscales(self.path)
        axes = [a["name"] for a in meta.get("axes", [])] or list(AXES)
        if self.level is not None and not 0 <= self.level < len(meta["datasets"]):
            raise ValueError(f"{self.path} has no level {self.level}")
        out = []
        for k, dataset in enumerate(meta["datasets"]):
            if self.level in (None, k):
                at = os.path.join(self.path, dataset["path"])
                out += [_Chunk(k, at, index, axes) for index in product(*(range(n) for n in ArrayInfo(at).grid()))]
        return out

    def read(self, part: _Chunk) -> Iterator[tuple]:
        info = ArrayInfo(part.path)
        block = info.read(part.index)
        space = [d for d, a in enumerate(part.axes) if a in "zyx"]
        t_axis, c_axis = (part.axes.index(a) if a in part.axes else None for a in "tc")
        for at in np.ndindex(*(block.shape[d] for d in range(block.ndim) if d not in space)):
            place, rest = [slice(None)] * block.ndim, iter(at)
            where = {}
            for d in range(block.ndim):
                if d not in space:
                    k = next(rest)
                    place[d] = k
                    where[d] = part.index[d] * info.chunks[d] + k
            data = np.ascontiguousarray(block[tuple(place)])
            off = [part.index[d] * info.chunks[d] for d in space]
            yield (self.view, part.level, where.get(t_axis, 0), str(where.get(c_axis, 0)), [part.index[d] for d in space], off, list(data.shape), data.dtype.name, data.astype(data.dtype.newbyteorder("<")).tobytes())


class OmeZarr(DataSource):
    """``spark.dataSource.register(OmeZarr)``, then ``spark.read.format("ome_zarr").option("view_id", 3).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "ome_zarr"

    def schema(self) -> StructType:
        return CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def levels(spark: SparkSession, path: str, view_id: int = 0) -> DataFrame:
    """The levels table of an image, from metadata alone."""
    meta = multiscales(path)
    axes = [a["name"] for a in meta.get("axes", [])] or list(AXES)
    space, rows = [d for d, a in enumerate(axes) if a in "zyx"], []
    for k, dataset in enumerate(meta["datasets"]):
        info = ArrayInfo(os.path.join(path, dataset["path"]))
        found = {x["type"]: x[x["type"]] for x in dataset.get("coordinateTransformations", [])}
        scale, shift = found.get("scale", [1.0] * len(axes)), found.get("translation", [0.0] * len(axes))
        rows.append((view_id, k, [info.shape[d] for d in space], [float(scale[d]) for d in space], [float(shift[d]) for d in space], [info.chunks[d] for d in space]))
    return spark.createDataFrame(rows, LEVELS)


def pixels(chunks: DataFrame, n: int) -> DataFrame:
    """(view_id, level, t, c, [z,] y, x, v) of a chunks table, decoded in Arrow batches."""
    dims = ["z", "y", "x"][-n:]
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["data"], np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["shape"])
                at = np.indices(block.shape).reshape(n, -1) + np.array(row["off"])[:, None]
                m = block.size
                yield pa.RecordBatch.from_pydict({"view_id": [row["view_id"]] * m, "level": pa.array([row["level"]] * m, pa.int32()), "t": pa.array([row["t"]] * m, pa.int32()), "c": [row["c"]] * m} | {d: at[k] for k, d in enumerate(dims)} | {"v": block.ravel().astype(float)})

    return chunks.mapInArrow(decode, "view_id long, level int, t int, c string, " + ", ".join(f"{d} long" for d in dims) + ", v double")


def write(pixels_: DataFrame, path: str, levels_: list[dict], dtype: str = "uint16", axes: tuple[str, ...] = ("y", "x"), overwrite: bool = False, value: str = "v") -> None:
    """Write an image of format 2, gzip-packed, one task a chunk; existing levels stay unless ``overwrite``.

    pixels_: (level, <axes>, value) of one image; levels_: [{"shape", "chunk", "scale", "translation"}] by number. ``path``
    must be a folder that all executors share.
    """
    os.makedirs(path, exist_ok=True)
    keep = {k for k in range(len(levels_)) if not overwrite and os.path.exists(os.path.join(path, str(k), ".zarray"))}
    for k, level in enumerate(levels_):
        os.makedirs(os.path.join(path, str(k)), exist_ok=True)
        meta = {"zarr_format": 2, "shape": level["shape"], "chunks": level["chunk"], "dtype": np.dtype(dtype).newbyteorder("<").str, "compressor": {"id": "gzip", "level": 1}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}
        _dump(meta, path, str(k), ".zarray")
    steps = lambda level: [{"type": "scale", "scale": level["scale"]}, {"type": "translation", "translation": level["translation"]}]
    kinds = {"t": "time", "c": "channel"}
    entry = {"version": "0.4", "axes": [{"name": a, "type": kinds.get(a, "space")} | ({"unit": "micrometer"} if a in "zyx" else {}) for a in axes], "datasets": [{"path": str(k), "coordinateTransformations": steps(level)} for k, level in enumerate(levels_)]}
    _dump({"zarr_format": 2}, path, ".zgroup")
    _dump({"multiscales": [entry]}, path, ".zattrs")
    import pandas as pd

    def store(key, part: pd.DataFrame) -> pd.DataFrame:
        k, index = key[0], key[1:]
        block = np.zeros(levels_[k]["chunk"], np.dtype(dtype).newbyteorder("<"))
        at = part[list(axes)].to_numpy(dtype=int) - np.array(index) * np.array(levels_[k]["chunk"])
        block[tuple(at.T)] = part[value].to_numpy()
        target = os.path.join(path, str(k), ".".join(map(str, index)))
        with open(f"{target}.{os.getpid()}.part", "wb") as f:
            f.write(gzip.compress(block.tobytes(), 1))
        os.replace(f.name, target)
        return pd.DataFrame({"level": [k]})

    rows = pixels_.where(~F.col("level").isin(sorted(keep))) if keep else pixels_
    cell = [F.floor(F.col(a) / F.element_at(F.array(*(F.lit(lv["chunk"][d]) for lv in levels_)), (F.col("level") + 1).cast("int"))).cast("int").alias(f"_{a}") for d, a in enumerate(axes)]
    spread = rows.select("*", *cell)
    spread.groupBy("level", *(f"_{a}" for a in axes)).applyInPandas(store, "level int").agg(F.count("*")).collect()


def _dump(what: dict, *parts: str) -> None:
    with open(os.path.join(*parts), "w", encoding="utf-8") as f:
        json.dump(what, f)


def set_translation(path: str, shift: list[float], axes_to_move: str = "zyx") -> None:
    """Add a translation to the spatial axes of every level on disk; a frame's scale stays as it is."""
    with open(os.path.join(path, ".zattrs"), encoding="utf-8") as f:
        attrs = json.load(f)
    entry = attrs["multiscales"][0]
    space = [d for d, a in enumerate(entry["axes"]) if a["name"] in axes_to_move]
    for dataset in entry["datasets"]:
        for step in dataset["coordinateTransformations"]:
            if step["type"] == "translation":
                for d, s in zip(space, shift, strict=True):
                    step["translation"][d] += s
    _dump(attrs, path, ".zattrs")
