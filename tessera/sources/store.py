"""Images as chunk tables: packing pixels into chunks of a grid and back, and the Parquet store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.combine import upsert


def packed(pixels: DataFrame, chunk: int, dims: tuple[str, ...] = ("y", "x"), dtype: str = "float32") -> DataFrame:
    """Rows of the chunks table of (view_id, <dims>, v); a pixel that is missing is 0."""
    cells = [F.floor(F.col(d) / chunk).cast("int").alias(f"_{d}") for d in dims]

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        index = [int(k) for k in key[1:]]
        off = [k * chunk for k in index]
        block = np.zeros((chunk,) * len(dims), np.dtype(dtype).newbyteorder("<"))
        block[tuple((part[list(dims)].to_numpy(dtype=int) - off).T)] = part["v"].to_numpy()
        return pd.DataFrame([{"view_id": key[0], "level": 0, "t": 0, "c": "0", "idx": index, "off": off, "shape": list(block.shape), "dtype": dtype, "data": block.tobytes()}])

    schema = "view_id long, level int, t int, c string, idx array<int>, off array<int>, shape array<int>, dtype string, data binary"
    return pixels.select("view_id", *dims, "v", *cells).groupBy("view_id", *(f"_{d}" for d in dims)).applyInPandas(pack, schema)


def unpacked(chunks: DataFrame, dims: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(view_id, <dims>, v) of the chunks' pixels other than 0."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["data"], np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["shape"])
                at = np.argwhere(block != 0)
                yield pa.RecordBatch.from_pydict({"view_id": np.full(len(at), row["view_id"])} | {d: at[:, k] + row["off"][k] for k, d in enumerate(dims)} | {"v": block[tuple(at.T)].astype(float)})

    return chunks.mapInArrow(unpack, "view_id long, " + ", ".join(f"{d} long" for d in dims) + ", v double")


def round_trip(pixels: DataFrame, chunk: int) -> DataFrame:
    return unpacked(packed(pixels, chunk))


def save(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """The image's tables as Parquet folders below ``path``; chunks and pixels lie by level, so that a level is read alone."""
    for name, table in tables.items():
        writer = table.write.mode(mode)
        (writer.partitionBy("level") if name in ("chunks", "pixels") and "level" in table.columns else writer).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = ("views", "levels", "transforms", "points", "chunks")) -> dict[str, DataFrame]:
    """The tables of a saved image that are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if there(f"{path}/{n}")}


def update_transforms(spark: SparkSession, path: str, new: DataFrame, overwrite: bool = False) -> None:
    """Add transforms to a saved image; keys that are there are skipped, or replaced with ``overwrite``."""
    at = f"{path}/transforms"
    merged = upsert(spark.read.parquet(at), new, overwrite)
    merged.write.mode("overwrite").parquet(f"{at}.new")
    spark.read.parquet(f"{at}.new").write.mode("overwrite").parquet(at)
