"""Uncompressed grayscale TIFF pages: read page by page from binary files, and written for image viewers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}


def pages(data: bytes) -> list[tuple[tuple[int, int], np.dtype, list[tuple[int, int]]]]:
    """((height, width), kind, strips as (offset, bytes)) of each page; ValueError for mixed or packed pages."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, found = struct.unpack(f"{order}I", data[4:8])[0], []
    while at:
        if at + 2 > len(data):
            raise ValueError("a TIFF page lies outside its file")
        count = struct.unpack(f"{order}H", data[at : at + 2])[0]
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack(f"{order}HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            size, place = _SIZE.get(kind, 1) * n, at + 10 + 12 * k
            place = struct.unpack(f"{order}I", data[place : place + 4])[0] if size > 4 else place
            if kind in (3, 4):
                tags[tag] = list(struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", data[place : place + size]))
        if tags.get(259, [1])[0] != 1:
            raise ValueError("packed TIFF pages cannot be read here")
        letter = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]]
        dtype = np.dtype(f"{order}{letter}{tags.get(258, [8])[0] // 8}")
        found.append(((tags[257][0], tags[256][0]), dtype, list(zip(tags[273], tags[279], strict=True))))
        at = struct.unpack(f"{order}I", data[at + 2 + 12 * count : at + 6 + 12 * count])[0]
    if len({(shape, dtype) for shape, dtype, _ in found}) > 1:
        raise ValueError("pages differ in shape or kind")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, shape, dtype, data) of every page of the files at ``path``; their pixels stay packed."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                for k, (shape, dtype, strips) in enumerate(pages(data)):
                    raw = b"".join(data[a : a + n] for a, n in strips)
                    image = np.frombuffer(raw, dtype).astype(dtype.newbyteorder("<"))
                    yield pa.RecordBatch.from_pydict({"path": [name], "page": pa.array([k], pa.int32()), "shape": pa.array([list(shape)], pa.list_(pa.int32())), "dtype": [dtype.newbyteorder("=").name], "data": pa.array([image.tobytes()], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, page int, shape array<int>, dtype string, data binary")


def write(path: str, images: Iterator[np.ndarray], spacing: tuple[float, float] = (1.0, 1.0)) -> int:
    """Write pages one at a time; the resolution is 1 / spacing. Returns their number."""
    letters = {"u": 1, "i": 2, "f": 3}
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 0))
        link, count = 4, 0
        for image in images:
            image = np.ascontiguousarray(image).astype(image.dtype.newbyteorder("<"))
            at = f.tell()
            f.write(image.tobytes())
            f.write(b"\0" * (f.tell() % 2))
            ratio = f.tell()
            for s in spacing[::-1]:
                f.write(struct.pack("<II", round(1e6 / s), 10**6))
            tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, image.nbytes), (282, 5, ratio), (283, 5, ratio + 8), (339, 3, letters[image.dtype.kind])]
            head = f.tell()
            f.write(struct.pack("<H", len(tags)))
            for tag, kind, v in tags:
                f.write(struct.pack("<HHII", tag, kind, 1, v))
            f.write(struct.pack("<I", 0))
            end = f.tell()
            f.seek(link)
            f.write(struct.pack("<I", head))
            link = end - 4
            f.seek(end)
            count += 1
    return count
