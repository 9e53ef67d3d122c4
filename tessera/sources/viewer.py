"""What an image viewer needs to show views: contrast limits, layer transforms, a state document and its address."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine


def contrast_window(pixels: DataFrame, channel: str = "c", value: str = "v") -> DataFrame:
    """(channel, start, end): least and greatest value of each channel."""
    return pixels.groupBy(channel).agg(F.min(value).alias("start"), F.max(value).alias("end"))


def source_transforms(transforms: DataFrame, spacing: list[float]) -> DataFrame:
    """(view_id, affine) with translations in output pixels."""
    n = len(spacing)
    moved = F.array(*(F.get(affine.translation_of(F.col("affine"), n), F.lit(d)) / spacing[d] for d in range(n)))
    return transforms.select("view_id", affine.from_linear(affine.linear_of(F.col("affine"), n), moved, n).alias("affine"))


def default_layout(shape: dict[str, int]) -> str:
    """A layout from the dimensions that are longer than one pixel."""
    flat = [d for d in "xyz" if shape.get(d, 1) > 1]
    return "4panel" if len(flat) == 3 else "".join(flat) if len(flat) == 2 else "xy"


def state(urls: dict[int, str], transforms: DataFrame, dims: list[str], spacing: list[float], unit: str = "um") -> dict:
    """A viewer state with a layer for each view; one row a view is collected."""
    found = {r["view_id"]: r["affine"] for r in source_transforms(transforms, spacing).collect()}
    n = len(dims)
    axes = {d: [s, unit] for d, s in zip(dims, spacing, strict=True)}
    layers = [{"name": f"view {v}", "type": "image", "source": {"url": u, "transform": {"matrix": [found[v][i * (n + 1) : (i + 1) * (n + 1)] for i in range(n)], "outputDimensions": axes}}} for v, u in sorted(urls.items()) if v in found]
    return {"dimensions": axes, "layers": layers, "layout": default_layout(dict.fromkeys(dims, 2))}


def address(document: dict, base: str) -> str:
    """The state as the fragment of a viewer's address."""
    return f"{base}#!{quote(json.dumps(document, separators=(',', ':')))}"


def plate(views: DataFrame) -> DataFrame:
    """(plate_row, plate_col, wells): fields of each well of a plate, in order."""
    return views.where("plate_row is not null").groupBy("plate_row", "plate_col").agg(F.array_sort(F.collect_list(F.struct("fov", "view_id"))).alias("fields"))
