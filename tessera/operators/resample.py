"""Resampling views onto the world grid by linear interpolation, as a join of shifted neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shift_linear(pixels: DataFrame, offsets: DataFrame, keys: list[str], dims: list[str], value: str = "v") -> DataFrame:
    """Views moved by any offset (view_id, o_<dim>...), sampled on whole world pixels: (keys, w<dim>..., value).

    A pixel gives each of the 2^n world pixels around it its share; a world pixel is valid only if all the pixels
    that it interpolates between are, and those at an exact hit need no neighbour. One shuffle, combined beforehand.
    """
    both = pixels.join(offsets, "view_id")
    base = {d: F.ceil(F.col(f"o_{d}")) for d in dims}
    part = {d: base[d] - F.col(f"o_{d}") for d in dims}
    steps = []
    for near in product((0, 1), repeat=len(dims)):
        # World pixel base + i - near takes the share (1 - part) of pixel i for near 0 and part for near 1.
        weight = reduce(mul, (part[d] if k else 1 - part[d] for d, k in zip(dims, near, strict=True)))
        steps.append(F.struct(*((F.col(d) + base[d] - k).cast("long").alias(f"w{d}") for d, k in zip(dims, near, strict=True)), weight.alias("share")))
    spread = both.select(*keys, value, F.explode(F.array(*steps)).alias("s")).select(*keys, value, "s.*").where("share > 0")
    out = spread.groupBy(*keys, *(f"w{d}" for d in dims)).agg(F.sum(F.col(value) * F.col("share")).alias(value), F.sum("share").alias("_all"))
    return out.where(F.col("_all") > 1 - 1e-9).drop("_all")


def resample_affine(pixels: DataFrame, transforms: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """(view_id, w<dim>..., values...) on whole world pixels of views (view_id, dims..., values...) placed by any affine.

    A view is one group: its plane or volume is held by one task, as a tile is of bounded size. World pixels whose sources
    are outside of the view or missing are left out.
    """
    import numpy as np
    import pandas as pd

    from tessera.functions import kernels

    n = len(dims)

    def place(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(part["affine"].iloc[0], dtype=float).reshape(n + 1, n + 1)
        spots = part[dims].to_numpy()
        first = spots.min(axis=0)
        size = tuple((spots.max(axis=0) - first + 1).tolist())
        ends = np.stack(np.meshgrid(*((f, f + k - 1) for f, k in zip(first, size, strict=True)), indexing="ij"), axis=-1).reshape(-1, n)
        world = np.round(ends @ matrix[:n, :n].T + matrix[:n, n], 9)
        lo, hi = np.ceil(world.min(axis=0)).astype(int), np.floor(world.max(axis=0)).astype(int)
        back = np.linalg.inv(matrix)
        offset = back[:n, :n] @ lo + back[:n, n] - first
        found = {}
        for name in values:
            image = np.full(size, np.nan)
            image[tuple((spots - first).T)] = part[name].to_numpy(dtype=float)
            found[name] = kernels.resample(image, back[:n, :n], offset, tuple(np.maximum(hi - lo + 1, 0).tolist()))
        at = np.argwhere(~np.isnan(found[values[0]]))
        out = {"view_id": np.full(len(at), part["view_id"].iloc[0])} | {f"w{d}": at[:, i] + lo[i] for i, d in enumerate(dims)}
        return pd.DataFrame(out | {name: found[name][tuple(at.T)] for name in values})

    schema = ", ".join(["view_id long", *(f"w{d} long" for d in dims), *(f"{v} double" for v in values)])
    rows = pixels.select(F.col("view_id").cast("long").alias("view_id"), *dims, *values).join(transforms.select(F.col("view_id").cast("long").alias("view_id"), "affine"), "view_id")
    return rows.groupBy("view_id").applyInPandas(place, schema)
