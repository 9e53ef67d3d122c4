"""Neighbourhood operators on haloed blocks: detection, content weights, deconvolution.

World pixels go to every block whose halo holds them, a block is one group, and only its core is returned, so that the
result does not depend on the blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import contracts, kernels


def haloed(pixels: DataFrame, dims: list[str], block: int, halo: int) -> DataFrame:
    """``pixels`` under every block (b_<dim>...) whose core or halo holds them."""
    out = pixels
    for d in dims:
        first, last = F.floor((F.col(d) - halo) / block), F.floor((F.col(d) + halo) / block)
        out = out.withColumn(f"b_{d}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


def _image(part: pd.DataFrame, dims: list[str], corner: np.ndarray, edge: int, views: list | None = None, value: str = "v") -> np.ndarray:
    """An array of a block and its halo, NaN where there is no pixel; a first axis of views if they are given."""
    shape = (edge,) * len(dims)
    out = np.full(shape if views is None else (len(views), *shape), np.nan)
    at = part[dims].to_numpy(dtype=int) - corner
    index = tuple(at.T)
    if views is not None:
        index = (np.searchsorted(views, part["view_id"].to_numpy()), *index)
    out[index] = part[value].to_numpy(dtype=float)
    return out


def detect(pixels: DataFrame, keys: list[str], dims: list[str], size: float, block: int = 64, spacing: float = 1.0, threshold_abs: float = 0.0) -> DataFrame:
    """(keys, <dim>...): bright spots of a physical size. A spot is reported by the block whose core holds its centre.

    ``threshold_abs`` is an absolute limit on the filter's answer, as a limit relative to a block's would change with it.
    """
    sigma = max(0.5, size / spacing / (2 * np.sqrt(len(dims))))
    halo = int(np.ceil(4 * sigma + max(1.0, size / spacing / 2))) + 2
    schema = ", ".join([f"{k} long" for k in keys] + [f"{d} double" for d in dims])

    def find(key, part: pd.DataFrame) -> pd.DataFrame:
        core = np.array(key[len(keys) :]) * block
        image = _image(part, dims, core - halo, block + 2 * halo)
        at = kernels.spots(image, [spacing] * len(dims), size, threshold_abs=threshold_abs) + core - halo
        own = at[((at >= core) & (at < core + block)).all(axis=1)]
        return pd.DataFrame({k: [v] * len(own) for k, v in zip(keys, key, strict=False)} | {d: own[:, i] for i, d in enumerate(dims)})

    return haloed(pixels, dims, block, halo).groupBy(*keys, *(f"b_{d}" for d in dims)).applyInPandas(find, schema)


def fuse_blocks(world: DataFrame, dims: list[str], method: str, block: int = 32, halo: int | None = None, **options) -> DataFrame:
    """(<dim>..., fused) by a method that looks at neighbourhoods: content, dct or deconvolution.

    world: (view_id, <dims>, v, w) with blending weights.
    """
    sigma = float(options.get("sigma", 1.0))
    halo = halo if halo is not None else {"content": int(4 * options.get("sigma_2", 11.0)), "dct": int(options.get("size", 8)), "deconvolution": int(np.ceil(3 * sigma)) * 2}[method]

    def fuse(key, part: pd.DataFrame) -> pd.DataFrame:
        core = np.array(key) * block
        views = np.unique(part["view_id"].to_numpy())
        image = _image(part, dims, core - halo, block + 2 * halo, views)
        weight = np.nan_to_num(_image(part, dims, core - halo, block + 2 * halo, views, "w"))
        total = weight.sum(axis=0)
        weight = weight / np.where(total == 0, 1.0, total)
        if method == "deconvolution":
            fused = kernels.deconvolve(image, weight, [kernels.gaussian_psf(sigma, len(dims))] * len(views), options.get("iterations", 5))
        else:
            extra = kernels.content_weights(image, options.get("sigma_1", 5.0), options.get("sigma_2", 11.0)) if method == "content" else kernels.dct_weights(image, options.get("size", 8))
            both = weight * extra
            total = both.sum(axis=0)
            fused = np.nansum(np.nan_to_num(image) * both, axis=0) / np.where(total == 0, 1.0, total)
        known = ~np.isnan(image).all(axis=0)
        inner = tuple(slice(halo, halo + block) for _ in dims)
        at = np.argwhere(known[inner])
        return pd.DataFrame({d: at[:, i] + core[i] for i, d in enumerate(dims)} | {"fused": fused[inner][tuple(at.T)]})

    schema = ", ".join([f"{d} long" for d in dims] + ["fused double"])
    spread = haloed(world, dims, block, halo)
    # Blocks that no view's pixel has in its core would return nothing.
    return spread.groupBy(*(f"b_{d}" for d in dims)).applyInPandas(fuse, schema)


def fuse_with(world: DataFrame, dims: list[str], fusion_func, weights_func=None, block: int = 64, halo: int = 0, spacing: float = 1.0, **options) -> DataFrame:
    """(<dim>..., fused) by a function that the user brings (see ``functions.contracts``), block by block with its halo.

    world: (view_id, <dims>, v, w). The function gets the views of a block (NaN outside of them) and normalised weights.
    """
    use_weights = weights_func is not None and contracts.wants_weights(fusion_func)
    halo = contracts.halo_of([fusion_func, weights_func if use_weights else None], options, halo)

    def fuse(key, part: pd.DataFrame) -> pd.DataFrame:
        core = np.array(key) * block
        views = np.unique(part["view_id"].to_numpy())
        image = _image(part, dims, core - halo, block + 2 * halo, views)
        weight = np.nan_to_num(_image(part, dims, core - halo, block + 2 * halo, views, "w"))
        total = weight.sum(axis=0)
        offered = {"transformed_views": image, "blending_weights": weight / np.where(total == 0, 1.0, total), "params": views.tolist(), "output_spacing": spacing, "output_chunksize": block}
        if use_weights:
            offered["fusion_weights"] = contracts.call(weights_func, offered, options)
        fused = contracts.call(fusion_func, {k: v for k, v in offered.items() if k in contracts.FUSION_ARGUMENTS}, options)
        inner = tuple(slice(halo, halo + block) for _ in dims)
        at = np.argwhere(~np.isnan(image).all(axis=0)[inner])
        return pd.DataFrame({d: at[:, i] + core[i] for i, d in enumerate(dims)} | {"fused": np.nan_to_num(fused[inner][tuple(at.T)]).astype(float)})

    schema = ", ".join([f"{d} long" for d in dims] + ["fused double"])
    return haloed(world, dims, block, halo).groupBy(*(f"b_{d}" for d in dims)).applyInPandas(fuse, schema)


def label_centroids(labels: DataFrame, dims: list[str], start: list[int], shape: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, n, c<dim>...): centroids of labels that fall into a core, half open, so that each is counted by one block."""
    centres = labels.where("label <> 0").groupBy(*by, "label").agg(F.count("*").alias("n"), *(F.avg(d).alias(f"c{d}") for d in dims))
    inside = [(F.col(f"c{d}") >= a) & (F.col(f"c{d}") < a + s) for d, a, s in zip(dims, start, shape, strict=True)]
    return centres.where(reduce(lambda a, b: a & b, inside))


def fill_holes(fused: DataFrame, grid: DataFrame, dims: list[str], value: str, reach: int) -> DataFrame:
    """Pixels of ``grid`` without a value take that of the nearest pixel within ``reach``, the first in order of equals."""
    missing = grid.join(fused, dims, "left_anti")
    cells = [F.explode(F.sequence(F.floor((F.col(d) - reach) / reach), F.floor((F.col(d) + reach) / reach))).alias(f"c_{d}") for d in dims]
    near = missing
    for d, c in zip(dims, cells, strict=True):
        near = near.select("*", c)
    there = fused.select(*(F.floor(F.col(d) / reach).alias(f"c_{d}") for d in dims), *(F.col(d).alias(f"_{d}") for d in dims), value)
    met = near.join(there, [f"c_{d}" for d in dims])
    d2 = reduce(lambda a, b: a + b, ((F.col(d) - F.col(f"_{d}")) ** 2 for d in dims))
    best = met.withColumn("_d2", d2).groupBy(*dims).agg(F.min_by(value, F.struct("_d2", *(f"_{d}" for d in dims))).alias(value))
    return fused.select(*dims, value).unionByName(best)
