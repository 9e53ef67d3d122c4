"""Synthetic tiled data: one smooth ground truth cut into overlapping tiles with seeded displacements."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.functions import kernels


@dataclass(frozen=True)
class Tiling:
    """Tiles of ``size`` pixels in a grid, neighbours sharing ``overlap`` of them, each moved by up to ``shift`` pixels."""

    across: tuple[int, int] = (2, 2)
    size: int = 30
    overlap: int = 5
    shift: float = 2.0
    smooth: float = 1.5
    frames: int = 1
    drift: float = 0.0
    seed: int = 0

    def views(self) -> pd.DataFrame:
        """(view_id, t, o_y, o_x, s_y, s_x): stage offsets, and true displacements that are added to them."""
        r, step, rows = np.random.default_rng(self.seed), self.size - self.overlap, []
        own = r.uniform(-self.shift, self.shift, (self.across[0] * self.across[1], 2))
        moved = np.cumsum(r.uniform(-self.drift, self.drift, (self.frames, len(own), 2)), axis=0)
        for t in range(self.frames):
            for v in range(len(own)):
                y, x = divmod(v, self.across[1])
                rows.append((v, t, y * step, x * step, *np.round(own[v] + moved[t, v])))
        return pd.DataFrame(rows, columns=["view_id", "t", "o_y", "o_x", "s_y", "s_x"])

    def truth(self) -> np.ndarray:
        """The ground truth with a margin on every side."""
        margin = self.margin()
        edge = [n * self.size + 2 * margin for n in self.across]
        image = kernels.gaussian(np.random.default_rng(self.seed + 1).uniform(0, 1, edge), self.smooth)
        return np.round(100 * (image - image.min()) / (image.max() - image.min()))

    def margin(self) -> int:
        return int(np.ceil(self.shift + self.drift * self.frames)) + 1


def tiles(spark: SparkSession, tiling: Tiling) -> DataFrame:
    """(view_id, t, y, x, v): each tile's pixels, made where they are needed from the seed."""
    views = spark.createDataFrame(tiling.views())

    def cut(key, part: pd.DataFrame) -> pd.DataFrame:
        truth, row, m = tiling.truth(), part.iloc[0], tiling.margin()
        y0, x0 = int(row.o_y + row.s_y) + m, int(row.o_x + row.s_x) + m
        block = truth[y0 : y0 + tiling.size, x0 : x0 + tiling.size]
        y, x = np.indices(block.shape)
        return pd.DataFrame({"view_id": int(row.view_id), "t": int(row.t), "y": y.ravel(), "x": x.ravel(), "v": block.ravel()})

    return views.groupBy("view_id", "t").applyInPandas(cut, "view_id long, t int, y long, x long, v double")
