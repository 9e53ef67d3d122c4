"""What functions that users bring may ask for, and the halo that they need.

A fusion function takes ``transformed_views`` and any of ``blending_weights``, ``fusion_weights``, ``params`` and
``output_spacing``; a weights function takes ``transformed_views`` and any of ``blending_weights``, ``params`` and
``output_chunksize``, and is called only if the fusion function takes ``fusion_weights``. Both may carry the halo that they
need (in pixels) and the distance by which a view's border should be drawn in.
"""

from __future__ import annotations

import inspect

import numpy as np

FUSION_ARGUMENTS = ("transformed_views", "blending_weights", "fusion_weights", "params", "output_spacing")
WEIGHTS_ARGUMENTS = ("transformed_views", "blending_weights", "params", "output_chunksize")


def _defaults(f) -> dict:
    return {n: p.default for n, p in inspect.signature(f).parameters.items() if p.default is not inspect.Parameter.empty}


def requires_overlap(halo):
    """Decorator: ``halo(options)`` gives the pixels that the function looks beyond a block, from defaults and options."""

    def attach(f):
        f.required_overlap = lambda options=None: halo(_defaults(f) | (options or {}))
        return f

    return attach


def requires_source_shrinkage(distance):
    """Decorator: ``distance(options)`` gives how far a view's border is drawn in."""

    def attach(f):
        f.required_source_shrinkage = lambda options=None: distance(_defaults(f) | (options or {}))
        return f

    return attach


def halo_of(functions: list, options: dict, least: int = 0) -> int:
    """The largest halo that the functions and the user ask for."""
    return int(max([least, *(np.ceil(np.max(f.required_overlap(options))) for f in functions if f is not None and hasattr(f, "required_overlap"))]))


def shrinkage_of(functions: list, options: dict) -> float:
    """The distance that the last function which states one asks for."""
    found = [f.required_source_shrinkage(options) for f in functions if f is not None and hasattr(f, "required_source_shrinkage")]
    return float(found[-1]) if found else 0.0


def call(f, offered: dict, options: dict):
    """``f`` with what it takes of what is offered, and of the options."""
    names = inspect.signature(f).parameters
    every = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in names.values())
    return f(**{k: v for k, v in offered.items() if k in names}, **{k: v for k, v in options.items() if every or k in names})


def wants_weights(f) -> bool:
    return "fusion_weights" in inspect.signature(f).parameters
