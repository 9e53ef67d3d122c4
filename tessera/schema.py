"""Tables of the tile engine and their checks.

Spatial arrays are ordered z, y, x (the last ndim of them). Affines are row-major homogeneous matrices of (ndim + 1)^2
numbers. A null ``t`` or ``c`` of a transform or point applies to every frame or channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ints, _doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


VIEWS = _table(view_id=T.LongType(), name=T.StringType(), ndim=T.IntegerType(), dtype=T.StringType(), plate_row=T.StringType(), plate_col=T.StringType(), fov=T.StringType())
LEVELS = _table(view_id=T.LongType(), level=T.IntegerType(), shape=_ints, spacing=_doubles, origin=_doubles, chunk=_ints)
TRANSFORMS = _table(transform_key=T.StringType(), view_id=T.LongType(), t=T.IntegerType(), c=T.StringType(), affine=_doubles)
POINTS = _table(points_key=T.StringType(), view_id=T.LongType(), t=T.IntegerType(), c=T.StringType(), point_id=T.LongType(), position=_doubles)
CHUNKS = _table(view_id=T.LongType(), level=T.IntegerType(), t=T.IntegerType(), c=T.StringType(), idx=_ints, off=_ints, shape=_ints, dtype=T.StringType(), data=T.BinaryType())
PIXELS = _table(view_id=T.LongType(), level=T.IntegerType(), t=T.IntegerType(), c=T.StringType(), z=T.IntegerType(), y=T.IntegerType(), x=T.IntegerType(), value=T.DoubleType())
EDGES = _table(src=T.LongType(), dst=T.LongType(), t=T.IntegerType(), overlap=T.DoubleType(), transform=_doubles, quality=T.DoubleType(), bbox_lower=_doubles, bbox_upper=_doubles)

#: Default name of a view's initial placement, and of its markers.
DEFAULT_TRANSFORM_KEY, DEFAULT_POINTS_KEY = "affine_metadata", "beads"
#: Default chunk edge by number of spatial dimensions, and default blending widths (z, y, x).
DEFAULT_CHUNK = {2: 2048, 3: 256}
BLENDING_WIDTHS = (3.0, 10.0, 10.0)


def validate(table: DataFrame, schema: T.StructType) -> DataFrame:
    """``table`` with the columns of ``schema`` in its order; raises ValueError for a missing column or a wrong kind."""
    have = dict(table.dtypes)
    wrong = [f"{f.name}: {f.dataType.simpleString()} wanted, {have.get(f.name)} found" for f in schema if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return table.select(*schema.names)


def check_compatible(views: DataFrame) -> int:
    """The number of spatial dimensions that all views share; ValueError for no views or for mixed ones."""
    kinds = [r["ndim"] for r in views.select("ndim").distinct().limit(3).collect()]
    if not kinds:
        raise ValueError("no views")
    if len(kinds) > 1:
        raise ValueError(f"views of different dimensions: {sorted(kinds)}")
    return kinds[0]
