"""Schemas and constants of the data model.

A volume is a dense 3-D grid of scalars: a header row, and its samples as ``voxel`` rows (long form, for pruning, statistics and selection) or
``brick`` rows (one XY plane per row, x fastest, for storage). Interaction is an append-only table of events.
"""

from __future__ import annotations

from pyspark.sql import types as T

_axes = lambda kind: T.StructType([T.StructField(a, kind) for a in "xyz"])
EXTENT = T.StructType([T.StructField(f"{a}{i}", T.IntegerType()) for a in "xyz" for i in (0, 1)])
POINT = _axes(T.DoubleType())
VOLUME = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("scalar_type", T.StringType()),
        T.StructField("extent", EXTENT),
        T.StructField("spacing", POINT),
        T.StructField("origin", POINT),
        T.StructField("direction", T.ArrayType(T.DoubleType())),
    ]
)
VOXEL = T.StructType([T.StructField("image_id", T.LongType()), *(T.StructField(a, T.IntegerType()) for a in "xyz"), T.StructField("v", T.DoubleType())])
BRICK = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("z", T.IntegerType()), T.StructField("data", T.ArrayType(T.DoubleType()))])
NODE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "midpoint", "sharpness")])
COLOUR_NODE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "red", "green", "blue", "midpoint", "sharpness")])
UI_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("view", T.StringType()),
        T.StructField("image_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("window", T.DoubleType()),
        T.StructField("level", T.DoubleType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("link_mode", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
AXES = ("x", "y", "z")
#: An orientation's code is the axis that its plane's normal has.
ORIENTATIONS = {"YZ": 0, "XZ": 1, "XY": 2}
#: In-plane axes u and v, and the normal w, of each orientation.
PLANE_AXES = {"YZ": (1, 2, 0), "XZ": (0, 2, 1), "XY": (0, 1, 2)}
VIEWS = ("VOLUME", "YZ", "XZ", "XY")
INTERPOLATIONS = ("Nearest", "Linear", "Cubic")
LINK_MODES = ("Disabled", "EndOnly", "Live")
DEFAULT_LINK_MODE = "Disabled"
U16_MAX = 65535
RECENT = 10
DEBOUNCE_MS = 60
#: Window and level, in the mapped domain, that linked slice views begin with.
LINKED_WINDOW, LINKED_LEVEL = 1000.0, 500.0
