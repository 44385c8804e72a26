"""Row types. Rasters have the type of Spark's image source: 8-bit BGR or gray, row by row."""

import pyarrow as pa
from pyspark.sql import types as T

IMAGE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])
POINT = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType())])
CONTOUR = T.ArrayType(POINT)  # top left, top right, bottom right, bottom left
PAGE = T.StructType([T.StructField("page_seq", T.LongType()), T.StructField("name", T.StringType()), T.StructField("image", IMAGE)])
SCAN = T.StructType([
    T.StructField("warped", IMAGE),
    T.StructField("contour", CONTOUR),
    T.StructField("backend", T.StringType()),
    T.StructField("detected", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
])
#: The same for Arrow batches.
ARROW_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
ARROW_SCAN = pa.struct([("warped", ARROW_IMAGE), ("contour", pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())]))), ("backend", pa.string()), ("detected", pa.bool_()), ("reason", pa.string()), ("errors", pa.list_(pa.string()))])
#: Spark's image source: mode 0 is 8-bit gray, 16 is 8-bit BGR.
GRAY_MODE, BGR_MODE = 0, 16
