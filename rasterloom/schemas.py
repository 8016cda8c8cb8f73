"""Schemas of the three views of an image: one row an image, a line, or a pixel."""

from pyspark.sql import types as T

ERROR = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("msg", T.StringType())])
COLOUR = T.StructType([T.StructField(c, T.ShortType()) for c in ("r", "g", "b")])

#: data: lines of packed bits (first pixel in the high bit, lines start on a byte) where d is 1, three bytes a pixel where d is 32, else one byte a pixel (two, little-endian, where d is 16).
IMAGE = T.StructType(
    [
        T.StructField("img_id", T.StringType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("xres", T.IntegerType()),
        T.StructField("yres", T.IntegerType()),
        T.StructField("informat", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("cmap", T.ArrayType(COLOUR)),
        T.StructField("data", T.BinaryType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("error", ERROR),
    ]
)
LINES = T.StructType([T.StructField("img_id", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))])
PIXELS = T.StructType([T.StructField("img_id", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.LongType())])

# Error codes, as a command-line caller would see them.
FORMAT, READ, MISSING, BOTH_SCALES, BAD_THRESHOLD, DEPTH = 1, 3, 4, 6, 11, 2
