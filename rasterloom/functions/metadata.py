"""Resolution, names and dates as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ppi(per_metre: Column) -> Column:
    """Pixels an inch of pixels a metre, rounded."""
    return F.floor(per_metre / F.lit(39.37) + F.lit(0.5))


def scale_resolution(xres: Column, yres: Column, sx: float, sy: float) -> tuple[Column, Column]:
    """Both resolutions scaled and rounded, unless either is unknown (0)."""
    known = (xres != 0) & (yres != 0)
    return tuple(F.when(known, F.floor(r * F.lit(float(s)) + F.lit(0.5))).otherwise(r.cast("long")) for r, s in ((xres, sx), (yres, sy)))


def words_per_line(w: Column, d: Column) -> Column:
    """32-bit words in a line."""
    return F.floor((w * d + 31) / 32)


def path_name(directory: Column, name: Column) -> Column:
    """A file's path; the directory may end in a slash."""
    trimmed = F.regexp_replace(directory, "/$", "")
    return F.when(name.isNull() | (name == ""), trimmed).when(directory.isNull() | (directory == ""), name).otherwise(F.concat_ws("/", trimmed, name))


def rfc1123(at: Column) -> Column:
    """A timestamp as in '29 Aug 1997 02:14:00 +0000'."""
    return F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
