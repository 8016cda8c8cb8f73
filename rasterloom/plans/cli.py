"""Command line: encode image files to standard output or into a folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .. import schemas
from ..sources.images import read_images
from ..sources.sinks import write_pages
from .pipeline import Options, convert

BAD_CLASS_THRESHOLD = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rasterloom", description="Encode PNG and PNM images losslessly as bi-level pages.")
    p.add_argument("-d", "--duplicate-line-removal", action="store_true", help="leave out repeated lines")
    p.add_argument("-p", "--pdf", action="store_true", help="write what a PDF embeds")
    p.add_argument("-t", type=float, default=0.85, metavar="THRESHOLD", help="accepted from 0.4 to 0.9; has no effect on pages without symbols")
    p.add_argument("-T", type=int, default=188, metavar="THRESHOLD", help="gray below it is black (0 to 255)")
    p.add_argument("-2", dest="up2", action="store_true", help="upscale twofold before the threshold")
    p.add_argument("-4", dest="up4", action="store_true", help="upscale fourfold before the threshold")
    p.add_argument("-v", action="store_true", help="describe the images on standard error")
    p.add_argument("-o", metavar="FOLDER", help="write a file for each image; needed for more than one")
    p.add_argument("--compat", action="store_true", help="historical readings of palettes and damaged files")
    p.add_argument("files", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0, or the first failed image's error code, or that of a bad option."""
    a = parser().parse_args(argv)
    if not 0.4 <= a.t <= 0.9:
        print("-t must be from 0.4 to 0.9", file=sys.stderr)
        return BAD_CLASS_THRESHOLD
    if not 0 <= a.T <= 255:
        print("-T must be from 0 to 255", file=sys.stderr)
        return schemas.BAD_THRESHOLD
    if not a.files:
        print("no file given", file=sys.stderr)
        return schemas.MISSING
    if a.up2 and a.up4:
        print("-2 and -4 exclude each other", file=sys.stderr)
        return schemas.BOTH_SCALES
    if not a.o and len(a.files) > 1:
        print("several files need -o", file=sys.stderr)
        return schemas.FORMAT
    spark = spark or SparkSession.builder.appName("rasterloom").config("spark.ui.enabled", "false").getOrCreate()
    options = Options(threshold=a.T, scale=2 if a.up2 else 4 if a.up4 else 1, typical=a.duplicate_line_removal, full=not a.pdf, compat=a.compat)
    if a.v:
        for r in read_images(spark, a.files, compat=a.compat).select("img_id", "w", "h", "d", "xres", "yres").toLocalIterator():
            print(f"{r.img_id}: width {r.w}, height {r.h}, {r.d} bits a pixel, {r.xres} by {r.yres} pixels an inch", file=sys.stderr)
    pages = convert(spark, a.files, options)
    if a.o:
        pages = pages.persist()
        folders = [os.path.dirname(f if "://" in f else os.path.abspath(f)) for f in a.files]
        write_pages(pages, a.o, root=os.path.commonprefix([f + "/" for f in folders]).rpartition("/")[0])
        failed = pages.where("error IS NOT NULL").select("img_id", "error").orderBy("img_id").take(20)
        pages.unpersist()
    else:
        row = pages.first()
        failed = [row] if row.error else []
        if not failed:
            sys.stdout.buffer.write(row.code)
    for r in failed:
        print(f"{r.img_id}: {r.error.msg}", file=sys.stderr)
    return failed[0].error.code if failed else 0
