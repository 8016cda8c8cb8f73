"""File formats by their first bytes, as a column and as a function."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 12

# Leading bytes (hex) and the format they mean, tried in this order.
MAGIC = (
    ("424D", "bmp"),
    ("4949", "tiff"),
    ("4D4D", "tiff"),
    ("5031", "pnm"),
    ("5034", "pnm"),
    ("5032", "pnm"),
    ("5035", "pnm"),
    ("5033", "pnm"),
    ("5036", "pnm"),
    ("FFD8", "jpeg"),
    ("89504E470D0A1A0A", "png"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("0000000C6A5020200D0A870A", "jp2"),
    ("73706978", "spix"),
)


def sniff(content: Column, length: Column | None = None) -> Column:
    """Format of binary ``content``; null where it is unknown or shorter than 12 bytes."""
    head = F.hex(F.substring(content, 1, SHORTEST))
    webp = head.startswith("52494646") & head.endswith("57454250")
    out = F.lit(None).cast("string")
    for magic, name in reversed((*MAGIC[:-1], ("", "webp"), MAGIC[-1])):
        out = F.when(webp if name == "webp" else head.startswith(magic), name).otherwise(out)
    return F.when((F.octet_length(content) if length is None else length) >= SHORTEST, out)


def sniff_bytes(data: bytes) -> str | None:
    """The same for one file."""
    if len(data) < SHORTEST:
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return next((name for magic, name in MAGIC if data.startswith(bytes.fromhex(magic))), None)
