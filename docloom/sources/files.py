"""Files as rows: path, bytes, content hash, format, ingest key, and the checks before anything is parsed."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from docloom.functions.ids import content_hash, ingest_key

EXTENSIONS = {
    "pdf": "pdf", "xlsx": "excel", "xls": "xls", "doc": "doc", "rtf": "rtf", "json": "json", "xml": "xml", "eml": "email", "msg": "email",
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
}

MAGIC = {
    "pdf": ["255044462D"], "excel": ["504B0304"], "xls": ["D0CF11E0A1B11AE1"], "doc": ["D0CF11E0A1B11AE1"], "rtf": ["7B5C727466"],
    "jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "png": ["89504E470D0A1A0A"], "gif": ["474946383761", "474946383961"], "bmp": ["424D"],
    "tif": ["49492A00", "4D4D002A"], "tiff": ["49492A00", "4D4D002A"], "webp": ["52494646"],
}

MB = 1 << 20


def read_files(spark: SparkSession, path: str, version: str = "1", tenant: str | None = None) -> DataFrame:
    """path, length, content, content_hash, format and ingest_key of the files under a path. Spark's scan leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", "length", "content", content_hash(F.col("content")).alias("content_hash"), file_format(F.col("path")).alias("format"))
    return hashed.withColumn("ingest_key", ingest_key(F.col("content_hash"), F.col("path"), F.lit(version), F.lit(tenant)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def file_format(path: Column) -> Column:
    """The format that handles a path; null: none does."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(known, extension(path))


def has_magic(content: Column, kind: str) -> Column:
    out = F.lit(False)
    for magic in MAGIC[kind]:
        out = out | (F.hex(F.substring(content, 1, len(magic) // 2)) == magic)
    if kind == "webp":
        out = out & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return out


def scan(content: Column, path: Column, wanted: str, largest: int = 100 * MB, warn_at: int = 10 * MB) -> Column:
    """The first thing wrong with a file (extension, empty, size, magic) as a code; W_LARGE_FILE for a big one; null: fine."""
    size, ext = F.length(content), extension(path)
    kinds = [k for k, f in EXTENSIONS.items() if f == wanted and k in MAGIC] or ([wanted] if wanted in MAGIC else [])
    fine = F.lit(not kinds)
    for k in kinds:
        fine = fine | ((ext == k) & has_magic(content, k))
    if not [k for k in kinds if k != wanted] and wanted in MAGIC:
        fine = has_magic(content, wanted)
    return (
        F.when(~F.coalesce(file_format(path) == wanted, F.lit(False)), "E_SECURITY_BAD_EXTENSION")
        .when(content.isNull(), "E_PARSE_NOT_FOUND")
        .when(size == 0, "E_PARSE_EMPTY")
        .when(size > largest, "E_SECURITY_TOO_LARGE")
        .when(~fine, "E_SECURITY_BAD_MAGIC")
        .when(size > warn_at, "W_LARGE_FILE")
    )


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes))


def scan_json(text: Column, path: Column | None = None, largest: int = 100 * MB, warn_at: int = 10 * MB, deepest: int = 100) -> Column:
    """The codes of a JSON file: W_LARGE_FILE for a big one, and the first fatal thing of extension, missing, empty, too large, not
    JSON, and too deep. The depth counts brackets outside of strings, and only where there are more of them than may nest."""
    size = F.octet_length(text)
    bare = F.regexp_replace(F.regexp_replace(text, '"(?:[^"\\\\]|\\\\.)*"', ""), "[^\\[\\]{}]", "")
    turn = lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1)
    step = lambda s, c: F.struct((s["now"] + turn(c)).alias("now"), F.greatest(s["most"], s["now"] + turn(c)).alias("most"))
    depth = F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    wrong = F.lit(False) if path is None else ~F.lower(path).endswith(".json")
    fatal = (
        F.when(wrong, "E_SECURITY_BAD_EXTENSION")
        .when(text.isNull(), "E_PARSE_CORRUPT")
        .when(size == 0, "E_PARSE_EMPTY")
        .when(size > largest, "E_SECURITY_TOO_LARGE")
        .when(F.try_parse_json(text).isNull(), "E_SECURITY_INVALID_JSON")
        .when(F.length(F.regexp_replace(bare, "[^\\[{]", "")) <= deepest, None)
        .when(depth > deepest, "E_SECURITY_NESTING_BOMB")
    )
    return _codes(F.when(~wrong & size.between(warn_at + 1, largest), "W_LARGE_FILE"), fatal)


@F.pandas_udf(StructType([StructField("valid", BooleanType()), StructField("depth", IntegerType()), StructField("elements", IntegerType())]))
def xml_shape(texts: pd.Series) -> pd.DataFrame:
    """Whether a text is well-formed XML, how deep it nests (the root: 1) and how many elements it has; no tree is built."""

    def shape(text: str | None) -> tuple[bool, int, int]:
        state = [0, 0, 0]  # now, deepest, elements

        def start(*_) -> None:
            state[0] += 1
            state[1] = max(state[1], state[0])
            state[2] += 1

        def end(*_) -> None:
            state[0] -= 1

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse((text or "").encode("utf-8", "surrogatepass"), True)
        except (expat.ExpatError, ValueError):
            return False, 0, 0
        return True, state[1], state[2]

    return pd.DataFrame([shape(t) for t in texts], columns=["valid", "depth", "elements"])


def scan_xml(text: Column, path: Column | None = None, largest: int = 100 * MB, warn_at: int = 10 * MB, deepest: int = 100, most: int = 500_000) -> Column:
    """The codes of an XML file, as of scan_json. Entity declarations and internal DTD subsets are refused before anything is parsed;
    W_TRUNCATED: more elements than are read."""
    size, upper = F.octet_length(text), F.upper(text)
    wrong = F.lit(False) if path is None else ~F.lower(path).endswith(".xml")
    early = (
        F.when(wrong, "E_SECURITY_BAD_EXTENSION")
        .when(text.isNull(), "E_PARSE_CORRUPT")
        .when(size == 0, "E_PARSE_EMPTY")
        .when(size > largest, "E_SECURITY_TOO_LARGE")
        .when(upper.contains("<!ENTITY") | upper.rlike("(?s)<!DOCTYPE[^>]*\\["), "E_SECURITY_ENTITY_DECLARATION")
    )
    shape = xml_shape(F.when(early.isNull(), text))
    late = F.when(early.isNull(), F.when(~shape["valid"], "E_SECURITY_INVALID_XML").when(shape["depth"] > deepest, "E_SECURITY_DEPTH_BOMB").when(shape["elements"] > most, "W_TRUNCATED"))
    return _codes(F.when(~wrong & size.between(warn_at + 1, largest), "W_LARGE_FILE"), early, late)


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _coded_size(contents: pd.Series) -> pd.DataFrame:
    """Width and height of JPEG, TIFF and WEBP, whose headers have to be walked."""

    def jpeg(b: bytes):
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            kind, length = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            at += 2 + length
        return None, None

    def tiff(b: bytes):
        order = "little" if b[:2] == b"II" else "big"
        number = lambda at, n: int.from_bytes(b[at : at + n], order)
        first, found = number(4, 4), {}
        for k in range(number(first, 2)):
            at = first + 2 + 12 * k
            if number(at, 2) in (256, 257) and at + 12 <= len(b):
                found[number(at, 2)] = number(at + 8, 2 if number(at + 2, 2) == 3 else 4)
        return found.get(256), found.get(257)

    def webp(b: bytes):
        little = lambda at, n: int.from_bytes(b[at : at + n], "little")
        kind = b[12:16]
        if kind == b"VP8X" and len(b) >= 30:
            return little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L" and len(b) >= 25:
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and len(b) >= 30:
            return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
        return None, None

    def size(b):
        b = bytes(b or b"")
        if b[:2] == b"\xff\xd8":
            return jpeg(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return tiff(b)
        return webp(b) if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else (None, None)

    return pd.DataFrame([size(b) for b in contents], columns=["width", "height"]).astype("Int64")


def image_size(content: Column) -> Column:
    """Width and height of PNG, GIF, BMP, JPEG, TIFF and WEBP from their headers; null otherwise."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.array_join(F.transform(F.sequence(F.lit(n), F.lit(1)), lambda i: F.hex(F.substr(content, i + at - 1, F.lit(1)))), ""), 16, 10).cast("long")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    coded = _coded_size(F.when(~has_magic(content, "png") & ~has_magic(content, "gif") & ~has_magic(content, "bmp"), content))
    return F.when(has_magic(content, "png"), size(number(17, 4), number(21, 4))).when(has_magic(content, "gif"), size(little(7, 2), little(9, 2))).when(has_magic(content, "bmp"), size(little(19, 4), little(23, 4))).when(coded["width"].isNotNull() & coded["height"].isNotNull(), coded)
