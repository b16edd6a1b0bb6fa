"""What a file's path says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions of each kind of file.
IMAGE = "jpg jpeg png gif bmp tiff tif webp heic heif raw nef cr2 arw dng orf sr2 raf rw2 pef srw".split()
IMAGE_EXTRA = "ico svg eps psd ai".split()
VIDEO = "mp4 mov avi mkv webm flv wmv m4v mpg mpeg 3gp mts m2ts ts vob ogv rm rmvb asf f4v".split()
AUDIO = "mp3 wav flac m4a aac ogg wma opus ape alac aiff mid midi amr".split()
DOCUMENT = "pdf doc docx txt rtf odt pages xls xlsx csv ods numbers ppt pptx odp key epub mobi azw azw3".split()
ARCHIVE = "zip rar 7z tar gz bz2 xz tgz tbz2 lz lzma z lzh".split()
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "webp": "image/webp", "heic": "image/heic",
    "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac",
}
# Name patterns of camera brands, first match wins; name shapes of bursts; what is processed again on change.
CAMERAS = {"canon": r"^IMG_.*\.(CR2|CR3|JPG)$", "nikon": r"^DSC_.*\.(NEF|JPG)$", "sony": r"^DSC.*\.(ARW|JPG)$", "fujifilm": r"^DSCF.*\.(RAF|JPG)$", "olympus": r"^P.*\.(ORF|JPG)$", "panasonic": r"^P.*\.(RW2|JPG)$", "iphone": r"^IMG_.*\.(HEIC|MOV)$", "samsung": r"^(IMG_.*\.JPG|VID_.*\.MP4)$"}
BURST_NAME = r"^(IMG_\d{4}( \d+)?|IMG_\d{8}_\d{6}_BURST\d+|\d{8}_\d{6}_\d{3}|DSC_\d+(-\d+)?)$"
REPROCESSED = "cr2 cr3 nef arw raf orf rw2 dng pdf doc docx xls xlsx".split()
RAW = "cr2 cr3 nef arw raf orf rw2".split()
COUNTER = r"( \d+|-\d+|_BURST\d+)$"


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot, as written; empty for none, for names that only start with a dot, and for a final dot."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.ltrim(suffix(path), F.lit(".")))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def file_type(path: Column) -> Column:
    """image, video, audio, document, archive or other, by extension."""
    kinds = {e: k for k, es in (("archive", ARCHIVE), ("document", DOCUMENT), ("audio", AUDIO), ("video", VIDEO), ("image", IMAGE + IMAGE_EXTRA)) for e in es}
    return F.coalesce(_lookup(extension(path), kinds), F.lit("other"))


def glob_type(path: Column) -> Column:
    """The same by name pattern: null when unknown, and without the drawing formats."""
    kinds = {e: k for k, es in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO), ("document", DOCUMENT), ("archive", ARCHIVE)) for e in es}
    return _lookup(F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1)), kinds)


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(extension(path), MIME), F.lit("application/octet-stream"))


def camera_brand(path: Column) -> Column:
    """First brand whose name pattern fits, null if none does."""
    name, brand = F.upper(basename(path)), F.lit(None).cast("string")
    for b, pattern in reversed(CAMERAS.items()):
        brand = F.when(name.rlike(pattern), b).otherwise(brand)
    return brand


def is_burst_name(path: Column) -> Column:
    return F.upper(stem(path)).rlike(BURST_NAME)


def capture_time(path: Column, mtime: Column) -> Column:
    """Time in the file name (yyyyMMdd_HHmmss, then 14 digits in a row), else mtime; a match that is no time gives mtime."""
    name = stem(path)
    pair = F.regexp_extract(name, r"IMG_(\d{8}_\d{6})", 1)
    pair = F.when(pair != "", pair).otherwise(F.regexp_extract(name, r"(\d{8}_\d{6})", 1))
    digits = F.when(pair != "", F.regexp_replace(pair, "_", "")).otherwise(F.regexp_extract(name, r"(\d{14})", 1))
    return F.coalesce(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss")), mtime)


def normalize_path(path: Column) -> Column:
    """A join key: forward slashes, no drive letter, no leading slash."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.when(F.length(p) > 2, F.regexp_replace(p, "^.:", "")).otherwise(p)
    return F.regexp_replace(p, "^/", "")


def should_reprocess(path: Column, types: list[str] | None = None) -> Column:
    """Raw and office formats, or a list of ".ext", "*" and "*ending"."""
    if types is None:
        return extension(path).isin(*REPROCESSED)
    ext, found = F.lower(suffix(path)), F.lit(False)
    for t in types:
        found = found | (F.lit(True) if t == "*" else ext == t.lower() if t.startswith(".") else ext.endswith(t[1:] if t.startswith("*") else t.rstrip("*")) if "*" in t else F.lit(False))
    return found


def organization_path(df: DataFrame, path: str, time: str, kind: str) -> DataFrame:
    """df with target: Kinds/yyyy/MM/dd/name; of files with one name (by path) the first keeps it, the nth after it gets the nth free _1, _2, ...

    A number is free unless a file of that name is there itself, so no target repeats: names given to different names never meet.
    """
    folder = F.concat(F.initcap(F.col(kind)), F.lit("s/"), F.date_format(time, "yyyy/MM/dd"), F.lit("/"))
    key = ["__f", "__s", "__e"]
    named = df.withColumn("__f", folder).withColumn("__s", stem(F.col(path))).withColumn("__e", suffix(F.col(path)))
    named = named.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(path)) - 1).withColumn("__given", F.lit(False))
    # A name x_7 takes the number 7 of x; below it are 7 less its rank among the numbers taken that are free, and so it moves all from there on.
    number = F.regexp_extract("__s", "_([1-9][0-9]{0,8})$", 1)
    given = named.where((F.col("__n") == 0) & (number != "")).select("__f", F.regexp_replace("__s", "_[0-9]+$", "").alias("__s"), "__e", number.cast("int").alias("__n"), F.lit(True).alias("__given"))
    given = given.withColumn("__n", F.col("__n") - F.row_number().over(Window.partitionBy(*key).orderBy("__n")) + 1)
    both = named.unionByName(given, allowMissingColumns=True)
    moved = F.sum(F.col("__given").cast("int")).over(Window.partitionBy(*key).orderBy("__n", F.desc("__given")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("__n", F.when(F.col("__n") > 0, F.col("__n") + moved).otherwise(0)).where(~F.col("__given"))
    tail = F.when(F.col("__n") > 0, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise("")
    return both.withColumn("target", F.concat("__f", "__s", tail, "__e")).drop(*key, "__n", "__given")
