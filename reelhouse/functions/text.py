"""Paths, names, escapes and display formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def parts(path: Column) -> Column:
    """The segments of a path, without empty ones and single dots."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def folders(path: Column) -> Column:
    """The segments above the last one, from the outermost."""
    p = parts(path)
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))


def name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot doesn't begin a suffix."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name(path), r".(\.[^.]+)$", 1))


def classify(ext: Column, cfg: Config) -> Column:
    """image, raw, video, sidecar or other; the first that has the extension."""
    kind = F.lit("other")
    for label, known in (("sidecar", cfg.sidecar_ext), ("video", cfg.video_ext), ("raw", cfg.raw_ext), ("image", cfg.image_ext)):
        kind = F.when(ext.isin(sorted(known)), label).otherwise(kind)
    return kind


def slugify(stem: Column, slug_max: int = 40) -> Column:
    """Letters and digits of ``stem`` with single hyphens between, cut to ``slug_max``; "img" if nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(joined, 1, slug_max)
    return F.when(cut == "", "img").otherwise(cut)


def destination(cfg: Config, root: str = "") -> Column:
    """Where a manifest row belongs in the library, below ``root``.

    ``YYYY/MM/date[_time]_slug_hash.ext``, the time only where it comes from metadata or the file's
    name and isn't midnight; ``unknown-date/slug_hash.ext`` without a date.
    """
    taken = F.col("date_taken").try_cast("timestamp_ntz")
    timed = F.col("date_source").isin("exif", "filename") & (F.date_format(taken, "HHmmss") != "000000")
    stamp = F.when(timed, F.date_format(taken, "yyyyMMdd_HHmmss")).otherwise(F.date_format(taken, "yyyyMMdd"))
    own = F.concat(
        slugify(stem(F.col("source_path")), cfg.slug_max), F.lit("_"), F.substring("content_hash", 1, 8), F.lower("ext")
    )
    dated = F.concat(F.date_format(taken, "yyyy/MM/"), stamp, F.lit("_"), own)
    place = F.when(taken.isNull(), F.concat(F.lit("unknown-date/"), own)).otherwise(dated)
    return F.concat(F.lit(root.rstrip("/") + "/"), place) if root else place


def hash_bits(hex16: Column) -> Column:
    """A 64-bit hash written in hex as a signed long with the same bits; null where it isn't one."""
    return F.when(hex16.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hex16, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def file_uri(path: Column) -> Column:
    """A ``file://`` URI of an absolute path, percent-encoded; null for a relative one."""
    encoded = F.url_encode(path)
    for seen, meant in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(seen), F.lit(meant))
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), encoded))


def resolution(width: Column, height: Column) -> Column:
    """``WxH``; a missing number is written None."""
    return F.concat(F.coalesce(width.cast("string"), F.lit("None")), F.lit("x"), F.coalesce(height.cast("string"), F.lit("None")))


def kilobytes(size: Column) -> Column:
    """Size in KiB, halves to the even number."""
    return F.bround(F.coalesce(size, F.lit(0)) / 1024, 0).cast("long")


def one_decimal(value: Column) -> Column:
    """A number from 0 to 2^63 with one digit after the point, rounded as C's ``%.1f`` does: by its exact value, halves to the even digit."""
    whole = F.floor(value)
    # The fraction in units of 2^-58, exact from 2^-6 on; ten times as many units still fit a long.
    units = ((value.cast("double") - whole) * float(1 << 58)).cast("long") * 10
    digit, rest = F.shiftright(units, 58), units.bitwiseAND((1 << 58) - 1)
    up = (rest > 1 << 57) | ((rest == 1 << 57) & (digit % 2 == 1))
    tenths = digit + up.cast("int")
    return F.concat((whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_label(size: Column) -> Column:
    megabytes = F.concat(one_decimal(size / 1048576), F.lit(" MB"))
    return F.when(size >= 1048576, megabytes).otherwise(F.concat(F.round(size / 1024).cast("long").cast("string"), F.lit(" KB")))


def megapixel_label(width: Column, height: Column) -> Column:
    known = (width > 0) & (height > 0)
    return F.when(known, F.concat(one_decimal(width.cast("double") * height / 1e6), F.lit(" MP"))).otherwise("? MP")


def csv_field(value: Column) -> Column:
    """RFC 4180: quoted where the value has a quote, comma or line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
