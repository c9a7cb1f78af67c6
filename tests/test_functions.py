from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelhouse.config import Config, ConfigError, load_config
from reelhouse.functions import dates, text

CFG = Config(max_year=2030)


def one(spark, column, **values):
    row = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], row).select(column.alias("r")).first()["r"]


def iso(column):
    return dates.isoformat(column)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2015:07:14 10:30:00", "2015-07-14T10:30:00"),
        ("2015:07:14T10:30:00", "2015-07-14T10:30:00"),
        ("2015:07:14 10:30:00+02:00", "2015-07-14T10:30:00"),
        (None, None),
        ("", None),
        ("garbage", None),
        ("0000:00:00 00:00:00", None),
        ("1989:01:01 00:00:00", None),
        ("2032:01:01 00:00:00", None),
        ("2015:02:30 10:00:00", None),
        ("2015:01:01 10:30:60", None),
    ],
)
def test_metadata_dates(spark, raw, want):
    assert one(spark, iso(dates.exif_date(F.col("x"), CFG)), x=raw) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("IMG_20190304_101112.jpg", "2019-03-04T10:11:12"),
        ("IMG-20190304-WA0001.jpg", "2019-03-04T00:00:00"),
        ("2019-03-04 party.jpg", "2019-03-04T00:00:00"),
        ("2019.3.4.jpg", "2019-03-04T00:00:00"),
        ("beach.jpg", None),
        ("IMG_30190304_101112.jpg", None),
        ("IMG_20191399_251199.jpg", None),
        ("2019-03-45.jpg", "2019-03-04T00:00:00"),
        ("2019.jpg", None),
    ],
)
def test_dates_in_names(spark, name, want):
    assert one(spark, iso(dates.filename_date(F.col("x"), CFG)), x=name) == want


@pytest.mark.parametrize(
    "path, want",
    [
        ("Old Laptop/Holiday 2015/a.jpg", 2015),
        ("2010/Trip 2015/a.jpg", 2015),
        ("stuff/IMG_2015.jpg", None),
        ("Archive 1980/a.jpg", None),
        ("Holiday_2015/a.jpg", None),
        ("1980 2015/a.jpg", None),
        ("2010/Trip 1980/a.jpg", 2010),
        (None, None),
    ],
)
def test_years_of_folders(spark, path, want):
    assert one(spark, dates.folder_year(F.col("x"), CFG), x=path) == want


@pytest.mark.parametrize(
    "exif, path, rel, mtime, want",
    [
        ("2015:07:14 10:30:00", "/s/2010/a.jpg", "2010/a.jpg", 1.0, ("2015-07-14T10:30:00", "exif", "high")),
        (None, "/s/2010/IMG_20190304_101112.jpg", "2010/x.jpg", 1.0, ("2019-03-04T10:11:12", "filename", "medium")),
        (None, "/s/2010/a.jpg", "2010/a.jpg", 1.0, ("2010-01-01T00:00:00", "folder", "low")),
        (None, "/s/a.jpg", "a.jpg", 1577836800.25, ("2020-01-01T00:00:00.250000", "mtime", "low")),
        (None, "/s/a.jpg", "a.jpg", 0.0, (None, "none", "none")),
        (None, "/s/a.jpg", "a.jpg", 1.0, (None, "none", "none")),
    ],
)
def test_first_place_with_a_date_wins(spark, exif, path, rel, mtime, want):
    row = one(spark, dates.resolve(CFG), exif_date=exif, source_path=path, rel_path=rel, mtime=mtime)
    assert tuple(row) == want


@pytest.mark.parametrize("stem, want", [("My Photo (1)!", "My-Photo-1"), ("a" * 100, "a" * 40), ("???", "img"), ("", "img")])
def test_slugs(spark, stem, want):
    assert one(spark, text.slugify(F.col("x")), x=stem) == want


@pytest.mark.parametrize(
    "taken, source, want",
    [
        ("2015-07-14T10:30:00", "exif", "/lib/2015/07/20150714_103000_My-Photo_deadbeef.jpg"),
        ("2015-07-14T10:30:00", "filename", "/lib/2015/07/20150714_103000_My-Photo_deadbeef.jpg"),
        ("2015-07-14T00:00:00", "exif", "/lib/2015/07/20150714_My-Photo_deadbeef.jpg"),
        ("2015-07-14T10:30:00", "mtime", "/lib/2015/07/20150714_My-Photo_deadbeef.jpg"),
        (None, "none", "/lib/unknown-date/My-Photo_deadbeef.jpg"),
    ],
)
def test_destinations(spark, taken, source, want):
    values = {"content_hash": "deadbeef" * 5, "source_path": "/s/My Photo.JPG", "ext": ".JPG", "date_taken": taken, "date_source": source}
    assert one(spark, text.destination(CFG, "/lib"), **values) == want


@pytest.mark.parametrize("a, b, want", [("ffffffffffffffff", "0", 64), ("0", "1f", 5), ("8000000000000000", "0", 1), ("7", "7", 0)])
def test_hamming_distances_have_all_64_bits(spark, a, b, want):
    assert one(spark, text.hamming(text.hash_bits(F.col("a")), text.hash_bits(F.col("b"))), a=a, b=b) == want


def test_escapes_and_formats(spark):
    assert one(spark, text.escape_html(F.col("x")), x="A&B <'\">") == "A&amp;B &lt;&#x27;&quot;&gt;"
    assert one(spark, text.script_safe(F.col("x")), x="</script>") == "<\\/script>"
    assert one(spark, text.file_uri(F.col("x")), x="/a b/ü*~+.jpg") == "file:///a%20b/%C3%BC%2A~%2B.jpg"
    assert one(spark, text.file_uri(F.col("x")), x="a.jpg") is None
    assert one(spark, text.kilobytes(F.col("x")), x=2560) == 2
    assert one(spark, text.kilobytes(F.col("x")), x=2000000) == 1953
    assert one(spark, text.csv_field(F.col("x")), x='b, "c"') == '"b, ""c"""'
    assert one(spark, text.size_label(F.col("x")), x=2_000_000) == "1.9 MB"
    assert one(spark, text.stem(F.col("x")), x="/a.b/c.d.jpg") == "c.d"
    assert one(spark, text.suffix(F.col("x")), x="/a.b/c.D.JPG") == ".jpg"


def test_labels_round_by_exact_value(spark):
    """Halves go to the even digit, as in C and in the SQL; 0.15 and 0.35 lie below it, 0.45 above it."""
    of = ((500, 500, "0.2 MP"), (1500, 500, "0.8 MP"), (1500, 100, "0.1 MP"), (3500, 100, "0.3 MP"), (4500, 100, "0.5 MP"), (1990, 1000, "2.0 MP"), (0, 9, "? MP"))
    for width, height, want in of:
        assert one(spark, text.megapixel_label(F.col("w"), F.col("h")), w=width, h=height) == want == (want if want[0] == "?" else "%.1f MP" % (width * height / 1e6))
    assert one(spark, text.size_label(F.col("x")), x=1048576 * 5 // 4) == "1.2 MB"
    assert one(spark, text.size_label(F.col("x")), x=1048576 * 5 // 4 + 1) == "1.3 MB"


def test_kinds(spark):
    for ext, want in ((".jpg", "image"), (".dng", "raw"), (".mp4", "video"), (".xmp", "sidecar"), (".txt", "other"), ("", "other")):
        assert one(spark, text.classify(F.col("x"), CFG), x=ext) == want


def test_configuration(tmp_path):
    assert load_config(tmp_path) == Config()
    (tmp_path / "reelhouse.toml").write_text('min_year = 1950\nraw_ext = [".raw"]\n')
    assert load_config(tmp_path).min_year == 1950
    assert load_config(tmp_path).raw_ext == frozenset({".raw"})
    (tmp_path / "reelhouse.toml").write_text("nonsense = 1\n")
    with pytest.raises(ConfigError, match="nonsense"):
        load_config(tmp_path)
