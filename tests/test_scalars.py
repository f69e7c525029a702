"""Scalar expressions: tables of cases."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as S


def one(spark, column, **values):
    """The column's value over one row of the given values."""
    frame = spark.range(1)
    for name, (value, kind) in values.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "cell, seconds",
    [("12", 12), ("12s", 12), ("5%", 36), ("abc", 0), ("", 0), ("0", 0), ("-1", -1), ("5d", 0), ("1e2", 100), (" 7 ", 7), ("+.5s", 0.5), ("x%", 0), ("5f", 0), ("5% ", 0), ("12ss", 0), ("10 %", 72), (None, None)],
)
def test_duration_literal(spark, cell, seconds):
    assert one(spark, S.duration_literal(F.col("c"), F.lit(720.0)), c=(cell, "string")) == seconds


@pytest.mark.parametrize("fps, interval, step", [(25.0, 0.5, 12), (30.0, 0.5, 15), (27.0, 0.5, 14), (30.0, 0.0, 1), (30.0, None, 1), (0.1, 1.0, 1)])
def test_frame_step(spark, fps, interval, step):
    assert one(spark, S.frame_step(F.col("r"), F.col("i")), r=(fps, "double"), i=(interval, "double")) == step


@pytest.mark.parametrize("path, archive, member", [("a/b.ZIP/c/d.png", "a/b.ZIP", "c/d.png"), ("x.zip\\\\y\\z", "x.zip", "y/z"), ("x.zip", "x.zip", ""), ("x.zipper/y", None, None), ("a.zip.zip/b", "a.zip.zip", "b")])
def test_archives(spark, path, archive, member):
    assert one(spark, S.archive_path(F.col("p")), p=(path, "string")) == archive
    assert one(spark, S.archive_member(F.col("p")), p=(path, "string")) == member


@pytest.mark.parametrize("text, rate", [("25", 25), ("30000/1001", 30000 / 1001), ("24/0", 24), ("x", 30), ("-5", -5), ("0", 0), ("a/b", 30), ("1/2/3", 30), (None, 30), (" 12.5 ", 12.5)])
def test_frame_rate(spark, text, rate):
    assert one(spark, S.frame_rate(F.col("t")), t=(text, "string")) == pytest.approx(rate)


@pytest.mark.parametrize("x, y", [(0.5, "0.5"), (2.0, "2"), (1 / 3, "0.333333333333"), (100.0, "100")])
def test_plain_decimal(spark, x, y):
    assert one(spark, S.plain_decimal(F.col("x")), x=(x, "double")) == y


@pytest.mark.parametrize("h, w, box", [(100, 200, (0, 100, 100, 200)), (100, 100, (0, 50, 25, 75)), (101, 103, (0, 50, 25, 77))])
def test_crop(spark, h, w, box):
    assert tuple(one(spark, S.crop(F.col("h"), F.col("w")), h=(h, "int"), w=(w, "int"))) == box


@pytest.mark.parametrize("x, models, size", [(12.0, 1, 8), (14.0, 1, 16), (7.9, 1, 7), (100.0, 2, 80), (100.0, 99, 32)])
def test_batches(spark, x, models, size):
    assert one(spark, S.batch_size(F.col("x"), F.col("m")), x=(x, "double"), m=(models, "int")) == size


@pytest.mark.parametrize("path, known, error", [("", True, "empty path"), (None, True, "empty path"), ("rtsp://x", False, None), ("a.mp4", True, None), ("a.mp4", None, "not found"), ("1x://y", False, "not found")])
def test_path_errors(spark, path, known, error):
    assert one(spark, S.path_error(F.col("p"), F.col("k")), p=(path, "string"), k=(known, "boolean")) == error


def test_other_scalars(spark):
    lit = F.lit
    assert one(spark, S.middle(F.array(*map(lit, "abcd")))) == "c"
    assert one(spark, S.target_rate(lit(0.0))) is None and one(spark, S.target_rate(lit(5000.0))) == 0.001
    assert one(spark, S.duration(lit(None).cast("double"), lit(50), lit(25.0))) == 2.0
    assert one(spark, S.duration(lit(None).cast("double"), lit(None).cast("int"), lit(25.0))) == 0.0
    assert one(spark, S.or_default(lit(""), None, "12")) == "12" and one(spark, S.or_default(lit(""), "9", "12")) == "9"
    assert one(spark, S.three_channels(F.array(lit(1)))) == [1, 1, 1] and one(spark, S.three_channels(F.array(lit(1), lit(2)))) is None
    assert one(spark, S.hardware_decoder(lit("H264"), lit("yuv444p"))) is None and one(spark, S.hardware_decoder(lit("AVC-1 (x)"), lit("nv12"))) == "h264_cuvid"
    assert one(spark, S.hardware_decoder(lit("mpeg2video"), lit(None).cast("string"))) == "mpeg2_cuvid" and one(spark, S.hardware_decoder(lit("gif"), lit("x"))) is None
    assert one(spark, S.active_backend(lit(None).cast("string"), False)) == "cpu" and one(spark, S.active_backend(lit("auto"), True)) == "auto"
    assert one(spark, S.frame_label(lit("gpu"), lit(24), lit(2), lit(12))) == 24 and one(spark, S.frame_label(lit("sequence"), lit(24), lit(2), lit(12))) == 2
    assert one(spark, S.shape_error(lit(3), lit(5), lit(5), 5)) is None and one(spark, S.shape_error(lit(1), lit(5), lit(5), 5))
    assert one(spark, S.normal_source(lit(" a\\b "), lit(True))) == "a/b" and one(spark, S.normal_source(lit(" a\\b "), lit(False))) == "a\\b"
    assert one(spark, S.normalised(F.array(lit(0.485), lit(0.456), lit(0.406)), 0)) == [0, 0, 0]
