"""Scalar expressions on paths, frame rates, frames and rule cells, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hard defaults of rule cells: shortest marker (s), largest gap (s), required total (s), tag threshold.
RULE_DEFAULTS = {"min_marker_duration": "12", "max_gap": "6", "required_duration": "20", "tag_threshold": "0.5"}
#: Batch multipliers by number of models; more models use the last.
BATCH_SHARES = [1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]
#: Normalisation presets: mean and standard deviation of the three channels.
PRESETS = {0: ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225]), 1: ([0.48145466, 0.4578275, 0.40821073], [0.26862954, 0.26130258, 0.27577711])}
#: Hardware decoders by the codec names' beginnings, and pixel formats that the hardware cannot decode.
DECODERS = {
    "h264": "h264_cuvid", "avc": "h264_cuvid", "hevc": "hevc_cuvid", "h265": "hevc_cuvid", "mpeg2": "mpeg2_cuvid",
    "mpeg2video": "mpeg2_cuvid", "mpeg4": "mpeg4_cuvid", "vp8": "vp8_cuvid", "vp9": "vp9_cuvid", "av1": "av1_cuvid",
}
UNSUPPORTED_FORMATS = ["yuv444p", "yuv444p10le", "yuv444p12le", "yuvj444p"]
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """The double a string spells, else null; stricter than a cast, which takes type suffixes."""
    text = F.trim(text)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


# paths -------------------------------------------------------------------------------------------------------


def archive_path(path: Column) -> Column:
    """O-2: up to the first ".zip" that a separator or the end follows; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*?\.zip)(?:[/\\]|$)", 1), F.lit(""))


def archive_member(path: Column) -> Column:
    """O-2, O-3: what follows the archive, with forward slashes and none in front; "" if nothing does."""
    return member_name(F.when(archive_path(path).isNotNull(), F.substring(path, F.length(archive_path(path)) + 2, F.length(path))))


def member_name(path: Column) -> Column:
    """O-3: forward slashes, none in front."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def path_error(path: Column, known: Column) -> Column:
    """O-6: why a source cannot be read, or null; a scheme passes unchecked, else ``known`` tells if it exists."""
    trimmed = F.trim(path)
    return (
        F.when(path.isNull() | (trimmed == ""), "empty path")
        .when(trimmed.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.lit(None).cast("string"))
        .when(~F.coalesce(known, F.lit(False)), "not found")
    )


def normal_source(path: Column, known_rewritten: Column) -> Column:
    """O-5: trimmed, with forward slashes only where the path so rewritten exists."""
    return F.when(F.coalesce(known_rewritten, F.lit(False)), F.replace(F.trim(path), F.lit("\\"), F.lit("/"))).otherwise(F.trim(path))


# frame rates and frames --------------------------------------------------------------------------------------


def frame_rate(text: Column, default: float = 30.0) -> Column:
    """O-9: a number, or a rational "a/b" (a zero b counts as 1); anything else is the default."""
    parts = F.split(text, "/")
    below = number(parts[1])
    ratio = F.when(F.size(parts) == 2, number(parts[0]) / F.when(below == 0, 1.0).otherwise(below))
    return F.coalesce(number(text), ratio, F.lit(default))


def duration(seconds: Column, frames: Column, rate: Column) -> Column:
    """O-7, O-8: the container's duration, else frames over rate, else 0."""
    return F.coalesce(seconds, F.when(rate > 0, frames / rate), F.lit(0.0))


def frame_step(rate: Column, interval: Column) -> Column:
    """O-22: frames from one sample to the next, half to even; 1 without a positive interval."""
    return F.when(interval > 0, F.greatest(F.lit(1), F.rint(rate * interval).cast("long"))).otherwise(F.lit(1).cast("long"))


def target_rate(interval: Column) -> Column:
    """O-26: samples a second, at least 0.001; null without a positive interval."""
    return F.when(interval > 0, F.greatest(1.0 / interval, F.lit(0.001)))


def frame_time(ordinal: Column, frame: Column, rate: Column, interval: Column) -> Column:
    """O-24: ordinal of the kept frame times the interval; without a positive one, frame over rate."""
    return F.when(interval > 0, ordinal * interval).otherwise(frame / rate)


def frame_label(backend: Column, frame: Column, ordinal: Column, step: Column) -> Column:
    """O-25: what stands for time when timestamps are off, by decoder backend."""
    return F.when(backend == "sequence", ordinal).when(backend == "gpu", ordinal * step).otherwise(frame)


def plain_decimal(x: Column) -> Column:
    """O-27: at most twelve decimals, no trailing zeros or point."""
    return F.regexp_replace(F.format_string("%.12f", x), r"\.?0+$", "")


def decode_backend(width: Column, height: Column) -> Column:
    """O-13: large pictures go to the hardware decoder."""
    return F.when((width >= 3600) | (height >= 1900), "gpu").otherwise("cpu")


def hardware_decoder(codec: Column, pixel_format: Column) -> Column:
    """O-12: the decoder by the beginning of the codec's name, case, blanks, brackets and dashes aside.

    Null for codecs without one and for unsupported pixel formats.
    """
    plain = F.regexp_replace(F.lower(codec), r"[\s()\[\]{}_-]", "")
    known = F.lit(None).cast("string")
    for start, decoder in DECODERS.items():
        known = F.coalesce(known, F.when(plain.startswith(start), decoder))
    return F.when(~F.coalesce(F.lower(pixel_format), F.lit("")).isin(UNSUPPORTED_FORMATS), known)


def active_backend(wanted: Column, has_gpu: bool) -> Column:
    """O-14: the configured backend (automatic by default); without a GPU its CPU kind."""
    wanted = F.coalesce(wanted, F.lit("auto"))
    return wanted if has_gpu else F.when(wanted.isin("auto", "gpu"), "cpu").otherwise(wanted)


def crop(height: Column, width: Column) -> Column:
    """O-28: the half-picture of a stereo frame: the right half of a wide one, else the top middle."""
    wide = width / height > 1.5
    return F.struct(
        F.lit(0).cast("int").alias("top"),
        F.when(wide, height).otherwise(F.floor(height / 2)).cast("int").alias("bottom"),
        F.when(wide, F.floor(width / 2)).otherwise(F.floor(width / 4)).cast("int").alias("left"),
        F.when(wide, width).otherwise(F.floor(3 * width / 4)).cast("int").alias("right"),
    )


def middle(frames: Column) -> Column:
    """O-29: the middle one of an animation's frames."""
    return F.element_at(frames, (F.floor(F.size(frames) / 2) + 1).cast("int"))


def three_channels(channels: Column) -> Column:
    """O-30: one channel three times, the first three of four or more; null for other counts."""
    n = F.size(channels)
    return F.when(n == 1, F.flatten(F.array_repeat(channels, 3))).when(n == 3, channels).when(n >= 4, F.slice(channels, 1, 3))


def scaled(values: Column) -> Column:
    """O-32: bytes to the range 0 to 1."""
    return F.transform(values, lambda v: v / 255.0)


def normalised(values: Column, preset: int) -> Column:
    """O-33: (x - mean) / deviation by channel."""
    mean, deviation = (F.array(*map(F.lit, x)) for x in PRESETS[preset])
    return F.zip_with(F.zip_with(values, mean, lambda v, m: v - m), deviation, lambda v, d: v / d)


def shape_error(channels: Column, height: Column, width: Column, size: int) -> Column:
    """O-34: null for 3 x size x size."""
    good = (channels == 3) & (height == size) & (width == size)
    return F.when(~F.coalesce(good, F.lit(False)), F.concat_ws("x", F.lit("not 3"), F.lit(size), F.lit(size)))


# rules and batches -------------------------------------------------------------------------------------------


def duration_literal(text: Column, media_duration: Column) -> Column:
    """O-37: "12", "12s" or "5%" of the media; one suffix and nothing after it; a malformed one is 0, null stays null."""
    body = number(F.left(text, F.length(text) - 1))
    value = F.when(text.endswith("%"), body / 100 * media_duration).when(text.endswith("s"), body).otherwise(number(text))
    return F.when(text.isNotNull(), F.coalesce(value, F.lit(0.0)))


def or_default(text: Column, configured: str | None, hard: str) -> Column:
    """O-38: an empty or missing cell is the configured default, else the hard one."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(configured), F.lit(hard))


def round8(x: Column) -> Column:
    """O-40: below 8 the whole part; else the multiple of 8 below, or above when over 5 remain."""
    whole = F.floor(x)
    rest = F.pmod(whole, F.lit(8))
    return F.when(x < 8, whole).when(rest <= 5, whole - rest).otherwise(whole + 8 - rest).cast("long")


def batch_size(base: Column, models: Column) -> Column:
    """O-40: the base batch times its share for that many models."""
    shares = F.array(*map(F.lit, BATCH_SHARES))
    return round8(base * F.element_at(shares, F.least(F.greatest(models, F.lit(1)), F.lit(len(BATCH_SHARES))).cast("int")))
