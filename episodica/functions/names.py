"""Column functions on names, paths and versions, and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that tell a modality's kind, in order of precedence.
KIND_WORDS = (
    ("image", ("image", "camera", "rgb", "video", "frame", "color", "fisheye", "depth")),
    ("text", ("language", "instruction", "text", "caption", "prompt")),
    ("action", ("action", "policy", "torque", "velocity")),
    ("state", ("observation", "state", "proprio", "joint", "pose", "ee")),
)


def kind_of(path: Column, is_text: Column | None = None, rank: Column | None = None) -> Column:
    """Kind of a modality: by substrings of its lower-cased path, else by its value, else generic."""
    lowered = F.lower(path)
    kind = F.when(F.lit(False), "")
    for name, words in KIND_WORDS:
        kind = kind.when(lowered.rlike("|".join(words)), name)
    if is_text is not None:
        kind = kind.when(is_text, "text")
    if rank is not None:
        kind = kind.when(rank >= 3, "image")
    return kind.otherwise("generic")


def kind_of_name(path: str) -> str:
    """The same for one path on the driver, from its name alone."""
    lowered = path.lower()
    return next((k for k, words in KIND_WORDS if any(w in lowered for w in words)), "generic")


def version_key(version: Column) -> Column:
    """All runs of digits as an array of numbers, ``[0]`` if there are none; compares like a tuple."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0).cast("bigint")))


def strip_slashes(path: Column) -> Column:
    """A path without slashes at its ends."""
    return F.regexp_replace(path, "^/+|/+$", "")


def utf8_or_null(data: Column) -> Column:
    """Bytes as text, null where they are no UTF-8; the bytes stay in their own column then."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def offset_steps(seconds: Column, frequency: Column) -> Column:
    """A time offset in steps, halves rounded to even."""
    return F.bround(seconds * frequency, 0).cast("int")


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``value`` held between two bounds."""
    return F.greatest(low, F.least(high, value))


def seeded_draw(seed: int | str | Column, draw: Column, total: Column) -> Column:
    """A number below ``total`` that depends on the seed and the draw only."""
    named = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(named, F.lit(":"), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % total
