"""Column functions on flat, row-major tensors and on the geometry of rendered frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 4


def hwc_to_chw(flat: Column, height: int, width: int, channels: int) -> Column:
    """A flat HWC tensor in CHW order."""
    plane = height * width
    source = lambda k: ((k % plane) * channels + F.floor(k / plane)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)), lambda k: F.get(flat, source(k)))


def channels_first(value: Column, shape: tuple[int, ...], depth: int = 0) -> Column:
    """Flat HWC tensors of a shape in CHW order, inside ``depth`` levels of arrays."""
    return hwc_to_chw(value, *shape) if depth == 0 else F.transform(value, lambda x: channels_first(x, shape, depth - 1))


def to_uint8(value: Column, low: Column, high: Column) -> Column:
    """``(value - low) / (high - low)`` held between 0 and 1, times 255, cut to an integer."""
    scaled = (value - low) / F.greatest(high - low, F.lit(1e-6))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) * 255).cast("int")


def layout_5d(shape: Column) -> Column:
    """Layout of a batch of clips by the place of the channel axis; null where there is none."""
    is_channel = lambda k: F.get(shape, F.lit(k)).isin(1, 3)
    return F.when(is_channel(4), "BTHWC").when(is_channel(2), "BTCHW").when(is_channel(1), "BCTHW")


def layout_4d(shape: Column) -> Column:
    """Layout of one clip: channels last, else second; null where there are none."""
    is_channel = lambda k: F.get(shape, F.lit(k)).isin(1, 3)
    return F.when(is_channel(3), "THWC").when(is_channel(1), "TCHW")


def layout_of(shape: tuple[int, ...]) -> str | None:
    """Layout of one frame by the place of the channel axis, last before first; None where there is none."""
    return "HWC" if shape[-1] in (1, 3) else "CHW" if shape[0] in (1, 3) else None


def chw_to_hwc(flat: Column, channels: int, height: int, width: int) -> Column:
    """A flat CHW tensor in HWC order."""
    plane = height * width
    source = lambda k: ((k % channels) * plane + F.floor(k / channels)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)), lambda k: F.get(flat, source(k)))


def gray_to_rgb(flat: Column) -> Column:
    """Every value three times."""
    return F.flatten(F.transform(flat, lambda x: F.array(x, x, x)))


def mosaic_place(index: Column, count: Column, height: Column, width: Column) -> Column:
    """Row, column and top left corner of an image in a nearly square mosaic."""
    columns = F.ceil(F.sqrt(count)).cast("bigint")
    row, column = F.floor(index / columns).cast("bigint"), (index % columns).cast("bigint")
    return F.struct(
        columns.alias("cols"),
        F.ceil(count / columns).cast("bigint").alias("rows"),
        row.alias("r"),
        column.alias("c"),
        (row * (height + PAD)).alias("y0"),
        (column * (width + PAD)).alias("x0"),
    )


def mosaic_size(count: int, height: int, width: int) -> tuple[int, int]:
    """Height and width of a mosaic of ``count`` images."""
    columns = math.ceil(math.sqrt(count))
    rows = math.ceil(count / columns)
    return rows * (height + PAD) - PAD, columns * (width + PAD) - PAD
