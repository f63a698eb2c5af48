"""Frames of batches and episodes for viewing: normalised in Spark, encoded on the driver."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.tensors import PAD, chw_to_hwc, gray_to_rgb, layout_of, mosaic_size, to_uint8
from episodica.operators.episodes import episode_ordinals
from episodica.operators.quantiles import exact_percentiles


def channel_ranges(values: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``channel, lo, hi``: exact percentiles of every channel of ``values`` (``channel, value``)."""
    return exact_percentiles(values, ["channel"], F.col("value"), {"lo": low, "hi": high})


def normalised(values: DataFrame) -> DataFrame:
    """``values`` with ``code``, each channel's robust range stretched over 0 to 255.

    Ranges are one row per channel, so they are joined by broadcast when Spark finds them small.
    """
    ranged = values.join(channel_ranges(values), "channel")
    return ranged.withColumn("code", to_uint8(F.col("value").cast("double"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def nth_episode(steps: DataFrame, ordinal: int) -> DataFrame:
    """Steps of the episode at a place in order of ids, from the end when negative."""
    places = episode_ordinals(steps)
    count = places.count()
    if not -count <= ordinal < count:
        raise IndexError(f"episode {ordinal} of {count}")
    return steps.join(F.broadcast(places.where(F.col("ordinal") == ordinal % count)), "episode_id", "left_semi")


def colour_frames(clips: DataFrame, key: str, shape: tuple[int, int, int]) -> DataFrame:
    """``clip, t, rgb``: frames of flat tensors, each channel's robust range stretched, red, green and blue by pixel.

    The layout follows from the shape: channels last or first, one of them (gray) or three. Ranges
    are a row per channel; frames stay whole rows.
    """
    layout = layout_of(shape)
    if layout is None:
        raise ValueError(f"no axis of {shape} has 1 or 3 channels")
    height, width, channels = shape if layout == "HWC" else (*shape[1:], shape[0])
    flat = F.col(key) if layout == "HWC" else chw_to_hwc(F.col(key), channels, height, width)
    frames = clips.select("clip", "t", flat.alias("v")).where(F.size("v") == height * width * channels)
    long = frames.select(F.posexplode("v").alias("k", "value")).select((F.col("k") % channels).alias("channel"), "value")
    found = {r.channel: (r.lo, r.hi) for r in channel_ranges(long).collect()}  # at most three rows
    low, high = (F.array(*[F.lit(float(found.get(c, (0, 1))[n])) for c in range(channels)]) for n in (0, 1))
    at = lambda bounds, k: F.get(bounds, (k % channels).cast("int"))
    codes = F.transform("v", lambda x, k: to_uint8(x.cast("double"), at(low, k), at(high, k)))
    return frames.select("clip", "t", (gray_to_rgb(codes) if channels == 1 else codes).alias("rgb"))


def _images(clips: DataFrame, key: str, shape: tuple[int, int, int]) -> dict[int, dict[int, np.ndarray]]:
    height, width = shape[:2] if layout_of(shape) == "HWC" else shape[1:]
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in colour_frames(clips, key, shape).orderBy("clip", "t").toLocalIterator():
        found.setdefault(row.clip, {})[row.t] = np.array(row.rgb, np.uint8).reshape(height, width, 3)
    if not found:
        raise ValueError(f"no frames of shape {shape} in {key}")
    return found


def batch_gif(clips: DataFrame, key: str, shape: tuple[int, int, int], fps: float = 4.0) -> bytes:
    """All clips of a batch ``(clip, t, key)`` side by side in a nearly square mosaic."""
    images = list(_images(clips, key, shape).values())
    height, width = next(iter(images[0].values())).shape[:2]
    full_height, full_width = mosaic_size(len(images), height, width)
    columns = (full_width + PAD) // (width + PAD)
    frames = []
    for t in sorted(images[0]):
        canvas = np.zeros((full_height, full_width, 3), np.uint8)
        for n, clip in enumerate(images):
            y, x = n // columns * (height + PAD), n % columns * (width + PAD)
            canvas[y : y + height, x : x + width] = clip.get(t, 0)
        frames.append(canvas)
    return gif(frames, fps)


def item_gif(clips: DataFrame, clip: int, key: str, shape: tuple[int, int, int], fps: float = 4.0) -> bytes:
    """One clip of a batch; an ``IndexError`` where there is none of that number."""
    own = clips.where(F.col("clip") == clip)
    if own.isEmpty():
        raise IndexError(f"no clip {clip}")
    return batch_gif(own, key, shape, fps)


def episode_gif(steps: DataFrame, keys: dict[str, tuple[int, int, int]], ordinal: int = 0, fps: float = 4.0) -> bytes:
    """A whole episode: its image leaves, of the given shapes, side by side, padded to the highest."""
    if not keys:
        raise ValueError("no image leaves are given")
    own = nth_episode(steps, ordinal).withColumn("clip", F.lit(0)).withColumnRenamed("step", "t")
    strips = [_images(own, key, shape)[0] for key, shape in keys.items()]
    sizes = [next(iter(s.values())).shape[:2] for s in strips]
    top, full_width = max(h for h, _ in sizes), sum(w for _, w in sizes)
    frames = []
    for t in sorted(strips[0]):
        canvas, x = np.zeros((top, full_width, 3), np.uint8), 0
        for (height, width), images in zip(sizes, strips, strict=True):
            canvas[:height, x : x + width] = images.get(t, 0)
            x += width
        frames.append(canvas)
    return gif(frames, fps)


#: Levels of red, green and blue in the palette of GIFs.
LEVELS = (6, 7, 6)


def palette_codes(image: np.ndarray) -> np.ndarray:
    """The nearest level of every channel, as a number of the palette."""
    red, green, blue = ((image[..., c].astype(int) * (n - 1) + 127) // 255 for c, n in enumerate(LEVELS))
    return ((red * LEVELS[1] + green) * LEVELS[2] + blue).astype(np.uint8)


def gif(images: Iterable[np.ndarray], fps: float = 4.0) -> bytes:
    """Colour frames of one size as an animated GIF without compression of its own."""
    images = list(images)
    height, width = images[0].shape[:2]
    colours = [[k * 255 // (n - 1) for k in range(n)] for n in LEVELS]
    palette = b"".join(bytes(c) for c in product(*colours)).ljust(768, b"\0")
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    delay = max(1, round(100 / fps))
    for frame in (palette_codes(image).tobytes() for image in images):
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\x00\x00\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08")
        bits = count = 0
        data = bytearray()
        for k, code in enumerate(frame):  # nine-bit codes; a clear code keeps the table from growing
            for value in ([256, code] if k % 254 == 0 else [code]):
                bits |= value << count
                count += 9
                while count >= 8:
                    data.append(bits & 255)
                    bits >>= 8
                    count -= 8
        bits |= 257 << count
        count += 9
        while count > 0:
            data.append(bits & 255)
            bits >>= 8
            count -= 8
        out += [bytes([len(block)]) + block for block in (bytes(data[i : i + 255]) for i in range(0, len(data), 255))]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"
