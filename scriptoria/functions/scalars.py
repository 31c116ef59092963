"""Scalar column functions: names, splits, numbers, pixel predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order in which extensions win.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")

# Accepted split names and the name each stands for.
SPLIT_NAMES = {
    "train": "train",
    "training": "train",
    "val": "val",
    "validation": "val",
    "test": "test",
    "public-test": "test",
}

# Per-channel mean and deviation of the usual image normalisation.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last extension with its dot, empty when there is none."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def has_extension(path: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS, ignore_case: bool = True) -> Column:
    pattern = r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
    return (F.lower(path) if ignore_case else path).rlike(pattern)


def extension_priority(path: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """0 for the preferred extension, null for an unknown one."""
    position = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower(extension(path)))
    return F.when(position > 0, (position - 1).cast("int"))


def canonical_split(split: Column) -> Column:
    """train, val or test; null means test; any other name is an error."""
    known = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])
    name = F.coalesce(F.lower(split), F.lit("test"))
    return F.coalesce(
        F.element_at(known, name), F.raise_error(F.concat(F.lit("unsupported split: "), name)).cast("string")
    )


def natural_key(path: Column) -> Column:
    """Sort key that compares digit runs as numbers, of any length.

    An array that begins and ends with a text piece (maybe empty) and alternates with
    numbers; arrays compare piece by piece, so text only ever meets text.  A number is its
    digits after their count.
    """
    texts = F.split(path, "[0-9]+", -1)
    runs = F.transform(F.regexp_extract_all(path, F.lit("[0-9]+"), F.lit(0)), lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    numbers = F.transform(runs, lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    pieces = F.flatten(F.zip_with(texts, numbers, lambda t, n: F.array(t, n)))
    return F.filter(pieces, lambda p: p.isNotNull())


def half_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def fixed(value: Column, digits: int = 6) -> Column:
    """Fixed-decimal text, rounding the exact binary value half to even as printf does."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clamped = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(clamped / (F.lit(1.0) - clamped))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def run_name(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def gray_level(r: Column, g: Column, b: Column) -> Column:
    """Luma rounded to a byte."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000)


def normalise_channel(value: Column, channel: str) -> Column:
    return (value / 255.0 - CHANNEL_MEAN[channel]) / CHANNEL_STD[channel]


def binarise(prob: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    hit = prob >= threshold if inclusive else prob > threshold
    return F.when(hit, 1).otherwise(0)


def mask_text(policy: str, r: Column, g: Column, b: Column) -> Column:
    """Whether a ground-truth pixel is text, by the coding of its data set."""
    if policy == "colour_coded":
        return b == 8
    if policy == "gray_positive":
        return gray_level(r, g, b) > 0
    if policy == "any_channel":
        return (r + g + b) > 0
    if policy == "above_127":
        return gray_level(r, g, b) > 127
    raise ValueError(f"unknown mask policy: {policy}")


def mask_dont_care(policy: str, r: Column) -> Column:
    return r == 128 if policy == "colour_coded" else F.lit(False)


def seeded_order(seed: int, *keys: Column) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
