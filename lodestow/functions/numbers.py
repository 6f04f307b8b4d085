"""Column functions on sizes, offsets, frame addresses and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frames in a second, bytes in a KB.
FRAMES, KB = 75, 1024


def div(a: Column, b: int) -> Column:
    """Integer quotient of non-negative numbers."""
    return F.floor(a / F.lit(b)).cast("bigint")


def align_up(c: Column, step: int) -> Column:
    return div(c + (step - 1), step) * step


def frames_of(minutes: Column, seconds: Column, frames: Column) -> Column:
    return (minutes.cast("bigint") * 60 + seconds) * FRAMES + frames


def msf_frames(text: Column) -> Column:
    """Frames of mm:ss:ff; null if the text is none."""
    part = [F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d+):(\d{1,2}):(\d{1,2})$", i), F.lit("")), F.lit("999999999")).cast("bigint") for i in (1, 2, 3)]
    return frames_of(*part)


def _two(c: Column) -> Column:
    """At least two digits."""
    return F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))


def msf_text(frames: Column) -> Column:
    """mm:ss:ff; hours and more stay minutes, of as many digits as they take."""
    return F.concat_ws(":", *map(_two, (div(frames, 60 * FRAMES), div(frames, FRAMES) % 60, frames % FRAMES)))


def msf_add(a: Column, b: Column) -> Column:
    """The sum of two mm:ss:ff."""
    return msf_text(msf_frames(a) + msf_frames(b))


def msf_subtract(a: Column, b: Column) -> Column:
    """The difference of two mm:ss:ff, 00:00:00 at least."""
    return msf_text(F.greatest(msf_frames(a) - msf_frames(b), F.lit(0).cast("bigint")))


def to_bcd(c: Column) -> Column:
    return div(c, 10) * 16 + c % 10


def from_bcd(c: Column) -> Column:
    return div(c, 16) * 10 + c % 16


def index_shift(size: Column, most: int = 31) -> Column:
    """The least shift after which an offset of ``size`` is under 2 ** ``most``."""
    return F.greatest(F.lit(0), F.length(F.bin(size)) - most)


def size_text(c: Column) -> Column:
    """A size in B, KB, MB or GB, with one digit after the point (halves away from zero)."""
    def scaled(power: int, unit: str) -> Column:
        tenths = F.floor(c * 10 / KB**power + 0.5).cast("bigint")
        return F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + unit))

    return F.when(c >= KB**3, scaled(3, "GB")).when(c >= KB**2, scaled(2, "MB")).when(c >= KB, scaled(1, "KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def size_bytes(text: Column) -> Column:
    """Bytes of a text such as 1.5 MB; null if it holds none."""
    number = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*(KB|MB|GB)", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*(KB|MB|GB)", 2))
    scale = F.when(unit == "KB", KB).when(unit == "MB", KB**2).when(unit == "GB", KB**3).cast("double")
    return F.floor(F.nullif(number, F.lit("")).cast("double") * scale).cast("bigint")


def flags(mask: Column, names: list[str]) -> Column:
    """The names of the bits that are set, in order."""
    every = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])
    return F.filter(every, lambda x: x.isNotNull())


def all_zero(data: Column) -> Column:
    """Whether no byte differs from zero (true of none)."""
    return F.regexp_replace(F.hex(data), "^(?:00)*", "") == ""


def any_nonzero(data: Column, at: int, size: int) -> Column:
    """Whether a slice has a byte other than zero."""
    return ~all_zero(F.substring(data, at + 1, size))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned integer of up to seven bytes in a binary column, ``at`` counted from 0; null beyond the end."""
    start = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, start + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.concat(*[F.hex(F.substring(part, i + 1, 1)) for i in reversed(range(size))]), 16, 10).cast("bigint"))


def le_bytes(c: Column, size: int) -> Column:
    """A non-negative integer as ``size`` bytes, the lowest first."""
    digits = F.lpad(F.hex(c.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def be_bytes(c: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * size, "0"))


def big_endian(data: Column, at: Column | int, size: int) -> Column:
    start = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, start + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))
