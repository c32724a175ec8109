"""Waveform maths on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.runtime import let

# Fixed values.
FLOOR, RELATIVE_FLOOR, PAD_SECONDS = 1e-4, 1e-3, 0.05
LEAST_RMS, MOST_GAIN, LEAST_PEAK, NEW_PEAK = 0.05, 30.0, 0.5, 0.95


def mono(channels: Column) -> Column:
    """Mean over an array of channels of equal length."""
    total = F.aggregate(F.slice(channels, 2, F.size(channels)), F.get(channels, 0), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(channels))


def finite(wave: Column) -> Column:
    return F.transform(wave, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def peak(wave: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(wave, lambda x: F.abs(x))), F.lit(0.0))


def mean_abs(wave: Column) -> Column:
    return F.aggregate(wave, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size(wave), F.lit(0))


def rms(wave: Column) -> Column:
    return F.sqrt(F.aggregate(wave, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(wave), F.lit(0)))


def silent(wave: Column) -> Column:
    """Null, empty, holding NaN or infinity, or of mean size below FLOOR."""
    odd = F.exists(wave, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(odd | (mean_abs(wave) < FLOOR), F.lit(True))


def trim(wave: Column, rate: int) -> Column:
    """Cut to the first and last sample above the floor, padded; unchanged where none is."""
    pad, eps = int(PAD_SECONDS * rate), F.greatest(F.lit(FLOOR), RELATIVE_FLOOR * peak(wave))

    def cut(e: Column) -> Column:
        loud = F.filter(F.transform(wave, lambda x, i: F.when(F.abs(x) > e, i)), lambda i: i.isNotNull())
        first, last = F.greatest(F.array_min(loud) - pad, F.lit(0)), F.least(F.array_max(loud) + pad, F.size(wave) - 1)
        return F.when(F.size(loud) > 0, F.slice(wave, first + 1, last - first + 1)).otherwise(wave)

    return let(eps, cut)


def _scaled(wave: Column, by: Column) -> Column:
    return let(by, lambda g: F.transform(wave, lambda x: x * g))


def lift(wave: Column) -> Column:
    r = rms(wave)
    return _scaled(wave, F.when((r > 0) & (r < LEAST_RMS), F.least(LEAST_RMS / r, F.lit(MOST_GAIN))).otherwise(F.lit(1.0)))


def raise_peak(wave: Column) -> Column:
    p = peak(wave)
    return _scaled(wave, F.when((p > 0) & (p < LEAST_PEAK), F.lit(NEW_PEAK) / p).otherwise(F.lit(1.0)))


def prepare(wave: Column, rate: int) -> Column:
    """Repair, trim, gain, peak, clip, in this order."""
    steps = [lambda w: trim(w, rate), lift, raise_peak, lambda w: F.transform(w, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))]
    out = finite(wave)
    for step in steps:
        out = let(out, step)
    return out


def padded(wave: Column, size: Column) -> Column:
    return F.concat(wave, F.array_repeat(F.lit(0.0), (size - F.size(wave)).cast("int")))


def layer_mean(*layers: Column) -> Column:
    """Element-wise mean of arrays of equal length, as features of several hidden layers are mixed."""
    return mono(F.array(*layers))
