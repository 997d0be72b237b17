"""Column functions on a spectrum's peaks, an array of (mz, intensity) by ascending m/z."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTON = 1.007825
ISOTOPE = 1.003355
PEAKS = "array<struct<mz:double,intensity:double>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mz_range(peaks, low: float | None, high: float | None) -> Column:
    """Peaks with low <= m/z <= high; None leaves an end open."""
    def inside(p: Column) -> Column:
        ok = F.lit(True)
        ok = ok if low is None else ok & (p["mz"] >= float(low))
        return ok if high is None else ok & (p["mz"] <= float(high))

    return F.filter(_col(peaks), inside)


def is_valid(peaks, min_peaks: int, min_range: float) -> Column:
    """At least so many peaks over at least such a range of m/z."""
    p = _col(peaks)
    return (F.size(p) >= min_peaks) & (F.size(p) > 0) & (F.get(p["mz"], F.size(p) - 1) - F.get(p["mz"], F.lit(0)) >= float(min_range))


def precursor_targets(precursor_mz, charge, isotope: int = 0) -> Column:
    """The m/z of the precursor at its charge and all lower ones, for the isotopes 0 to ``isotope``."""
    m, z = _col(precursor_mz).cast("double"), _col(charge).cast("int")
    charges = F.when(z >= 1, F.sequence(F.lit(1), z)).otherwise(F.array().cast("array<int>"))
    of = lambda i: F.transform(charges, lambda c: ((m - PROTON) * z + i * ISOTOPE) / c + PROTON)
    return F.flatten(F.array(*(of(i) for i in range(isotope + 1))))


def remove_precursor(peaks, precursor_mz, charge, tolerance: float, unit: str = "Da", isotope: int = 0) -> Column:
    """Peaks farther than the tolerance from the precursor at every charge."""
    def near(p: Column, t: Column) -> Column:
        return F.abs(mass_diff(p["mz"], t, unit)) <= float(tolerance)

    return let(precursor_targets(precursor_mz, charge, isotope), lambda ts: F.filter(_col(peaks), lambda p: ~F.exists(ts, lambda t: near(p, t))))


def mass_diff(a, b, unit: str) -> Column:
    """a - b in Da, or in parts per million of b."""
    d = _col(a) - _col(b)
    return d if unit == "Da" else d / _col(b) * 1e6


def most_intense(peaks, k: int, min_share: float = 0.0) -> Column:
    """The k most intense peaks (of equal ones those of lower m/z) above a share of the highest, by m/z."""
    keyed = F.transform(_col(peaks), lambda p: F.struct((-p["intensity"]).alias("i"), p["mz"].alias("mz")))
    top = F.slice(F.array_sort(keyed), 1, k)
    kept = let(top, lambda t: F.filter(t, lambda x: -x["i"] > -F.get(t["i"], F.lit(0)) * float(min_share)))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["mz"].alias("mz"), (-x["i"]).alias("intensity"))))


def scale(peaks, scaling: str, max_rank: int | None = None, degree: int = 2, base: int = 2, max_intensity: float | None = None) -> Column:
    """Intensities by their root, logarithm or rank (``max_rank`` for the most intense, down by one); 'off' leaves them.
    Then, with ``max_intensity``, so that the highest is that."""
    p = _col(peaks)
    if max_intensity is not None:
        def to_top(q: Column) -> Column:
            top = F.array_max(q["intensity"])
            return F.transform(q, lambda x: F.struct(x["mz"].alias("mz"), F.try_divide(x["intensity"] * float(max_intensity), top).alias("intensity")))

        return let(scale(p, scaling, max_rank, degree, base), to_top)
    if scaling == "off":
        return p
    of = {"root": lambda i: F.pow(i, F.lit(1.0 / degree)), "log": lambda i: F.log1p(i) / math.log(base)}
    if scaling in of:
        return F.transform(p, lambda x: F.struct(x["mz"].alias("mz"), of[scaling](x["intensity"]).alias("intensity")))
    if scaling != "rank":
        raise ValueError(f"no scaling {scaling!r}")

    def rank(p: Column) -> Column:
        most = F.size(p) if max_rank is None else F.when(F.size(p) <= max_rank, F.lit(max_rank)).otherwise(F.raise_error(F.lit("max_rank is less than the number of peaks")).cast("int"))
        order = F.array_sort(F.transform(p, lambda x: F.struct((-x["intensity"]).alias("i"), x["mz"].alias("mz"))))
        ranked = F.transform(order, lambda x, i: F.struct(x["mz"].alias("mz"), (most - i).cast("double").alias("intensity")))
        return F.array_sort(ranked)

    return let(p, rank)


def unit_norm(peaks) -> Column:
    """Intensities over their Euclidean norm; all zero stays zero."""
    p = _col(peaks)
    norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x["intensity"] * x["intensity"]))
    return let(norm, lambda n: F.transform(p, lambda x: F.struct(x["mz"].alias("mz"), F.when(n > 0, F.try_divide(x["intensity"], n)).otherwise(0.0).alias("intensity"))))


def bucket(precursor_mz, charge, width: int = 1) -> Column:
    """The mass bucket of a precursor: its neutral mass in nominal units, half to even, by ``width``."""
    z = F.greatest(F.abs(_col(charge).cast("int")), F.lit(1))
    return F.floor(F.rint((_col(precursor_mz).cast("double") - 1.00794) * z / 1.0005079) / width).cast("int")


def bin_count(low: float, high: float, width: float) -> int:
    """How many bins of a width cover the range, with ends at multiples of it."""
    start, end = low - low % width, high + width - high % width
    return math.ceil((end - start) / width)


def mz_bin(mz, binning: str = "unit", low: float = 101.0, width: float = 0.05) -> Column:
    """The bin of an m/z: its whole part, or the number of widths from the lowest."""
    m = _col(mz)
    return m.cast("int") if binning == "unit" else F.floor((m - low) / width).cast("int")


def level(intensity, q: int) -> Column:
    """The level of a normalised intensity, 0 to q."""
    return (_col(intensity) * q).cast("int")
