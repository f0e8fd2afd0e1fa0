"""Scalar column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: ColumnLike, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest``/``least`` alone would drop it)."""
    c = col(c)
    out = c
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def floor_zero(c: ColumnLike) -> Column:
    """The positive part."""
    return clip(c, low=0.0)


def ratio(numerator: ColumnLike, denominator: ColumnLike, eps: float = K.EPS) -> Column:
    """``numerator / (denominator + eps)``; NULL where the denominator is zero."""
    return F.try_divide(col(numerator), col(denominator) + F.lit(eps))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def finite_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating-point column."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: finite(n) for n in names}) if names else df


def weighted(parts: Iterable[tuple[float, ColumnLike]]) -> Column:
    """Weighted sum, added left to right."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * col(c) for w, c in parts])


def celsius(kelvin: ColumnLike) -> Column:
    return col(kelvin) - F.lit(K.KELVIN_OFFSET)


def millimetres(metres: ColumnLike) -> Column:
    return col(metres) * F.lit(1000.0)


def evaporation_mm(evabs: ColumnLike = "evabs", factor: float = K.EVAPORATION_MM) -> Column:
    """Monthly evaporation magnitude in millimetres."""
    return F.abs(col(evabs)) * F.lit(float(factor))


def cyclic(c: ColumnLike, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of one turn per ``period``."""
    angle = F.lit(2 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season_flag(month: ColumnLike, name: str) -> Column:
    return col(month).isin(*K.SEASON_MONTHS[name]).cast("int")


def monsoon_phase(month: ColumnLike) -> Column:
    """Phase 0 to 5 of the monsoon year."""
    phases = F.array(*[F.lit(p) for p in K.MONSOON_PHASE])
    return F.try_element_at(phases, col(month).cast("int"))


def monsoon_factor(month: ColumnLike) -> Column:
    """Half sine wave from April to October, zero outside."""
    return F.greatest(F.lit(0.0), F.sin(F.lit(math.pi) * (col(month) - F.lit(4)) / F.lit(6.0)))


def apparent_temperature(temperature: ColumnLike, soil_moisture: ColumnLike) -> Column:
    """Felt temperature, with soil moisture standing in for humidity; not yet limited."""
    t = col(temperature)
    h = clip(col(soil_moisture) * F.lit(100.0), 20.0, 95.0) / F.lit(100.0)

    def term(weight: float, t_power: int, h_power: int) -> Column:
        return reduce(lambda a, b: a * b, [F.lit(weight)] + [t] * t_power + [h] * h_power)

    return reduce(lambda a, b: a + b, [term(*t_) for t_ in K.APPARENT_TEMPERATURE])


def bands(c: ColumnLike, steps: Sequence[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """Label by descending lower bounds; ``strict`` leaves the bound itself below."""
    c = col(c)
    out = F
    for bound, label in steps:
        out = out.when((c > bound) if strict else (c >= bound), F.lit(label))
    return out.otherwise(F.lit(default))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds."""
    out = F
    for condition, label in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(default))


def encode(c: ColumnLike, mapping: Mapping[str, int | float]) -> Column:
    """Literal map lookup; unknown keys give NULL."""
    c = col(c)
    out = F
    for key, value in mapping.items():
        out = out.when(c == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(None))


def decode_class(ordinal: ColumnLike, labels: Sequence[str] = K.RISK_CLASSES) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), col(ordinal).cast("int"))


def one_hot(c: ColumnLike, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per level; an unknown level gives all zeros."""
    c = col(c)
    return {f"{prefix}{level}": F.coalesce((c == F.lit(level)).cast("int"), F.lit(0)) for level in levels}


def one_hot_label(levels: Sequence[str], prefix: str) -> Column:
    """Level of the first flag that is set."""
    out = F
    for level in levels:
        out = out.when(F.col(f"`{prefix}{level}`") == 1, F.lit(level))
    return out.otherwise(F.lit(None))


def parse_date(text: ColumnLike, formats: Sequence[str] = K.DATE_FORMATS) -> Column:
    """First format that parses; NULL when none does."""
    t = F.trim(col(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats])


def equals_ignoring_case(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def contains_ignoring_case(c: ColumnLike, needle: str) -> Column:
    return col(c).ilike(f"%{needle}%")


def match_key(c: ColumnLike) -> Column:
    """Trimmed lower-case form used to compare names."""
    return F.lower(F.trim(col(c)))


def as_int(text: ColumnLike, default: int) -> Column:
    """Whole number from text such as ``'6'`` or ``'6.9'``; the default when it is not a number."""
    number = finite(col(text).try_cast("double"))
    return F.coalesce(number.try_cast("int"), F.lit(default))


def valid_month(text: ColumnLike, default: int = 6) -> Column:
    return clip(as_int(text, default), 1, 12)


def with_defaults(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Fill the named columns, adding the ones that are absent."""
    present = set(df.columns)
    return df.withColumns(
        {
            name: F.coalesce(F.col(name).cast("double"), F.lit(float(value))) if name in present else F.lit(float(value))
            for name, value in defaults.items()
        }
    )


# Names of the parts of a number, for columns that hold their sums.
PARTS = ("whole", "millionths", "rest")


def exact_parts(c: ColumnLike) -> tuple[Column, Column, Column]:
    """Whole part, millionths and what is left in units of 1e-15, as long integers.

    Their sums are exact, so the order of the rows cannot change them, and they
    cost little more than a sum of doubles. What is left counts where it is more
    than the binary error of the number itself; parts below 1e-15 are lost.
    """
    c = col(c)
    millionths = F.rint((c - F.floor(c)) * F.lit(1e6))
    rest = (c - F.floor(c)) - millionths / F.lit(1e6)
    real = F.abs(rest) > F.greatest(F.abs(c), F.lit(1e-6)) * F.lit(1e-15)
    return F.floor(c), millionths.cast("long"), F.when(real, F.rint(rest * F.lit(1e15))).otherwise(F.when(c.isNotNull(), F.lit(0))).cast("long")


def exact_total(whole: ColumnLike, millionths: ColumnLike, rest: ColumnLike) -> Column:
    """The number that summed parts stand for."""
    units = col(whole).cast("decimal(20,0)") * F.lit(1_000_000) + col(millionths)
    return units.cast("double") / F.lit(1e6) + col(rest).cast("double") / F.lit(1e15)


def exact_mean(c: ColumnLike) -> Column:
    """Average that does not depend on the order of the rows."""
    return F.try_divide(exact_total(*map(F.sum, exact_parts(c))), F.count(col(c)).cast("double"))


def round_to(c: ColumnLike, digits: int) -> Column:
    """Round halves away from zero.

    A value that binary arithmetic left below the half, by no more than 1e-9 of the
    last digit kept, counts as the half: 1.005 gives 1.01.
    """
    c, unit = col(c), F.lit(float(10**digits))
    return F.signum(c) * F.floor(F.abs(c) * unit + F.lit(0.500000001)) / unit + F.lit(0.0)


def rounded(c: ColumnLike, digits: int = 2) -> Column:
    return round_to(F.coalesce(col(c), F.lit(0.0)), digits)


def level_change(before: ColumnLike, after: ColumnLike, order: Mapping[str, int] = K.RISK_ORDINAL) -> Column:
    """``'+2 levels'``, ``'-1 level'`` or ``'No change'``."""
    diff = F.coalesce(encode(after, order), F.lit(0)) - F.coalesce(encode(before, order), F.lit(0))
    unit = F.when(F.abs(diff) > 1, F.lit(" levels")).otherwise(F.lit(" level"))
    sign = F.when(diff > 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(diff == 0, F.lit("No change")).otherwise(F.concat(sign, diff.cast("string"), unit))


def signed_text(c: ColumnLike, digits: int = 3) -> Column:
    """A rounded number with its sign and at least one decimal, e.g. ``'+0.05'``."""
    text = F.format_string(f"%+.{digits}f", round_to(c, digits))
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def month_start_text(year: ColumnLike, month: ColumnLike) -> Column:
    return F.format_string("%d-%02d-01", col(year).cast("int"), col(month).cast("int"))


def messages(parts: Sequence[Column]) -> Column:
    """Array of the parts that are not NULL."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def top_names(scores: Sequence[tuple[str, Column]], n: int, fallback: str) -> Column:
    """Names of the n highest positive scores; equal scores keep the given order."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.coalesce(s, F.lit(0.0))).alias("minus"), F.lit(i).alias("pos"), F.lit(name).alias("name"))
                for i, (name, s) in enumerate(scores)
            ]
        )
    )
    names = F.transform(F.filter(F.slice(ranked, 1, n), lambda x: x["minus"] < 0), lambda x: x["name"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(fallback)))
