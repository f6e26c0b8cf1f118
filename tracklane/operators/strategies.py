"""Aggregates, scalers and encoders by name; a name that isn't known is a ValueError."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

AGGREGATES: dict[str, Callable[[Column | str], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


def _known(kind: str, name: str, among: dict) -> None:
    if name not in among:
        raise ValueError(f"{kind} {name!r} is none of {', '.join(among)}")


def aggregate(name: str) -> Callable[[Column | str], Column]:
    _known("aggregate", name, AGGREGATES)
    return AGGREGATES[name]


def _standard(df: DataFrame, c: str) -> tuple:
    return df.agg(F.avg(c), F.stddev_pop(c)).first()


def _minmax(df: DataFrame, c: str) -> tuple:
    low, high = df.agg(F.min(c), F.max(c)).first()
    return low, None if low is None else high - low


def _robust(df: DataFrame, c: str) -> tuple:
    a, m, b = quantiles(df, c, [0.25, 0.5, 0.75])[None]
    return m, None if m is None else b - a


SCALERS: dict[str, Callable[[DataFrame, str], tuple]] = {"standard": _standard, "minmax": _minmax, "robust": _robust}


@dataclass(frozen=True)
class Scaler:
    """(x - centre) / width of a column, fitted on some rows and applied to any; a width of zero gives null."""

    centre: float | None
    width: float | None

    @staticmethod
    def fitted(name: str, df: DataFrame, column: str) -> Scaler:
        _known("scaler", name, SCALERS)
        centre, width = SCALERS[name](df, column)
        return Scaler(None if centre is None else float(centre), None if width is None else float(width))

    def scaled(self, column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return F.try_divide(c - F.lit(self.centre).cast("double"), F.lit(self.width).cast("double"))

    def restored(self, column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return c * F.lit(self.width).cast("double") + F.lit(self.centre).cast("double")


@dataclass(frozen=True)
class Encoder:
    """Codes of a column's known values, a short list: their places in order, or columns of 0 and 1."""

    name: str
    values: tuple

    @staticmethod
    def fitted(name: str, df: DataFrame, column: str, most: int = 10_000) -> Encoder:
        """Distinct values in order; over most of them is a ValueError, as they are the query's literals."""
        _known("encoder", name, dict.fromkeys(("ordinal", "onehot")))
        found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"over {most} values of {column}")
        return Encoder(name, tuple(found))

    def encoded(self, column: str, unknown: int = -1) -> dict[str, Column]:
        """Ordinal: one column, unknown values and nulls as unknown. One-hot: a column for each value but the first."""
        if self.name == "ordinal":
            place = F.array_position(F.array(*map(F.lit, self.values)), F.col(column)) - 1 if self.values else F.lit(-1)
            return {column: F.when(place >= 0, place).otherwise(unknown).cast("bigint")}
        return {f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("double") for v in self.values[1:]}
