"""Parameter grids: hypotheses, their registration hash, expansion to cells, and validity."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ABBREVIATED = 48


@functools.singledispatch
def canonical(value):
    """One form per meaning: whole floats are ints, keys are sorted, NaN and infinities have names, tuples are lists."""
    if hasattr(value, "item"):  # a number of an array library
        return canonical(value.item())
    raise TypeError(f"no canonical form of {type(value).__name__}")


@canonical.register(type(None))
@canonical.register(int)
@canonical.register(str)
def _(value):
    return value


@canonical.register(float)
def _(value):
    # Names that json lacks.
    named = {math.inf: "__inf__", -math.inf: "__-inf__"}.get(value) or ("__nan__" if value != value else None)
    return named or (int(value) if value == int(value) else float(value))


@canonical.register(Mapping)
def _(value):
    return dict(sorted((str(k), canonical(v)) for k, v in value.items()))


@canonical.register(Sequence)
def _(value):
    if isinstance(value, (bytes, bytearray)):
        raise TypeError("no canonical form of bytes")
    return list(map(canonical, value))


def canonical_hash(value, digits: int = 16) -> str:
    return hashlib.sha256(json.dumps(canonical(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]


def is_ordinal(levels: Sequence) -> bool:
    """More than two numeric levels that are no booleans; a level of None makes an axis categorical by leaving too few."""
    return sum(isinstance(v, (int, float)) and not isinstance(v, bool) for v in levels) > 2


@dataclass(frozen=True)
class Hypothesis:
    id: str
    family: str
    claim: str
    kill_condition: str
    universe: tuple[str, ...]
    grid: Mapping[str, Sequence]
    fixed: Mapping[str, object] = field(default_factory=dict)
    track: str = "A"
    registered_hash: str | None = None

    def payload(self) -> dict:
        p = {"id": self.id, "family": self.family, "claim": self.claim, "kill_condition": self.kill_condition, "universe": sorted(self.universe), "grid": dict(self.grid), "fixed": dict(self.fixed)}
        return p if self.track == "A" else p | {"track": self.track}

    def registration(self) -> str:
        return canonical_hash(self.payload(), 64)

    def validate(self, ceiling: int = 2000) -> None:
        """Refuse changed registrations, axes that are also fixed, empty and oversized grids, and grids without a shape."""
        if self.registered_hash is not None and self.registered_hash != self.registration():
            raise ValueError(f"{self.id}: the registration does not match its hash")
        both = set(self.grid) & set(self.fixed)
        if both:
            raise ValueError(f"{self.id}: both axis and fixed: {', '.join(sorted(both))}")
        if not self.universe or any(len(v) == 0 for v in self.grid.values()):
            raise ValueError(f"{self.id}: an empty axis")
        if self.cells() * len(set(self.universe)) > ceiling:
            raise ValueError(f"{self.id}: {self.cells() * len(set(self.universe))} cells are over the ceiling of {ceiling}")
        if not any(is_ordinal(v) for v in self.grid.values()):
            raise ValueError(f"{self.id}: no ordinal axis, so no shape can be measured")

    def cells(self) -> int:
        return math.prod(len(v) for v in self.grid.values())

    def expand(self) -> list[dict]:
        """Symbols in order, then the axes in order of their names, the last one fastest."""
        self.validate()
        names = sorted(self.grid)
        return [{**self.fixed, **dict(zip(names, combo)), "symbol": s} for s in sorted(set(self.universe)) for combo in itertools.product(*(self.grid[n] for n in names))]

    def cell_frame(self, spark: SparkSession) -> DataFrame:
        """(cell, symbol, <axis>_ord, config): one row per cell; its size is the ceiling at most."""
        names = sorted(self.grid)
        per, rows = self.cells(), []
        for i, cfg in enumerate(self.expand()):
            rest, at = i % per, []
            for n in reversed(names):
                rest, o = divmod(rest, len(self.grid[n]))
                at.append(o)
            rows.append((i, cfg["symbol"], *reversed(at), json.dumps(canonical(cfg))))
        return spark.createDataFrame(rows, "cell int, symbol string, " + ", ".join(f"{n}_ord int" for n in names) + ", config string")


def expand_relational(universe: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """universe (symbol) with one row per symbol and combination of axis levels, unfolded in place, without a join."""
    out = universe
    for name in sorted(axes):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in axes[name]])))
    return out


def uses_closed_form(gate: Column, leverage: Column, take_profit: Column, stop_loss: Column, funding: Column) -> Column:
    """The closed form is exact without gate, leverage, exits and funding; everything else is simulated."""
    return (F.coalesce(gate, F.lit("none")) == "none") & (leverage == 1.0) & take_profit.isNull() & stop_loss.isNull() & ~F.coalesce(funding, F.lit(True))


def skip_reasons(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n): reasons up to their bracket, at most 48 characters, counted."""
    short = F.substring(F.substring_index(F.col(reason), "(", 1), 1, ABBREVIATED)
    return df.where(F.col(reason).isNotNull()).groupBy(short.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
