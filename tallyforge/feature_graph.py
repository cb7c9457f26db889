"""A graph of features: what each needs, in which window it looks, and what stands for a value that is missing.

Features name the columns or other features that they need. They are built in levels, those that need others after these, and inside a level in
order of their windows, so that all features of one (keys, order) share one shuffle and one sort. A builder that fails, by an error of
its own, by a column that isn't there or by one that it didn't name, gives a column of nulls and is reported; no other feature is touched but
those that need it, which see nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small

STRATEGIES = ("nan", "zero", "positional_mean", "shrink_to_prior", "indicator")


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[], Column]
    needs: tuple[str, ...]
    group: str
    missing: str
    prior: float | None
    keys: tuple[str, ...]
    order: tuple[str, ...]
    version: int
    description: str


class Graph:
    """Features by name. ``positions`` are the columns whose groups a positional mean is taken over."""

    def __init__(self, positions: Iterable[str] = ()):
        self.features: dict[str, Feature] = {}
        self.positions = tuple(positions)

    def feature(self, name: str, needs: Iterable[str], group: str, missing: str = "nan", prior: float | None = None, over: tuple[Iterable[str], Iterable[str]] = ((), ()), version: int = 1, description: str = ""):
        """Register a builder, a function without arguments that gives a Column."""
        if missing not in STRATEGIES:
            raise ValueError(f"{name}: no strategy {missing}")
        if (missing == "shrink_to_prior") != (prior is not None):
            raise ValueError(f"{name}: a prior goes with shrink_to_prior")

        def register(build: Callable[[], Column]) -> Callable[[], Column]:
            self.features[name] = Feature(name, build, tuple(needs), group, missing, prior, tuple(over[0]), tuple(over[1]), version, description or (build.__doc__ or "").strip().split("\n")[0])
            return build

        return register

    def wanted(self, names: Iterable[str] | None = None) -> list[str]:
        """``names`` and all features that these need, in order of their names."""
        out, open_ = set(), list(self.features if names is None else names)
        while open_:
            name = open_.pop()
            if name in self.features and name not in out:
                out.add(name)
                open_ += self.features[name].needs
        return sorted(out)

    def levels(self, names: Iterable[str] | None = None) -> list[list[Feature]]:
        """Features in the order to build them; an error if some need each other."""
        left, out = {n: self.features[n] for n in self.wanted(names)}, []
        while left:
            ready = [f for f in left.values() if not any(d in left for d in f.needs)]
            if not ready:
                raise ValueError(f"features need each other: {', '.join(sorted(left))}")
            out.append(sorted(ready, key=lambda f: (f.keys, f.order, f.name)))
            for f in ready:
                del left[f.name]
        return out

    def by_group(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for name in sorted(self.features):
            f = self.features[name]
            out.setdefault(f.group, []).append({"name": name, "version": f.version, "missing": f.missing, "needs": list(f.needs), "description": f.description})
        return out

    def build_wide(self, df: DataFrame, names: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        """``df`` with a column for each feature (and <name>_missing for indicators), and the failures by name."""
        failed: dict[str, str] = {}
        for level in self.levels(names):
            columns = {}
            for f in level:
                try:
                    seen = {*f.needs, *f.keys, *f.order}
                    column = f.build().cast("double")
                    df.select(*seen).select(column)  # it may only read what it names
                except (PySparkException, Exception) as e:  # noqa: BLE001
                    failed[f.name] = str(e).split("\n")[0]
                    column = F.lit(None).cast("double")
                columns[f.name] = column
            df = self._filled(df.withColumns(columns), level)
        return df, failed

    def _filled(self, df: DataFrame, level: list[Feature]) -> DataFrame:
        fill, means = {}, []
        for f in level:
            c = F.col(f.name)
            if f.missing == "zero":
                fill[f.name] = F.coalesce(c, F.lit(0.0))
            elif f.missing == "shrink_to_prior":
                fill[f.name] = F.coalesce(c, F.lit(f.prior))
            elif f.missing == "indicator":
                fill[f"{f.name}_missing"] = c.isNull().cast("double")
            elif f.missing == "positional_mean":
                means.append(f.name)
        if means:
            of = df.groupBy(*self.positions).agg(*(F.avg(n).alias(f"__{n}") for n in means)).select(*(F.col(p).alias(f"__at_{p}") for p in self.positions), *(f"__{n}" for n in means))
            on = [F.col(p).eqNullSafe(F.col(f"__at_{p}")) for p in self.positions]
            df = df.join(broadcast_if_small(of), on, "left").drop(*(f"__at_{p}" for p in self.positions))
            fill |= {n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in means}
        return df.withColumns(fill).drop(*(f"__{n}" for n in means)) if fill else df

    def build_tall(self, df: DataFrame, keys: list[str], names: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        """(keys, name, version, value) of each feature that has a value, and the failures by name."""
        wanted = self.wanted(names)
        wide, failed = self.build_wide(df, wanted)
        columns = [c for n in wanted for c in ([n, f"{n}_missing"] if self.features[n].missing == "indicator" else [n])]
        tall = wide.select(*keys, *columns).unpivot(keys, columns, "name", "value").filter("value is not null")
        versions = F.create_map(*(x for n in wanted for c in (n, f"{n}_missing") for x in (F.lit(c), F.lit(self.features[n].version))))
        return tall.select(*keys, "name", F.element_at(versions, F.col("name")).alias("version"), "value"), failed
