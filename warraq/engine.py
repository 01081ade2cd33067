"""The engine as one object: rules, options and fonts, over DataFrames of units."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import fonts as font_rules
from .operators import repair, report, rules
from .operators.rules import RepairOptions

FONT_RULES = ("font-coverage", "shaping-broken")


@dataclass(frozen=True)
class Engine:
    """Default rules; ``only`` chooses among them, ``fonts`` (faces of ``sources.fonts``) arms the font rules."""

    options: RepairOptions = field(default_factory=RepairOptions)
    fonts: DataFrame | None = None
    only: tuple[str, ...] | None = None

    def with_options(self, options: RepairOptions) -> Engine:
        return replace(self, options=options)

    def with_fonts(self, faces: DataFrame) -> Engine:
        return replace(self, fonts=faces)

    def from_rules(self, *ids: str) -> Engine:
        unknown = set(ids) - set(rules.REGISTRY)
        if unknown:
            raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
        return replace(self, only=ids)

    @property
    def rules(self) -> tuple[str, ...]:
        return tuple(r for r in rules.REGISTRY if self.only is None or r in self.only)

    def diagnostics(self, units: DataFrame) -> DataFrame:
        plain = [r for r in self.rules if r not in FONT_RULES]
        found = rules.diagnostics(units, self.options, plain)
        armed = [r for r in self.rules if r in FONT_RULES]
        if self.fonts is None or not armed:
            return found
        return found.unionByName(font_rules.diagnostics(units, self.fonts).where(F.col("rule").isin(armed)))

    def audit(self, units: DataFrame, strict: bool = False, unread: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The report by document, and the findings."""
        found = self.diagnostics(units)
        return report.report(units, found, strict, unread, self.fonts is not None), found

    def plan(self, units: DataFrame) -> DataFrame:
        return repair.plan(units, self.options)
