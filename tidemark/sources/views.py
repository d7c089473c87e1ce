"""Named views of a snapshot with guarded, column-pruned access."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Views:
    """DataFrames by name; reads name their columns so scans stay narrow."""

    frames: dict[str, DataFrame]
    decision: str | None = None

    @classmethod
    def open(cls, frames: dict[str, DataFrame], manifest: dict) -> Views:
        """Views of a decision snapshot; any other kind is refused."""
        if manifest.get("kind") != "decision":
            raise ValueError(f"expected a decision view, got {manifest.get('kind')!r}")
        return cls(frames, str(manifest["decision_time"]))

    def names(self) -> list[str]:
        return sorted(self.frames)

    def columns(self, name: str) -> list[str]:
        return self.frames[name].columns

    def load(self, name: str, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, day: str = "trade_date") -> DataFrame:
        """Chosen columns of a date range; a date past the decision fails the read."""
        df = self.frames[name]
        if start:
            df = df.where(F.col(day) >= start)
        if end:
            df = df.where(F.col(day) <= end)
        if self.decision:
            late = F.col(day).cast("timestamp_ntz") > F.lit(self.decision).cast("timestamp_ntz")
            refused = F.raise_error(F.lit(f"{name} holds dates after the decision")).cast("boolean")
            df = df.where(F.when(late, refused).otherwise(True))
        return df.select(*columns) if columns else df
