"""How complete a sampled set of groups is (Chao1 richness, Good-Turing coverage)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Completeness:
    observed: int
    singletons: int
    doubletons: int
    rows: int
    known: int | None = None

    @property
    def chao1(self) -> float:
        """Estimated number of groups, bias-corrected so that no doubletons do no harm."""
        return self.observed + self.singletons * (self.singletons - 1) / (2 * (self.doubletons + 1))

    @property
    def coverage(self) -> float:
        """Estimated share of the population's rows that lie in observed groups."""
        return 1 - self.singletons / self.rows if self.rows else 0.0

    @property
    def expected(self) -> float:
        return self.known if self.known is not None else self.chao1

    @property
    def missing(self) -> float:
        return max(0.0, self.expected - self.observed)

    @property
    def is_complete(self) -> bool:
        return self.observed >= self.known if self.known is not None else self.rows > 0 and self.singletons == 0


def group_frequencies(rows: DataFrame, keys: list) -> DataFrame:
    """One row: observed, singletons, doubletons, n_rows, chao1, good_turing."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    one, two = (F.coalesce(F.sum((F.col("c") == k).cast("int")), F.lit(0)) for k in (1, 2))
    out = counts.agg(F.count("*").alias("observed"), one.alias("singletons"), two.alias("doubletons"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"))
    s1, s2 = F.col("singletons").cast("double"), F.col("doubletons").cast("double")
    return out.withColumns({"chao1": F.col("observed") + s1 * (s1 - 1) / (2 * (s2 + 1)), "good_turing": F.when(F.col("n_rows") > 0, 1 - s1 / F.col("n_rows")).otherwise(F.lit(0.0))})


def assess(rows: DataFrame, keys: list, known: int | None = None) -> Completeness:
    r = group_frequencies(rows, keys).first()
    return Completeness(r["observed"], r["singletons"], r["doubletons"], r["n_rows"], known)
