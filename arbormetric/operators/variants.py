"""The sixteen distance variants and their names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defined combinations of shape and gap; each comes with and without relabels.
DEFINED = {("f", True), ("f", False), ("t", True), ("t", False), ("s", True), ("a", True),
           ("p", True), ("p", False)}
# Fixed value: distance of two trees that share no label under the exact agreement shape.
NO_AGREEMENT = 100000000.0


@dataclass(frozen=True)
class Variant:
    """``shape``: f pieces, t tree, s separated, a agreement, p path.  ``exact``: no relabels."""

    shape: str
    gap: bool = True
    exact: bool = False
    weight: float = 1.0
    floating: bool = True

    def __post_init__(self):
        if not self.floating or (self.shape, self.gap) not in DEFINED:
            raise ValueError(f"no distance is defined for {self}")
        if self.weight < 0:
            raise ValueError("the relabel weight is negative")
        if self.exact:
            object.__setattr__(self, "weight", 1.0)

    @property
    def target(self) -> str:
        flags = "".join("t" if x else "f" for x in (self.gap, self.floating, self.exact))
        return self.shape + flags + ("" if self.exact else str(round(self.weight * 100)))


def all_variants(weight: float = 1.0) -> list[Variant]:
    return [
        Variant(shape, gap, exact, weight)
        for shape, gap in sorted(DEFINED, reverse=True)
        for exact in (False, True)
    ]


def target_name(
    shape: Column, gap: Column, floating: Column, exact: Column, weight: Column,
    legacy: bool = False,
) -> Column:
    """Name of a target from header fields (flags are ``t`` or ``f``).

    The hundredfold weight is rounded; ``legacy`` cuts it, which turns 0.29 into 28.
    """
    hundredfold = weight.cast("double") * 100
    number = hundredfold if legacy else F.round(hundredfold)
    suffix = F.when(exact == "f", number.cast("int").cast("string")).otherwise("")
    return F.concat(shape, gap, floating, exact, suffix)
