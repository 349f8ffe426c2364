"""Offer categories: ordered lists of name fragments, first match wins.

Matching ignores case. The operators evaluate categories on the offer catalogue, never
on events. In the seed catalogue every ``Loan_*`` name also contains ``Mo``, so the rules
below put those offers with data; pass other rules to change that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CategoryRules:
    branches: tuple[tuple[str, tuple[str, ...]], ...]
    otherwise: str

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(label for label, _ in self.branches) + (self.otherwise,)


# Report labels and the name fragments behind them.
PREFERENCE_RULES = CategoryRules(
    branches=(
        ("Data Users", ("Data", "Internet", "Mo")),
        ("Voice-centric users", ("Voice", "min", "SMS")),
        ("Loan takers", ("Loan",)),
    ),
    otherwise="General users",
)
RECOMMENDATION_RULES = CategoryRules(
    branches=(
        ("Data Users", ("Data", "Internet", "Mo")),
        ("Voice-centric users", ("Voice", "min", "SMS")),
        ("Loan Users", ("Loan",)),
    ),
    otherwise="Mixed Users",
)
# What each segment may be offered; a segment not named here may be offered anything.
RECOMMENDATION_CANDIDATES = {
    "Data Users": ("Data", "Internet"),
    "Voice-centric users": ("Voice", "min", "SMS"),
    "Loan Users": ("Loan",),
}
PRODUCT_RULES = CategoryRules(
    branches=(
        ("Data Products", ("Data", "Internet", "Mo")),
        ("Voice Products", ("Voice", "min", "Call")),
        ("Financial Products", ("Loan",)),
    ),
    otherwise="Other Products",
)
BUNDLE_FRAGMENTS = ("Data", "Mo", "Internet")
NETWORK_DATA_FRAGMENTS = ("Data", "Internet")
NETWORK_VOICE_FRAGMENTS = ("Voice", "min")
LOAN_FRAGMENTS = ("Loan",)


def mentions(name: Column, fragments: Sequence[str]) -> Column:
    """Whether the name contains any of the fragments; NULL names give NULL."""
    return reduce(lambda a, b: a | b, [name.ilike(f"%{part}%") for part in fragments])


def category(name: Column, rules: CategoryRules) -> Column:
    label = F.lit(rules.otherwise)
    for branch, fragments in reversed(rules.branches):
        label = F.when(mentions(name, fragments), F.lit(branch)).otherwise(label)
    return label
