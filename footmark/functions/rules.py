"""The rule catalogue as a small ordered dimension.

A ``RuleBook`` lives on the driver because matchers turn it into literals of a
``CASE WHEN`` chain.  Rules that come from a table are read through
``RuleBook.from_df``, which checks how many there are before collecting them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from footmark.functions import catalogue

RULE_SCHEMA = "kind string, ord int, pattern string, platform string, model string"
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    kind: str
    ord: int
    pattern: str
    platform: str
    model: str | None = None


class RuleBook:
    """Rules of all kinds, each kind kept in ``ord`` order."""

    def __init__(self, rules: Iterable[Rule]):
        self._rules = sorted(rules, key=lambda r: (r.kind, r.ord))
        self._by_kind: dict[str, list[Rule]] = {}
        for rule in self._rules:
            self._by_kind.setdefault(rule.kind, []).append(rule)

    def of(self, *kinds: str) -> list[Rule]:
        """Rules of the given kinds; several kinds are merged platform by platform."""
        if len(kinds) == 1:
            return self._by_kind.get(kinds[0], [])
        merged = []
        for platform in self.platforms(*kinds):
            for kind in kinds:
                merged += [r for r in self.of(kind) if r.platform == platform]
        return merged

    def platforms(self, *kinds: str) -> list[str]:
        """Platforms in the order in which the catalogue lists them."""
        known = [p for p in catalogue.PLATFORMS if any(r.platform == p for r in self._rules)]
        extra = dict.fromkeys(r.platform for r in self._rules if r.platform not in known)
        present = {r.platform for k in kinds for r in self.of(k)} if kinds else None
        return [p for p in [*known, *extra] if present is None or p in present]

    def extended(self, rules: Iterable[Rule]) -> RuleBook:
        """Own rules on top of these, tried after them unless their ``ord`` says otherwise."""
        return RuleBook([*self._rules, *rules])

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(r) for r in self._rules], RULE_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame, max_rules: int = MAX_RULES) -> RuleBook:
        rows = df.select("kind", "ord", "pattern", "platform", "model").limit(max_rules + 1)
        found = rows.collect()
        if len(found) > max_rules:
            raise ValueError(f"more than {max_rules} rules; raise max_rules if that is meant")
        return cls(Rule(*r) for r in found)


def default_rules() -> RuleBook:
    """The built-in catalogue."""
    rules: list[Rule] = []

    def add(kind: str, pairs: list[tuple[str, str]], models: list[str] | None = None):
        for i, (platform, pattern) in enumerate(pairs):
            rules.append(Rule(kind, i, pattern, platform, models[i] if models else None))

    for kind, table in catalogue.SIMPLE_KINDS.items():
        add(kind, [(p, s) for p in catalogue.PLATFORMS for s in table.get(p, [])])
    named = [(p, s, m) for p in catalogue.PLATFORMS
             for m, strings in catalogue.MODEL_STRINGS.get(p, {}).items() for s in strings]
    add("model", [(p, s) for p, s, _ in named], [m for _, _, m in named])
    return RuleBook(rules)
