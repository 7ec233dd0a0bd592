"""Usage-evidence analytics as Spark jobs: classify, link, score, sessionize, report."""

from footmark.functions.rules import Rule, RuleBook, default_rules

__all__ = ["Rule", "RuleBook", "default_rules"]
__version__ = "0.1.0"
