"""Text against rules, as column expressions.

First-match questions become one ``CASE WHEN`` chain of literals, so they run
inside whole-stage codegen next to the scan and never shuffle.  Questions that
want every platform become an array with one slot per platform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from footmark.functions.rules import Rule

def no_string() -> Column:
    return F.lit(None).cast("string")


def distinct(col: Column | str) -> Column:
    """Number of distinct values of a short closed list.

    Unlike ``count_distinct`` it does not multiply the rows when several are asked for at once, and it
    combines on the map side.
    """
    return F.size(F.collect_set(col)).cast("bigint")


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text contains one of the words.

    A word that contains another word of the list adds nothing, so it is left out.
    """
    words = list(dict.fromkeys(w.lower() for w in words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return any_of(F.contains(lowered, F.lit(w)) for w in needed)


def regex_any(text: Column, patterns: Iterable[str]) -> Column:
    """True when the text matches one of the patterns, whatever its case."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def chain(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first branch whose test holds."""
    if not branches:
        return no_string() if otherwise is None else otherwise
    col = F.when(*branches[0])
    for test, value in branches[1:]:
        col = col.when(test, value)
    return col if otherwise is None else col.otherwise(otherwise)


def first_word(lowered: Column, words: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first (word, value) pair whose word is in the lower-cased text."""
    runs = [(v, [w for w, _ in g]) for v, g in groupby(words, key=lambda p: p[1])]
    branches = [(contains_any(lowered, ws), F.lit(v)) for v, ws in runs]
    return chain(branches, None if default is None else F.lit(default))


def _runs(rules: list[Rule], key: Callable[[Rule], object]) -> list[tuple[object, list[str]]]:
    return [(k, [r.pattern for r in g]) for k, g in groupby(rules, key=key)]


def match_platform(lowered: Column, rules: list[Rule]) -> Column:
    """Platform of the first rule contained in the lower-cased text, else null."""
    return chain([(contains_any(lowered, ps), F.lit(p)) for p, ps in _runs(rules, lambda r: r.platform)])


def match_model(lowered: Column, rules: list[Rule]) -> Column:
    """Model of the first rule contained in the lower-cased text, else null."""
    return chain([(contains_any(lowered, ps), F.lit(m)) for m, ps in _runs(rules, lambda r: r.model)])


def first_pattern(lowered: Column, rules: list[Rule]) -> Column:
    """The first pattern contained in the lower-cased text, else null."""
    return chain([(F.contains(lowered, F.lit(r.pattern.lower())), F.lit(r.pattern)) for r in rules])


def pattern_of_platform(lowered: Column, platform: Column, rules: list[Rule]) -> Column:
    """First pattern of an already known platform: only that platform's rules are tried."""
    by_platform: dict[str, list[Rule]] = {}
    for rule in rules:
        by_platform.setdefault(rule.platform, []).append(rule)
    return chain([(platform == F.lit(p), first_pattern(lowered, rs)) for p, rs in by_platform.items()])


def match_regex_platform(text: Column, rules: list[Rule]) -> Column:
    """Platform of the first rule whose pattern occurs in the text, else null."""
    return chain([(regex_any(text, ps), F.lit(p)) for p, ps in _runs(rules, lambda r: r.platform)])


def first_regex_of_platform(text: Column, platform: Column, rules: list[Rule]) -> Column:
    """First matching pattern of an already known platform."""
    by_platform: dict[str, list[Rule]] = {}
    for rule in rules:
        by_platform.setdefault(rule.platform, []).append(rule)
    return chain([
        (platform == F.lit(p), chain([(text.rlike("(?i)" + r.pattern), F.lit(r.pattern)) for r in rs]))
        for p, rs in by_platform.items()
    ])


def per_platform(
    platforms: list[str], slots: Callable[[str], list[tuple[Column, Column]]], **extra: Callable[[str], Column]
) -> Column:
    """Array with one struct per platform that has a hit, in platform order.

    ``slots(platform)`` lists (test, indicator) pairs; the first one that holds
    is the platform's hit.
    """
    items = []
    for platform in platforms:
        branches = slots(platform)
        if not branches:
            continue
        indicator = chain(branches)
        fields = [F.lit(platform).alias("platform"), indicator.alias("indicator")]
        fields += [fn(platform).alias(name) for name, fn in extra.items()]
        items.append(F.struct(*fields))
    return F.filter(F.array(*items), lambda h: h["indicator"].isNotNull())


def match_cookie_host(host: Column, rules: list[Rule]) -> Column:
    """Platform of the first cookie domain that is in the host or ends it (case-sensitive)."""
    return chain([
        (any_of(F.contains(host, F.lit(p)) | host.endswith(p.lstrip(".")) for p in ps), F.lit(platform))
        for platform, ps in _runs(rules, lambda r: r.platform)
    ])


def match_host_suffix(url: Column, rules: list[Rule]) -> Column:
    """Stricter variant of ``match_platform``: the URL's host is a rule or a subdomain of one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return chain([
        (any_of((host == p) | host.endswith("." + p) for p in (x.lower() for x in ps)), F.lit(platform))
        for platform, ps in _runs(rules, lambda r: r.platform)
    ])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(name: Column) -> Column:
    """Lower-cased extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def parent_name(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def lenient_text(content: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))
