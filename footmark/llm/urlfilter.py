"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot after each (``com.example.www.``), so a rule for a host and all
its subdomains is the interval of keys that begin with the rule's key.  Each task sorts its urls by key and sweeps
over them together with the sorted intervals, keeping a stack of the nested rules that are active; of those whose
path begins the url's path the longest wins.  Urls are not shuffled, so a host with a third of all rows is no hot key.

The rules go to the tasks in blocks of at most ``block`` rules, one sweep for each block, so what is broadcast has a
bound; the best rule so far stays with the url.

Nulls and edge cases: a null url or one without ``://`` has empty host and path and fits no rule unless one has an
empty host; rules with a null host or path or verdict are ignored; if one (host, path) has several verdicts, block
wins; the longest rule is that with most characters, then that with the longer host; repeated rows are judged each; a
null id is kept; with no rules every url gets the default verdict.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Intervals:
    """The rules of a block as intervals [key, key with its last dot raised), by start."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_host: dict[str, dict[str, str]] = defaultdict(dict)
        for host, path, verdict in rules:
            if by_host[host].get(path) != "block":
                by_host[host][path] = verdict
        self.items = sorted((k := host_key(h), k[:-1] + "/", h, sorted({len(p) for p in paths}, reverse=True), paths)
                            for h, paths in by_host.items())


class Sweep:
    """Goes over urls in the order of their keys with a stack of the active, nested rules."""

    def __init__(self, intervals: Intervals):
        self.items, self.at, self.stack = intervals.items, 0, []

    def best(self, key: str, path: str) -> tuple[str, str, str] | None:
        """Host, path and verdict of the longest rule that fits."""
        stack, items = self.stack, self.items
        while stack and stack[-1][1] <= key:
            stack.pop()
        while self.at < len(items) and items[self.at][0] <= key:
            if items[self.at][1] > key:
                stack.append(items[self.at])
            self.at += 1
        best = None
        for _, _, host, lengths, paths in stack:
            n = next((n for n in lengths if len(path) >= n and path[:n] in paths), None)
            if n is not None and (best is None or (len(host) + n, len(host)) > (len(best[0]) + len(best[1]), len(best[0]))):
                best = (host, path[:n], paths[path[:n]])
        return best


SCHEMA = "page_id long, host string, path string, key string, rule string, rule_host int, verdict string"


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", block: int = 100_000) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that won, else null), verdict."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    found = urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("rule_host"),
                        F.lit(None).cast("string").alias("verdict")).sortWithinPartitions("key")
    for part in blocks_of(rules, block):
        found = swept(found, part)
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def blocks_of(rules: DataFrame, block: int):
    """Lists of at most ``block`` rules; one at a time is on the driver."""
    held = []
    for r in rules.select("host", "path", "verdict").dropna().toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def swept(found: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One sweep; rows of a partition must be sorted by key and stay so."""
    shared = found.sparkSession.sparkContext.broadcast(Intervals(rules))

    def work(batches):
        sweep = Sweep(shared.value)
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            yield merged(columns, [sweep.best(k, p) for k, p in zip(columns["key"], columns["path"])])

    return arrow_map(found, work, SCHEMA)


def merged(columns: dict[str, list], best: list) -> dict[str, list]:
    """The longer of the rule so far and the new one."""
    for i, new in enumerate(best):
        if new and (columns["rule"][i] is None
                    or (len(new[0]) + len(new[1]), len(new[0])) > (len(columns["rule"][i]), columns["rule_host"][i])):
            columns["rule"][i], columns["rule_host"][i], columns["verdict"][i] = new[0] + new[1], len(new[0]), new[2]
    return columns
