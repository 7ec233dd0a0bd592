"""Spelling variants by finite-state composition: words that are one edit apart, and the form each of them stands for.

Two words are near if one code point is inserted, deleted or replaced.  Where the edit happens, a pair shares all that
lies before it and all that lies behind it.  So words meet in partitions of a *window*: those with the same beginning
before the window and the same end behind it.  In a partition, the beginning is the initial state.  The middles become
a minimised acceptor; composed with the one-edit transducer and itself, its paths stay on one state up to the edit, and
then run in two states whose right languages are intersected.  The transducer is kept canonical (an edit is made at the
first difference), so each pair has one path, in one window.

Windows start as the two halves of the shorter word.  A partition of more than ``PARTITION`` words is dealt anew with its
window cut in two, which makes its beginning or its end longer, until it is small; a window of one code point holds
one word for each letter and each pair of letters at most.  So a beginning with a third of all words is no large group.

Nulls and edge cases: a null text has no words; a null ``doc_id`` counts as an empty string where words are altered;
repeated rows are separate documents, so their words count again; very long runs of letters are words like others;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, parts_for, slices, stage

#: More words than a window of one code point can hold: 90 letters, and 90 * 90 pairs of them.
PARTITION = 10_000


def count_words(docs: DataFrame, shortest: int = 6, alter_every: int = 199) -> DataFrame:
    """Words (runs of Latin letters, A-Z lowered) of at least ``shortest`` code points, and how often each occurs.

    One of ``alter_every`` (document, run) pairs, by its checksum, loses a code point: misspellings by rule.  0: none.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)  # a run that is shorter cannot give a word

    def work(batches):
        for batch in slices(batches, most=8 << 20):
            counts: Counter = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = runs.findall(text.encode().lower().decode()) if text else []
                if alter_every:
                    start = zlib.crc32((("" if doc is None else str(doc)) + ":").encode())
                    sums = {w: zlib.crc32(w.encode(), start) for w in set(own)}
                    altered = {w: w[:h % len(w)] + w[h % len(w) + 1:] for w, h in sums.items() if h % alter_every == 0}
                    if altered:
                        own = [altered.get(w, w) for w in own]
                counts.update(own)
            words = [w for w in counts if len(w) >= shortest]
            yield {"word": words, "n": [counts[w] for w in words]}

    rows = arrow_map(docs.select("doc_id", "text"), work, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic automaton of sorted words: ``states[i]`` is (accepts, {letter: state})."""

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, dict[str, int]]] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]  # states of the last word that may still grow
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, edges = path.pop()
                key = (accepts, *edges.items())
                if key not in known:
                    known[key] = len(self.states)
                    self.states.append((accepts, edges))
                path[-1][1][last[len(path) - 1]] = known[key]

        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            close(shared)
            path.extend([False, {}] for _ in word[shared:])
            path[-1][0] = True
            last = word
        close(0)
        self.start = len(self.states)
        self.states.append((path[0][0], path[0][1]))

    def both(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """Endings that both states accept, and that do not begin with ``but``."""
        stack = [(p, q, "", but)]
        while stack:
            p, q, said, but = stack.pop()
            (first, edges), (second, others) = self.states[p], self.states[q]
            steps: list[str] = []
            while True:
                if first and second:
                    yield said + "".join(steps)
                shared = [c for c in edges if c in others and c != but]
                if len(shared) != 1:
                    break
                but = ""
                steps.append(shared[0])
                (first, edges), (second, others) = self.states[edges[shared[0]]], self.states[others[shared[0]]]
            stack += [(edges[c], others[c], said + "".join(steps) + c, "") for c in shared]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Endings (u, v) from a state on, where v differs from u by its first letter: put in, or in place of another."""
        accepts, edges = self.states[state]
        letters = sorted(edges)
        found = [(a + end, b + end) for i, a in enumerate(letters) for b in letters[i + 1:] for end in self.both(edges[a], edges[b])]
        return found + [(end, c + end) for c in letters for end in self.both(state, edges[c], but=c)]

    def pairs(self, most: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs one edit apart: of ``most`` letters both, or with one more in the second."""
        known: dict[int, list[tuple[str, str]]] = {}
        stack = [(self.start, "")]
        while stack:
            state, said = stack.pop()
            steps = []
            while not self.states[state][0] and len(edges := self.states[state][1]) == 1:
                letter, state = next(iter(edges.items()))
                steps.append(letter)
            said += "".join(steps)
            edges = self.states[state][1]
            if edges:
                if state not in known:
                    known[state] = self.edits(state)
                yield from ((said + u, said + v) for u, v in known[state] if len(said) + len(u) == most)
                stack += [(to, said + c) for c, to in edges.items()]


def pairs_of_window(words: list[str], m: int, a: int, c: int) -> Iterator[tuple[str, str]]:
    """Near pairs, of ``m`` code points both or of m and m + 1, whose first difference lies in the window from a up to c
    (at c too if that is the end).  All words share their first ``a`` and last ``m - c`` code points."""
    begin, end = words[0][:a], words[0][len(words[0]) - (m - c):]
    middles = sorted(w[a:len(w) - (m - c)] for w in words)
    for u, v in Acceptor(middles).pairs(c - a):
        if c == m or len(u) == len(v) or not v.startswith(u):
            yield begin + u + end, begin + v + end


def nearest_forms(rows: list[tuple[str, int]], pairs: Iterator[tuple[str, str]], out: dict[str, list]) -> None:
    """For each word that has any: how many near words, and the most frequent of them (ties: the smallest)."""
    sizes = dict(rows)
    found: dict[str, list] = {}
    for pair in pairs:
        for word, other in (pair, pair[::-1]):
            own = found.setdefault(word, [0, (1, "")])
            own[0] += 1
            own[1] = min(own[1], (-sizes[other], other))
    for word, (n_near, (n, form)) in found.items():
        for name, value in (("word", word), ("n_near", n_near), ("form", form), ("form_n", -n)):
            out[name].append(value)


KEY = "concat_ws('|', m, a, c, left(word, a), right(word, m - c))"


def windows(words: DataFrame, shortest: int) -> DataFrame:
    """One row for each word and window it meets others in: with words of its length, and as the longer of a pair."""
    classes = words.withColumn("m", F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= shortest)))
    return cut(classes.withColumn("a", F.lit(0)).withColumn("c", F.col("m")))


def cut(rows: DataFrame) -> DataFrame:
    """Each window in two."""
    middle = F.floor((F.col("a") + F.col("c")) / 2).cast("int")
    halves = F.array(F.struct("a", middle.alias("c")), F.struct(middle.alias("a"), "c"))
    return rows.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.*").withColumn("key", F.expr(KEY))


def near_words(words: DataFrame, shortest: int, partition: int = PARTITION) -> DataFrame:
    """word, n_near, form and form_n of each word of ``words`` (word, n) that has near words.

    ``words`` must be a written table.  The driver learns whether large partitions are left, and nothing else.
    """
    todo, done = windows(words, shortest), []
    while True:
        large = stage(todo.where("c - a > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > partition).select("key"), "large")
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, "key", "left_anti").select(*todo.columns))
        todo = cut(todo.join(large, "key", "left_semi"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)

    def work(batches):
        held, key = [], None

        def solved():
            if len(held) > 1:
                _, m, a, c = key
                nearest_forms(held, pairs_of_window([w for w, _ in held], m, a, c), out)

        out: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
        for batch in batches:
            for word, n, *own in zip(*(batch.column(x).to_pylist() for x in ("word", "n", "key", "m", "a", "c"))):
                if key != tuple(own):
                    solved()
                    held, key = [], tuple(own)
                held.append((word, n))
            yield out
            out = {name: [] for name in out}
        solved()
        yield out

    parts = parts_for(words, 4 * words.count(), 200_000)
    found = arrow_map(rows.repartition(parts, "key").sortWithinPartitions("key"), work,
                      "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root``: from a word, its form, that one's form and so on, to the last.  ``words`` must be a written table.

    A form is more frequent than its word, so chains end; each round doubles the steps that are known.
    """
    links = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(further, "root", "left")
                      .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return words.join(links.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 6, at_least: int = 5, ratio: int = 5, alter_every: int = 199) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that occurs ``at_least`` times.

    A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent; else null.
    """
    words = stage(count_words(docs, shortest, alter_every).where(F.col("n") >= at_least), "words")
    near = near_words(words, shortest)
    kept = F.col("form_n") >= F.lit(ratio) * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("form_n")).alias("form_n"))
    return with_roots(stage(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
