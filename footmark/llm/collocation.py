"""Phrase collocations by best-first branch and bound.

A phrase is cut in two where its parts predict each other least; its score is how often it occurs, twice, over how
often the parts do.  Growing a phrase can only make it rarer, so the counts of what it grows from bound its score:
with A the least count of the pairs in it and f of its first word, no phrase scores above 2A / (f + A); likewise from
its last word, and at a cut between counted parts.  Each language works on its best pairs first: the frontier is all
that a threshold leaves, set where twice as many pairs stand as phrases are wanted.  Only phrases whose bound reaches
the threshold are counted, and those that may take a phrase above it into themselves.  When enough phrases above the
threshold have survived, nothing below it matters, ties included; else the language goes on with a lower threshold.

Texts are read once, block by block, into word numbers.  A block counts its own phrases and learns from joins what the
whole corpus says about them, so neither the vocabulary nor the phrases of the corpus are in one place, and a word or
pair in a third of all documents is one row for each block.  Bounds are taken in double precision with a slack (they may
admit more, never less); scores are exact.

Nulls and edge cases: a null text is empty; a null language is ``und``; a null ``doc_id`` does not matter; repeated rows
count again; a text of any length is one unit, and a block holds it alone; other columns are ignored, whatever their
names; a language without words or candidates gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices, stage

BLOCK_BYTES = 8 << 20
#: A byte that UTF-8 does not know: the end of a piece.
EDGE = b"\xff"
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", EDGE * 10 + b" ")

BLOCKS = "block long, lang string, n long, words array<string>, counts array<long>, tokens binary"
PAIRS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
GROWN = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("third", pa.int64()), ("n", pa.int64())])
#: Scores are parts of a million.
SCALE = 2_000_000


def numbered_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the texts as places in that list, -1 at the end of a piece."""
    words = EDGE.join(texts).lower().translate(TABLE).replace(EDGE, b" " + EDGE + b" ").split()
    coded = pa.array([EDGE, *words], pa.binary()).dictionary_encode()
    tokens = coded.indices.to_numpy()[1:].astype("<i4") - 1
    distinct = coded.dictionary.slice(1)
    return distinct.cast(pa.string()), np.bincount(tokens[tokens >= 0], minlength=len(distinct)), tokens


def read_blocks(docs: DataFrame) -> DataFrame:
    """One row for each block and language: its words with counts, and its texts as places in that list."""
    def work(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, most=BLOCK_BYTES):
            by_language: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    by_language.setdefault(lang, []).append(text.encode())
            for lang, texts in by_language.items():
                words, counts, tokens = numbered_words(texts)
                one = pa.array([0, len(words)], pa.int32())
                yield {"block": [block], "lang": [lang], "n": [int(counts.sum())], "tokens": [tokens.tobytes()],
                       "words": pa.ListArray.from_arrays(one, words).cast(pa.list_(pa.field("element", pa.string()))),
                       "counts": pa.ListArray.from_arrays(one, pa.array(counts, pa.int64())).cast(pa.list_(pa.field("element", pa.int64())))}
                block += 1

    return arrow_map(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), work, BLOCKS)


def block_words(blocks: DataFrame) -> DataFrame:
    return (blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
            .select("block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n")))


def frequent_words(blocks: DataFrame, at_least: int) -> DataFrame:
    """lang, word, f and a number below 2**31 for each word that can be part of a candidate."""
    words = block_words(blocks).groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least)
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word")).cast("long") - 1
    return words.withColumn("part", part).withColumn("id", place * parts + F.col("part")).drop("part")


def count_pairs(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """What each block says about pairs of frequent words: (block, lang, pair, n) rows, and one row with its tokens as
    word numbers.  A pair is the number of its first word, times 2**32, plus that of its second."""
    known = block_words(blocks).join(words, ["lang", "word"]).select(F.col("block").alias("home"), "place", "id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return PAIRS.empty_table()
        block, lang = left.column("block")[0], left.column("lang")[0]
        tokens = np.frombuffer(left.column("tokens")[0].as_py(), "<i4")
        ids = np.full(int(tokens.max(initial=0)) + 2, -1, np.int64)
        ids[right.column("place").to_numpy()] = right.column("id").to_numpy()
        tokens = np.r_[-1, ids[tokens], -1]  # ids[-1] stays -1
        joined = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
        pairs, n = np.unique(tokens[:-1][joined] << 32 | tokens[1:][joined], return_counts=True)
        inside = np.r_[False, joined] | np.r_[joined, False]
        tokens = np.where(inside, tokens, -1)
        tokens = tokens[np.r_[False, inside[1:] | inside[:-1]]].astype("<i4")  # one -1 between runs
        rows = len(pairs) + 1
        return pa.Table.from_arrays([
            pa.repeat(block, rows), pa.repeat(lang, rows), pa.array([*pairs.tolist(), None], pa.int64()),
            pa.array(np.r_[n, 0], pa.int64()), pa.array([None] * (rows - 1) + [tokens.tobytes()], pa.binary())], schema=PAIRS)

    return (blocks.select("block", "lang", "tokens").groupBy("block").cogroup(known.groupBy("home"))
            .applyInArrow(work, "block long, lang string, pair long, n long, tokens binary"))


def score(a: str, left: str, right: str) -> Column:
    return F.expr(f"cast({a} AS decimal(20,0)) * {SCALE} div cast({left} + {right} AS decimal(20,0))")


def score_pairs(counted: DataFrame, words: DataFrame, at_least: int) -> DataFrame:
    """pair, a, l, r, lang and score of each pair that is a candidate."""
    pairs = counted.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("a")).where(F.col("a") >= at_least)
    first = words.select(F.col("id").alias("w1"), F.col("f").alias("l"), "lang")
    second = words.select(F.col("id").alias("w2"), F.col("f").alias("r"))
    return (pairs.withColumn("w1", F.shiftrightunsigned("pair", 32)).withColumn("w2", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
            .join(first, "w1").join(second, "w2").select("pair", "a", "l", "r", "lang", score("a", "l", "r").alias("score")))


def bound(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """No less than the score of what occurs ``a`` times between parts that occur at least so often."""
    return SCALE * a.astype(float) / (left + right) + 1


def grow(counted: DataFrame, pairs: DataFrame, thresholds: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """Phrases of three and four words, as pairs that overlap, which their bounds leave in the frontier, or which may take
    in a phrase of the frontier: (first, second, third or null, n) by block.

    A block learns of the pairs whose own bound reaches the threshold; what begins and ends with others cannot.
    ``keep`` is the share (numerator, denominator) of occurrences from which a longer phrase takes the shorter one in.
    """
    reach = (F.lit(float(SCALE)) * F.col("a") / (F.least("l", "r") + F.col("a")) + 1) >= F.col("threshold")
    frontier = pairs.join(thresholds, "lang").where(reach)
    known = (counted.where("pair IS NOT NULL").select("block", "pair").join(frontier, "pair")
             .select(F.col("block").alias("home"), "pair", "a", "l", "r", "score", "threshold"))
    tokens = counted.where("tokens IS NOT NULL").join(thresholds, "lang", "left_semi").select("block", "tokens")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return GROWN.empty_table()
        right = right.sort_by("pair")
        pair, a, f, g, own = (right.column(c).to_numpy() for c in ("pair", "a", "l", "r", "score"))
        least = float(right.column("threshold")[0].as_py())
        ids = np.frombuffer(left.column("tokens")[0].as_py(), "<i4").astype(np.int64)
        here = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
        at = np.minimum(np.searchsorted(pair, here), len(pair) - 1)
        at = np.where(pair[at] == here, at, len(pair))  # the last place stands for all other pairs
        begins = np.append(bound(a, f, a) >= least, False)  # may begin a phrase of the frontier
        ends = np.append(bound(a, a, g) >= least, False)
        stands = np.append(own >= least, False)
        a, f, g = np.append(a, 1 << 62), np.append(f, 1), np.append(g, 1)  # of other pairs nothing is known

        def rows(*parts: np.ndarray) -> pa.Table:
            code, columns = np.zeros(len(parts[0]), np.int64), []
            for p in parts:
                values, place = np.unique(p, return_inverse=True)
                code = np.unique(code, return_inverse=True)[1] * max(1, len(values)) + place  # numbers of this block stay below 64 bits
            _, places, n = np.unique(code, return_index=True, return_counts=True)
            columns = [pa.array(p[places], pa.int64()) for p in parts] + [pa.nulls(len(n), pa.int64())]
            return pa.Table.from_arrays([*columns[:3], pa.array(n, pa.int64())], schema=GROWN)

        threes = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        x, y = at[threes], at[threes + 1]
        most = np.minimum(a[x], a[y])
        grows = (begins[x] & (bound(most, f[x], most) >= least)) | (ends[y] & (bound(most, most, g[y]) >= least))
        takes = np.zeros(len(most), bool)
        for p in (x, y):
            takes |= stands[p] & (most * float(keep[1]) >= keep[0] * a[p] * (1 - 1e-9))
        good = begins[x] & ends[y] & (np.minimum(bound(most, f[x], a[y]), bound(most, a[x], g[y])) >= least)  # may be of the frontier
        wanted = threes[grows | takes]
        threes_found = rows(here[wanted], here[wanted + 1])
        next_to = np.flatnonzero(np.diff(threes) == 1)  # four words: two threes that follow each other
        x4, y4, z4 = x[next_to], y[next_to], y[next_to + 1]
        most = np.minimum(np.minimum(a[x4], a[y4]), a[z4])
        top = begins[x4] & ends[z4] & (np.minimum(
            np.minimum(bound(most, f[x4], most), bound(most, most, g[z4])), bound(most, a[x4], a[z4])) >= least)
        wanted = threes[next_to[top | good[next_to] | good[next_to + 1]]]
        return pa.concat_tables([threes_found, rows(here[wanted], here[wanted + 1], here[wanted + 2])])

    return tokens.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(work, "first long, second long, third long, n long")


CANDIDATES = ["lang", "first", "second", "third", "a", "l", "r", "score"]


def lowest_cut(*cuts: tuple[str, str]) -> list[Column]:
    """l, r and score of the cut that scores lowest; ties: the first one."""
    best = F.least(*[F.struct(score("a", left, right).alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r"))
                     for k, (left, right) in enumerate(cuts)])
    return [best[c].alias(c) for c in ("l", "r", "score")]


def score_phrases(grown: DataFrame, pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Candidates of two to four words that score at least their language's threshold.  ``grown`` holds what was counted
    often enough; what else scores that high was counted as well, and so were its parts."""
    def facts(name: str, *columns: str) -> DataFrame:
        return pairs.select(F.col("pair").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    threes = (grown.where("third IS NULL").drop("third").join(facts("first", "a", "l", "lang"), "first").join(facts("second", "a", "r"), "second"))
    three = threes.select(F.col("first_lang").alias("lang"), "first", "second", F.lit(None).cast("long").alias("third"), "a",
                          *lowest_cut(("first_l", "second_a"), ("first_a", "second_r")))
    part = grown.where("third IS NULL")
    fours = (grown.where("third IS NOT NULL").join(facts("first", "a", "l", "lang"), "first").join(facts("third", "a", "r"), "third")
             .join(part.select("first", "second", F.col("a").alias("start")), ["first", "second"])
             .join(part.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("rest")), ["second", "third"]))
    four = fours.select(F.col("first_lang").alias("lang"), "first", "second", "third", "a",
                        *lowest_cut(("first_l", "rest"), ("first_a", "third_a"), ("start", "third_r")))
    two = pairs.select("lang", F.col("pair").alias("first"), F.lit(None).cast("long").alias("second"),
                       F.lit(None).cast("long").alias("third"), "a", "l", "r", "score")
    return two.unionByName(three).unionByName(four).join(thresholds, "lang").where("score >= threshold").select(*CANDIDATES)


def surviving(candidates: DataFrame, grown: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """Candidates that no longer phrase takes in.  A phrase of four words that takes a pair in takes it in by one of three."""
    threes, fours = grown.where("third IS NULL"), grown.where("third IS NOT NULL")
    none = F.lit(None).cast("long")
    inside = threes.select(F.explode(F.array("first", "second")).alias("first"), none.alias("second"), "a").unionByName(
        fours.select(F.explode(F.array(F.struct("first", "second"), F.struct(F.col("second").alias("first"), F.col("third").alias("second")))).alias("p"), "a")
        .select("p.first", "p.second", "a"))
    longest = inside.groupBy(F.col("first").alias("f"), F.col("second").alias("s")).agg(F.max("a").alias("longer"))
    taken = (F.col("first") == F.col("f")) & F.col("second").eqNullSafe(F.col("s")) & F.col("third").isNull()
    return (candidates.join(longest, taken, "left")
            .where(F.col("longer").isNull() | (keep[1] * F.col("longer") < keep[0] * F.col("a"))).select(*candidates.columns))


def thresholds_at(pairs: DataFrame, rank: int, of: DataFrame) -> DataFrame:
    """The score of each language's pair of that rank (0 where there are fewer), of the languages of a table.

    Scores are counted first: a language has at most as many different ones as there are scores.
    """
    by_score = pairs.join(of.select("lang"), "lang", "left_semi").groupBy("lang", "score").agg(F.count("*").alias("n"))
    running = by_score.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    reached = running.where(F.col("above") >= rank).groupBy("lang").agg(F.max("score").alias("reached"))
    return of.select("lang").join(reached, "lang", "left").select("lang", F.coalesce("reached", F.lit(0)).alias("threshold"))


def spell(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``phrase``, the words in order."""
    pair_words = F.array(F.shiftrightunsigned("first", 32), F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)),
                         F.col("second").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("third").bitwiseAND(F.lit(0xFFFFFFFF)))
    apart = phrases.select(*phrases.columns, F.posexplode(F.filter(pair_words, lambda w: w.isNotNull())).alias("place", "id"))
    said = apart.join(words.select("id", "word"), "id").groupBy(*phrases.columns).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("said"))
    return said.select(*phrases.columns, F.array_join(F.col("said.word"), " ").alias("phrase"))


def best_phrases(docs: DataFrame, top: int = 2000, at_least: int = 30, keep: tuple[int, int] = (80, 100)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` best phrases of two to four words."""
    blocks = stage(read_blocks(docs), "blocks")
    words = stage(frequent_words(blocks, at_least), "words")
    if not words.where(F.col("id") >= 1 << 31).isEmpty():
        raise ValueError("more than 2**31 frequent words")
    counted = stage(count_pairs(blocks, words), "counted")
    pairs = stage(score_pairs(counted, words, at_least), "pairs")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    open_languages, rank, found = pairs.select("lang").distinct(), 2 * top, []
    while True:
        thresholds = stage(thresholds_at(pairs, rank, open_languages), "thresholds")
        if thresholds.isEmpty():
            break
        grown = (grow(counted, pairs, thresholds, keep).groupBy("first", "second", "third").agg(F.sum("n").alias("a"))
                 .where(F.col("a") >= at_least))
        grown = stage(grown, "grown")
        survivors = stage(surviving(score_phrases(grown, pairs, thresholds), grown, keep), "survivors")
        settled = (thresholds.join(survivors.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left")
                   .where((F.col("threshold") == 0) | (F.col("n") >= top)).select("lang"))
        found.append(survivors.join(settled, "lang", "left_semi"))
        open_languages, rank = thresholds.join(settled, "lang", "left_anti"), 4 * rank
    phrases = pairs.where("false").select(
        "lang", *[F.col("pair").alias(c) for c in ("first", "second", "third")], "a", "l", "r", "score")
    for more in found:
        phrases = phrases.unionByName(more)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = phrases.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= top).drop("rank")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spell(first, words).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
