"""Similarity join of documents on word shingles by the chosen-path method.

A document is the set of its runs of five words.  Documents with one set are a class; one member speaks for it.  A run
is a path: classes are split on the token of one of the signature's coordinates, the shingle of smallest hash there,
which two sets share with the probability of their similarity.  Small nodes are searched by brute force on the
signatures, and so are large ones in which many pairs are near, in tiles; the others go on along the run's path and are
split on its next coordinate.  What is still large at the end of the path is compared in tiles.

A pair stays together for d steps with probability threshold ** d, so more runs are needed the longer paths are.
``runs_for`` says how many; classes that were in a large node after d - 1 steps take part in all runs that d steps need.
So a pair at the threshold is missed with probability 1 - ``recall`` at most, whatever the size of its nodes.

Candidates are kept as spanning links of each node, never as all its pairs.  Classes that hang together are verified
exactly on their whole sets, in tasks of at most ``TILE`` classes against as many; they count the links of each class
and return spanning links only.  So a group of n similar texts costs comparisons but gives n rows.

Words are separated by white space and compared unchanged.  Nulls and edge cases: a text of one to four words has one
shingle, all its words; a text without words has no links; a null ``doc_id`` cannot be named: its class is null and it
has no links; rows with one id and different texts each get a row; repeated rows are copies of each other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices, stage
from footmark.llm.substring import WORDS, hashed_runs, mixed

COORDINATES = 48
SALTS = np.random.default_rng(3).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Signatures that agree in this part of the coordinates are verified; five standard deviations below a similarity of 0.8.
AGREE = 0.5
SMALL = 1000  # classes of a node that are searched by brute force
TILE = 2048
ROW = "_row_of_the_join"
SAMPLE, NEAR = 64, 0.25  # classes of a large node that are compared, and the part of their pairs that makes it near


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    words = text.encode().split() if text else []
    hashes = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    return np.unique(hashed_runs(hashes, min(n, len(hashes)))) if len(hashes) else hashes


def signature(tokens: np.ndarray) -> np.ndarray:
    """Smallest hash of a token for each coordinate."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(tokens), 4096):
        part = (tokens[at:at + 4096, None] * SALTS) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, set_id (null without words), sig."""

    def work(batches):
        for batch in slices(batches):
            found = [shingles(t, n) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "set_id": [set_id(s) if len(s) else None for s in found],
                   "sig": [signature(s).tobytes() for s in found]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, set_id long, sig binary")


def whole_runs(batches, key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a key, in pieces that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield joined(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if cut:
            yield joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


# --- splitting -------------------------------------------------------------------------------------------------
def child(path: np.ndarray, coordinate: int, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(path + (np.uint64(coordinate) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) ^ token.astype(np.uint64))


def coordinate_of(run: int, step: int, depth: int) -> int:
    """The coordinate of a run's step.  Runs take the coordinates in turn, in another order each time all were taken, so
    the first 48 / ``depth`` runs share none and are independent."""
    turn, place = divmod(run * depth + step, COORDINATES)
    return int(np.random.default_rng(turn).permutation(COORDINATES)[place])


def runs_for(threshold: float, recall: float, steps: int) -> int:
    """Runs after which a pair at the threshold has parted in all of them, within so many steps, with probability
    1 - ``recall`` at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** steps))


def begin(classes: DataFrame, runs: range, steps: int, depth: int) -> DataFrame:
    """path, run, set_id of the nodes of each class after the first steps of these runs."""
    plan = [(r, [coordinate_of(r, s, depth) for s in range(steps)]) for r in runs]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = batch.column("set_id").to_numpy(), matrix(batch.column("sig"))
            for r, coordinates in plan:
                path = mixed(np.full(len(ids), r + 1, np.uint64) * np.uint64(0xA24BAED4963EE407))
                for c in coordinates:
                    path = child(path, c, sig[:, c])
                yield {"path": path.view(np.int64), "run": np.full(len(ids), r, np.int32), "set_id": ids}

    return arrow_map(classes.select("set_id", "sig"), work, "path long, run int, set_id long")


def proceed(rows: DataFrame, step: int, depth: int) -> DataFrame:
    """The nodes of path, run, set_id, sig rows after one step more: one row for each."""
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            run, path, sig = batch.column("run").to_numpy(), batch.column("path").to_numpy().view(np.uint64).copy(), matrix(batch.column("sig"))
            for r in np.unique(run).tolist():
                c, own = coordinate_of(r, step, depth), run == r
                path[own] = child(path[own], c, sig[own, c])
            yield {"path": path.view(np.int64), "run": run, "set_id": batch.column("set_id")}

    return arrow_map(rows.select("path", "run", "set_id", "sig"), work, "path long, run int, set_id long")


def components(adjacent: np.ndarray) -> np.ndarray:
    """Number of the first row of each row's component."""
    label = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                near = adjacent[front].any(axis=0) & (label < 0)
                label[near] = i
                front = np.flatnonzero(near)
    return label


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = np.zeros((len(a), len(b)), np.uint8)
    for i in range(COORDINATES):
        same += a[:, i, None] == b[None, :, i]
    return same >= AGREE * COORDINATES


def node_links(nodes: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the classes of each node whose signatures agree; rows sorted by node within partitions."""

    def work(batches):
        for batch in whole_runs(batches, "path"):
            path, ids, sig = batch.column("path").to_numpy(), batch.column("set_id").to_numpy(), matrix(batch.column("sig"))
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            size = np.diff(edge)
            first = edge[:-1][size == 2]
            near = (sig[first] == sig[first + 1]).sum(axis=1) >= AGREE * COORDINATES
            a, b = [ids[first[near]]], [ids[first[near] + 1]]
            for at, n in zip(edge[:-1][size > 2], size[size > 2]):
                own = np.argsort(ids[at:at + n]) + at
                root = components(agreeing(sig[own], sig[own]))
                other = root != np.arange(n)
                a.append(ids[own[root[other]]])
                b.append(ids[own[other]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    return arrow_map(nodes, work, "a long, b long")


def near_nodes(large: DataFrame) -> DataFrame:
    """path of the nodes in which a quarter of the pairs of about ``SAMPLE`` classes agree.  Splits keep such classes
    together, and most of their pairs have to be verified anyway: they are searched at once."""
    sample = large.where(F.pmod(F.xxhash64("path", "set_id"), F.col("n")) < SAMPLE).select("path", "sig")

    def work(batches):
        for batch in whole_runs(batches, "path"):
            path, sig = batch.column("path").to_numpy(), matrix(batch.column("sig"))
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            own = [(a, b) for a, b in zip(edge[:-1], edge[1:]) if b - a > 1]
            yield {"path": [path[a] for a, b in own if agreeing(sig[a:b], sig[a:b]).sum() - (b - a) >= NEAR * (b - a) * (b - a - 1)]}

    return arrow_map(sample.repartition("path").sortWithinPartitions("path"), work, "path long")


def tiles(rows: DataFrame, size: str, most: int, key: str, *members: str) -> DataFrame:
    """Each group of more than ``most`` rows becomes pairs of tiles of about ``most`` rows; a row goes to the pairs of
    its tile.  Adds ``group`` (the pair), ``tile`` (0 for the first tile of a pair, 1 for the second), ``tiled``, and
    ``within`` (the pair is one tile with itself)."""
    n = F.ceil(F.col(size) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(1)), n).cast("int")
    pairs = F.when(n == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y"))))
    out = rows.withColumn("own", own).withColumn("pair", F.explode(pairs))
    return out.select(F.xxhash64(key, "pair").alias("group"), *([key] if key not in members else []), *members,
                      F.when(F.col("own") == F.col("pair.x"), 0).otherwise(1).alias("tile"), (n > 1).alias("tiled"),
                      (F.col("pair.x") == F.col("pair.y")).alias("within"))


def candidates(classes: DataFrame, threshold: float, recall: float, depth: int) -> DataFrame:
    """Links (a, b) between classes that may be similar, spanning those of each node.  ``classes`` is a written table."""
    each = 1 - (1 - recall) / depth  # a pair may be missed at every length of path
    found = []

    def searched(level: DataFrame, name: str, most: int) -> DataFrame:
        """Searches the nodes of at most that many classes; the rows of the others."""
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        nodes = stage(level.join(sizes.hint("merge"), "path").join(classes.hint("merge"), "set_id"), f"nodes-{name}")
        small, large = nodes.where(F.col("n") <= most), nodes.where(F.col("n") > most)
        if not large.isEmpty():
            near = stage(near_nodes(large), f"near-{name}")
            small = small.unionByName(large.join(near, "path", "left_semi").select(*small.columns))
            large = large.join(near, "path", "left_anti").select(*nodes.columns)
        links = node_links(small.select("path", "set_id", "sig", "n").transform(dense).repartition("path").sortWithinPartitions("path"))
        found.append(stage(links.distinct(), f"links-{name}"))
        return large

    runs = runs_for(threshold, each, 1)
    level = begin(classes, range(runs), 1, depth)
    for steps in range(1, depth + 1):
        large = searched(level, str(steps), SMALL if steps < depth else 1 << 62)
        if steps == depth or large.isEmpty():
            break
        crowded = stage(classes.join(large.select("set_id").distinct().hint("merge"), "set_id").select(*classes.columns), "crowded")
        before, runs = runs, max(runs, runs_for(threshold, each, steps + 1))
        level = proceed(large, steps, depth).unionByName(begin(crowded, range(before, runs), steps + 1, depth))
    return reduce(DataFrame.unionByName, found).distinct()


def dense(nodes: DataFrame) -> DataFrame:
    """Nodes that are still too large after the last split, as pairs of tiles."""
    paired = tiles(nodes, "n", 4 * SMALL, "path", "set_id", "sig")
    return paired.select(F.col("group").alias("path"), "set_id", "sig")


# --- components ------------------------------------------------------------------------------------------------
def smallest_reachable(links: DataFrame) -> DataFrame:
    """set_id, label: the smallest id of each component.  Labels go to neighbours and to the label's own label until
    nothing changes; each round is a written table."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(both.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["set_id"]).groupBy(F.col("a").alias("set_id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "set_id").select("set_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("set_id").alias("label"), F.col("label").alias("up"))
        new = stage(stepped.join(up, "label", "left").select("set_id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"),
                    "labels")
        labels = new.select("set_id", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels


# --- verification ----------------------------------------------------------------------------------------------
def shared_tokens(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.cumsum(count > 1) - 1
    use = count[number] > 1
    rows, number = rows[use], kept[number[use]]
    total = np.zeros((len(left), len(right)), np.float32)
    width = int((count > 1).sum())
    for at in range(0, width, 4096):
        part = (number >= at) & (number < at + 4096)
        x = np.zeros((len(sets), min(4096, width - at)), np.float32)
        x[rows[part], number[part] - at] = 1
        total += x[left] @ x[right].T
    return total


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """For each class of a group its links and, from untiled groups, its component; spanning links from tiled ones.

    kind 0: set_id, label (smallest document of the component), links; kind 1: set_id is linked with label."""

    def work(batches):
        for batch in whole_runs(batches, "group"):
            group, ids = batch.column("group").to_numpy(), batch.column("set_id").to_numpy()
            doc, copies = batch.column("doc").to_numpy(), batch.column("copies").to_numpy()
            tile, tiled, within = batch.column("tile").to_numpy(), batch.column("tiled").to_pylist(), batch.column("within").to_pylist()
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for a, b in zip(edge[:-1], edge[1:]):
                own = np.unique(ids[a:b], return_index=True)[1] + a  # once each, should rows repeat
                sets = [np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64) for i in own.tolist()]
                yield links_of(ids[own], doc[own], copies[own], sets, tile[own], tiled[a], within[a], threshold)

    return arrow_map(groups, work, "kind int, set_id long, label long, links long")


def links_of(ids, doc, copies, sets, tile, tiled: bool, within: bool, threshold: float) -> dict:
    size = np.array([len(s) for s in sets], np.float32)
    left = np.flatnonzero(tile == 0)
    right = left if within else np.flatnonzero(tile == 1)
    common = shared_tokens(sets, left, right)
    linked = common >= threshold * (size[left, None] + size[None, right] - common) - 1e-4
    if within:
        np.fill_diagonal(linked, False)
    out = {"kind": [], "set_id": [], "label": [], "links": []}

    def add(kind, own, label, links):
        for name, values in zip(out, ([kind] * len(own), own, label, links)):
            out[name].extend(values)

    whole = linked if within else np.block([[np.zeros((len(left),) * 2, bool), linked], [linked.T, np.zeros((len(right),) * 2, bool)]])
    rows = left if within else np.r_[left, right]
    root = components(whole)
    smallest = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, doc[rows])
    counts = (whole * copies[rows][None, :]).sum(axis=1) if len(rows) < 512 else whole.astype(np.float64) @ copies[rows]
    add(0, ids[rows], smallest[root] if not tiled else [None] * len(rows), counts.astype(np.int64))
    if tiled:
        other = root != np.arange(len(rows))
        add(1, ids[rows][other], ids[rows][root[other]], [0] * int(other.sum()))
    return out


def join_similar(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, depth: int = 3) -> DataFrame:
    """doc_id, class_id (smallest id among the documents that hang together by links), copy_of (smallest id with the
    same set), n_links (other documents that are similar enough, copies among them)."""
    sets = stage(sets_of(docs, n), "sets")
    named = sets.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    members = stage(named.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes")
    signatures = stage(named.join(members, (named["doc_id"] == members["doc"]) & (named["set_id"] == members["set_id"]))
                       .select(named["set_id"], "sig").dropDuplicates(["set_id"]), "signatures")
    maybe = smallest_reachable(candidates(signatures, threshold, recall, depth))
    sizes = maybe.groupBy("label").agg(F.count("*").alias("n"))
    wanted = stage(maybe.join(sizes, "label").join(members, "set_id"), "wanted")

    def tokens(batches):
        for batch in slices(batches):
            rows = [shingles(t, n) for t in batch.column("text").to_pylist()]
            keep = pa.array([len(s) > 0 and set_id(s) == k for s, k in zip(rows, batch.column("set_id").to_pylist())])
            part = batch.filter(keep)
            yield {**{c: part.column(c) for c in ("label", "n", "set_id", "doc", "copies")},
                   "tokens": [s.tobytes() for s, k in zip(rows, keep.to_pylist()) if k]}

    # A merge join at every size: the wanted classes grow with the documents.  Repeated rows meet in their group.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted.hint("merge"), "doc")
    told = arrow_map(texts.select("label", "n", "set_id", "doc", "copies", "text"), tokens,
                     "label long, n long, set_id long, doc long, copies long, tokens binary")
    groups = tiles(told, "n", TILE, "label", "set_id", "doc", "copies", "tokens")
    results = stage(verified(groups.repartition("group").sortWithinPartitions("group"), threshold), "verified")
    links = results.where("kind = 0").groupBy("set_id").agg(F.max("label").alias("label"), F.sum("links").alias("links"))
    spanning = results.where("kind = 1")
    if not spanning.isEmpty():
        reached = smallest_reachable(spanning.select(F.least("set_id", "label").alias("a"), F.greatest("set_id", "label").alias("b")))
        first = reached.join(members, "set_id").groupBy("label").agg(F.min("doc").alias("doc"))
        own = reached.join(first, "label").select("set_id", F.col("doc").alias("reached"))
        links = links.join(own, "set_id", "left").withColumn("label", F.coalesce("label", "reached")).drop("reached")
    labelled = members.join(links, "set_id", "left").select(
        F.col("set_id").alias("own"), "doc", "copies", F.coalesce("label", "doc").alias("label"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    named = F.col("doc_id").isNotNull()
    return sets.join(labelled, (sets["set_id"] == labelled["own"]) & named, "left").select(
        "doc_id", F.coalesce("label", "doc_id").alias("class_id"), F.coalesce("doc", "doc_id").alias("copy_of"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"))


def one_per_class(docs: DataFrame, **settings) -> DataFrame:
    """One row of each class with all its columns: that of the smallest id (null last), one of them if rows repeat.

    Rows are judged, not ids: of two rows with one id and different texts, one may stay and one go.  A row without
    words is a class of its own.  The rows are written once with a number each, so that all that follows means the same.
    """
    numbered = stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = join_similar(numbered.select(F.col(ROW).alias("doc_id"), "text"), **settings)
    ids = numbered.select(F.col(ROW).alias("doc_id"), F.col("doc_id").alias("id"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "doc_id")
    kept = found.join(ids, "doc_id").groupBy("class_id").agg(F.min(place)["doc_id"].alias(ROW)).select(ROW)
    return numbered.join(kept, ROW, "left_semi").select(*docs.columns)
