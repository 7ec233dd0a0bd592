"""Pattern hits inside long texts: counts, values, offsets, redaction, first hits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions.rules import RuleBook
from footmark.operators.artifacts import as_artifacts

# hit type, regular expression, platform, and a lower-case string that every match contains (or none)
Pattern = tuple[str, str, str, str | None]


# --- fixed values: a plain lower-case string inside every match, per pattern -------
MODEL_ANCHORS = ["gpt-4", "gpt-3.5-turbo", "claude-3", "claude-2", "gemini-", "dall", "whisper-", "codex"]
EXPORT_ANCHORS = ['"model"', '"model"', '"conversation_id"', '"message_id"', '"author"', '"parts"']
TOKEN_ANCHORS = ["sk-", "sk-ant-", "sess-"]


def hit_patterns(keywords: list[str] = ()) -> list[Pattern]:
    """The scan's patterns in order; own keywords come last and are taken literally."""
    return (
        [("Domain Hit", p, platform, p.replace("\\", "").split(".*")[0].lower()) for p, platform in V.HIT_DOMAINS]
        + [("Model Name Hit", p, V.UNKNOWN, a) for p, a in zip(V.HIT_MODELS, MODEL_ANCHORS)]
        + [("Export Marker", p, V.UNKNOWN, a) for p, a in zip(V.HIT_EXPORT_MARKERS, EXPORT_ANCHORS)]
        + [("Platform Token", p, platform, a) for (p, platform), a in zip(V.HIT_TOKENS, TOKEN_ANCHORS)]
        + [("Generic String", re.escape(k), V.UNKNOWN, k.lower()) for k in keywords]
    )


def _flagged(kind: str, pattern: str) -> str:
    return pattern if kind == "Platform Token" else "(?i)" + pattern


def scan_hit_values(df: DataFrame, text_col: str, patterns: list[Pattern]) -> DataFrame:
    """Every hit as a row with its type, pattern number, platform and text; stays in the JVM.

    A pattern runs only on texts that contain its anchor.  Token hits keep a
    placeholder instead of the secret.
    """
    none = F.array().cast("array<struct<pattern_no:int,hit_type:string,platform:string,matched:string>>")

    def hits(i: int, kind: str, pattern: str, platform: str, anchor: str | None) -> Column:
        found = F.regexp_extract_all(F.col(text_col), F.lit(_flagged(kind, pattern)), 0)
        rows = F.transform(found, lambda m: F.struct(
            F.lit(i).alias("pattern_no"), F.lit(kind).alias("hit_type"), F.lit(platform).alias("platform"),
            (F.lit(V.TOKEN_PLACEHOLDER) if kind == "Platform Token" else m).alias("matched")))
        return rows if anchor is None else F.when(
            F.contains(F.col("text_lower"), F.lit(anchor)), rows).otherwise(none)

    keep = [c for c in df.columns if c != text_col]
    every = F.flatten(F.array(*[hits(i, *p) for i, p in enumerate(patterns)]))
    # A filter on the anchors would be pushed below the lower-case text and lower it once for each of them.
    return df.withColumn("text_lower", F.lower(text_col)).select(*keep, F.explode(every).alias("hit")).select(*keep, "hit.*")


#: Runs that hold every secret: each token pattern begins like this and goes on with these letters only, so that matches
#: which overlap lie in one run.
SECRET_RUN = r"(?:sk-|sess-|AIza)[A-Za-z0-9_-]{20,}"
#: Steps of running sums that are added up in one go.
STEPS = 256


def as_latin(data: Column) -> Column:
    """Bytes as a text with one character for each byte: character positions are byte positions."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def _latin_pattern(kind: str, pattern: str) -> str:
    """A pattern for bytes read as characters; a line ends at a line feed only."""
    return ("(?d)" if kind == "Platform Token" else "(?id)") + pattern.encode().decode("latin-1")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(steps: Column) -> Column:
    """Sums of an array's first, first two, first three, ... numbers.

    Arrays grow by copies, so sums are taken over parts of the array and shifted by the sums of the parts before.
    """
    def append(zero: str) -> Column:
        return F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast(zero).alias("out"))

    def one_part(part: Column) -> Column:
        return F.aggregate(part, append("array<bigint>"), lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")))

    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(STEPS))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda at: one_part(F.slice(steps, at, STEPS)))
    shifted = F.aggregate(parts, append("array<array<bigint>>"), lambda acc, part: F.struct(
        (acc["sum"] + part["sum"]).alias("sum"),
        F.concat(acc["out"], F.array(F.transform(part["out"], lambda x: x + acc["sum"]))).alias("out")))
    return F.flatten(shifted["out"])


SPOT = "array<struct<offset:bigint,pattern_no:int,length:int>>"


def _anchored(lowered: Column, patterns: list[Pattern]) -> Column:
    """Numbers of the patterns whose anchor a text has; plain search, and none of the patterns is run."""
    anchors = F.array(*[F.lit(a if a is not None and a.isascii() else "") for *_, a in patterns])
    return F.filter(F.array(*[F.lit(i) for i in range(len(patterns))]), lambda i: F.contains(lowered, F.get(anchors, i)))


def _spots(latin: Column, numbers: Column, patterns: list[Pattern]) -> Column:
    """Places of all hits of the numbered patterns, in (offset, pattern) order: lengths of what lies between matches, added up.

    Patterns are a constant array, so the expression is one whatever their number.
    """
    regexes = F.array(*[F.lit(_latin_pattern(kind, p)) for kind, p, *_ in patterns])

    def of(i: Column) -> Column:
        regex = F.get(regexes, i)

        def steps(lengths: Column) -> Column:
            gaps = F.transform(F.split(latin, regex, -1), lambda g: F.length(g).cast("bigint"))
            # the last gap lies behind the last match and starts nothing
            return F.slice(F.zip_with(gaps, F.concat(F.array(F.lit(0)), lengths), lambda g, m: g + m), F.lit(1), F.size(lengths))

        def found(lengths: Column) -> Column:
            return _let(steps(lengths), lambda s: F.zip_with(running_sum(s), lengths, lambda at, n: F.struct(
                at.alias("offset"), i.alias("pattern_no"), n.alias("length"))).cast(SPOT))

        return _let(F.transform(F.regexp_extract_all(latin, regex, 0), lambda m: F.length(m)), found)

    return F.array_sort(F.flatten(F.transform(numbers, of)))


def _covered(latin: Column) -> Column:
    """Bytes with every secret covered, so that no context shows one, not that of a neighbour either."""
    gaps, secrets = F.split(latin, SECRET_RUN, -1), F.regexp_extract_all(latin, F.lit(SECRET_RUN), 0)
    stars = F.transform(secrets, lambda s: F.repeat(F.lit("*"), F.length(s)))
    covered = F.array_join(F.zip_with(gaps, stars, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return F.encode(F.when(F.rlike(latin, F.lit(SECRET_RUN)), covered).otherwise(latin), "ISO-8859-1")


HIT = "array<struct<offset:bigint,pattern_no:int,length:int,matched:string,context:string>>"


def _hits(latin: Column, numbers: Column, patterns: list[Pattern]) -> Column:
    """All hits of a text in order, with what they matched and what stands around them; secrets are covered."""
    secret = F.array(*[F.lit(kind == "Platform Token") for kind, *_ in patterns])
    spans = F.array(*[F.lit(128 if kind == "Export Marker" else 64) for kind, *_ in patterns])

    def described(spot: Column, safe: Column) -> Column:
        i, at = spot["pattern_no"], spot["offset"].cast("int")
        first = F.greatest(at - F.get(spans, i), F.lit(0))
        around = F.replace(M.lenient_text(F.substring(safe, first + 1, at + F.get(spans, i) - first)), F.lit("\0"), F.lit(""))
        return F.struct(
            spot["offset"].alias("offset"), i.alias("pattern_no"), spot["length"].alias("length"),
            F.when(F.get(secret, i), V.TOKEN_PLACEHOLDER).otherwise(M.lenient_text(F.substring(safe, at + 1, spot["length"]))).alias("matched"),
            F.when(F.get(secret, i), V.TOKEN_CONTEXT).otherwise(F.left(around, F.lit(256))).alias("context"))

    return _let(_spots(latin, numbers, patterns), lambda spots: F.when(
        F.size(spots) > 0, _let(_covered(latin), lambda safe: F.transform(spots, lambda s: described(s, safe)).cast(HIT)))
        .otherwise(F.array().cast(HIT)))


def _named(rows: DataFrame, keep: list[str], patterns: list[Pattern]) -> DataFrame:
    """Hits as columns, with their pattern's type and platform."""
    def of_pattern(n: int) -> Column:
        return F.get(F.array(*[F.lit(p[n]) for p in patterns]), F.col("hit.pattern_no"))

    return rows.select(*keep, "hit.pattern_no", of_pattern(0).alias("hit_type"), of_pattern(2).alias("platform"), "hit.offset",
                       "hit.length", "hit.matched", "hit.context")


def scan_hits(df: DataFrame, text_col: str, patterns: list[Pattern], cap: int | None = None) -> DataFrame:
    """Every hit with byte offset, length and context, numbered in (offset, pattern) order per text.

    Texts are read as characters of one byte each, so all of it is SQL functions.  ``cap`` keeps the first hits per
    text, for callers who want that.
    """
    keep = [c for c in df.columns if c != text_col]
    rows = df.withColumns({"latin": as_latin(F.col(text_col)), "text_lower": F.lower(text_col)})
    numbers = _anchored(F.col("text_lower"), patterns)
    found = rows.select(*keep, F.posexplode(_hits(F.col("latin"), numbers, patterns)).alias("hit_no", "hit"))
    if cap is not None:
        found = found.where(F.col("hit_no") < cap)
    return _named(found, [*keep, "hit_no"], patterns)


def scan_ranges(ranges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Every hit of files read in ranges (``sources.ranges``), found once: in the range in which it starts.

    Matches may be as long as ranges overlap.  Offsets count from the beginning of the file.
    """
    keep = [c for c in ranges.columns if c not in ("first", "start", "stop", "data")]
    rows = ranges.withColumn("latin", as_latin(F.col("data"))).withColumn("text_lower", F.lower("latin"))
    numbers = _anchored(F.col("text_lower"), patterns)
    found = rows.select(*keep, "first", "start", "stop", F.explode(_hits(F.col("latin"), numbers, patterns)).alias("hit"))
    here = F.col("first") + F.col("hit.offset")
    inside = found.where((here >= F.col("start")) & (here < F.col("stop")))
    return _named(inside, [*keep, "first"], patterns).withColumn("offset", F.col("first") + F.col("offset")).drop("first")


def redact_key(key: Column) -> Column:
    """First eight and last four characters of a key, never the rest."""
    return F.concat(F.left(key, F.lit(8)), F.lit("..."), F.right(key, F.lit(4)))


def redact_text(text: Column) -> Column:
    """Text with every token replaced by the placeholder."""
    return F.regexp_replace(text, "|".join(f"(?:{p})" for p, _ in V.HIT_TOKENS), V.TOKEN_PLACEHOLDER)


def first_hits(hits: DataFrame, keys: list[str], order: str = "offset") -> DataFrame:
    """The hit with the smallest offset per key.

    An aggregate, not a window: every task passes on one row per key at most,
    so a source with most of the hits does not end up in one task.
    """
    rest = [c for c in hits.columns if c not in keys and c != order]
    if not rest:  # a plain minimum is a hash aggregate
        return hits.groupBy(*keys).agg(F.min(order).alias(order))
    return hits.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("first")).select(*keys, "first.*")


def first_rule_hits(df: DataFrame, source: str, text_col: str, rules: RuleBook) -> DataFrame:
    """First hit per (source, kind, platform, pattern) of long texts: domains, cookie domains, models, keys, processes.

    Model and storage keys of fewer than four characters and process names of
    fewer than five are ignored.  ``offset`` is the character position.
    """
    kinds = {"domain": 0, "cookie_domain": 0, "model": 4, "ls_key": 4, "process": 5}
    by_word: dict[str, list] = {}
    for r in (r for k, n in kinds.items() for r in rules.of(k) if len(r.pattern) >= n):
        by_word.setdefault(r.pattern.lower(), []).append(r)
    words = sorted(by_word)
    # A filter on the lower-case text would be pushed below it and lower the text once for each word; a generator is not.
    constants = F.array(*[F.lit(w) for w in words])
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("text_lower"), F.lit(w)), F.lit(i)) for i, w in enumerate(words)]))
    rows = df.withColumn("text_lower", F.lower(text_col)).select(source, "text_lower", F.explode(found).alias("word_no"))
    at = F.position(F.get(constants, F.col("word_no")), F.col("text_lower")).cast("bigint")
    first = first_hits(rows.select(source, "word_no", at.alias("offset")), [source, "word_no"])
    told = df.sparkSession.createDataFrame([(i, r.kind, r.platform, r.pattern) for i, w in enumerate(words) for r in by_word[w]],
                                           "word_no int, kind string, platform string, pattern string")
    return first.join(told, "word_no").groupBy(source, "kind", "platform", "pattern").agg(F.min("offset").alias("offset"))


def memory_keys(df: DataFrame, source: str, text_col: str, most: int | None = None) -> DataFrame:
    """Distinct keys per source, redacted, with a digest that tells keys of one beginning and end apart.

    All of them, or the smallest ``most`` for a report that wants so many.
    """
    keys = df.select(source, F.explode(F.regexp_extract_all(
        F.col(text_col), F.lit(V.MEMORY_KEY_PATTERN), 0)).alias("key"))
    platform = M.chain([(F.col("key").startswith("sk-ant"), F.lit("Claude")),
                        (F.col("key").startswith("sk-"), F.lit("ChatGPT")),
                        (F.col("key").startswith("AIza"), F.lit("Gemini"))], F.lit(V.UNKNOWN))
    distinct = keys.select(source, redact_key(F.col("key")).alias("redacted"), platform.alias("platform"),
                           F.sha2("key", 256).alias("key_hash")).distinct()
    if most is None:
        return distinct
    from pyspark.sql import Window
    w = Window.partitionBy(source).orderBy("redacted", "platform", "key_hash")
    # Spark keeps only the first rows of each group on the map side for this filter.
    return distinct.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def cap_hits(hits: DataFrame, source: str, most: int) -> DataFrame:
    """The first hits per source in (offset, pattern) order: the report's cap, only on request."""
    from pyspark.sql import Window
    w = Window.partitionBy(source).orderBy("offset", "pattern_no")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def hit_artifacts(hits: DataFrame) -> DataFrame:
    """Hits as artifacts, always Low. Input: the columns of ``scan_hits`` with case_id and evidence_id."""
    at = F.concat(F.lit("0x"), F.lower(F.hex("offset")))
    kind = F.col("hit_type")
    return as_artifacts(
        hits, "hit", ["evidence_id", "offset", "pattern_no"],
        artifact_family=F.when(kind == "Export Marker", V.CONTENT).otherwise(V.FILE_SYSTEM),
        artifact_type=F.concat(F.lit("Raw Hit ("), kind, F.lit(")")),
        artifact_subtype=F.concat(F.lit("raw_"), kind), artifact_path=F.concat(F.lit("raw_stream@"), at),
        parser_used="HitExtractor", extracted_indicator=F.col("matched"), suspected_platform=F.col("platform"),
        attribution_layer=F.when(kind == "Model Name Hit", "Model").when(kind == "Export Marker", "Content")
        .otherwise("Platform"),
        initial_confidence="Low",
        notes=F.concat(F.lit("[RAW] offset="), at, F.lit(", len="), F.col("length").cast("string"),
                       F.lit(", type="), kind, F.lit(", pattern="), "matched"),
    )


def blob_artifacts(blobs: DataFrame) -> DataFrame:
    """Sniffed blobs as artifacts, never above Moderate.

    Input columns: case_id, path, name, offset, recovered_size, rule, validation, confidence_hint.
    """
    export = F.col("rule") == "ChatGPT_Export"
    at = F.concat(F.lit("0x"), F.lower(F.hex("offset")))
    return as_artifacts(
        blobs, "blob", ["path", "offset", "rule"],
        artifact_family=F.when(export, V.CONTENT).otherwise(V.FILE_SYSTEM),
        artifact_type=F.concat(F.lit("Carved File ("), "rule", F.lit(")")),
        artifact_subtype=F.concat(F.lit("carved_"), "rule"), artifact_path=F.col("path"),
        parser_used="BlobExtractor", extracted_indicator=F.col("name"),
        suspected_platform=F.when(export, "ChatGPT").otherwise(V.UNKNOWN),
        attribution_layer=F.when(export, "Platform").otherwise("Content"),
        initial_confidence=F.when(F.col("confidence_hint") == "High", "Moderate").otherwise(F.col("confidence_hint")),
        notes=F.concat(F.lit("[CARVED] offset="), at, F.lit(", size="), F.col("recovered_size").cast("string"),
                       F.lit(", rule="), "rule", F.lit(", validation="), "validation",
                       F.lit(", mode=Signature Carving")),
    )
