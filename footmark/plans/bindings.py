"""The driver tables read as evidence.

Each function derives one evidence table from the given tables, row by row, so
it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.functions.timeconv import MICROS_1601_TO_1970, SECONDS_1970_TO_2001
from footmark.operators.artifacts import ARTIFACT_SCHEMA, record_id
from footmark.plans import samples as S
from footmark.session import prepare
from footmark.sources.sinks import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its times as UTC timestamps."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def pick(values: list[str], n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def own_ids(column: str, name: str) -> list[Column]:
    """Case, profile and an id that is unique only within them, from a number."""
    n = F.col(column)
    return [F.concat(F.lit("C"), (n % 4).cast("string")).alias("case_id"), F.concat(F.lit("u"), (n % 3).cast("string")).alias("user_profile"),
            F.floor(n / 12).cast("bigint").alias(name)]


def _every(n: Column, step: int, value: Column | str) -> Column:
    return F.when(n % step == 0, value)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` from their properties and the case they belong to."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("case_id"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as artifacts of five platforms."""
    k, n = F.col("k"), F.col("event_id").cast("string")
    platform = (F.when(F.col("event_type") == "click", "ChatGPT").when(F.col("event_type") == "view", "Claude")
                .when(F.col("event_type") == "purchase", "Gemini").when(F.col("event_type") == "signup", "DeepSeek")
                .otherwise("Unknown"))
    rows = events(spark, sf_dir).withColumns({
        "seq": F.col("event_id"),
        "user_profile": F.col("user_id").cast("string"),
        "suspected_platform": platform,
        "artifact_family": pick(S.FAMILIES, k),
        "artifact_type": pick(S.TYPES, k),
        "artifact_subtype": pick(S.SUBTYPES, k),
        "artifact_path": F.concat(F.lit("/ev/"), F.col("user_id").cast("string"), F.lit("/"), k.cast("string")),
        "parser_used": pick(S.PARSERS, k),
        "timestamp_type": F.lit("Created"),
        "extracted_indicator": F.when(k % len(S.INDICATORS) == 7, "").otherwise(F.concat(pick(S.INDICATORS, k), n)),
        "suspected_model": pick(S.MODELS, k),
        "access_mode": pick(S.MODES, k),
        "classification": F.when(F.col("value") >= 20, "Direct").when(k % 3 == 0, "Circumstantial").otherwise("Inferred"),
        "attribution_layer": pick(S.LAYERS, k),
        "initial_confidence": F.when(F.col("value") >= 50, "Moderate").otherwise("Low"),
        "notes": pick(S.NOTES, k),
        "source_class": F.lit("Unknown"),
        "acquisition_source": pick(S.SOURCES, F.col("event_id")),
        "platform_surface": pick(S.SURFACES, F.col("event_id")),
        "persistence_state": F.lit("Not Observed Within Scope"),
        "related_link_id": F.coalesce(_every(k, 29, n), F.lit("")),
        "related_asset_id": F.coalesce(_every(k, 31, n), F.lit("")),
        "related_voice_id": F.coalesce(_every(k, 23, n), F.lit("")),
        "ts": F.when(k % 10 != 0, F.col("ts")),
        "tz_norm": k % 2 == 0,
    }).withColumn("record_id", record_id("event", "event_id"))
    return rows.select(*ARTIFACT_SCHEMA.names)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case: the kind of image, and what follows from it."""
    n = F.substring("case_id", 2, 9).cast("int")
    return events(spark, sf_dir).select("case_id").distinct().select(
        "case_id", pick(S.IMAGES, n).alias("image_type"), (n == 0).alias("full_disk_available"),
        (n % 2 == 0).alias("carving_enabled"), (n % 3).alias("profiles"))


def _raw_time() -> dict[str, Column]:
    at, k = F.unix_micros("ts"), F.col("k")
    seconds = F.floor(at / 1_000_000).cast("bigint")
    kinds = ["webkit", "unix_us", "filetime", "cocoa", "unix_ms", "unix_s"]
    raw = (
        F.when(k % 10 == 0, F.lit(0)).when(k % 6 == 0, at + MICROS_1601_TO_1970).when(k % 6 == 1, at)
        .when(k % 6 == 2, (at + MICROS_1601_TO_1970) * 10 + 7).when(k % 6 == 3, seconds - SECONDS_1970_TO_2001)
        .when(k % 6 == 4, F.floor(at / 1000).cast("bigint")).otherwise(seconds))
    return {"raw_time": raw, "time_kind": pick(kinds, k)}


BROWSERS = ["Chrome", "Firefox", "Edge", "Safari", "Brave", "Samsung"]


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as URL visits; every 50th has no URL."""
    n = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", "case_id", F.col("user_id").cast("string").alias("user_profile"),
        pick(BROWSERS, "k").alias("browser"),
        F.when(n % 50 != 0, F.concat(pick(S.URLS, n), n.cast("string"))).alias("url"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("Page "), "event_type")).alias("title"),
        F.col("k").alias("visit_count"), *[c.alias(a) for a, c in _raw_time().items()], F.col("ts").alias("visit_ts"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    name = F.concat(pick(S.FILE_HEADS, F.floor(n / 3)), n.cast("string"), pick(S.FILE_TAILS, F.floor(n / 2)))
    return events(spark, sf_dir).select(
        "event_id", "case_id", F.col("user_id").cast("string").alias("user_profile"), pick(BROWSERS, "k").alias("browser"),
        F.concat(F.lit("C:\\Users\\a\\Downloads/"), name).alias("target_path"),
        F.concat(pick(S.URLS, n), F.lit("dl")).alias("tab_url"), (F.col("k") * 1000).alias("total_bytes"),
        *[c.alias(a) for a, c in _raw_time().items()], F.lit("text/plain").alias("mime_type"))


def cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", "case_id", F.col("user_id").cast("string").alias("user_profile"), pick(BROWSERS, "k").alias("browser"),
        pick(S.HOSTS, "event_id").alias("host_key"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("name"),
        *[c.alias(a) for a, c in _raw_time().items()])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: whole text with a marker behind it."""
    n = F.col("doc_id")
    name = F.concat(pick(S.FILE_HEADS, n), n.cast("string"), pick(S.FILE_TAILS, F.floor(n / 5)))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("C"), (n % 4).cast("string")).alias("case_id"),
        F.concat(F.lit("u"), (n % 7).cast("string")).alias("user_profile"), pick(BROWSERS, n).alias("browser"),
        name.alias("name"), F.concat(F.lit("/Users/u"), (n % 7).cast("string"), F.lit("/Downloads/"), name).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600).alias("mtime"), F.col("n_chars").alias("size"),
        F.concat("text", F.lit("\n"), pick(S.MARKERS, n)).alias("text"))


def log_lines(spark: SparkSession, sf_dir: str, logcat: bool = False) -> DataFrame:
    stamp = F.date_format("ts", "MM-dd HH:mm:ss" if logcat else "yyyy-MM-dd HH:mm:ss")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("line_no"), "case_id", F.col("user_id").cast("string").alias("user_profile"),
        F.concat(F.lit("/log/"), "event_type").alias("path"),
        F.concat(stamp, F.lit(".123 host: "), pick(S.LOG_TEXTS, "event_id")).alias("line"))


def text_files(rows: DataFrame, order: str, per_file: int) -> str:
    """Writes lines as text files of so many numbers of ``order`` each, in its order; the folder they are in.

    Input columns: case_id, the order, line.
    """
    root = new_folder(rows.sparkSession)
    files = rows.withColumn("file_no", F.floor(F.col(order) / per_file))
    (files.repartition("case_id", "file_no").sortWithinPartitions("case_id", "file_no", order)
     .select("case_id", "file_no", "line").write.partitionBy("case_id", "file_no").text(root))
    return root


def file_of(path: str = "path") -> list[Column]:
    """Case and number of a file that ``text_files`` wrote."""
    return [F.replace("case_id", F.lit("case_id="), F.lit("")).alias("case_id"),
            F.regexp_extract(path, "file_no=([0-9]+)", 1).cast("bigint").alias("file_no")]


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", "case_id", pick(S.KEY_LABELS, "k").alias("key_label"), pick(S.KEY_VALUES, n).alias("value"),
        pick(S.URLS, n).alias("origin_url"), pick(S.KEY_VALUES, F.floor(n / 2)).alias("data_url"),
        pick(BROWSERS, "k").alias("agent"), pick(S.PROGRAMS, n).alias("display_name"),
        pick(S.KEY_VALUES, F.floor(n / 3)).alias("install_location"), F.concat(F.lit("key"), "event_type").alias("key_name"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id", "case_id", "ts", pick(S.PACKAGES, "event_id").alias("package"),
        _every(k, 3, k).alias("wifi_in"), (k % 2).alias("wifi_out"), F.lit(0).cast("bigint").alias("wwan_in"),
        _every(k, 5, k * 2).alias("wwan_out"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as names of executed programs and as registry paths."""
    return events(spark, sf_dir).select(
        "event_id", "case_id", pick(S.EXECUTIONS, "event_id").alias("name"), pick(S.KNOWN_PATHS, "k").alias("key_path"),
        pick(S.EVIDENCE_PATHS, "event_id").alias("path"), F.col("ts").alias("mtime"))


def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", "case_id", pick([e for e, _ in S.EXTENSIONS], n).alias("ext_id"),
        pick([m for _, m in S.EXTENSIONS], n).alias("manifest"), F.col("k").cast("string").alias("version"),
        pick(S.PROGRAMS, n).alias("name"), pick(S.LOG_TEXTS, F.floor(n / 2)).alias("description"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an export: one row per conversation with its turns as a mapping."""
    turns = table(spark, sf_dir, "conversations")
    node = F.struct(F.struct(
        F.struct(F.col("role").alias("role"), F.lit(None).cast("string").alias("name")).alias("author"),
        F.struct(F.array("text").alias("parts")).alias("content"),
        (F.lit(1_700_000_000.0) + F.col("turn") * 60).alias("create_time"),
        F.struct(F.when(F.col("turn") % 3 == 0, "gpt-4o").alias("model_slug")).alias("metadata")).alias("message"))
    grouped = turns.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.lpad(F.col("turn").cast("string"), 6, "0").alias("key"), node.alias("value"))))).alias("mapping"))
    n = F.col("conv_id")
    slugs = ["gpt-4", "gpt-4-turbo", "o-model", "claude-3-opus-x", ""]
    return grouped.select(
        F.concat(F.lit("C"), (n % 4).cast("string")).alias("case_id"), F.lit("u").alias("user_profile"),
        F.concat(F.lit("/x/"), n.cast("string"), F.lit("/conversations.json")).alias("path"), n.cast("string").alias("id"),
        F.concat(F.lit("Talk "), n.cast("string")).alias("title"), (F.lit(1_700_000_000.0) + n * 60).alias("create_time"),
        F.lit(None).cast("double").alias("update_time"), pick(slugs, n).alias("default_model_slug"),
        pick(slugs, n).alias("model_slug"), F.lit(None).cast("string").alias("model"),
        F.when(n % 5 == 0, "claude web").alias("source"),
        F.when(n % 3 == 0, F.array(F.lit("p1"), F.lit("p2"))).alias("plugin_ids"),
        F.lit(None).cast("string").alias("gizmo_id"), "mapping")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an inventory of tools."""
    n = F.col("p_partkey")
    key = n.cast("string")
    categories = ["Web Assistant", "Local LLM", "IDE Extension", "Image Generator", "Native Assistant", "API Credential",
                  "Terminal CLI", "AI IDE"]
    surfaces = F.when(n % 5 == 0, F.array(F.lit("BROWSER"))).when(n % 5 == 1, F.array(F.lit("DESKTOP_APP"))).when(
        n % 5 == 2, F.array(F.lit("DESKTOP_APP"), F.lit("BROWSER"))).when(
        n % 5 == 3, F.array(F.lit("TERMINAL"), F.lit("DOCKER_CONTAINER"))).otherwise(
        F.array(F.lit("DESKTOP_APP"), F.lit("SELF_HOSTED_REMOTE")))
    windows = F.array(F.concat(F.lit("%LocalAppData%/Tools/t"), key), F.concat(F.lit("%ProgramFiles%\\t"), key),
                      F.concat(F.lit("%UserProfile%/.t"), key, F.lit("*/config")))
    mac = F.array(F.concat(F.lit("~/Library/t"), key), F.concat(F.lit("/Applications/t"), key, F.lit(".app")))
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), key).alias("tool_id"), F.col("p_name").alias("tool_name"), pick(categories, n).alias("category"),
        F.when(n % 4 == 0, F.array(F.lit("macOS"))).otherwise(F.array(F.lit("Windows"), F.lit("macOS"))).alias("platform_supported"),
        surfaces.alias("execution_surface"),
        F.create_map(F.lit("Windows"), F.when(n % 9 == 0, empty).otherwise(windows), F.lit("macOS"), mac)
        .alias("artifact_path_candidates"),
        F.lit("folder").alias("detection_method"),
        pick(["", "Remote use.", "API key file", "portable, cloud sync"], n).alias("notes"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of files that order lines stand for."""
    n, l = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    user = F.concat(F.lit("Users/u"), (F.col("l_suppkey") % 2).cast("string"))
    path = (
        F.when(l == 1, F.concat(user, F.lit("/AppData/Local/Tools/t"), n)).when(l == 2, F.concat(F.lit("Program Files/t"), n))
        .when(l == 3, F.concat(user, F.lit("/.t"), n, F.lit("x/config"))).when(l == 4, F.concat(user, F.lit("/Library/t"), n))
        .otherwise(F.concat(user, F.lit("/Documents/t"), n)))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), (F.col("l_orderkey") % 4).cast("string")).alias("case_id"), path.alias("path"))


def case_os(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).select("case_id", F.when(F.col("case_id") == "C3", "macOS").when(
        F.col("case_id") == "C2", "Linux").otherwise("Windows").alias("os"))


def case_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), (F.col("l_orderkey") % 4).cast("string")).alias("case_id"),
        F.concat(F.lit("u"), (F.col("l_suppkey") % 2).cast("string")).alias("user_profile")).distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor runs: nations as extractors, regions of customers as cases."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), (F.col("c_custkey") % 4).cast("string")).alias("case_id"),
        F.concat(F.lit("X"), F.col("c_nationkey").cast("string")).alias("extractor"),
        pick(S.EXTRACTOR_STATUS, "c_nationkey").alias("status"), F.lit("1.0.0").alias("version")).distinct()
