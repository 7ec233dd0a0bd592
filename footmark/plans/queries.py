"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions import timeconv
from footmark.functions.rules import Rule, RuleBook, default_rules
from footmark.operators import (
    artifacts as art, content, cube, enrich, episodes, exports, hits, links, reports, scoring, timeline, tools,
    traces, usage, visits)
from footmark.plans import bindings as B
from footmark.plans import samples as S
from footmark.sources import files, ranges, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RULES = default_rules()
# Rules that fit the host names of the pages table, in this order.
PAGE_RULES = RuleBook([Rule("domain", 0, "pills", "P1"), Rule("domain", 1, "example.net", "P2"),
                       Rule("domain", 2, "example.org", "P3")])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def us(column: str, name: str | None = None) -> Column:
    """A time as microseconds since 1970, the same in every time zone."""
    return F.unix_micros(column).alias(name or f"{column}_us")


def joined(column: str, name: str | None = None) -> Column:
    return F.array_join(column, "|").alias(name or column)


def big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich(B.artifacts(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(links.link(enriched(spark, d)), B.coverage(spark, d))


def hours(spark: SparkSession, d: str) -> DataFrame:
    return cube.hourly_cube(scored(spark, d))


def plain(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts for results that show no score: neither links nor caps are computed."""
    return enriched(spark, d).withColumn("confidence", F.col("initial_confidence"))


def counted_hours(spark: SparkSession, d: str) -> DataFrame:
    """The cube for results that show no score."""
    return cube.hourly_cube(plain(spark, d))


def all_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.episodes(counted_hours(spark, d), B.coverage(spark, d))


# --- sources -------------------------------------------------------------------

@query
def read_visits(spark, d):
    rows = B.visits(spark, d).withColumn("at", timeconv.to_ts_by_kind(F.col("raw_time"), F.col("time_kind")))
    return rows.select("event_id", "browser", "url", us("at"))


@query
def log_line_times(spark, d):
    full = B.log_lines(spark, d).select("line_no", timeconv.log_time(F.col("line")).alias("at"))
    short = B.log_lines(spark, d, logcat=True).select(
        "line_no", timeconv.short_log_time(F.col("line"), 2023).alias("dated"))
    return full.join(short, "line_no").select("line_no", us("at"), us("dated"))


@query
def read_cookies(spark, d):
    """Cookie tables of two browsers; the last access counts, else the creation."""
    at, k, n = F.unix_micros("ts"), F.col("k"), F.col("event_id")
    rows = B.events(spark, d).withColumn("user_profile", F.col("user_id").cast("string")).withColumn("name", n.cast("string"))
    webkit, root = at + timeconv.MICROS_1601_TO_1970, sinks.new_folder(spark)
    rows.where(n % 2 == 0).select(
        "case_id", "user_profile", F.lit("a.example").alias("host_key"), "name", (webkit - 5_000_000).alias("creation_utc"),
        F.when(k % 3 == 0, 0).when(k % 5 != 0, webkit).alias("last_access_utc")).write.parquet(f"{root}/chrome")
    rows.where(n % 2 == 1).select(
        "case_id", "user_profile", F.lit("b.example").alias("host"), "name", (at - 7_000_000).alias("creationTime"),
        at.alias("lastAccessed")).write.parquet(f"{root}/firefox")
    cookies = tables.read_cookies(spark, {"Chrome": f"{root}/chrome", "Firefox": f"{root}/firefox"})
    return cookies.select("case_id", "user_profile", "browser", "host_key", "name",
                          us_of(timeconv.to_ts_by_kind(F.col("raw_time"), F.col("time_kind"))))


@query
def utf16_texts(spark, d):
    """Values stored as UTF-16 with a zero character and rubbish behind it."""
    raw = F.concat(F.encode(F.concat("text", F.lit("\0 rubbish")), "UTF-16LE"), F.lit(b"x"))
    return B.table(spark, d, "documents").select("doc_id", F.md5(timeconv.utf16_text(raw)).alias("text_hash"))


@query
def log_file_lines(spark, d):
    """Lines of log files, numbered in each file."""
    root = B.text_files(B.log_lines(spark, d), "line_no", 10_000)
    return files.read_log_lines(spark, root).select(*B.file_of(), "line_no", F.md5("line").alias("line_hash"))


@query
def install_times(spark, d):
    raw = F.concat(F.lit("0x"), F.lower(F.hex(F.unix_millis("ts"))))
    rows = B.events(spark, d).withColumn("raw", F.when(F.col("k") % 2 == 0, raw).otherwise(
        F.unix_millis("ts").cast("string")))
    return rows.select("event_id", us_of(timeconv.install_time(F.col("raw"))))


def us_of(col: Column) -> Column:
    return F.unix_micros(col).alias("at_us")


@query
def acquisition_quality(spark, d):
    n = F.col("o_orderkey")
    size = F.concat(F.lit("0x"), F.hex(F.floor(F.col("o_totalprice")).cast("bigint")))
    state = F.when((F.col("o_custkey") % 5 == 0) & (n % 3 == 0), "-").when(n % 7 == 0, "/").otherwise("+")
    line = F.when(n % 11 == 0, "# comment").otherwise(F.concat_ws("  ", F.lit("0x00"), size, state))
    lines = B.table(spark, d, "orders").select(F.col("o_custkey").alias("evidence_id"), line.alias("line"))
    return usage.acquisition_quality(lines)


@query
def history_item_visits(spark, d):
    items = B.table(spark, d, "pages").select(*B.own_ids("page_id", "item_id"), "url")
    page = F.floor(F.col("event_id") / 4).cast("bigint")
    seen = B.table(spark, d, "events").withColumn("page", page).select(*B.own_ids("page", "item_id"), "event_id", "ts")
    return usage.history_visits(items, seen).select("case_id", "user_profile", "item_id", "url", "event_id", us("ts"))


@query
def annotated_downloads(spark, d):
    notes = B.table(spark, d, "lineitem").select(
        *B.own_ids("l_orderkey", "place_id"), F.floor(F.col("l_suppkey") / 12).cast("bigint").alias("attribute_id"),
        F.concat(F.lit("file:///f"), F.col("l_partkey").cast("string")).alias("content"))
    places = B.table(spark, d, "orders").select(
        *B.own_ids("o_orderkey", "place_id"), F.concat(F.lit("https://h"), F.col("o_custkey").cast("string")).alias("url"))
    names = B.table(spark, d, "supplier").select(
        *B.own_ids("s_suppkey", "attribute_id"), F.when(F.col("s_nationkey") % 5 == 0, "dest").otherwise("other").alias("name"))
    found = usage.annotated_downloads(notes, places, names, "dest")
    return found.groupBy("url").agg(F.count("*").alias("n"), F.min("target_path").alias("first_target"))


@query
def app_usage(spark, d):
    objects = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("object_id"), *B.own_ids("o_custkey", "metadata_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "/app/usage").otherwise("/display").alias("stream"),
        (F.col("o_orderkey") * 10).alias("start_raw"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 300).alias("end_raw"))
    # A third of the metadata rows have ids that no object has.
    metadata = B.table(spark, d, "customer").select(*B.own_ids("c_custkey", "metadata_id"), "c_custkey").select(
        "case_id", "user_profile", F.when(F.col("c_custkey") % 3 == 0, -1 - F.col("metadata_id")).otherwise(F.col("metadata_id")).alias("metadata_id"),
        B.pick(S.PACKAGES, "c_custkey").alias("bundle_id"))
    found = traces.match_package(usage.app_usage(objects, metadata), RULES, "bundle_id")
    return found.select("object_id", "case_id", "user_profile", "bundle_id", "platform", "seconds")


@query
def app_traffic(spark, d):
    found = traces.match_traffic(B.packages(spark, d), RULES)
    return found.select("event_id", "package", "platform", big("total_bytes"))


@query
def latest_usage_rows(spark, d):
    rows = B.events(spark, d).select("case_id", "event_id", us("ts"))
    return usage.latest(rows, 500, F.desc("ts_us"), "case_id")


@query
def replace_by_key(spark, d):
    rows = B.events(spark, d).select("user_id", "event_type", "event_id", "k")
    return usage.replace_by_key(rows, ["user_id", "event_type"], "event_id")


# --- classification --------------------------------------------------------------

@query
def visits_by_platform(spark, d):
    found = visits.classify_visits(B.visits(spark, d), RULES)
    return found.select("event_id", "url", "platform", "domain", "model")


@query
def page_visits(spark, d):
    url = F.lower("url")
    rows = B.table(spark, d, "pages").withColumn("platform", M.match_platform(url, PAGE_RULES.of("domain")))
    strict = M.match_host_suffix(F.col("url"), PAGE_RULES.of("domain"))
    return rows.select("page_id", "url", "platform", strict.alias("host_platform"))


@query
def visit_artifacts(spark, d):
    rows = visits.visit_artifacts(B.visits(spark, d), RULES)
    return rows.select("case_id", "record_id", "user_profile", "artifact_subtype", "extracted_indicator",
                       "suspected_platform", "suspected_model", "notes", us("ts"), "tz_norm")


@query
def downloads_by_platform(spark, d):
    rows = visits.classify_downloads(B.downloads(spark, d), RULES)
    return rows.select("event_id", "platform", "target_path")


@query
def cookies_by_platform(spark, d):
    return visits.classify_cookies(B.cookies(spark, d), RULES).select("event_id", "host_key", "platform")


@query
def model_mentions(spark, d):
    text = F.lower("text")
    rows = B.files(spark, d).select("doc_id", M.match_model(text, RULES.of("model")).alias("model"))
    return rows.where(F.col("model").isNotNull())


@query
def file_names_by_platform(spark, d):
    return content.match_filename(B.files(spark, d), RULES).select("doc_id", "name", "platform", "pattern")


@query
def screenshots_by_platform(spark, d):
    return content.match_screenshot(B.files(spark, d), RULES).select("doc_id", "name", "platform")


@query
def content_remnants(spark, d):
    rows = content.scan_content(B.files(spark, d).select("doc_id", "text"), RULES)
    return rows.select("doc_id", "remnant", "platform", "model", "indicator")


@query
def unified_log_hits(spark, d):
    return traces.classify_lines(B.log_lines(spark, d), RULES, "unified_log").select("line_no", "platform", "indicator")


@query
def event_log_hits(spark, d):
    return traces.classify_lines(B.log_lines(spark, d), RULES, "event_log").select("line_no", "platform", "indicator")


@query
def logcat_hits(spark, d):
    return traces.classify_lines(B.log_lines(spark, d), RULES, "logcat").select("line_no", "platform", "indicator")


@query
def packages_by_platform(spark, d):
    return traces.match_package(B.packages(spark, d), RULES).select("event_id", "package", "platform")


@query
def storage_keys(spark, d):
    rows = B.files(spark, d).select("doc_id", "text")
    return visits.match_storage_keys(rows, RULES).select("doc_id", "platform", "indicator")


@query
def registry_values(spark, d):
    rows = traces.classify_key_values(B.key_values(spark, d), RULES)
    return rows.select("event_id", "key_label", "value", "platform", "confidence", "classification")


@query
def plist_values(spark, d):
    return traces.classify_key_values(B.key_values(spark, d), RULES, "plist").select("event_id", "value", "platform")


@query
def quarantine_events(spark, d):
    return traces.classify_key_values(B.key_values(spark, d), RULES, "quarantine").select("event_id", "platform")


@query
def registry_subkeys(spark, d):
    return traces.classify_subkeys(B.key_values(spark, d), RULES).select("event_id", "value", "platform")


@query
def folder_navigation(spark, d):
    return traces.classify_subkeys(B.key_values(spark, d), RULES, folders=True).select("event_id", "value", "platform")


@query
def installed_programs(spark, d):
    return traces.classify_installs(B.key_values(spark, d), RULES).select("event_id", "display_name", "platform")


@query
def registered_applications(spark, d):
    rows = B.key_values(spark, d).select("event_id", F.col("display_name").alias("name"), "value")
    return traces.classify_installs(rows, RULES, registered=True).select("event_id", "name", "platform")


@query
def known_registry_keys(spark, d):
    rows = B.traces(spark, d).select("event_id", "key_path")
    return traces.match_known_paths(rows, RULES, "registry_key", "key_path").select("event_id", "platform", "known")


@query
def bundle_plists(spark, d):
    rows = B.packages(spark, d).select("event_id", F.concat("package", F.lit(".plist")).alias("name"))
    return traces.match_known_paths(rows, RULES, "bundle_id", "name").select("event_id", "platform", "known")


@query
def execution_traces(spark, d):
    return traces.classify_execution(B.traces(spark, d), RULES).select("event_id", "name", "platform", "rule")


@query
def cleanup_tools(spark, d):
    return traces.detect_cleanup(B.traces(spark, d)).select("event_id", "name", "tool")


@query
def recent_files(spark, d):
    return traces.classify_recent(B.files(spark, d), RULES).select("doc_id", "name", "platform", "pattern")


@query
def deleted_files(spark, d):
    return traces.classify_deleted(B.files(spark, d), RULES).select("doc_id", "name", "platform", "pattern")


@query
def toolchain_traces(spark, d):
    return visits.detect_toolchain(B.visits(spark, d)).select("event_id", "url", "trace", "tool")


@query
def api_key_names(spark, d):
    rows = visits.detect_api_config(B.files(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", joined("key_names"))


@query
def browser_extensions(spark, d):
    rows = visits.classify_extensions(B.extensions(spark, d))
    return rows.select("event_id", "ext_id", "platform", "classification", "confidence", "ext_name")


@query
def browser_addons(spark, d):
    return visits.classify_addons(B.extensions(spark, d)).select("event_id", "platform")


@query
def latest_manifests(spark, d):
    rows = B.extensions(spark, d).select("case_id", "ext_id", "version", "manifest")
    return visits.latest_manifest(rows)


@query
def recovered_visits(spark, d):
    rows = B.visits(spark, d).select(
        "case_id", F.regexp_replace("url", "[0-9]+$", "").alias("url"), "title", F.col("event_id").alias("seq"))
    return visits.classify_recovered(rows, RULES, "visits").select("case_id", "url", "platform", "title", "seq")


@query
def recovered_cookies(spark, d):
    rows = B.cookies(spark, d).select("case_id", "host_key", "name", F.col("event_id").alias("seq"))
    return visits.classify_recovered(rows, RULES, "cookies").select("case_id", "host_key", "name", "platform", "seq")


@query
def recovered_downloads(spark, d):
    rows = B.downloads(spark, d).select(
        "case_id", F.regexp_replace("target_path", "[0-9]+", "").alias("target_path"), "tab_url",
        F.col("event_id").alias("seq"))
    return visits.classify_recovered(rows, RULES, "downloads").select(
        "case_id", "target_path", "tab_url", "platform", "seq")


@query
def any_table_scan(spark, d):
    return visits.scan_table(B.key_values(spark, d), "key_values", RULES)


@query
def context_urls(spark, d):
    domains = list(dict.fromkeys(r.pattern for r in RULES.of("domain")))
    return content.context_urls(B.files(spark, d).select("doc_id", "text"), domains)


@query
def evidence_classes(spark, d):
    return B.traces(spark, d).select("event_id", content.evidence_class(F.col("path")).alias("evidence_class"))


@query
def rule_matches(spark, d):
    """Every rule that fits, not only the first one: URLs per domain rule."""
    found = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(r.pattern)), F.lit(r.pattern))
                               for r in RULES.of("domain")]), lambda p: p.isNotNull())
    rows = B.visits(spark, d).select("event_id", F.lower("url").alias("low"))
    return rows.select(F.explode(found).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


# --- exports, links, hits, blobs -----------------------------------------------------

@query
def export_replay(spark, d):
    rows = exports.replay_exports(B.exports(spark, d), RULES)
    return rows.select("case_id", "artifact_path", "artifact_type", "artifact_subtype", "suspected_model",
                       "extracted_indicator", us("ts"))


@query
def export_files(spark, d):
    rows = B.files(spark, d).withColumn("name", F.element_at(F.array(*[F.lit(x) for x in (
        "conversations.json", "User.json", "claude_conversations.json", "threads.json", "x.json")]),
        (F.col("doc_id") % 5).cast("int") + 1))
    folder = F.when(F.col("doc_id") % 3 == 0, "/a/My Activity/").otherwise("/a/b/")
    rows = rows.withColumn("path", F.concat(folder, "name"))
    return exports.classify_exports(rows).select("doc_id", "platform", "subtype")


@query
def provider_conversations(spark, d):
    rows = exports.provider_conversations(B.exports(spark, d))
    return rows.select("id", "platform", "model_name", us("created"))


@query
def shared_links(spark, d):
    rows = content.extract_shared_links(B.files(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", big("pos"), "url", "platform")


KEYWORDS = ["token =", "example.net"]


@query
def hit_counts(spark, d):
    rows = B.files(spark, d).select("doc_id", "text")
    found = hits.scan_hit_values(rows, "text", hits.hit_patterns(KEYWORDS))
    return found.groupBy("doc_id", "pattern_no", "hit_type", "platform").agg(
        F.count("*").alias("n"), F.min("matched").alias("first_matched")).withColumn("pattern_no", big("pattern_no"))


def all_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = B.files(spark, d).select(F.col("doc_id").alias("evidence_id"), "case_id", "text")
    return hits.scan_hits(rows, "text", hits.hit_patterns(KEYWORDS))


@query
def hit_offsets(spark, d):
    return all_hits(spark, d).select(
        F.col("evidence_id").alias("doc_id"), big("hit_no"), big("pattern_no"), "hit_type", "platform", "offset",
        big("length"), "matched")


@query
def hit_artifacts(spark, d):
    return hits.hit_artifacts(all_hits(spark, d)).select(
        "case_id", "record_id", "artifact_family", "artifact_path", "extracted_indicator", "suspected_platform",
        "attribution_layer", "notes")


@query
def capped_hits(spark, d):
    """The first three hits of each text, for a report that wants so many."""
    return hits.cap_hits(all_hits(spark, d), "evidence_id", 3).select(
        F.col("evidence_id").alias("doc_id"), big("pattern_no"), "offset", "matched")


@query
def keyword_offsets(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id", "text")
    found = hits.scan_hits(rows, "text", [("Generic String", "token", "Unknown", "token")])
    return hits.first_hits(found.select("doc_id", "pattern_no", "offset", "matched"), ["doc_id", "pattern_no"]).select(
        "doc_id", big("pattern_no"), big("offset"))


@query
def file_hits(spark, d):
    """Hits in files that are read in ranges: documents of a case, some hundred to a file."""
    rows = B.files(spark, d).select("case_id", "doc_id", F.col("text").alias("line"))
    inventory = files.file_inventory(spark, B.text_files(rows, "doc_id", 500)).where(F.col("size") > 0)
    found = hits.scan_ranges(ranges.read_ranges(inventory, size=1 << 18), hits.hit_patterns(KEYWORDS))
    return found.select(*B.file_of(), big("pattern_no"), "hit_type", "platform", "offset", big("length"), "matched")


@query
def file_sizes(spark, d):
    """The inventory of the same files."""
    rows = B.files(spark, d).select("case_id", "doc_id", F.col("text").alias("line"))
    inventory = files.file_inventory(spark, B.text_files(rows, "doc_id", 500))
    return inventory.select(*B.file_of(), "ext", "size")


@query
def redacted_text(spark, d):
    text = hits.redact_text(F.col("text"))
    return B.files(spark, d).select("doc_id", F.md5(text).alias("text_hash"), F.length(text).cast("bigint").alias("chars"))


@query
def secrets_left(spark, d):
    """Tokens that redacted texts and the contexts of hits still show."""
    token = "|".join(p for p, _ in V.HIT_TOKENS)
    files = B.files(spark, d).select("doc_id", "text")
    shown = hits.scan_hits(files, "text", hits.hit_patterns(["token"])).select(
        F.lit("context").alias("place"), F.concat_ws(" ", "matched", "context").alias("shown"))
    texts = files.select(F.lit("text").alias("place"), hits.redact_text(F.col("text")).alias("shown"))
    return texts.unionByName(shown).groupBy("place").agg(F.count_if(F.rlike("shown", F.lit(token))).alias("left"))


@query
def redacted_keys(spark, d):
    return hits.memory_keys(B.files(spark, d).select("doc_id", "text"), "doc_id", "text")


@query
def first_rule_hits(spark, d):
    rows = B.files(spark, d).select("case_id", F.col("text").alias("body"))
    found = hits.first_rule_hits(rows.withColumnRenamed("case_id", "source"), "source", "body", RULES)
    return found.select("source", "kind", "platform", "pattern", "offset")


def blob_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blobs: some get the header or footer of a format."""
    n = F.col("doc_id")
    head = B.pick(["%PDF-1.7\n", "<html>", "# ", '{"', '[{"title":', "GIF8", "PK\x03\x04", "", "BM"], n)
    tail = B.pick(["%%EOF", "</html>", "", "\x00;"], n)
    return B.files(spark, d).select("doc_id", F.encode(F.concat(head, "text", tail), "UTF-8").alias("content"))


@query
def blob_formats(spark, d):
    from footmark.sources.rules import blob_rules
    return content.sniff_blobs(blob_files(spark, d), blob_rules(spark)).select(
        "doc_id", "rule", "validation", "platform", "recovery_status", "confidence_hint")


@query
def generated_assets(spark, d):
    rows = B.files(spark, d).withColumn("content", F.encode(
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("c2pa "), "text"))
        .when(F.col("doc_id") % 9 == 1, '{"prompt": "x", "size": 3}').otherwise(F.col("text")), "UTF-8"))
    found = content.detect_assets(rows)
    return found.select("doc_id", "method", "asset_type", "platform", "file_hash")


@query
def stripped_images(spark, d):
    name = F.concat(F.lit("dall-e-"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    head = F.unhex(F.when(F.col("doc_id") % 3 == 0, "FFD8FFE1").otherwise("FFD8FFDB"))
    rows = B.files(spark, d).select("doc_id", name.alias("name"), "size", F.concat(
        head, F.encode("text", "UTF-8")).alias("content"))
    return content.detect_stripped_images(rows).select("doc_id", "name", "size")


@query
def manifests(spark, d):
    rows = B.files(spark, d).select("doc_id", B.pick(S.MANIFESTS, "doc_id").alias("manifest"))
    return content.classify_manifests(rows).select("doc_id", "ai_detected", "platform", "confidence", "classification")


@query
def transcripts(spark, d):
    rows = B.files(spark, d).select(
        "doc_id", B.pick(S.TRANSCRIPT_NAMES, "doc_id").alias("name"), F.when(F.col("doc_id") % 6 != 1, F.when(
            F.col("doc_id") % 6 == 3, F.concat(F.lit('{"text":"said '), F.col("doc_id").cast("string"), F.lit('"}'))
        ).otherwise(F.col("text"))).alias("text"))
    found = content.classify_transcripts(rows)
    return found.select("doc_id", "platform", "classification", "confidence",
                        F.length("transcript").cast("bigint").alias("chars"))


# --- tree facts -----------------------------------------------------------------------

def tree(spark: SparkSession, d: str) -> DataFrame:
    names = ["Windows", "Users", "Library", "System", "HomeDomain", "Applications", "ProgramData", "data"]
    return B.events(spark, d).select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("case_id"),
        B.pick(names, (F.col("event_id") + F.col("user_id") * 3) % (F.col("user_id") % 5 + 1)).alias("name"))


@query
def operating_systems(spark, d):
    return traces.detect_os(tree(spark, d))


@query
def image_types(spark, d):
    return traces.image_type(tree(spark, d))


@query
def profiles(spark, d):
    users = ["Public", "alice", "Shared", "Default User", "bob", "All Users"]
    rows = B.events(spark, d).select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("case_id"),
        F.concat(F.lit("/Users/"), B.pick(users, F.col("user_id") % 4 + F.col("event_id") % 2),
                 F.when(F.col("k") % 2 == 0, "/Documents/a.txt").otherwise("")).alias("path"))
    return traces.user_profiles(rows)


@query
def browsers_found(spark, d):
    folders = [f for _, f in V.BROWSER_DIRS] + ["Documents"]
    rows = B.events(spark, d).select("case_id", F.concat(
        F.lit("/Users/u/"), B.pick(folders, F.col("event_id") % (F.col("user_id") % 4 + 1)), F.lit("/x")).alias("path"))
    return traces.browsers_detected(rows).select("case_id", joined("browsers"))


# --- enrichment, links, score ------------------------------------------------------------

@query
def enriched_artifacts(spark, d):
    return enriched(spark, d).select("record_id", "source_class", "acquisition_source", "platform_surface",
                                     "persistence_state")


@query
def base_confidence(spark, d):
    rows = scoring.base_confidence(enriched(spark, d))
    return rows.select("record_id", F.round("score", 9).alias("score"), "confidence")


def link_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x["id"]), "|").alias(column)


@query
def hourly_links(spark, d):
    return links.hourly_links(enriched(spark, d)).select("record_id", link_text("links"))


@query
def all_links(spark, d):
    return links.link(enriched(spark, d)).select(
        "record_id", link_text("links"), links.link_families(F.col("links")).cast("bigint").alias("families"))


@query
def final_confidence(spark, d):
    return scored(spark, d).select("record_id", "confidence", "initial_confidence", "notes")


@query
def acquisition_ceiling(spark, d):
    quality = B.coverage(spark, d).where(F.col("case_id") != "C3").select(
        "case_id", F.when(F.col("case_id") == "C0", "Normal").when(F.col("case_id") == "C1", "Degraded")
        .otherwise("Unknown").alias("quality"))
    rows = B.events(spark, d).select("event_id", "case_id", B.pick(
        ["High", "Moderate", "Low", "Unsupported", "Medium"], "k").alias("confidence_hint"))
    return scoring.cap_acquisition(rows, quality).select("event_id", "confidence_hint")


# --- sessions, footprints, episodes ----------------------------------------------------------

@query
def platform_usage(spark, d):
    """Which platforms were used in a case, in how many sessions, and how surely."""
    rows = reports.footprints(hours(spark, d), B.coverage(spark, d))
    return rows.select(
        "case_id", "suspected_platform", "total", "direct", "inferred", "earliest_us", "latest_us", big("sessions"),
        "image_indicators", "export_indicators", "prompt_remnants", "response_remnants", "model", "access_mode",
        "overall_confidence", joined("caveats"))


@query
def platform_summaries(spark, d):
    rows = reports.platform_summary(counted_hours(spark, d))
    return rows.withColumns({"families": joined("families"), "access_modes": joined("access_modes")})


@query
def episode_sessions(spark, d):
    return episodes.episode_sessions(B.artifacts(spark, d)).select("record_id", big("session_no"))


@query
def episode_members(spark, d):
    rows = episodes.episode_members(B.artifacts(spark, d))
    return rows.groupBy(*episodes.EPISODE, "role").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).withColumn(
        "session_no", big("session_no"))


@query
def episode_facts(spark, d):
    rows = episodes.episode_facts(counted_hours(spark, d))
    return rows.select(
        "case_id", "suspected_platform", "user_profile", big("session_no"), "artifacts", "direct", "inferred", "timed",
        "families", "source_classes", "start_us", "end_us", "model", "access_mode", "activity", "image_review",
        "persistence", joined("acquisition_sources"), joined("surfaces"), "voice_related", "link_related",
        "asset_related", joined("evidence_classes"))


@query
def episode_levels(spark, d):
    return all_episodes(spark, d).select(
        "case_id", "suspected_platform", "user_profile", big("session_no"), "ready", big("score"), "event_confidence",
        big("claim_rank"), "confidence_class", "present", "coverage_sufficient")


@query
def episode_remarks(spark, d):
    size = [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("boundaries", "caveats", "alternatives")]
    text = [F.md5(F.array_join(c, "|")).alias(c) for c in ("boundaries", "caveats", "alternatives")]
    return all_episodes(spark, d).select(
        "case_id", "suspected_platform", "user_profile", big("session_no"), *size, *text)


@query
def artifact_claims(spark, d):
    promoted = episodes.promote_claims(plain(spark, d), all_episodes(spark, d))
    return promoted.select("record_id", "claim_level")


@query
def confidence_classes(spark, d):
    return reports.confidence_classes(all_episodes(spark, d))


@query
def case_timeline(spark, d):
    return timeline.timeline(scored(spark, d), B.artifacts(spark, d)).select(
        "case_id", "record_id", us("ts"), "event_type", "description", "initial_confidence", "confidence")


@query
def sorted_timeline(spark, d):
    """Events of all cases in order, for a page that shows them one after the other."""
    return timeline.sorted_timeline(timeline.timeline(plain(spark, d))).select("case_id", us("ts"), big("seq"), "record_id", "event_type")


@query
def first_timeline_events(spark, d):
    rows = timeline.first_events(timeline.timeline(plain(spark, d)))
    return rows.select("case_id", big("row_no"), "record_id", "event_type")


@query
def history_gaps(spark, d):
    rows = timeline.history_gaps(B.events(spark, d), ["user_id"])
    return rows.select("user_id", big("gap_no"), us("gap_start"), us("gap_end"), "gap")


@query
def future_stamps(spark, d):
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return timeline.future_stamps(B.events(spark, d), ["user_id"], as_of)


# --- reports -------------------------------------------------------------------------------------

@query
def comparison_matrix(spark, d):
    return reports.matrix(scored(spark, d), B.coverage(spark, d)).select(
        "record_id", "tool_or_model", "evidence_value", "time_quality", "persistence_text", "relevance",
        "coverage_caveat", "comments", "confidence")


@query
def exhibits(spark, d):
    return reports.exhibits(plain(spark, d)).select(
        "case_id", big("exhibit_no"), "record_id", "title", "description", "exhibit_time")


@query
def first_exhibits(spark, d):
    rows = reports.first_exhibits(reports.exhibits(plain(spark, d)))
    return rows.select("case_id", "suspected_platform", big("exhibit_no"), "record_id")


@query
def image_findings(spark, d):
    return reports.image_findings(scored(spark, d), reports.exhibits(plain(spark, d))).select(
        "record_id", "finding", "confidence", big("exhibit_no"))


@query
def event_exhibits(spark, d):
    rows = plain(spark, d)
    found = reports.event_exhibits(timeline.timeline(rows), reports.exhibits(rows))
    return found.select("record_id", us("ts"), big("exhibit_no"))


@query
def exhibit_hashes(spark, d):
    body = F.encode("text", "UTF-8")
    return B.table(spark, d, "documents").select(
        "doc_id", F.md5(body).alias("md5"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"))


@query
def case_totals(spark, d):
    return reports.case_totals(counted_hours(spark, d))


@query
def json_export(spark, d):
    """Case totals written as JSON lines and read again."""
    totals, root = case_totals(spark, d), sinks.new_folder(spark)
    sinks.write_json({"case_totals": totals}, root)
    return spark.read.schema(totals.schema).json(f"{root}/case_totals")


@query
def platform_counts(spark, d):
    return reports.counts_by(B.artifacts(spark, d), "suspected_platform")


@query
def top_confidence(spark, d):
    return reports.top_confidence(hours(spark, d))


@query
def coverage_rollup(spark, d):
    rows = reports.coverage_rollup(B.runs(spark, d), counted_hours(spark, d), B.coverage(spark, d))
    return rows.select("case_id", "image_type", *[joined(c) for c in (
        "succeeded", "failed", "not_applicable", "stubs", "families_found", "families_missing", "limitations")])


@query
def requirement_status(spark, d):
    return reports.requirement_status(counted_hours(spark, d), all_episodes(spark, d))


@query
def governance_facts(spark, d):
    built = counted_hours(spark, d)
    cover = B.coverage(spark, d)
    rolled = reports.coverage_rollup(B.runs(spark, d), built, cover).select("case_id", "families_missing")
    rows = reports.governance_facts(built, cover.join(rolled, "case_id"))
    return rows.select("case_id", *[joined(c) for c in (
        "source_classes", "surfaces", "platforms", "acquisition_gaps", "blind_spots")], "direct", "other")


@query
def drift_register(spark, d):
    rows = reports.drift_register(B.runs(spark, d), F.to_date(F.lit("2024-02-01")))
    return rows.select("case_id", "component", "version", F.col("last_validated").cast("string").alias("last_validated"))


@query
def platform_blind_spots(spark, d):
    return reports.platform_blind_spots(counted_hours(spark, d), reports.blind_spots(spark))


@query
def capability_features(spark, d):
    seen = B.artifacts(spark, d).groupBy("suspected_platform").agg(F.count("*").alias("n"))
    rows = reports.with_capability(seen, reports.capabilities(spark))
    return rows.select("suspected_platform", "n", "export", "voice", "capability_confidence")


@query
def tamper_counts(spark, d):
    return reports.tamper_counts(counted_hours(spark, d))


@query
def validation_results(spark, d):
    base = B.artifacts(spark, d).withColumn("case_id", F.col("user_profile"))
    labels = B.table(spark, d, "labels").groupBy((F.col("doc_id") % 150).cast("string").alias("case_id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    expected = F.array_compact(F.array(F.when(F.col("quality") == 1, "ChatGPT"), F.when(F.col("toxic") == 1, "Claude"),
                                       F.when(F.col("doc_id") % 7 == 0, "Poe")))
    cases = labels.select(
        "case_id", (F.col("doc_id") % 5).alias("phase"), expected.alias("expected"),
        (F.col("doc_id") % 90).alias("min_count"), (F.col("doc_id") % 11 == 0).alias("negative"), F.lit(60).alias("allowed"))
    counted = base.groupBy("case_id", "suspected_platform").agg(F.count("*").alias("n"))
    return reports.validation_results(cases, counted).select("case_id", "phase", joined("expected"), joined("actual"),
                                                             "artifacts", "passed")


@query
def validation_summary(spark, d):
    rows = validation_results(spark, d)
    out = reports.validation_summary(rows)
    return out.select("total", "passed", "failed", F.array_join(F.transform("phases", lambda p: p.cast("string")), "|")
                      .alias("phases"), "state")


@query
def store_health(spark, d):
    n = F.col("o_orderkey")
    rows = B.table(spark, d, "orders").select(
        F.col("o_custkey").alias("evidence_id"),
        B.pick(["MBR", "GPT", "None Detected", "Unknown"], F.col("o_custkey")).alias("scheme"),
        F.when(F.col("o_custkey") % 6 == 0, "Intact").when(F.col("o_custkey") % 6 == 1, "Corrupt")
        .otherwise(B.pick(["Intact", "Degraded", "Corrupt", "Unknown"], n)).alias("health"))
    return reports.store_health(rows)


@query
def recovery_audit(spark, d):
    blobs = B.table(spark, d, "orders").select(F.col("o_custkey").alias("evidence_id"))
    found = B.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("evidence_id"))
    parts = B.table(spark, d, "customer").select(F.col("c_custkey").alias("evidence_id"))
    return reports.recovery_audit(blobs, found, parts).select(
        "evidence_id", "carved", "raw_hits", "partitions", joined("modes"))


@query
def artifact_drilldown(spark, d):
    rows = reports.filter_artifacts(B.artifacts(spark, d), "Claude", "C1")
    return rows.select("record_id", "user_profile", us("ts"))


@query
def run_ledgers(spark, d):
    runs = B.runs(spark, d)
    bad = runs.where(F.col("status") == "Failed").select("case_id", "extractor", F.lit("failure").alias("ledger"))
    stub = runs.where(F.col("status").startswith("Stub")).select("case_id", "extractor", F.lit("gap").alias("ledger"))
    good = runs.where(F.col("status") == "Success").select("case_id", "extractor", F.lit("coverage").alias("ledger"))
    return reports.union_ledgers(good, stub, bad)


# --- tools ---------------------------------------------------------------------------------------

@query
def tool_surfaces(spark, d):
    return tools.surface_class(B.tools(spark, d)).select("tool_id", "surface_class")


@query
def tool_path_templates(spark, d):
    return tools.tool_paths(B.tools(spark, d)).select("tool_id", "os", big("ord"), "template")


@query
def tool_candidates(spark, d):
    rows = tools.expand_tool_paths(tools.tool_paths(B.tools(spark, d)), B.case_profiles(spark, d), B.case_os(spark, d))
    return rows.select("case_id", "tool_id", "candidate", big("ord"))


def all_entries(spark: SparkSession, d: str) -> DataFrame:
    return tools.checklist(B.tools(spark, d), B.case_os(spark, d), B.case_profiles(spark, d), B.inventory(spark, d))


@query
def tool_checklist(spark, d):
    return all_entries(spark, d).select(
        "case_id", "tool_id", "status", joined("paths"), big("artifact_count"), big("class_count"), "corroboration",
        "attribution_scope", "inference_location", "tool_confidence", "coverage_status")


@query
def tool_caveats(spark, d):
    texts = F.array_join(tools.caveat_text(F.col("caveat_flags")), "|")
    return all_entries(spark, d).select("case_id", "tool_id", joined("caveat_flags"), F.md5(texts).alias("texts"))


@query
def tool_ledgers(spark, d):
    # Both ledgers read the entries: they are made once.
    entries = sinks.stage(all_entries(spark, d), "entries", sinks.new_folder(spark))
    rows = tools.coverage_ledger(entries).unionByName(tools.gap_ledger(entries))
    return rows.select("case_id", "tool_id", "ledger", "place", big("evidence_count"), "caveats")


@query
def case_artifacts(spark, d):
    """All extractors of one case collection as one artifact table, counted."""
    every = art.union_artifacts(
        visits.visit_artifacts(B.visits(spark, d), RULES), visits.download_artifacts(B.downloads(spark, d), RULES),
        visits.cookie_artifacts(B.cookies(spark, d), RULES), visits.toolchain_artifacts(B.visits(spark, d)),
        *content.file_artifacts(B.files(spark, d), RULES), visits.storage_key_artifacts(B.files(spark, d), RULES),
        content.shared_link_artifacts(B.files(spark, d)), traces.execution_artifacts(traces_with_path(spark, d), RULES),
        traces.cleanup_artifacts(traces_with_path(spark, d)),
        traces.log_artifacts(B.log_lines(spark, d), RULES, "unified_log"))
    return every.groupBy("case_id", "artifact_family", "artifact_type", "suspected_platform", "parser_used").agg(
        F.count("*").alias("n"), F.count("ts").alias("timed"))


def traces_with_path(spark: SparkSession, d: str) -> DataFrame:
    return B.traces(spark, d).withColumn("path", F.concat(F.lit("/p/"), F.col("event_id").cast("string")))
