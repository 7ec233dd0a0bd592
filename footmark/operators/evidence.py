"""Classified rows as artifacts: registry sub-keys, installs, plists, phone usage, memory and network texts,
manifests, extensions, and signs of tampering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.rules import RuleBook
from footmark.operators import content, hits, timeline, traces, visits
from footmark.operators.artifacts import as_artifacts


def _modified(column: str = "mtime") -> dict[str, Column]:
    at = F.col(column)
    return {"ts": at, "timestamp_type": F.when(at.isNotNull(), "Modified"), "tz_norm": at.isNotNull()}


def _optional(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


# --- Windows and macOS -------------------------------------------------------------
def subkey_artifacts(df: DataFrame, rules: RuleBook, folders: bool = False) -> DataFrame:
    """Input columns: case_id, path, key_label, key_path, value."""
    kind = F.col("key_label") if not folders else F.lit("Folder Navigation")
    found = traces.classify_subkeys(df, rules, folders)
    return as_artifacts(
        found, "folder_key" if folders else "subkey", ["path", "key_path", "value"], artifact_family=V.REGISTRY,
        artifact_type=F.concat(F.lit("Registry — "), kind), artifact_subtype=kind, artifact_path=F.col("path"),
        parser_used="RegistryExtractor", extracted_indicator=F.col("value"), suspected_platform=F.col("platform"),
        classification=F.col("classification"), initial_confidence=F.col("confidence"),
        notes=F.concat(F.lit("Match in key "), "key_path", F.lit(".")))


def install_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, key_label, key_name, display_name, install_location, mtime."""
    shown = F.coalesce("display_name", "key_name")
    return as_artifacts(
        traces.classify_installs(df, rules), "install", ["path", "key_label", "key_name"], artifact_family=V.REGISTRY,
        artifact_type=F.concat(F.lit("Registry — "), "key_label"), artifact_subtype=F.col("key_label"),
        artifact_path=F.col("path"), parser_used="RegistryExtractor",
        extracted_indicator=F.concat(F.lit("Installed: "), shown), suspected_platform=F.col("platform"),
        access_mode="Native App", classification=F.col("classification"), initial_confidence=F.col("confidence"),
        notes=F.concat(F.lit("Installed program. Registry key: "), "key_name"), **_modified())


def registered_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, name, value."""
    return as_artifacts(
        traces.classify_installs(df, rules, registered=True), "registered", ["path", "name", "value", "platform"],
        artifact_family=V.REGISTRY, artifact_type="Registry — RegisteredApplications",
        artifact_subtype="RegisteredApplications", artifact_path=F.col("path"), parser_used="RegistryExtractor",
        extracted_indicator=F.concat("name", F.lit(": "), F.coalesce("value", F.lit(""))),
        suspected_platform=F.col("platform"), access_mode="Native App", classification=F.col("classification"),
        initial_confidence=F.col("confidence"))


def known_key_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path (of the hive), key_path, mtime."""
    return as_artifacts(
        traces.match_known_paths(df, rules, "registry_key", "key_path"), "known_key", ["path", "key_path", "known"],
        artifact_family=V.REGISTRY, artifact_type="Registry — AI Platform Key", artifact_subtype="Known AI Key",
        artifact_path=F.col("path"), parser_used="RegistryExtractor",
        extracted_indicator=F.concat(F.lit("Registry key exists: "), "known"), suspected_platform=F.col("platform"),
        access_mode="Native App", classification="Direct", initial_confidence="High", **_modified())


def plist_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, value."""
    return as_artifacts(
        traces.classify_key_values(df, rules, "plist"), "plist", ["path", "value"], artifact_family=V.PLIST,
        artifact_type="Plist Value", artifact_subtype="AI Reference", artifact_path=F.col("path"),
        parser_used="PlistExtractor", extracted_indicator=F.col("value"), suspected_platform=F.col("platform"),
        classification=F.col("classification"), initial_confidence=F.col("confidence"),
        notes="Value found in plist file. Requires corroboration.")


# --- phones ------------------------------------------------------------------------
def usage_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, bundle_id, at, seconds (null where unknown)."""
    found = traces.match_package(df, rules, "bundle_id")
    length = F.when(F.col("seconds").isNotNull(), F.concat(F.lit(" Duration: "), F.col("seconds").cast("string"), F.lit("s")))
    return as_artifacts(
        found, "app_usage", ["path", "bundle_id", "at"], artifact_family=V.NATIVE, artifact_type="App Usage",
        artifact_subtype="Usage Event", artifact_path=F.col("path"), parser_used="AppUsageExtractor", ts=F.col("at"),
        timestamp_type="Session Start", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat(F.lit("App used: "), "bundle_id"), suspected_platform=F.col("platform"),
        access_mode="Native App", classification="Direct", initial_confidence="High",
        notes=F.concat(F.lit("App usage event."), F.coalesce(length, F.lit(""))))


def traffic_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, package, at, wifi_in, wifi_out, wwan_in, wwan_out."""
    found = traces.match_traffic(df, rules)
    return as_artifacts(
        found, "app_traffic", ["path", "package", "at"], artifact_family=V.NATIVE, artifact_type="Network Usage",
        artifact_subtype="DataUsage Event", artifact_path=F.col("path"), parser_used="AppTrafficExtractor", ts=F.col("at"),
        timestamp_type="Created", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat(F.lit("Network activity: "), "package"), suspected_platform=F.col("platform"),
        access_mode="Native App", classification="Direct", initial_confidence="Moderate",
        notes=F.concat(F.lit("Data usage: "), F.col("total_bytes").cast("string"), F.lit(" bytes")))


# --- memory and network texts ---------------------------------------------------------
def memory_artifacts(df: DataFrame, rules: RuleBook, network: bool = False) -> DataFrame:
    """First domain and model references and the keys of memory texts; domains only of network texts.

    Input columns: case_id, path, text.  Keys are shown redacted.
    """
    source = df.withColumn("source", F.struct("case_id", "path"))
    found = hits.first_rule_hits(source.select("source", "text"), "source", "text", rules)
    kinds = ["domain"] if network else ["domain", "model"]
    rows = found.where(F.col("kind").isin(kinds)).select("source.case_id", "source.path", "kind", "platform", "pattern", "offset")
    model = F.col("kind") == "model"
    if network:
        what = {"artifact_type": "Network AI Traffic", "artifact_subtype": "pcap_domain", "parser_used": "NetworkExtractor",
                "classification": "Direct", "initial_confidence": "High",
                "extracted_indicator": F.concat(F.lit("AI domain in network traffic: "), "pattern")}
    else:
        what = {"artifact_type": F.when(model, "Memory AI Model Reference").otherwise("Memory AI Domain Reference"),
                "artifact_subtype": F.when(model, "memory_model").otherwise("memory_domain"), "parser_used": "MemoryExtractor",
                "attribution_layer": F.when(model, "Model").otherwise("Platform"), "initial_confidence": "Moderate",
                "extracted_indicator": F.when(model, F.concat(F.lit("AI model string in memory: "), "pattern")).otherwise(
                    F.concat(F.lit("AI domain in memory at offset "), F.col("offset").cast("string"), F.lit(": "), "pattern"))}
    out = as_artifacts(rows, "network" if network else "memory", ["path", "kind", "platform", "pattern"], artifact_family=V.NATIVE,
                       artifact_path=F.col("path"), suspected_platform=F.col("platform"), **what)
    if network:
        return out
    keys = hits.memory_keys(source.select("source", "text"), "source", "text").select(
        "source.case_id", "source.path", "redacted", "platform", "key_hash")
    return out.unionByName(as_artifacts(
        keys, "memory_key", ["path", "key_hash"], artifact_family=V.NATIVE, artifact_type="Memory API Key Fragment",
        artifact_subtype="memory_api_key", artifact_path=F.col("path"), parser_used="MemoryExtractor",
        extracted_indicator=F.concat(F.lit("API key in memory: "), "redacted"), suspected_platform=F.col("platform"),
        classification="Direct", initial_confidence="High", notes="API key found in memory. Key redacted for security."))


# --- manifests and extensions ------------------------------------------------------------
def manifest_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, path, name, manifest, mtime."""
    found = content.classify_manifests(df)
    said = F.when(F.col("ai_detected"), " AI-generation assertion detected.").otherwise("")
    return as_artifacts(
        found, "manifest", ["path"], artifact_family=V.CONTENT, artifact_type="C2PA Content Credentials",
        artifact_subtype="c2pa_manifest", artifact_path=F.col("path"), parser_used="ManifestExtractor",
        extracted_indicator=F.concat(F.lit("Content credentials in "), "name"), suspected_platform=F.col("platform"),
        attribution_layer="Content", classification=F.col("classification"), initial_confidence=F.col("confidence"),
        notes=F.concat(F.lit("C2PA manifest found in "), "name", F.lit("."), said), **_modified())


def extension_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, path, ext_id, manifest, mtime."""
    return as_artifacts(
        visits.classify_extensions(df), "extension", ["path", "ext_id"], artifact_family=V.SESSION,
        artifact_type="AI Browser Extension", artifact_subtype="chromium-extension", artifact_path=F.col("path"),
        parser_used="ExtensionExtractor",
        extracted_indicator=F.concat(F.lit("Extension: "), "ext_name", F.lit(" (ID: "), "ext_id", F.lit(")")),
        suspected_platform=F.col("platform"), classification=F.col("classification"), initial_confidence=F.col("confidence"),
        **_modified())


def addon_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, path, name, description."""
    return as_artifacts(
        visits.classify_addons(df), "addon", ["path", "name"], artifact_family=V.SESSION, artifact_type="Firefox AI Extension",
        artifact_subtype="addon", artifact_path=F.col("path"), parser_used="ExtensionExtractor",
        extracted_indicator=F.concat(F.lit("Firefox addon: "), "name"), suspected_platform=F.col("platform"),
        initial_confidence="Moderate")


# --- signs of tampering ---------------------------------------------------------------------
HISTORY_SOURCE = ["case_id", "user_profile", "browser"]


def gap_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, user_profile, browser, ts of each visit."""
    gaps = timeline.history_gaps(df, HISTORY_SOURCE)
    return as_artifacts(
        gaps, "gap", ["user_profile", "browser", "gap_start"], artifact_family=V.HISTORY, artifact_type="History Gap Detected",
        artifact_subtype="temporal_gap", artifact_path=F.concat("browser", F.lit(" history")), parser_used="TamperDetector",
        ts=F.col("gap_start"), timestamp_type="Last Visited", extracted_indicator=F.col("gap"), initial_confidence="Low")


def future_stamp_artifacts(df: DataFrame, as_of: Column) -> DataFrame:
    """Input columns: case_id, user_profile, browser, ts of each visit."""
    late = timeline.future_stamps(df, HISTORY_SOURCE, as_of)
    return as_artifacts(
        late, "future", ["user_profile", "browser"], artifact_family=V.HISTORY, artifact_type="Timestamp Anomaly",
        artifact_subtype="future_timestamp", artifact_path=F.concat("browser", F.lit(" history")), parser_used="TamperDetector",
        extracted_indicator=F.concat(F.col("future_count").cast("string"), F.lit(" entries with future timestamps")),
        initial_confidence="Moderate")


def stripped_image_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, path, name, size, content."""
    return as_artifacts(
        content.detect_stripped_images(df), "stripped", ["path"], artifact_family=V.CONTENT,
        artifact_type="Metadata-Stripped AI Image", artifact_subtype="exif_stripped", artifact_path=F.col("path"),
        parser_used="TamperDetector", extracted_indicator=F.concat(F.lit("AI-named image without EXIF: "), "name"),
        attribution_layer="Content", initial_confidence="Low")


def timed_visits(df: DataFrame) -> DataFrame:
    """Visits of the readers with their time as ``ts``."""
    from footmark.functions.timeconv import to_ts_by_kind
    return df.select(*HISTORY_SOURCE, to_ts_by_kind(F.col("raw_time"), F.col("time_kind")).alias("ts"))
