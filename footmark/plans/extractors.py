"""Extractors by name: registered once, run over all cases, each on its own.

An extractor turns input tables into artifacts.  It may be limited to operating
systems; a failing one is recorded and does not stop the others, because every
output is written on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.functions.rules import RuleBook
from footmark.operators import content, evidence, exports, hits, tools, traces, visits
from footmark.operators.artifacts import ARTIFACT_SCHEMA, union_artifacts
from footmark.sources.sinks import shared_folder

Inputs = dict[str, DataFrame]
RUN_SCHEMA = "extractor string, version string, status string, artifacts bigint, message string"


@dataclass(frozen=True)
class Extractor:
    name: str
    run: Callable[[Inputs, RuleBook], DataFrame]
    needs: tuple[str, ...]
    version: str = "1.0.0"
    systems: tuple[str, ...] = ()


@dataclass
class Registry:
    extractors: dict[str, Extractor] = field(default_factory=dict)

    def register(self, name: str, needs: tuple[str, ...], version: str = "1.0.0", systems: tuple[str, ...] = ()):
        def add(fn: Callable[[Inputs, RuleBook], DataFrame]):
            self.extractors[name] = Extractor(name, fn, needs, version, systems)
            return fn
        return add

    def copy(self) -> Registry:
        return Registry(dict(self.extractors))

    def run_all(self, spark: SparkSession, inputs: Inputs, rules: RuleBook, folder: str,
                case_os: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Artifacts of all extractors, and one row per extractor on how it went."""
        parts, runs = [], []
        folder = f"{shared_folder(spark, folder)}/run-{uuid.uuid4().hex}"  # runs that share a folder keep apart
        for e in self.extractors.values():
            if not all(n in inputs for n in e.needs):
                runs.append((e.name, e.version, "Skipped", 0, "input missing"))
                continue
            try:
                out = e.run(inputs, rules).select(*ARTIFACT_SCHEMA.names)
                if e.systems and case_os is not None:
                    out = out.join(case_os.where(F.col("os").isin(*e.systems)), "case_id", "left_semi")
                path = f"{folder}/extracted/{e.name}"
                out.write.mode("overwrite").parquet(path)
                done = spark.read.schema(ARTIFACT_SCHEMA).parquet(path)
                n = done.count()
                parts.append(done)
                runs.append((e.name, e.version, "Success" if n else "Not Applicable", n, ""))
            except Exception as error:  # noqa: BLE001 - one extractor must not stop the others
                runs.append((e.name, e.version, "Failed", 0, str(error)[:500]))
        every = union_artifacts(*parts) if parts else spark.createDataFrame([], ARTIFACT_SCHEMA)
        return every, spark.createDataFrame(runs, RUN_SCHEMA)


#: Logcat lines carry no year; own registrations name another.
LOGCAT_YEAR = 2024

DEFAULT = Registry()
register = DEFAULT.register
register("VisitExtractor", ("visits",))(lambda i, r: visits.visit_artifacts(i["visits"], r))
register("DownloadExtractor", ("downloads",))(lambda i, r: visits.download_artifacts(i["downloads"], r))
register("CookieExtractor", ("cookies",))(lambda i, r: visits.cookie_artifacts(i["cookies"], r))
register("StorageKeyExtractor", ("storage_files",))(lambda i, r: visits.storage_key_artifacts(i["storage_files"], r))
register("ToolChainExtractor", ("visits",))(lambda i, r: visits.toolchain_artifacts(i["visits"]))
register("ContentExtractor", ("files",))(lambda i, r: union_artifacts(*content.file_artifacts(i["files"], r)))
register("SharedLinkExtractor", ("files",))(
    lambda i, r: content.shared_link_artifacts(i["files"].where(F.col("text").isNotNull())))
register("AssetExtractor", ("binary_files",))(lambda i, r: content.asset_artifacts(i["binary_files"]))
register("ExecutionExtractor", ("executions",), systems=("Windows",))(
    lambda i, r: traces.execution_artifacts(i["executions"], r))
register("TamperDetector", ("executions",), systems=("Windows",))(lambda i, r: traces.cleanup_artifacts(i["executions"]))
register("UnifiedLogExtractor", ("unified_log",), systems=("macOS",))(
    lambda i, r: traces.log_artifacts(i["unified_log"], r, "unified_log"))
register("EventLogExtractor", ("event_log",), systems=("Windows",))(
    lambda i, r: traces.log_artifacts(i["event_log"], r, "event_log"))
register("ExportReplay", ("exports",))(lambda i, r: exports.replay_exports(i["exports"], r))
register("ProviderExportExtractor", ("files",))(lambda i, r: exports.export_file_artifacts(i["files"]))
register("RegistryExtractor", ("registry_values",), systems=("Windows",))(
    lambda i, r: traces.registry_artifacts(i["registry_values"], r))
register("QuarantineExtractor", ("quarantine_events",), systems=("macOS",))(
    lambda i, r: traces.quarantine_artifacts(i["quarantine_events"], r))
register("RecentFileExtractor", ("recent_files",), systems=("Windows",))(
    lambda i, r: traces.recent_artifacts(i["recent_files"], r))
register("DeletedFileExtractor", ("deleted_files",), systems=("Windows",))(
    lambda i, r: traces.deleted_artifacts(i["deleted_files"], r))
register("PackageExtractor", ("packages",), systems=("Android",))(
    lambda i, r: traces.package_artifacts(i["packages"], r))
register("TranscriptExtractor", ("transcripts",))(lambda i, r: content.transcript_artifacts(i["transcripts"]))
register("LogcatExtractor", ("logcat",), systems=("Android",))(
    lambda i, r: traces.log_artifacts(i["logcat"], r, "logcat", year=LOGCAT_YEAR))
register("SubkeyExtractor", ("registry_subkeys",), systems=("Windows",))(
    lambda i, r: evidence.subkey_artifacts(i["registry_subkeys"], r))
register("FolderKeyExtractor", ("folder_keys",), systems=("Windows",))(
    lambda i, r: evidence.subkey_artifacts(i["folder_keys"], r, folders=True))
register("InstallExtractor", ("installs",), systems=("Windows",))(lambda i, r: evidence.install_artifacts(i["installs"], r))
register("RegisteredAppExtractor", ("registered_apps",), systems=("Windows",))(
    lambda i, r: evidence.registered_artifacts(i["registered_apps"], r))
register("KnownKeyExtractor", ("registry_keys",), systems=("Windows",))(
    lambda i, r: evidence.known_key_artifacts(i["registry_keys"], r))
register("PlistExtractor", ("plist_values",), systems=("macOS",))(lambda i, r: evidence.plist_artifacts(i["plist_values"], r))
register("AppUsageExtractor", ("app_usage",), systems=("iPhone", "Android"))(
    lambda i, r: evidence.usage_artifacts(i["app_usage"], r))
register("AppTrafficExtractor", ("app_traffic",), systems=("iPhone",))(
    lambda i, r: evidence.traffic_artifacts(i["app_traffic"], r))
register("MemoryExtractor", ("memory_texts",))(lambda i, r: evidence.memory_artifacts(i["memory_texts"], r))
register("NetworkExtractor", ("network_texts",))(lambda i, r: evidence.memory_artifacts(i["network_texts"], r, network=True))
register("ManifestExtractor", ("manifests",))(lambda i, r: evidence.manifest_artifacts(i["manifests"]))
register("ExtensionExtractor", ("extensions",))(lambda i, r: evidence.extension_artifacts(i["extensions"]))
register("AddonExtractor", ("addons",))(lambda i, r: evidence.addon_artifacts(i["addons"]))
register("HistoryGapDetector", ("visits",))(lambda i, r: evidence.gap_artifacts(evidence.timed_visits(i["visits"])))
register("FutureStampDetector", ("visits",))(
    lambda i, r: evidence.future_stamp_artifacts(evidence.timed_visits(i["visits"]), F.current_timestamp()))
register("StrippedImageDetector", ("binary_files",))(lambda i, r: evidence.stripped_image_artifacts(i["binary_files"]))
register("HitExtractor", ("raw_texts",))(
    lambda i, r: hits.hit_artifacts(hits.scan_hits(i["raw_texts"], "text", hits.hit_patterns())))
register("BlobExtractor", ("blobs",))(lambda i, r: hits.blob_artifacts(i["blobs"]))
#: The tool inventory, the systems and profiles of the cases, and the paths found in them.
TOOL_INPUTS = ("tools", "tool_systems", "tool_profiles", "tool_paths")
register("ToolScanner", TOOL_INPUTS)(lambda i, r: tools.checklist_artifacts(tools.checklist(*(i[n] for n in TOOL_INPUTS))))
