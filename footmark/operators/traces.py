"""Operating-system evidence: log lines, key/value stores, executions, recent and deleted files, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions.rules import RuleBook
from footmark.functions.timeconv import log_time, short_log_time
from footmark.operators.artifacts import as_artifacts
from footmark.operators.hits import redact_text

# What a line of each log is compared with, in this order, and how the hit is labelled.
LINE_ORDERS = {
    "unified_log": [("domain", "Domain: "), ("process", "Process: ")],
    "event_log": [("domain", "Domain: "), ("process", "Process: "), ("app_win", "App: ")],
    "logcat": [("package", "Package: "), ("domain", "Domain: ")],
}


def line_hits(lowered: Column, rules: RuleBook, order: list[tuple[str, str]]) -> Column:
    """Array of (platform, indicator), one slot per platform with a hit, in platform order."""
    kinds = [k for k, _ in order]

    def slots(platform: str):
        return [(F.contains(lowered, F.lit(r.pattern.lower())), F.lit(label + r.pattern))
                for kind, label in order for r in rules.of(kind) if r.platform == platform]

    return M.per_platform(rules.platforms(*kinds), slots)


def classify_lines(lines: DataFrame, rules: RuleBook, log: str, line_col: str = "line") -> DataFrame:
    """Log lines that mention a platform: adds platform and indicator.

    One row per platform and line; for ``logcat`` only the first platform.
    """
    order = LINE_ORDERS[log]
    # A line without any of the words is dropped before the wider expression runs.
    words = [r.pattern for kind, _ in order for r in rules.of(kind)]
    kept = lines.withColumn("line_lower", F.lower(line_col)).where(
        M.contains_any(F.col("line_lower"), words))
    hits = line_hits(F.col("line_lower"), rules, order)
    if log == "logcat":
        found = kept.withColumn("hit", F.get(hits, F.lit(0)))
    else:
        found = kept.withColumn("hit", F.explode(hits))
    return found.select(*lines.columns, "hit.platform", "hit.indicator")


def log_artifacts(lines: DataFrame, rules: RuleBook, log: str, year: int | None = None) -> DataFrame:
    """Input columns: case_id, user_profile, path, line_no, line.  ``year`` dates logcat lines."""
    family, kind, subtype, confidence = {
        "unified_log": (V.UNIFIED_LOG, "macOS Unified Log", "Text Log Entry", "Moderate"),
        "event_log": (V.EVENT_LOG, "Windows Event Log", "Event Log Record", "Low"),
        "logcat": (V.EVENT_LOG, "Android System Log", "Logcat Entry", "Low"),
    }[log]
    at = short_log_time(F.col("line"), year) if log == "logcat" else log_time(F.col("line"))
    found = classify_lines(lines, rules, log).withColumn("at", at)
    head = "Logcat entry: " if log == "logcat" else "Log entry: "
    return as_artifacts(
        found, log, ["path", "line_no", "platform"], artifact_family=family, artifact_type=kind,
        artifact_subtype=subtype, artifact_path=F.col("path"), parser_used="LogLineExtractor",
        ts=F.col("at"), timestamp_type="Created", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.col("indicator"), suspected_platform=F.col("platform"),
        classification="Circumstantial", initial_confidence=confidence,
        notes=F.concat(F.lit(head), redact_text(F.trim("line"))),
    )


def match_package(df: DataFrame, rules: RuleBook, package_col: str = "package") -> DataFrame:
    """Rows whose package id is a known one: adds platform, first rule first."""
    package = F.col(package_col)
    branches = [(package.isin([r.pattern for r in rules.of("package") if r.platform == p]), F.lit(p))
                for p in rules.platforms("package")]
    return df.withColumn("platform", M.chain(branches)).where(F.col("platform").isNotNull())


def match_traffic(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Traffic of known packages, also as the end of a longer name, with bytes above zero.

    Input columns: package, wifi_in, wifi_out, wwan_in, wwan_out.  Adds platform and total_bytes.
    """
    package = F.col("package")
    branches = [(M.any_of(package.endswith(r.pattern) for r in rules.of("package") if r.platform == p), F.lit(p))
                for p in rules.platforms("package")]
    counters = ["wifi_in", "wifi_out", "wwan_in", "wwan_out"]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counters), F.lit(0))
    return df.withColumn("total_bytes", total).where(F.col("total_bytes") > 0).withColumn(
        "platform", M.chain(branches)).where(F.col("platform").isNotNull())


def _first_of(lowered: Column, rules: RuleBook, *kinds: str) -> Column:
    """Domain first; else the first platform with a word of one of the kinds."""
    return F.coalesce(M.match_platform(lowered, rules.of("domain")), M.match_platform(lowered, rules.of(*kinds)))


def classify_key_values(df: DataFrame, rules: RuleBook, kind: str = "registry") -> DataFrame:
    """Key/value text to platform; confidence and class follow from the key label.

    ``registry``: key_label, value.  ``plist``: value.  ``quarantine``:
    origin_url, data_url, agent.
    """
    direct = F.lit("Direct")
    if kind == "quarantine":
        text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("origin_url", "data_url", "agent")])
        platform = M.match_platform(F.lower(text), rules.of("domain"))
        confidence, classification = F.lit("Moderate"), direct
    elif kind == "plist":
        platform = _first_of(F.lower("value"), rules, "app_mac", "bundle_id")
        confidence, classification = F.lit("Low"), F.lit("Inferred")
    else:
        platform = _first_of(F.lower("value"), rules, "domain", "app_win", "process", "search_kw")
        weak = F.col("key_label").isin(V.INFERRED_LOW_LABELS)
        confidence = F.when(F.col("key_label").isin(V.DIRECT_HIGH_LABELS), "High").when(
            weak, "Low").otherwise("Moderate")
        classification = F.when(weak, "Inferred").otherwise("Direct")
    return df.withColumn("platform", platform).where(F.col("platform").isNotNull()).withColumn(
        "confidence", confidence).withColumn("classification", classification)


def classify_subkeys(df: DataFrame, rules: RuleBook, folders: bool = False) -> DataFrame:
    """Sub-key text by domain, then file pattern; folder-navigation text by domain, then application.

    Always Inferred and Low.  Folder texts shorter than four characters are left out.
    """
    lowered = F.lower("value")
    if folders:
        rows = df.where(F.length("value") >= 4)
        platform = _first_of(lowered, rules, "domain", "app_win")
    else:
        rows = df
        platform = F.coalesce(M.match_platform(lowered, rules.of("domain")),
                              M.match_regex_platform(lowered, rules.of("download_re", "export_re")))
    return rows.withColumn("platform", platform).where(F.col("platform").isNotNull()).withColumn(
        "confidence", F.lit("Low")).withColumn("classification", F.lit("Inferred"))


def classify_installs(df: DataFrame, rules: RuleBook, registered: bool = False) -> DataFrame:
    """Installed programs (first platform, Direct) or registered applications (every platform, Inferred).

    Installed: display_name, install_location, key_name.  Registered: name, value.
    """
    if registered:
        text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("value", F.lit(""))))
        hits = line_hits(F.col("text_lower"), rules, [("app_win", "")])
        return df.withColumn("text_lower", text).withColumn("hit", F.explode(hits)).select(
            *df.columns, "hit.platform", F.lit("Low").alias("confidence"),
            F.lit("Inferred").alias("classification"))
    display = F.coalesce("display_name", "key_name")
    text = F.lower(F.concat_ws(
        " ", display, F.coalesce("install_location", F.lit("")), F.coalesce("key_name", F.lit(""))))
    platform = M.match_platform(F.col("text_lower"), rules.of("app_win", "process", "domain"))
    return df.withColumn("text_lower", text).withColumn("platform", platform).drop("text_lower").where(
        F.col("platform").isNotNull()).withColumn("confidence", F.lit("Moderate")).withColumn(
        "classification", F.lit("Direct"))


def match_known_paths(paths: DataFrame, rules: RuleBook, kind: str, path_col: str = "path") -> DataFrame:
    """Paths that end in a known key or folder, or names that contain a known bundle id.

    ``kind``: registry_key, app_dir, app_dir_mac or bundle_id.  Adds platform and known.
    """
    known = rules.of(kind)
    if kind == "bundle_id":
        hits = line_hits(F.lower(path_col), rules, [(kind, "")])
        return paths.withColumn("hit", F.explode(hits)).select(
            *paths.columns, "hit.platform", F.col("hit.indicator").alias("known"))
    sep = "\\" if kind == "registry_key" else "/"
    path = F.lower(path_col)

    def at_end(pattern: str) -> Column:
        return (path == pattern.lower()) | path.endswith(sep + pattern.lower())

    hits = F.array_compact(F.array(*[
        F.when(at_end(r.pattern), F.struct(F.lit(r.platform).alias("platform"), F.lit(r.pattern).alias("known")))
        for r in known]))
    return paths.withColumn("hit", F.explode(hits)).select(*paths.columns, "hit.platform", "hit.known")


def classify_execution(df: DataFrame, rules: RuleBook, name_col: str = "name") -> DataFrame:
    """Execution traces whose name contains a rule name: one row per rule that fits."""
    upper = F.upper(name_col)
    hits = F.array_compact(F.array(*[
        F.when(F.contains(upper, F.lit(r.pattern.upper())),
               F.struct(F.lit(r.platform).alias("platform"), F.lit(r.pattern).alias("rule")))
        for r in rules.of("prefetch")]))
    return df.withColumn("hit", F.explode(hits)).select(*df.columns, "hit.platform", "hit.rule")


def execution_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, name, mtime."""
    return as_artifacts(
        classify_execution(df, rules), "execution", ["path", "rule"], artifact_family=V.EXECUTION,
        artifact_type="Prefetch", artifact_subtype="Application Execution", artifact_path=F.col("path"),
        parser_used="ExecutionExtractor", ts=F.col("mtime"), timestamp_type="Execution",
        tz_norm=F.col("mtime").isNotNull(), extracted_indicator=F.concat(F.lit("Prefetch: "), "name"),
        suspected_platform=F.col("platform"), access_mode="Native App", classification="Direct",
        initial_confidence="Moderate",
        notes="Prefetch file indicates program execution. Does not confirm interactive AI use.",
    )


def detect_cleanup(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Executions of a cleanup tool: adds tool, first rule first."""
    return df.withColumn("tool", M.chain([
        (F.contains(F.upper(name_col), F.lit(key)), F.lit(tool)) for key, tool in V.CLEANUP_TOOLS
    ])).where(F.col("tool").isNotNull())


def cleanup_artifacts(df: DataFrame) -> DataFrame:
    return as_artifacts(
        detect_cleanup(df), "cleanup", ["path"], artifact_family=V.EXECUTION,
        artifact_type="Cleanup Tool Execution", artifact_subtype="prefetch", artifact_path=F.col("path"),
        parser_used="TamperDetector", ts=F.col("mtime"), timestamp_type="Execution",
        extracted_indicator=F.concat(F.lit("Cleanup tool: "), "tool", F.lit(" ("), "name", F.lit(")")),
        initial_confidence="Moderate",
    )


def _name_slots(name: Column, rules: RuleBook, platform: str, with_domains: bool) -> list[tuple[Column, Column]]:
    both = [r for r in rules.of("download_re", "export_re") if r.platform == platform]
    slots = [(name.rlike("(?i)" + r.pattern), F.lit(r.pattern)) for r in both]
    if with_domains:
        for r in rules.of("domain"):
            if r.platform == platform:
                variants = [r.pattern.replace(".", "_"), r.pattern.replace(".", "-")]
                slots.append((M.any_of(F.contains(name, F.lit(v)) for v in variants), F.lit(r.pattern)))
    return slots


def classify_recent(df: DataFrame, rules: RuleBook, name_col: str = "name") -> DataFrame:
    """Recent files by file pattern, else by a domain written with ``_`` or ``-``; one row per platform."""
    name = F.lower(name_col)
    hits = M.per_platform(rules.platforms("download_re", "export_re", "domain"),
                          lambda p: _name_slots(name, rules, p, True))
    return df.withColumn("hit", F.explode(hits)).select(
        *df.columns, "hit.platform", F.col("hit.indicator").alias("pattern"))


def classify_deleted(df: DataFrame, rules: RuleBook, name_col: str = "name") -> DataFrame:
    """Original names of deleted files: every platform that fits, with its first pattern."""
    hits = M.per_platform(rules.platforms("download_re", "export_re"),
                          lambda p: _name_slots(F.col(name_col), rules, p, False))
    return df.withColumn("hit", F.explode(hits)).select(
        *df.columns, "hit.platform", F.col("hit.indicator").alias("pattern"))


def detect_os(paths: DataFrame) -> DataFrame:
    """Operating system per case from the names at the top of the evidence tree (case_id, name)."""
    def score(names: list[str]) -> Column:
        return M.distinct(F.when(F.col("name").isin(names), F.col("name")))

    scores = paths.groupBy("case_id").agg(
        score(V.WINDOWS_NAMES).alias("win"), score(V.MAC_NAMES).alias("mac"), score(V.PHONE_NAMES).alias("phone"))
    os = (F.when((F.col("phone") > 0) & (F.col("phone") >= F.col("mac")), "iPhone")
          .when(F.col("mac") > F.col("win"), "macOS").when(F.col("win") > 0, "Windows").otherwise(V.UNKNOWN))
    return scores.select("case_id", os.alias("os"))


def user_profiles(paths: DataFrame) -> DataFrame:
    """User folders per case; when only system names are left, the macOS list of system names decides."""
    users = paths.select("case_id", F.regexp_extract("path", r"^/?Users/([^/]+)(?:/|$)", 1).alias("user_profile")
                         ).where(F.col("user_profile") != "").distinct()
    name = F.lower("user_profile")
    marked = users.withColumn("plain", ~name.isin(V.SYSTEM_PROFILES)).withColumn(
        "mac_plain", ~name.isin(V.MAC_SYSTEM_PROFILES))
    any_plain = marked.groupBy("case_id").agg(F.bool_or("plain").alias("any_plain"))
    return marked.join(any_plain, "case_id").where(
        F.when(F.col("any_plain"), F.col("plain")).otherwise(F.col("mac_plain"))).select("case_id", "user_profile")


def image_type(paths: DataFrame) -> DataFrame:
    """Full disk, logical or partial, per case, from the top-level names (case_id, name)."""
    def has(*names: str) -> Column:
        return F.coalesce(F.max(F.col("name").isin(*names)), F.lit(False))

    return paths.groupBy("case_id").agg(
        F.when(has("Windows", "System"), "Full Disk Image").when(has("Users"), "Logical Image")
        .otherwise("Partial Evidence Container").alias("image_type"))


def browsers_detected(paths: DataFrame) -> DataFrame:
    """Browsers with a profile folder in the tree (case_id, path), sorted names per case."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    browser = F.explode(F.array_compact(F.array(*[
        F.when(F.contains(path, F.lit("/" + folder)), F.lit(b)) for b, folder in V.BROWSER_DIRS])))
    return paths.select("case_id", browser.alias("browser")).distinct().groupBy("case_id").agg(
        F.array_sort(F.collect_set("browser")).alias("browsers"))


# --- fixed values: subtype of a registry label where it differs from the label ----
LABEL_SUBTYPES = {"TypedURLs": "TypedURL", "TypedPaths": "TypedPath"}


def registry_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, key_label, name, value, mtime."""
    label = F.col("key_label")
    subtype = F
    for name, text in LABEL_SUBTYPES.items():
        subtype = subtype.when(label == name, text)
    return as_artifacts(
        classify_key_values(df, rules), "registry", ["path", "key_label", "name", "value"], artifact_family=V.REGISTRY,
        artifact_type=F.concat(F.lit("Registry — "), label), artifact_subtype=subtype.otherwise(label),
        artifact_path=F.col("path"), parser_used="RegistryExtractor", ts=F.col("mtime"),
        timestamp_type=F.when(F.col("mtime").isNotNull(), "Modified"), tz_norm=F.col("mtime").isNotNull(),
        extracted_indicator=F.concat("name", F.lit(": "), "value"),
        suspected_platform=F.col("platform"), access_mode=F.when(label == "TypedURLs", "Browser"),
        classification=F.col("classification"), initial_confidence=F.col("confidence"))


def quarantine_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, origin_url, data_url, agent, at."""
    parts = [F.coalesce(c, F.lit("")) for c in ("origin_url", "data_url", "agent")]
    return as_artifacts(
        classify_key_values(df, rules, "quarantine"), "quarantine", ["path", "origin_url", "data_url", "at"],
        artifact_family=V.FILE_SYSTEM, artifact_type="Quarantine Event", artifact_subtype="Download Source",
        artifact_path=F.col("path"), parser_used="QuarantineExtractor", ts=F.col("at"), timestamp_type="Created",
        tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat(F.lit("Origin: "), parts[0], F.lit(", Data: "), parts[1], F.lit(", Agent: "), parts[2]),
        suspected_platform=F.col("platform"), access_mode="Browser", classification="Direct", initial_confidence="Moderate",
        notes="Quarantine event records download source information.")


def recent_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, name, mtime."""
    return as_artifacts(
        classify_recent(df, rules), "recent", ["path", "platform"], artifact_family=V.RECENT,
        artifact_type="Recent File / LNK", artifact_subtype="Windows Recent", artifact_path=F.col("path"),
        parser_used="RecentFileExtractor", ts=F.col("mtime"), timestamp_type="Accessed", tz_norm=F.col("mtime").isNotNull(),
        extracted_indicator=F.concat(F.lit("Recent file: "), "name"), suspected_platform=F.col("platform"),
        initial_confidence="Low")


def deleted_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, path, name (the original one)."""
    return as_artifacts(
        classify_deleted(df, rules), "deleted", ["path", "platform"], artifact_family=V.FILE_SYSTEM,
        artifact_type="Recycle Bin Entry", artifact_subtype="Deleted File", artifact_path=F.col("path"),
        parser_used="DeletedFileExtractor", extracted_indicator=F.concat(F.lit("Deleted: "), "name"),
        suspected_platform=F.col("platform"), initial_confidence="Low",
        notes="Deleted file with AI-suggestive filename. Filename alone is a weak indicator.")


def package_artifacts(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Installed mobile packages. Input columns: case_id, path, package, at."""
    return as_artifacts(
        match_package(df, rules), "package", ["path", "package"], artifact_family=V.NATIVE,
        artifact_type="App Installation", artifact_subtype="packages.xml Entry", artifact_path=F.col("path"),
        parser_used="PackageExtractor", ts=F.col("at"), timestamp_type="Created", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat(F.lit("Package: "), "package"), suspected_platform=F.col("platform"),
        access_mode="Native App", classification="Direct", initial_confidence="High")
