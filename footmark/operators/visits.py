"""Browser evidence: visits, downloads, cookies, storage keys, extensions, tool chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions.rules import RuleBook
from footmark.functions.timeconv import to_ts_by_kind
from footmark.operators.artifacts import as_artifacts


def classify_visits(visits: DataFrame, rules: RuleBook, host_suffix: bool = False) -> DataFrame:
    """Visits to a known platform, with platform, first matching domain and model.

    Input columns: case_id, user_profile, browser, url, title, visit_count,
    raw_time, time_kind.  ``host_suffix=True`` compares the host instead of
    looking for the domain anywhere in the URL.
    """
    domains = rules.of("domain")
    lowered = visits.withColumn("url_lower", F.lower("url"))
    url = F.col("url_lower")
    platform = M.match_host_suffix(F.col("url"), domains) if host_suffix else M.match_platform(url, domains)
    return (
        lowered.withColumn("platform", platform)
        .where(F.col("platform").isNotNull())
        .withColumn("domain", M.pattern_of_platform(url, F.col("platform"), domains))
        .withColumn("model", F.coalesce(M.match_model(url, rules.of("model")), F.lit(V.UNKNOWN)))
        .drop("url_lower")
    )


def visit_artifacts(visits: DataFrame, rules: RuleBook) -> DataFrame:
    found = classify_visits(visits, rules).withColumn(
        "at", to_ts_by_kind(F.col("raw_time"), F.col("time_kind")))
    return as_artifacts(
        found, "visit", ["user_profile", "browser", "url", "raw_time"],
        artifact_family=V.HISTORY, artifact_type="URL Visit",
        artifact_subtype=F.concat("browser", F.lit(" History")), parser_used="VisitExtractor",
        ts=F.col("at"), timestamp_type="Last Visited", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.col("url"), suspected_platform=F.col("platform"),
        suspected_model=F.col("model"), access_mode="Browser", classification="Direct",
        initial_confidence="Moderate",
        notes=F.concat(F.lit("Visit count: "), F.coalesce(F.col("visit_count"), F.lit(0)).cast("string"),
                       F.lit(", Title: "), F.coalesce("title", F.lit(""))),
    )


def classify_downloads(downloads: DataFrame, rules: RuleBook) -> DataFrame:
    """Downloads from a known platform's page, or with a file name that looks like one of its exports.

    Input columns: case_id, user_profile, browser, target_path, tab_url,
    total_bytes, raw_time, time_kind, mime_type.
    """
    by_url = M.match_platform(F.lower("tab_url"), rules.of("domain"))
    name = F.lower(M.basename(F.col("target_path")))
    by_name = M.match_regex_platform(name, rules.of("download_re"))
    return downloads.withColumn("platform", F.coalesce(by_url, by_name)).where(F.col("platform").isNotNull())


def download_artifacts(downloads: DataFrame, rules: RuleBook) -> DataFrame:
    found = classify_downloads(downloads, rules).withColumn(
        "at", to_ts_by_kind(F.col("raw_time"), F.col("time_kind")))
    return as_artifacts(
        found, "download", ["user_profile", "browser", "tab_url", "target_path", "raw_time"],
        artifact_family=V.DOWNLOADS, artifact_type="Download",
        artifact_subtype=F.concat("browser", F.lit(" Download")), parser_used="DownloadExtractor",
        ts=F.col("at"), timestamp_type="Created", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat(F.lit("URL: "), F.coalesce("tab_url", F.lit("")), F.lit(" -> "),
                                     F.coalesce("target_path", F.lit(""))),
        suspected_platform=F.col("platform"), access_mode="Browser", classification="Direct",
        initial_confidence="Moderate",
        notes=F.concat(F.lit("Size: "), F.coalesce(F.col("total_bytes"), F.lit(0)).cast("string"),
                       F.lit(", MIME: "), F.coalesce("mime_type", F.lit(""))),
    )


def classify_cookies(cookies: DataFrame, rules: RuleBook) -> DataFrame:
    """Cookies of a known platform. Input columns: case_id, user_profile, browser, host_key, name, raw_time, time_kind."""
    platform = M.match_cookie_host(F.col("host_key"), rules.of("cookie_domain"))
    return cookies.withColumn("platform", platform).where(F.col("platform").isNotNull())


def cookie_artifacts(cookies: DataFrame, rules: RuleBook) -> DataFrame:
    found = classify_cookies(cookies, rules).withColumn(
        "at", to_ts_by_kind(F.col("raw_time"), F.col("time_kind")))
    return as_artifacts(
        found, "cookie", ["user_profile", "browser", "host_key", "name", "raw_time"],
        artifact_family=V.COOKIES, artifact_type="Cookie",
        artifact_subtype=F.concat("browser", F.lit(" Cookie")), parser_used="CookieExtractor",
        ts=F.col("at"), timestamp_type="Last Visited", tz_norm=F.col("at").isNotNull(),
        extracted_indicator=F.concat("host_key", F.lit(" / "), F.coalesce("name", F.lit(""))),
        suspected_platform=F.col("platform"), access_mode="Browser", classification="Direct",
        initial_confidence="Low",
        notes="Cookie alone is not sufficient to conclude substantive AI use.",
    )


def match_storage_keys(files: DataFrame, rules: RuleBook, text_col: str = "text") -> DataFrame:
    """At most one storage-key hit per platform and file: adds platform and indicator (the key)."""
    text = F.lower(text_col)
    hits = M.per_platform(
        rules.platforms("ls_key"),
        lambda p: [(F.contains(text, F.lit(r.pattern.lower())), F.lit(r.pattern))
                   for r in rules.of("ls_key") if r.platform == p],
    )
    return files.withColumn("hit", F.explode(hits)).select(
        *files.columns, F.col("hit.platform").alias("platform"), F.col("hit.indicator").alias("indicator"))


def storage_key_artifacts(files: DataFrame, rules: RuleBook) -> DataFrame:
    """Input columns: case_id, user_profile, browser, path, text."""
    return as_artifacts(
        match_storage_keys(files, rules), "storage_key", ["path", "platform", "indicator"],
        artifact_family=V.LOCAL_STORAGE, artifact_type="Local Storage Key",
        artifact_subtype=F.concat("browser", F.lit(" Local Storage")), artifact_path=F.col("path"),
        parser_used="StorageKeyExtractor",
        extracted_indicator=F.concat(F.lit("Key match: '"), "indicator", F.lit("' in "),
                                     M.basename(F.col("path"))),
        suspected_platform=F.col("platform"), access_mode="Browser", initial_confidence="Low",
        notes="Local storage key match is a weak indicator. Corroboration required.",
    )


def detect_toolchain(visits: DataFrame) -> DataFrame:
    """Plugin, tool-chain and vector-store traces: at most one row of each sort per visit.

    Adds trace (plugin_url, toolchain_url or rag_url) and tool (its name, for tool chains).
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))))

    def slot(trace: str, test, tool):
        return F.when(test, F.struct(F.lit(trace).alias("trace"), tool.alias("tool")))

    tool = M.chain([(text.rlike("(?i)" + p), F.lit(n)) for p, n in V.TOOLCHAIN_PATTERNS])
    slots = F.array(
        slot("plugin_url", M.regex_any(text, V.PLUGIN_PATTERNS), M.no_string()),
        slot("toolchain_url", tool.isNotNull(), tool),
        slot("rag_url", M.regex_any(text, V.VECTOR_STORE_PATTERNS), M.no_string()),
    )
    return visits.withColumn("found", F.explode(F.array_compact(slots))).select(
        *visits.columns, "found.trace", "found.tool")


def toolchain_artifacts(visits: DataFrame) -> DataFrame:
    plugin, chain = F.col("trace") == "plugin_url", F.col("trace") == "toolchain_url"
    return as_artifacts(
        detect_toolchain(visits), "toolchain", ["user_profile", "browser", "url", "raw_time", "trace"],
        artifact_family=V.HISTORY,
        artifact_type=F.when(plugin, "ChatGPT Plugin/Custom GPT").when(chain, "AI Tool-Chain Trace")
        .otherwise("RAG Infrastructure Trace"),
        artifact_subtype=F.col("trace"), parser_used="ToolChainExtractor",
        extracted_indicator=F.when(chain, F.concat("tool", F.lit(": "), "url"))
        .otherwise(F.col("url")),
        suspected_platform=F.when(plugin, "ChatGPT").otherwise(V.UNKNOWN),
        attribution_layer=F.when(plugin, "Platform").otherwise("Content"),
        initial_confidence=F.when(plugin, "High").when(chain, "Moderate").otherwise("Low"),
        classification=F.when(plugin, "Direct").otherwise("Inferred"),
    )


def detect_api_config(files: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """Configuration files that name an API key variable: adds the distinct names, in text order."""
    text = F.col(text_col) if max_chars is None else F.substring(text_col, 1, max_chars)
    pattern = "(?i)(" + "|".join(V.API_KEY_NAMES) + ")"
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    return files.withColumn("key_names", names).where(F.size("key_names") > 0)


def classify_extensions(extensions: DataFrame) -> DataFrame:
    """Known extension id (Direct, High), else words of the manifest (Inferred, Moderate).

    Input columns: ext_id, manifest (JSON text).
    """
    lowered = F.lower("manifest")
    by_id = M.chain([(F.col("ext_id") == i, F.lit(p)) for i, _, p in V.EXTENSION_IDS])
    name = M.chain([(F.col("ext_id") == i, F.lit(n)) for i, n, _ in V.EXTENSION_IDS])
    by_words = M.first_word(lowered, V.MANIFEST_WORDS)
    known = F.col("known_name").isNotNull()
    return (
        extensions.withColumn("known_name", name)
        .withColumn("platform", F.coalesce(by_id, by_words))
        .where(F.col("platform").isNotNull())
        .withColumn("classification", F.when(known, "Direct").otherwise("Inferred"))
        .withColumn("confidence", F.when(known, "High").otherwise("Moderate"))
        .withColumn("ext_name", F.coalesce(
            "known_name", F.get_json_object("manifest", "$.name"), F.col("ext_id")))
        .drop("known_name")
    )


def classify_addons(addons: DataFrame) -> DataFrame:
    """Add-ons by words of name and description. Input columns: name, description."""
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))
    return addons.withColumn("platform", M.first_word(text, V.ADDON_WORDS)).where(
        F.col("platform").isNotNull())


def latest_manifest(versions: DataFrame) -> DataFrame:
    """Manifest of the highest version (string order) per case and extension."""
    return versions.groupBy("case_id", "ext_id").agg(F.max_by("manifest", "version").alias("manifest"))


def classify_recovered(rows: DataFrame, rules: RuleBook, kind: str) -> DataFrame:
    """Visits, cookies or downloads of recovered tables: one row per natural key.

    Keys: url; host and name; path and url.  Which of several equal keys stays
    is decided by the smallest ``seq``.
    """
    if kind == "visits":
        key, platform = ["url"], M.match_platform(F.lower("url"), rules.of("domain"))
    elif kind == "cookies":
        key = ["host_key", "name"]
        platform = M.match_platform(F.lower("host_key"), rules.of("cookie_domain"))
    else:
        key = ["target_path", "tab_url"]
        both = F.lower(F.concat_ws(" ", F.coalesce("target_path", F.lit("")), F.coalesce("tab_url", F.lit(""))))
        platform = M.match_platform(both, rules.of("domain"))
    rest = [c for c in [*rows.columns, "platform"] if c not in ["case_id", *key]]
    # min() of a struct led by seq combines on the map side, so a hot key costs one row per task.
    found = rows.withColumn("platform", platform).where(F.col("platform").isNotNull())
    first = found.groupBy("case_id", *key).agg(
        F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("first"))
    return first.select("case_id", *key, "first.*")


def scan_table(df: DataFrame, table: str, rules: RuleBook, min_chars: int = 6) -> DataFrame:
    """Every string cell of any table against the domains, once per (table, cell)."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cells = df.select(F.explode(F.array(*[F.col(n) for n in names])).alias("cell")).where(
        F.length("cell") >= min_chars).distinct()
    found = cells.withColumn("platform", M.match_platform(F.lower("cell"), rules.of("domain"))).where(
        F.col("platform").isNotNull())
    return found.select(F.lit(table).alias("table_name"), "cell", "platform")
