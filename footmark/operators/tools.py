"""Tool checklist: which tools of an inventory left files in the evidence, and what that supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.matching import distinct
from footmark.operators.content import evidence_class
from footmark.operators.spread import join_few

FOUND, NOT_FOUND, NOT_VERIFIED = "FOUND", "NOT_FOUND", "NOT_VERIFIED"


def surface_class(tools: DataFrame) -> DataFrame:
    """Adds ``surface_class`` from the category, else from the execution surfaces."""
    def has(surface: str) -> Column:
        return F.array_contains("execution_surface", surface)

    col = F
    for name, categories in V.TOOL_CATEGORIES.items():
        col = col.when(F.col("category").isin(categories), name)
    col = (
        col.when(has("DOCKER_CONTAINER") | has("SELF_HOSTED_REMOTE"), "LOCAL_WEBUI")
        .when(has("IDE_EXTENSION") | has("TERMINAL"), "IDE_CLI")
        .when(has("BROWSER") & ~has("DESKTOP_APP"), "BROWSER_FIRST")
        .when(has("DESKTOP_APP") & (F.col("category") == "Local LLM") & has("BROWSER"), "LOCAL_WEBUI")
        .otherwise("NATIVE_DESKTOP"))
    return tools.withColumn("surface_class", col)


def tool_paths(tools: DataFrame) -> DataFrame:
    """One row per tool, operating system and path template, in list order."""
    per_os = tools.select("tool_id", F.explode("artifact_path_candidates").alias("os", "templates"))
    return per_os.select("tool_id", "os", F.posexplode("templates").alias("ord", "template"))


def expand_tool_paths(paths: DataFrame, profiles: DataFrame, case_os: DataFrame) -> DataFrame:
    """Templates to candidate paths of each case: variables, home folders and profiles filled in.

    ``profiles``: case_id, user_profile.  ``case_os``: case_id, os.  Returns (case_id, tool_id, candidate, ord), each candidate once.
    """
    template = F.col("template")
    filled = template
    for name, place in V.PATH_VARIABLES:
        filled = F.regexp_replace(filled, f"(?i)%{name}%", place)
    home = template.startswith("~")
    windows = F.when(home, template).otherwise(F.replace(filled, F.lit("\\"), F.lit("/")))
    posix = F.when(home, F.concat(F.lit("Users/{user}/"), F.regexp_replace(template, "^[~/]+", ""))).otherwise(template)
    # Variables are filled in once per template; only the user differs from case to case.
    ready = paths.withColumn("place", F.ltrim(F.when(F.col("os") == "Windows", windows).otherwise(posix), F.lit("/")))
    users = case_os.join(profiles, "case_id", "left").withColumn("user", F.coalesce("user_profile", F.lit("*")))
    # An operating system is a key of a handful of values, each with a large part of the inventory.
    rows = join_few(ready, users, ["os"], ["tool_id", "ord"]).withColumn("candidate", F.replace("place", F.lit("{user}"), F.col("user")))
    return rows.groupBy("case_id", "tool_id", "candidate").agg(F.min("ord").alias("ord"))


def glob_regex(glob: Column) -> Column:
    """Regular expression of a glob whose ``*`` and ``?`` stay inside one path part."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")),
                    F.lit("$"))


def match_tool_paths(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """Candidates that exist in the file inventory (case_id, path): (case_id, tool_id, ord, path).

    Plain candidates are an equi join.  One with wildcards is joined on the text
    before its first wildcard: a file offers its beginnings in the lengths that
    like wildcard candidates of its case really have, so only files that share the
    beginning are compared with the pattern.  The smallest path counts.
    """
    wild = F.col("candidate").rlike(r"[*?]")
    files = inventory.select("case_id", F.regexp_replace("path", "^/+", "").alias("path"))
    plain = candidates.where(~wild).join(
        files.withColumnRenamed("path", "candidate"), ["case_id", "candidate"], "left_semi").select(
        "case_id", "tool_id", "ord", F.col("candidate").alias("path"))
    globs = candidates.where(wild).select(
        "case_id", "tool_id", "ord", "candidate", glob_regex(F.col("candidate")).alias("pattern"),
        F.size(F.split("candidate", "/")).alias("depth"), F.regexp_extract("candidate", r"^[^*?]*", 0).alias("head"))
    # How the part with the wildcard begins and how long the text before it is: a few of each per case and depth.  Most
    # files have no such part, so they offer no beginning, and a beginning that many files share is not sent around.
    begun = globs.groupBy("case_id", "depth", F.size(F.split("head", "/")).alias("place"),
                          F.substring(F.substring_index("head", "/", -1), 1, 2).alias("lead")).agg(
        F.collect_set(F.length("head")).alias("lengths"))
    leads = begun.groupBy("case_id", "depth").agg(F.collect_list(F.struct("place", "lead", "lengths")).alias("leads"))
    deep = files.withColumn("depth", F.size(F.split("path", "/")))
    fits = F.filter("leads", lambda x: F.startswith(F.get(F.split("path", "/"), x["place"] - 1), x["lead"]))
    # A case and depth may hold much of the files.
    heads = join_few(deep, leads, ["case_id", "depth"], ["path"]).select(
        "case_id", "path", "depth", F.explode(F.array_distinct(F.flatten(F.transform(fits, lambda x: x["lengths"])))).alias("n")).where(
        F.length("path") >= F.col("n")).select(
        "case_id", "path", "depth", F.substring("path", F.lit(1), F.col("n")).alias("head"))
    wide = globs.join(heads, ["case_id", "depth", "head"]).where(F.rlike("path", F.col("pattern"))).groupBy(
        "case_id", "tool_id", "ord", "candidate").agg(F.min("path").alias("path"))
    return plain.unionByName(wide.drop("candidate"))


def _notes_have(*words: str) -> Column:
    upper = F.upper(F.coalesce("tool_notes", F.lit("")))
    out = F.contains(upper, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(upper, F.lit(w))
    return out


def caveat_flags(entries: DataFrame) -> DataFrame:
    """Adds ``caveat_flags``: rule sets by surface class and status, order kept, each flag once.

    Input columns: surface_class, status, execution_surface, category,
    tool_notes, class_count.
    """
    found = F.col("status") == FOUND
    surfaces = F.col("execution_surface")
    several = F.size(surfaces) > 1
    yes = F.lit(True)

    def has(surface: str) -> Column:
        return F.array_contains(surfaces, surface)

    def flags(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(t, F.lit(f)) for t, f in pairs]))

    by_class = {
        "BROWSER_FIRST": flags(
            (yes, "BROWSER_ACCESS_ONLY"), (found, "USE_NOT_ESTABLISHED"), (found, "REMOTE_INFERENCE_POSSIBLE"),
            (~found, "BROWSER_HISTORY_CLEARED"), (~found, "PRIVACY_OR_CLEANUP_POSSIBLE"),
            (~found, "NEGATIVE_FINDING_SCOPED"), (several, "MULTI_SURFACE_PRODUCT")),
        "LOCAL_WEBUI": flags(
            (yes, "LOCAL_WEBUI_LOCALHOST_ONLY"),
            (has("DOCKER_CONTAINER") | has("WSL"), "LOCAL_WEBUI_CONTAINER_POSSIBLE"), (found, "USE_NOT_ESTABLISHED"),
            (found & has("SELF_HOSTED_REMOTE"), "REMOTE_INFERENCE_POSSIBLE"), (~found, "PORTABLE_INSTALL_POSSIBLE"),
            (~found, "CUSTOM_PATH_POSSIBLE"), (~found, "NEGATIVE_FINDING_SCOPED"), (several, "MULTI_SURFACE_PRODUCT")),
        "IDE_CLI": flags(
            (yes, "IDE_CONFIG_NOT_USAGE"), (_notes_have("API KEY", "TOKEN", "CREDENTIAL"), "CREDENTIAL_FILE_ONLY"),
            (_notes_have("API KEY", "TOKEN", "CREDENTIAL"), "ATTRIBUTION_NOT_ESTABLISHED"),
            (found, "USE_NOT_ESTABLISHED"), (~found, "PORTABLE_INSTALL_POSSIBLE"), (~found, "CUSTOM_PATH_POSSIBLE"),
            (~found, "NEGATIVE_FINDING_SCOPED"), (several, "MULTI_SURFACE_PRODUCT")),
        "NATIVE_DESKTOP": flags(
            (has("BROWSER"), "BROWSER_ACCESS_ONLY"),
            (_notes_have("REMOTE") | F.contains(F.upper("category"), F.lit("API")), "REMOTE_INFERENCE_POSSIBLE"),
            (_notes_have("PORTABLE"), "PORTABLE_INSTALL_POSSIBLE"), (_notes_have("SYNC"), "CLOUD_SYNC_POSSIBLE"),
            (_notes_have("API KEY") | F.contains(F.upper("category"), F.lit("CREDENTIAL")),
             "ATTRIBUTION_NOT_ESTABLISHED"),
            (several, "MULTI_SURFACE_PRODUCT"), (found, "USE_NOT_ESTABLISHED"), (~found, "NEGATIVE_FINDING_SCOPED"),
            (~found, "PORTABLE_INSTALL_POSSIBLE"), (~found, "CUSTOM_PATH_POSSIBLE")),
    }
    col = F
    for name, value in by_class.items():
        col = col.when(F.col("surface_class") == name, value)
    base = F.array_distinct(col.otherwise(F.array().cast("array<string>")))
    added = flags((yes, "PRESENCE_ONLY"), (F.col("class_count") <= 1, "CORROBORATION_LEVEL_LIMITED"))
    out = (
        F.when(F.col("status") == NOT_VERIFIED, F.when(
            F.col("os_supported"), F.array(F.lit("PARSER_LIMITATION"), F.lit("NEGATIVE_FINDING_SCOPED")))
            .otherwise(F.array(F.lit("OS_OR_HARDWARE_LIMITATION"), F.lit("NEGATIVE_FINDING_SCOPED"))))
        .when(found, F.concat(base, added)).otherwise(base))
    return entries.withColumn("caveat_flags", out)


def caveat_text(flags: Column) -> Column:
    """Texts of flags; a flag without a text stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in V.CAVEAT_TEXT.items() for x in pair])
    return F.transform(flags, lambda f: F.coalesce(F.element_at(table, f), f))


def checklist(tools: DataFrame, case_os: DataFrame, profiles: DataFrame, inventory: DataFrame) -> DataFrame:
    """Status of every tool in every case, with paths, corroboration, scope and caveats.

    ``tools``: tool_id, tool_name, category, platform_supported,
    execution_surface, artifact_path_candidates, detection_method, notes.
    """
    described = surface_class(tools).withColumnRenamed("notes", "tool_notes")
    matched = match_tool_paths(expand_tool_paths(tool_paths(tools), profiles, case_os), inventory)
    hits = matched.groupBy("case_id", "tool_id", "path").agg(F.min("ord").alias("ord")).groupBy("case_id", "tool_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"),
        distinct(evidence_class(F.col("path"))).alias("class_count"))
    # Every case gets every tool, if it has one of the systems a case can have.
    systems = ("Windows", "macOS", "Linux", "iPhone", "Android", V.UNKNOWN)
    every = join_few(described, case_os.where(F.col("os").isin(*systems)), [], ["tool_id"])
    has_templates = F.size(F.coalesce(F.element_at("artifact_path_candidates", F.col("os")), F.array().cast("array<string>"))) > 0
    supported = F.array_contains("platform_supported", F.col("os")) | (F.col("os") == V.UNKNOWN)
    looked_for = supported & has_templates
    joined = every.join(hits, ["case_id", "tool_id"], "left").withColumn("os_supported", supported).withColumns({
        "paths": F.coalesce(F.when(looked_for, F.col("paths")), F.array().cast("array<string>")),
        "class_count": F.coalesce(F.when(looked_for, F.col("class_count")), F.lit(0)),
        "looked_for": looked_for})
    count = F.size("paths")
    status = F.when(~F.col("looked_for"), NOT_VERIFIED).when(count > 0, FOUND).otherwise(NOT_FOUND)
    out = joined.withColumn("status", status).withColumn("artifact_count", count).drop("looked_for")
    return caveat_flags(derive_checklist(out)).drop("artifact_path_candidates", "platform_supported")


def derive_checklist(entries: DataFrame) -> DataFrame:
    """Corroboration, attribution scope, inference location, confidence, coverage and notes of an entry."""
    found, n = F.col("status") == FOUND, F.col("artifact_count")
    browser_only = F.array_contains("execution_surface", "BROWSER") & (F.size("execution_surface") == 1)
    category = F.col("category")

    def names(*words: str) -> Column:
        out = F.contains(category, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(category, F.lit(w))
        return out

    return entries.withColumns({
        "corroboration": F.when(found & (n >= 2) & (F.col("class_count") >= 2),
                                "LEVEL_2_CONFIGURATION_OR_WORKSPACE_INDICATORS")
        .otherwise("LEVEL_1_PRESENCE_OR_ACCESS_ONLY"),
        "attribution_scope": F.when(browser_only, "DEVICE_LEVEL_ONLY").when(found, "USER_PROFILE_LINKED")
        .otherwise("PERSON_ATTRIBUTION_NOT_ESTABLISHED"),
        "inference_location": F.when(names("Local LLM", "Image Generator"), "LOCAL")
        .when(names("Browser", "Web"), "REMOTE").otherwise("UNKNOWN"),
        "tool_confidence": F.when(found & (n >= 2), "HIGH").when(found, "MEDIUM").otherwise("N/A"),
        "coverage_status": F.when(F.col("status") == NOT_VERIFIED, "NOT_COVERED").otherwise("COVERED"),
    })


def coverage_ledger(entries: DataFrame) -> DataFrame:
    """Found tools as coverage rows with all their paths and flags."""
    paths = F.array_join("paths", ", ")
    return entries.where(F.col("status") == FOUND).select(
        "case_id", "tool_id", F.lit("coverage").alias("ledger"), paths.alias("place"),
        F.col("artifact_count").alias("evidence_count"), F.array_join("caveat_flags", "; ").alias("caveats"))


def gap_ledger(entries: DataFrame) -> DataFrame:
    """Tools that were looked for and not found as gap rows."""
    return entries.where(F.col("status") == NOT_FOUND).select(
        "case_id", "tool_id", F.lit("gap").alias("ledger"),
        F.concat(F.lit("NOT_FOUND: "), "tool_name").alias("place"), F.lit(0).alias("evidence_count"),
        F.array_join("caveat_flags", "; ").alias("caveats"))


def checklist_artifacts(entries: DataFrame) -> DataFrame:
    """Found paths as artifacts with their evidence class in the notes."""
    from footmark.operators.artifacts import as_artifacts
    rows = entries.where(F.col("status") == FOUND).withColumn("path", F.explode("paths"))
    return as_artifacts(
        rows, "tool", ["tool_id", "path"], artifact_family=V.INSTALL, artifact_type=F.col("tool_name"),
        artifact_path=F.col("path"), parser_used="ToolScanner", access_mode="Read Only",
        classification="Circumstantial", attribution_layer="Device", initial_confidence="Medium",
        timestamp_type="Filesystem Modified",
        notes=F.concat(F.lit("Tool detected: "), "tool_name", F.lit(" ("), "category", F.lit("). Evidence class: "),
                       evidence_class(F.col("path")), F.lit(". "), F.coalesce("tool_notes", F.lit(""))))
