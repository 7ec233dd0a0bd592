"""Provider exports: conversations flattened to rows, export files recognized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions.rules import RuleBook
from footmark.functions.timeconv import to_ts
from footmark.operators.artifacts import as_artifacts
from footmark.operators.hits import redact_text

EXPORT_SCHEMA = """
    id string, title string, create_time double, update_time double, default_model_slug string,
    model_slug string, model string, source string, plugin_ids array<string>, gizmo_id string,
    mapping map<string, struct<message: struct<
        author: struct<role: string, name: string>,
        content: struct<parts: array<string>>,
        create_time: double,
        metadata: struct<model_slug: string>>>>
"""


def slug_model(slug: Column) -> Column:
    """Model of a slug from the slug table; unknown slugs give null."""
    return M.chain([(slug == s, F.lit(m)) for s, m in V.MODEL_SLUGS.items()])


def message_text(parts: Column) -> Column:
    """Parts joined; a part that is a JSON object counts as its content type in brackets."""
    kind = lambda p: F.get_json_object(p, "$.content_type")
    return F.array_join(F.transform(parts, lambda p: F.when(
        F.startswith(p, F.lit("{")),
        F.coalesce(F.concat(F.lit("["), kind(p), F.lit("]")), F.lit(""))).otherwise(p)), "")


def replay_exports(exports: DataFrame, rules: RuleBook, max_messages: int | None = None) -> DataFrame:
    """Artifacts of conversation exports: one per conversation, message and plugin.

    Input: the columns of ``EXPORT_SCHEMA`` with case_id, user_profile and path.
    All messages are kept unless ``max_messages`` is given.
    """
    slug = F.coalesce("default_model_slug", F.lit(""))
    model = F.coalesce(slug_model(slug), M.match_model(F.lower(slug), rules.of("model")), F.lit(V.UNKNOWN))
    base = (
        exports.withColumn("slug", slug).withColumn("model_name", model)
        .withColumn("created", to_ts(F.col("create_time"), "unix_s"))
        .withColumn("name", F.coalesce("title", F.lit("Untitled")))
        .withColumn("conv", F.coalesce("id", F.lit("")))
    )
    known = dict(artifact_family=V.CONTENT, artifact_path=F.col("path"), parser_used="ExportReplay",
                 timestamp_type="Created", suspected_platform="ChatGPT", initial_confidence="High",
                 classification="Direct")
    plugins = F.when(F.size(F.coalesce("plugin_ids", F.array().cast("array<string>"))) > 0,
                     F.concat(F.lit(" | Plugins: "), F.array_join("plugin_ids", ", ")))
    gizmo = F.when(F.coalesce("gizmo_id", F.lit("")) != "", F.concat(F.lit(" | Custom GPT: "), "gizmo_id"))
    conversations = as_artifacts(
        base, "conversation", ["path", "conv", "name", "create_time"], artifact_type="ChatGPT Conversation",
        artifact_subtype="conversation_export", ts=F.col("created"), suspected_model=F.col("model_name"),
        access_mode="Browser", attribution_layer="Model",
        extracted_indicator=F.concat(
            F.lit("Conversation: '"), "name", F.lit("' (ID: "), "conv", F.lit(") Model: "),
            F.coalesce(F.nullif(F.col("slug"), F.lit("")), F.lit("unknown")),
            F.coalesce(plugins, F.lit("")), F.coalesce(gizmo, F.lit(""))), **known)

    nodes = base.select("case_id", *[c for c in ("user_profile",) if c in exports.columns], "path", "conv",
                        "name", "slug", "model_name", F.posexplode("mapping").alias("node_no", "node_id", "node"))
    message = F.col("node.message")
    role = F.col("role")
    turns = (
        nodes.withColumn("role", message["author"]["role"]).where(role.isin("user", "assistant", "tool"))
        .withColumn("text", F.coalesce(message_text(message["content"]["parts"]), F.lit("")))
        .withColumn("tool", F.when(role == "tool", F.coalesce(message["author"]["name"], F.lit("unknown_tool"))))
        .withColumn("said_at", to_ts(message["create_time"], "unix_s"))
        .withColumn("own_slug", F.coalesce(message["metadata"]["model_slug"], F.lit("")))
    )
    if max_messages is not None:
        from pyspark.sql import Window
        w = Window.partitionBy("case_id", "path", "conv").orderBy("node_no")
        turns = turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_messages).drop("n")
    tool_tag = F.coalesce(F.concat(F.lit("(Tool: "), "tool", F.lit(") ")), F.lit(""))
    said = F.when(F.length("text") > 0, redact_text(F.col("text"))).otherwise("(empty)")
    messages = as_artifacts(
        turns, "message", ["path", "conv", "node_id"], artifact_type="ChatGPT Message",
        artifact_subtype=F.concat("role", F.lit("_message")), ts=F.col("said_at"),
        suspected_model=F.coalesce(slug_model(F.col("own_slug")), F.col("model_name")), access_mode="Browser",
        attribution_layer="Content",
        extracted_indicator=F.concat(F.lit("["), F.upper("role"), F.lit("] "), tool_tag, said),
        notes=F.concat(F.lit("Turn in conversation '"), "name", F.lit("'. Role: "), "role", F.lit(", Model: "),
                       F.coalesce(F.nullif(F.col("own_slug"), F.lit("")), F.col("slug")),
                       F.lit(". Content length: "), F.length("text").cast("string"), F.lit(" chars.")), **known)

    used = base.withColumn("plugin", F.explode("plugin_ids"))
    plugin_rows = as_artifacts(
        used, "plugin", ["path", "conv", "plugin"], artifact_type="ChatGPT Plugin Usage",
        artifact_subtype="plugin_reference", ts=F.col("created"), suspected_model=F.col("model_name"),
        extracted_indicator=F.concat(F.lit("Plugin: "), "plugin", F.lit(" in conversation '"), "name", F.lit("'")),
        **known)
    return conversations.unionByName(messages).unionByName(plugin_rows)


def classify_exports(files: DataFrame) -> DataFrame:
    """Export files by name, or by parent folder for activity exports. Input columns: path, name."""
    name = F.lower("name")
    branches = [(name.isin(V.PROVIDER_FILES[p]), F.lit(p)) for p in ("ChatGPT", "Claude")]
    branches.append((M.parent_name(F.col("path")).isin(V.GEMINI_FOLDERS), F.lit("Gemini")))
    branches.append((name.isin(V.PROVIDER_FILES["Perplexity"]), F.lit("Perplexity")))
    return files.withColumn("platform", M.chain(branches)).where(F.col("platform").isNotNull()).withColumn(
        "subtype", F.concat(F.lower("platform"), F.lit("_export:"), "name"))


def export_file_artifacts(files: DataFrame) -> DataFrame:
    """Input columns: case_id, path, name, mtime."""
    return as_artifacts(
        classify_exports(files), "export_file", ["path"], artifact_family=V.CONTENT,
        artifact_type="Provider Export", artifact_subtype=F.col("subtype"), artifact_path=F.col("path"),
        parser_used="ProviderExportExtractor", ts=F.col("mtime"),
        extracted_indicator=F.concat(F.lit("Provider data export: "), "name"),
        suspected_platform=F.col("platform"), classification="Direct", initial_confidence="High",
        source_class="Provider-Export-Derived", acquisition_source="Provider Export",
        platform_surface="Provider Export",
        notes=F.concat(F.lit("[ProviderExport] first-party data export file: "), "name"),
    )


def provider_conversations(exports: DataFrame, max_per_file: int | None = None) -> DataFrame:
    """Conversation rows of a provider export file: platform by source, model by slug.

    Input: columns of ``EXPORT_SCHEMA`` with case_id and path.  Adds platform, model_name, created.
    """
    slug = F.coalesce(F.nullif(F.col("model_slug"), F.lit("")), F.col("model"), F.lit(""))
    rows = exports
    if max_per_file is not None:
        from pyspark.sql import Window
        w = Window.partitionBy("case_id", "path").orderBy("create_time", "id")
        rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_per_file).drop("n")
    claude = F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("claude"))
    return (
        rows.withColumn("platform", F.when(claude, "Claude").otherwise("ChatGPT"))
        .withColumn("model_name", F.coalesce(slug_model(F.lower(slug)), F.lit(V.UNKNOWN)))
        .withColumn("created", to_ts(F.col("create_time"), "unix_s"))
    )
