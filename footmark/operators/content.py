"""Files and texts: names, screenshots, prompt and answer remnants, links, assets, blobs, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions import matching as M
from footmark.functions.rules import RuleBook
from footmark.operators.artifacts import as_artifacts


def match_filename(files: DataFrame, rules: RuleBook, name_col: str = "name") -> DataFrame:
    """File names that look like a download or export of a platform: adds platform and pattern."""
    both = rules.of("download_re", "export_re")
    name = F.lower(name_col)
    found = files.withColumn("platform", M.match_regex_platform(name, both)).where(F.col("platform").isNotNull())
    return found.withColumn("pattern", M.first_regex_of_platform(name, F.col("platform"), both))


def match_screenshot(files: DataFrame, rules: RuleBook, name_col: str = "name") -> DataFrame:
    """Image files whose name points to a platform."""
    name = F.lower(name_col)
    return files.where(M.extension(F.col(name_col)).isin(V.SCREENSHOT_EXT)).withColumn(
        "platform", M.match_regex_platform(name, rules.of("screenshot_re"))
    ).where(F.col("platform").isNotNull())


def scan_content(df: DataFrame, rules: RuleBook, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """Per text at most one prompt and one answer row per platform, and at most one model row.

    Adds remnant, platform, model, indicator, layer.  Whole texts are searched;
    ``max_chars`` leaves out longer texts altogether.
    """
    rows = df if max_chars is None else df.where(F.length(text_col) <= max_chars)
    text = F.col("text_lower")

    def slots(kind: str, remnant: str) -> list[Column]:
        out = []
        for platform in rules.platforms(kind):
            mine = [r for r in rules.of(kind) if r.platform == platform]
            first = M.first_pattern(text, mine)
            hit = F.struct(
                F.lit(remnant).alias("remnant"), F.lit(platform).alias("platform"),
                F.lit(V.UNKNOWN).alias("model"), first.alias("indicator"), F.lit("Platform").alias("layer"))
            out.append(F.when(M.contains_any(text, [r.pattern for r in mine]), hit))
        return out

    models = rules.of("model")
    model = M.match_model(text, models)
    owner = M.chain([(F.col("found_model") == m, F.lit(p)) for m, p in
                     dict((r.model, r.platform) for r in reversed(models)).items()])
    model_hit = F.when(F.col("found_model").isNotNull(), F.struct(
        F.lit("Model Reference").alias("remnant"), F.coalesce(owner, F.lit(V.UNKNOWN)).alias("platform"),
        F.col("found_model").alias("model"), F.col("found_model").alias("indicator"),
        F.lit("Model").alias("layer")))
    hits = F.array_compact(F.array(
        *slots("prompt", "Prompt Remnant"), *slots("response", "Response Remnant"), model_hit))
    return (
        rows.withColumn("text_lower", F.lower(text_col)).withColumn("found_model", model)
        .withColumn("hit", F.explode(hits)).select(*df.columns, "hit.*")
    )


def file_artifacts(files: DataFrame, rules: RuleBook) -> list[DataFrame]:
    """Artifacts of a file inventory (case_id, user_profile, path, name, mtime, text).

    One table each for file names, screenshots and texts; ``text`` is null for
    files that are not text.
    """
    known = dict(ts=F.col("mtime"), timestamp_type="Modified", tz_norm=F.col("mtime").isNotNull(),
                 artifact_path=F.col("path"), suspected_platform=F.col("platform"),
                 initial_confidence="Low", parser_used="ContentExtractor")
    named = as_artifacts(
        match_filename(files, rules), "file_name", ["path"], artifact_family=V.CONTENT,
        artifact_type="AI Export/Download File", artifact_subtype="Filename Pattern Match",
        extracted_indicator=F.concat(F.lit("File: "), "name", F.lit(" (pattern: "), "pattern", F.lit(")")),
        notes="Filename suggestive of AI output. A filename alone is only a weak indicator "
              "unless corroborated.", **known)
    shots = as_artifacts(
        match_screenshot(files, rules), "screenshot", ["path"], artifact_family=V.SCREENSHOT,
        artifact_type="Screenshot", artifact_subtype="AI Session Screenshot",
        extracted_indicator=F.concat(F.lit("Screenshot: "), "name"),
        notes="Screenshot filename suggests AI session. Cannot confirm chronology without "
              "timestamp correlation.", **known)
    texts = files.where(M.extension(F.col("name")).isin(V.TEXT_EXT))
    word = F.col("remnant")
    content = as_artifacts(
        scan_content(texts, rules), "content", ["path", "remnant", "platform"],
        artifact_family=V.CONTENT, artifact_type="Content Indicator", artifact_subtype=word,
        extracted_indicator=F.when(
            word == "Model Reference", F.concat(F.lit("Model string: "), "indicator", F.lit(" in "), "name")
        ).otherwise(F.concat(F.split(word, " ")[0], F.lit(" indicator: '"), "indicator", F.lit("' in "), "name")),
        suspected_model=F.col("model"), attribution_layer=F.col("layer"),
        notes=F.when(word == "Model Reference",
                     "Model identifier found in file content. Stronger than platform-only.")
        .otherwise(F.concat(F.split(word, " ")[0], F.lit(" indicator string found in file content."))),
        **known)
    return [named, shots, content]


def extract_shared_links(df: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """One row per shared-conversation URL of a text, in text order: adds pos, url, platform."""
    text = F.col(text_col) if max_chars is None else F.substring(text_col, 1, max_chars)
    urls = F.regexp_extract_all(text, F.lit(V.SHARE_LINK_PATTERN), 0)
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(urls).alias("pos", "url")).withColumn(
        "platform", M.first_word(F.lower("url"), V.SHARE_LINK_PLATFORMS, V.UNKNOWN))


def shared_link_artifacts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Input columns: case_id, path and the text."""
    links = extract_shared_links(df, text_col).withColumn(
        "link_id", F.sha2(F.concat_ws("|", "case_id", "path", F.col("pos").cast("string"), "url"), 256))
    return as_artifacts(
        links, "shared_link", ["path", "pos", "url"], artifact_family=V.HISTORY,
        artifact_type="Shared AI Link", artifact_subtype="share_url", artifact_path=F.col("path"),
        parser_used="SharedLinkExtractor", extracted_indicator=F.col("url"),
        suspected_platform=F.col("platform"), classification="Direct", initial_confidence="High",
        source_class="Browser-Derived", acquisition_source="Shared Link Capture",
        platform_surface="Browser Web", related_link_id=F.col("link_id"),
        notes=F.concat(F.lit("[SharedLink] Shared AI platform URL found in "), M.basename(F.col("path"))),
    )


def evidence_class(path: Column) -> Column:
    """Evidence class A to F of a path: first keyword set that fits, else presence."""
    lowered = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    branches = [
        (M.any_of(F.contains(lowered, F.lit(w)) for w in words), F.lit(name))
        for name, words in V.EVIDENCE_CLASS_WORDS
    ]
    return M.chain(branches, F.lit(V.DEFAULT_EVIDENCE_CLASS))


def context_urls(df: DataFrame, domains: list[str], text_col: str = "text") -> DataFrame:
    """One row per domain of a text and URL that holds it, whole; the domain itself where no URL does.

    Adds domain, found.  All hits of whole texts count.
    """
    keep = [c for c in df.columns if c != text_col]
    lowered = F.lower(text_col)
    urls = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"https?://[^\s\"'<>\x00-\x1f]{5,}"), 0))

    def slot(domain: str) -> Column:
        word = F.lit(domain.lower())
        holding = F.filter(F.col("urls"), lambda u: F.contains(F.lower(u), word))
        return F.when(F.contains(F.col("lowered"), word), F.struct(F.lit(domain).alias("domain"), F.when(
            F.size(holding) > 0, holding).otherwise(F.array(F.lit(domain))).alias("found")))

    hit = (df.withColumn("lowered", lowered).where(M.contains_any(F.col("lowered"), [x.lower() for x in domains]))
           .withColumn("urls", urls).select(*keep, F.explode(F.array_compact(F.array(*map(slot, domains)))).alias("hit")))
    return hit.select(*keep, "hit.domain", F.explode("hit.found").alias("found"))


# --- generated assets, images, manifests, blobs -------------------------------

def _has_bytes(content: Column, text: str) -> Column:
    return F.contains(content, F.lit(text.encode()))


def detect_assets(files: DataFrame, header_bytes: int | None = None) -> DataFrame:
    """Generated assets by name, else by credential marker in an image, else by JSON sidecar keys.

    Input columns: case_id, path, name, size, mtime, content.  Adds method,
    asset_type, platform, file_hash.  The marker is looked for in the whole
    file unless ``header_bytes`` limits the search.
    """
    name, ext = F.lower("name"), M.extension(F.col("name"))
    head = F.col("content") if header_bytes is None else F.substring("content", 1, header_bytes)
    is_image = ext.isin(V.ASSET_IMAGE_EXT)
    marker = M.any_of(_has_bytes(head, m) for m in V.CREDENTIAL_MARKERS)
    sidecar = F.arrays_overlap(
        F.json_object_keys(M.lenient_text(F.col("content"))), F.array(*[F.lit(k) for k in V.SIDECAR_KEYS]))
    method = (
        F.when(M.contains_any(name, V.ASSET_NAMES), "filename_match")
        .when(is_image & marker, "c2pa_manifest")
        .when((ext == "json") & F.coalesce(sidecar, F.lit(False)), "metadata_sidecar")
    )
    return (
        files.withColumn("method", method).where(F.col("method").isNotNull())
        .withColumn("asset_type", F.when(is_image, "image").otherwise("document"))
        .withColumn("platform", M.first_word(name, V.ASSET_PLATFORMS, V.UNKNOWN))
        .withColumn("file_hash", F.sha2("content", 256)).drop("content")
    )


def asset_artifacts(files: DataFrame) -> DataFrame:
    found = detect_assets(files).withColumn("asset_id", F.sha2(F.concat_ws("|", "case_id", "path"), 256))
    return as_artifacts(
        found, "asset", ["path"], artifact_family=V.CONTENT, artifact_type="Generated Asset",
        artifact_subtype=F.concat("asset_type", F.lit(":"), "method"), artifact_path=F.col("path"),
        parser_used="AssetExtractor", ts=F.col("mtime"),
        extracted_indicator=F.concat(F.lit("AI-generated "), "asset_type", F.lit(": "), "name"),
        suspected_platform=F.col("platform"), initial_confidence="Moderate",
        source_class="Content-Remnant-Derived", acquisition_source="Generated File Capture",
        related_asset_id=F.col("asset_id"),
        notes=F.concat(F.lit("[GeneratedAsset] Detection: "), "method", F.lit(". Hash: "),
                       F.substring("file_hash", 1, 16), F.lit("... C2PA: "),
                       F.when(F.col("method") == "c2pa_manifest", "present").otherwise("absent"), F.lit(".")),
    )


def detect_stripped_images(files: DataFrame, min_size: int = 0, header_bytes: int | None = None) -> DataFrame:
    """AI-named JPEG files without an EXIF marker: in the whole file unless ``header_bytes`` limits the search, in
    files of any size unless ``min_size`` names one."""
    name = F.lower("name")
    head = F.col("content") if header_bytes is None else F.substring("content", 1, header_bytes)
    return files.where(
        M.extension(F.col("name")).isin("png", "jpg", "jpeg", "webp")
        & M.regex_any(name, V.STRIPPED_IMAGE_PATTERNS) & (F.col("size") >= min_size)
        & F.startswith(head, F.unhex(F.lit("FFD8"))) & ~F.contains(head, F.unhex(F.lit("FFE1")))
    ).drop("content")


def sniff_blobs(files: DataFrame, blob_rules: DataFrame, marker_bytes: int | None = None) -> DataFrame:
    """One row per blob and format rule whose header bytes fit.

    ``blob_rules`` (name, extension, header, footer, validate_internal,
    min_size, max_size) is a small table, read here into literals after a check
    of its size.  A rule with a maximum looks at so many bytes of a blob and no
    more; one with a minimum leaves shorter blobs out.  ZIP, SQLite and PDF
    rules that ask for it are checked inside.  Adds rule, carved_ext,
    validation, platform, recovery_status, confidence_hint.
    """
    rules = blob_rules.select("name", "extension", "header", "footer", "validate_internal", "min_size", "max_size").limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("more than 1000 blob rules")
    whole = F.col("content")

    def validated(name: str, data: Column) -> Column:
        """What the inside of a blob says about its format."""
        if name in ("DOCX", "ZIP", "ChatGPT_Export"):
            state = F.when(F.startswith(data, F.unhex(F.lit("504B0304"))) & (F.length(data) > 30), F.when(
                F.contains(data, F.unhex(F.lit("504B0506"))), "Valid").otherwise("Partial Structure"))
        elif name == "SQLite":
            state = F.when(F.startswith(data, F.lit(b"SQLite format 3\x00")) & (F.length(data) >= 100), "Valid")
        elif name == "PDF":
            state = F.when(F.startswith(data, F.lit(b"%PDF-")), F.when(
                F.contains(data, F.lit(b"%%EOF")), "Valid").otherwise("Partial Structure"))
        else:
            return F.lit("Header Only")
        return F.coalesce(state, F.lit("Header Only"))

    slots = []
    for name, ext, header, footer, validate, least, most in rules:
        data = whole if most is None else F.substring(whole, 1, most)
        fits = (F.startswith(data, F.lit(bytes(header))) & (F.length(data) > len(header))
                & (F.length(data) >= least))
        closed = F.contains(F.substring(data, F.lit(len(header) + 1), F.length(data)), F.lit(bytes(footer))) \
            if footer else F.lit(False)
        state = validated(name, data) if validate else F.lit("Not Validated")
        slots.append(F.when(fits, F.struct(
            F.lit(name).alias("rule"), F.lit(ext).alias("carved_ext"), state.alias("validation"),
            F.when(closed, "Complete").otherwise("Partial").alias("recovery_status"),
            F.when(closed, "Moderate").otherwise("Low").alias("confidence_hint"))))
    sample = whole if marker_bytes is None else F.substring(whole, 1, marker_bytes)
    lowered = F.lower(F.decode(sample, "ISO-8859-1"))
    return (
        files.withColumn("found", F.explode(F.array_compact(F.array(*slots))))
        .withColumn("platform", M.first_word(lowered, V.BLOB_MARKERS, V.UNKNOWN))
        .select(*[c for c in files.columns if c != "content"], "found.*", "platform")
    )


def sniff_ranges(ranges: DataFrame, blob_rules: DataFrame) -> DataFrame:
    """``sniff_blobs`` for files that were read in ranges (``sources.ranges``), and so of any size.

    Each range says what it holds of a file: the header if it is the first, footers, marks of structure, platform
    markers.  What lies across a border is whole in an overlap, which must be as long as the longest of them; a file's
    facts are then the union over its ranges, one short row for each of them.
    """
    rules = blob_rules.select("name", "extension", "header", "footer", "validate_internal", "min_size", "max_size").limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("more than 1000 blob rules")
    keep = [c for c in ranges.columns if c not in ("first", "start", "stop", "data")]
    insides = {"DOCX": "504B0506", "ZIP": "504B0506", "ChatGPT_Export": "504B0506", "PDF": "2525454F46"}
    begins = F.col("first") == 0

    def seen(what: bytes, most: int | None, after: int) -> Column:
        """Whether a range holds some bytes that lie behind the first ``after`` ones of the file and within ``most``."""
        stop = F.lit(2**31 - 1) if most is None else F.greatest(F.lit(most) - F.col("first"), F.lit(0)).cast("int")
        skip = F.greatest(F.lit(after) - F.col("first"), F.lit(0)).cast("int")
        return F.contains(F.substring(F.substring("data", F.lit(1), stop), skip + 1, F.lit(2**31 - 1)), F.lit(what))

    facts, plain = [], F.coalesce("data", F.lit(b""))
    for i, r in enumerate(rules):
        most = r["max_size"]
        facts.append(F.max(begins & F.startswith(plain, F.lit(bytes(r["header"])))).alias(f"head_{i}"))
        facts.append(F.max(seen(bytes(r["footer"]), most, len(r["header"])) if r["footer"] else F.lit(False)).alias(f"foot_{i}"))
        inside = insides.get(r["name"]) if r["validate_internal"] else None
        facts.append(F.max(seen(bytes.fromhex(inside), most, 0) if inside else F.lit(False)).alias(f"inside_{i}"))
    starts = {"DOCX": b"PK\x03\x04", "ZIP": b"PK\x03\x04", "ChatGPT_Export": b"PK\x03\x04", "SQLite": b"SQLite format 3\x00", "PDF": b"%PDF-"}
    for what in set(starts.values()):
        facts.append(F.max(begins & F.startswith(plain, F.lit(what))).alias("begins_" + what.hex()))
    lowered = F.lower(F.decode(F.col("data"), "ISO-8859-1"))
    words = [w for w, _ in V.BLOB_MARKERS]
    marker = M.chain([(F.contains(lowered, F.lit(w)), F.lit(i)) for i, w in enumerate(words)], F.lit(len(words)))
    files = ranges.groupBy(*keep).agg(*facts, F.min(marker).alias("marker"))
    slots = []
    for i, r in enumerate(rules):
        name, least, most = r["name"], r["min_size"], r["max_size"]
        size = F.col("size") if most is None else F.least(F.col("size"), F.lit(most))
        header = len(r["header"])
        if not r["validate_internal"]:
            state = F.lit("Not Validated")
        elif name in starts:
            right = F.col("begins_" + starts[name].hex())
            enough = size >= 100 if name == "SQLite" else size > 30 if name != "PDF" else size >= 5
            whole = F.lit("Valid") if name == "SQLite" else F.when(F.col(f"inside_{i}"), "Valid").otherwise("Partial Structure")
            state = F.when(right & enough, whole).otherwise("Header Only")
        else:
            state = F.lit("Header Only")
        closed = F.col(f"foot_{i}")
        slots.append(F.when(F.col(f"head_{i}") & (size > header) & (size >= least), F.struct(
            F.lit(name).alias("rule"), F.lit(r["extension"]).alias("carved_ext"), state.alias("validation"),
            F.when(closed, "Complete").otherwise("Partial").alias("recovery_status"),
            F.when(closed, "Moderate").otherwise("Low").alias("confidence_hint"))))
    platforms = F.array(*[F.lit(p) for _, p in V.BLOB_MARKERS], F.lit(V.UNKNOWN))
    return (files.withColumn("found", F.explode(F.array_compact(F.array(*slots)))).withColumn("platform", F.get(platforms, F.col("marker")))
            .select(*keep, "found.*", "platform"))


MANIFEST_SCHEMA = "actions array<struct<action string, softwareAgent string>>, claim_generator string"


def classify_manifests(df: DataFrame, json_col: str = "manifest") -> DataFrame:
    """Credential manifests: adds ai_detected, platform, confidence, classification.

    The last generator rule that fits names the platform, claim generator after
    the agents of the actions.
    """
    m = F.from_json(F.col(json_col), MANIFEST_SCHEMA)
    raw_info = F.coalesce(F.get_json_object(json_col, "$.generativeInfo"), F.get_json_object(json_col, "$.ai_info"))
    info = F.coalesce(~raw_info.isin("", "{}", "[]", "null", "false", "0"), F.lit(False))
    words = V.MANIFEST_ACTION_WORDS
    actions = F.coalesce(m["actions"], F.array().cast("array<struct<action:string,softwareAgent:string>>"))
    acted = F.exists(actions, lambda a: M.contains_any(F.lower(F.coalesce(a["action"], F.lit(""))), words))
    named = list(reversed(V.MANIFEST_GENERATORS))
    agents = F.filter(
        F.transform(actions, lambda a: M.first_word(F.lower(F.coalesce(a["softwareAgent"], F.lit(""))), named)),
        lambda p: p.isNotNull())
    by_claim = M.first_word(F.lower(m["claim_generator"]), named)
    by_agent = F.when(F.size(agents) > 0, F.element_at(agents, -1))
    found = F.coalesce(by_claim, by_agent)
    return (
        df.withColumn("found", found).withColumn("ai_detected", acted | info | F.col("found").isNotNull())
        .withColumn("platform", F.coalesce("found", F.lit(V.UNKNOWN))).drop("found")
        .withColumn("confidence", F.when(F.col("ai_detected"), "High").otherwise("Moderate"))
        .withColumn("classification", F.when(F.col("ai_detected"), "Direct").otherwise("Inferred"))
    )


def classify_transcripts(df: DataFrame) -> DataFrame:
    """Transcripts and audio files: platform by words of content and name.

    Input columns: name, text (null or empty for audio).  JSON text is replaced
    by its text, transcript or content field; both count for the platform.
    """
    ext = M.extension(F.col("name"))
    raw = F.coalesce("text", F.lit(""))
    entries = F.from_json(raw, "array<struct<text:string,transcript:string>>")
    joined = F.array_join(F.transform(entries, lambda e: F.coalesce(e["text"], e["transcript"], F.lit(""))), "\n")
    picked = F.coalesce(
        F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.transcript"),
        F.get_json_object(raw, "$.content"), F.when(F.startswith(F.ltrim(raw), F.lit("[")), joined), F.lit(""))
    said = F.when(ext == "json", picked).otherwise(raw)
    lowered = F.lower(F.concat_ws(" ", F.when(ext == "json", said).otherwise(F.lit(None)), raw, "name"))
    with_text = F.length("transcript") > 0
    return (
        df.withColumn("transcript", said)
        .withColumn("platform", M.first_word(lowered, V.TRANSCRIPT_WORDS, V.UNKNOWN))
        .withColumn("classification", F.when(with_text, "Direct").otherwise("Inferred"))
        .withColumn("confidence", F.when(with_text, "Moderate").otherwise("Low"))
    )


def transcript_artifacts(df: DataFrame) -> DataFrame:
    """Input columns: case_id, path, name, mtime, text."""
    said = F.col("transcript")
    found = classify_transcripts(df).withColumn("voice_id", F.sha2(F.concat_ws("|", "case_id", "path"), 256))
    kind = F.when(F.length(said) == 0, "Audio Metadata").when(M.extension(F.col("name")) == "json", "Voice Session Log")
    return as_artifacts(
        found, "transcript", ["path"], artifact_family=V.CONTENT, artifact_type="Voice/Audio Evidence",
        artifact_subtype=kind.otherwise("Transcript Text"), artifact_path=F.col("path"), parser_used="TranscriptExtractor",
        ts=F.col("mtime"), suspected_platform=F.col("platform"), classification=F.col("classification"),
        initial_confidence=F.col("confidence"), source_class="Voice-Derived", acquisition_source="Transcript Capture",
        platform_surface="Voice Session", related_voice_id=F.col("voice_id"),
        extracted_indicator=F.when(F.length(said) > 0, said).otherwise(
            F.concat(F.lit("Audio file: "), "name")))
