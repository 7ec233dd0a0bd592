"""The same questions in DuckDB SQL, formulated on their own.

Rules are joined as a table and the smallest order wins, sessions use plain
row-by-row windows, links compare whole groups: none of the shortcuts of the
Spark side is repeated here.
"""

from __future__ import annotations

from footmark.functions import fixed_values as V
from footmark.functions.rules import Rule, default_rules
from footmark.operators import episodes as E
from footmark.operators import reports as R
from footmark.operators import timeline as _T  # noqa: F401
from footmark.operators import traces
from footmark.plans import bindings as B
from footmark.plans import samples as S
from footmark.plans.queries import KEYWORDS

RULES = default_rules()


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pk(values: list[str], n: str) -> str:
    return f"list_extract({arr(values)}, CAST(({n}) % {len(values)} AS INTEGER) + 1)"


def inlist(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(str(c) if isinstance(c, (int, float)) else q(c) for c in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def rule_table(name: str, rules: list[Rule]) -> str:
    places = {p: i for i, p in enumerate(RULES.platforms())}
    return values(name, "ord, kind, platform, pattern, model, place",
                  [(i, r.kind, r.platform, r.pattern, r.model or "", places[r.platform]) for i, r in enumerate(rules)])


def of(*kinds: str) -> list[Rule]:
    return RULES.of(*kinds)


def first_match(name: str, source: str, key: str, text: str, rules: str, test: str = "contains", value: str = "platform") -> str:
    cond = {
        "contains": f"contains(lower({text}), lower(r.pattern))",
        "regex": f"regexp_matches({text}, r.pattern, 'i')",
        "cookie": f"(contains({text}, r.pattern) OR suffix({text}, ltrim(r.pattern, '.')))",
        "equal": f"{text} = r.pattern",
        "suffix": f"suffix({text}, r.pattern)",
    }[test]
    return (f"{name} AS (SELECT s.{key}, arg_min(r.{value}, r.ord) AS {value}, arg_min(r.pattern, r.ord) AS pattern "
            f"FROM {source} s JOIN {rules} r ON {cond} GROUP BY s.{key})")


def per_platform(source: str, key: str, text: str, rules: str, cond: str | None = None) -> str:
    cond = cond or f"contains(lower({text}), lower(r.pattern))"
    return (f"SELECT s.{key}, r.platform, arg_min(r.pattern, r.ord) AS pattern FROM {source} s JOIN {rules} r ON {cond} "
            f"GROUP BY s.{key}, r.platform")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def us(expr: str) -> str:
    return f"epoch_us({expr})"


def joined(expr: str) -> str:
    """Distinct values, sorted, as one text."""
    return f"coalesce(array_to_string(list_sort(list_distinct(list({expr}) FILTER (WHERE ({expr}) IS NOT NULL))), '|'), '')"


def texts(pairs: list[tuple[str, str]]) -> str:
    """List of the texts whose test holds."""
    items = ", ".join(f"CASE WHEN {t} THEN {x} END" for t, x in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


# --- evidence tables -------------------------------------------------------------
EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  'C' || (user_id % 4) AS case_id FROM events)"""

AT = """CASE WHEN k % 10 = 0 THEN NULL WHEN k % 6 < 3 THEN epoch_us(ts)
  WHEN k % 6 = 4 THEN (epoch_us(ts) // 1000) * 1000 ELSE (epoch_us(ts) // 1000000) * 1000000 END"""
RAW = f"""CASE WHEN k % 10 = 0 THEN 0 WHEN k % 6 = 0 THEN epoch_us(ts) + 11644473600000000 WHEN k % 6 = 1 THEN epoch_us(ts)
  WHEN k % 6 = 2 THEN (epoch_us(ts) + 11644473600000000) * 10 + 7 WHEN k % 6 = 3 THEN epoch_us(ts) // 1000000 - 978307200
  WHEN k % 6 = 4 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END"""
VIS = f"""vis AS (SELECT event_id, case_id, CAST(user_id AS VARCHAR) AS user_profile, {pk(B.BROWSERS, 'k')} AS browser,
  CASE WHEN event_id % 50 <> 0 THEN {pk(S.URLS, 'event_id')} || event_id END AS url,
  CASE WHEN k % 7 <> 0 THEN 'Page ' || event_type END AS title, k AS visit_count, {AT} AS at_us, {RAW} AS raw_time FROM ev)"""
DOWN = f"""down AS (SELECT event_id, case_id, 'C:\\Users\\a\\Downloads/' || {pk(S.FILE_HEADS, 'event_id // 3')} || event_id
  || {pk(S.FILE_TAILS, 'event_id // 2')} AS target_path, {pk(S.FILE_HEADS, 'event_id // 3')} || event_id
  || {pk(S.FILE_TAILS, 'event_id // 2')} AS name, {pk(S.URLS, 'event_id')} || 'dl' AS tab_url FROM ev)"""
COOK = f"cook AS (SELECT event_id, case_id, {pk(S.HOSTS, 'event_id')} AS host_key, 'c' || k AS name FROM ev)"
FILES = f"""fil AS (SELECT doc_id, 'C' || (doc_id % 4) AS case_id, n_chars AS size, {pk(S.FILE_HEADS, 'doc_id')} || doc_id
  || {pk(S.FILE_TAILS, 'doc_id // 5')} AS name, text || chr(10) || {pk(S.MARKERS, 'doc_id')} AS text FROM documents)"""
LOG = f"log AS (SELECT event_id AS line_no, ts, 'host: ' || {pk(S.LOG_TEXTS, 'event_id')} AS line FROM ev)"
KV = f"""kv AS (SELECT event_id, {pk(S.KEY_LABELS, 'k')} AS key_label, {pk(S.KEY_VALUES, 'event_id')} AS value,
  {pk(S.URLS, 'event_id')} AS origin_url, {pk(S.KEY_VALUES, 'event_id // 2')} AS data_url, {pk(B.BROWSERS, 'k')} AS agent,
  {pk(S.PROGRAMS, 'event_id')} AS display_name, {pk(S.KEY_VALUES, 'event_id // 3')} AS install_location,
  'key' || event_type AS key_name FROM ev)"""
PKG = f"""pkg AS (SELECT event_id, {pk(S.PACKAGES, 'event_id')} AS package,
  CASE WHEN k % 3 = 0 THEN k ELSE 0 END + k % 2 + CASE WHEN k % 5 = 0 THEN 2 * k ELSE 0 END AS total_bytes FROM ev)"""
TR = f"""tr AS (SELECT event_id, case_id, {pk(S.EXECUTIONS, 'event_id')} AS name, {pk(S.KNOWN_PATHS, 'k')} AS key_path,
  {pk(S.EVIDENCE_PATHS, 'event_id')} AS path FROM ev)"""
EXT = f"""ext AS (SELECT event_id, case_id, {pk([e for e, _ in S.EXTENSIONS], 'event_id')} AS ext_id,
  {pk([m for _, m in S.EXTENSIONS], 'event_id')} AS manifest, CAST(k AS VARCHAR) AS version,
  lower({pk(S.PROGRAMS, 'event_id')} || ' ' || {pk(S.LOG_TEXTS, 'event_id // 2')}) AS text FROM ev)"""

ART = f"""art AS (SELECT case_id, sha256(concat_ws('|', case_id, 'event', event_id)) AS record_id, event_id AS seq,
  CAST(user_id AS VARCHAR) AS user_profile,
  CASE event_type WHEN 'click' THEN 'ChatGPT' WHEN 'view' THEN 'Claude' WHEN 'purchase' THEN 'Gemini'
    WHEN 'signup' THEN 'DeepSeek' ELSE 'Unknown' END AS suspected_platform,
  {pk(S.FAMILIES, 'k')} AS artifact_family, {pk(S.TYPES, 'k')} AS artifact_type, {pk(S.SUBTYPES, 'k')} AS artifact_subtype,
  '/ev/' || user_id || '/' || k AS artifact_path, {pk(S.PARSERS, 'k')} AS parser_used,
  CASE WHEN k % {len(S.INDICATORS)} = 7 THEN '' ELSE {pk(S.INDICATORS, 'k')} || event_id END AS extracted_indicator,
  {pk(S.MODELS, 'k')} AS suspected_model, {pk(S.MODES, 'k')} AS access_mode,
  CASE WHEN value >= 20 THEN 'Direct' WHEN k % 3 = 0 THEN 'Circumstantial' ELSE 'Inferred' END AS classification,
  {pk(S.LAYERS, 'k')} AS attribution_layer, CASE WHEN value >= 50 THEN 'Moderate' ELSE 'Low' END AS initial_confidence,
  {pk(S.NOTES, 'k')} AS notes, {pk(S.SOURCES, 'event_id')} AS acq0, {pk(S.SURFACES, 'event_id')} AS surf0,
  k % 23 = 0 AS voice, k % 29 = 0 AS link, k % 31 = 0 AS asset,
  CASE WHEN k % 10 <> 0 THEN ts END AS ts, k % 2 = 0 AS tz_norm FROM ev)"""
COV = f"""cov AS (SELECT case_id, {pk(S.IMAGES, "CAST(substr(case_id, 2) AS INTEGER)")} AS image_type,
  case_id = 'C0' AS full_disk_available, case_id IN ('C0', 'C2') AS carving_enabled,
  CAST(substr(case_id, 2) AS INTEGER) % 3 AS profiles FROM (SELECT DISTINCT case_id FROM ev))"""


def _family_rows() -> list[tuple]:
    rows = []
    for f in dict.fromkeys([*V.FAMILY_RELIABILITY, V.INSTALL, "Unknown"]):
        cls = next((c for c, fs in V.SOURCE_CLASS.items() if f in fs), "Unknown")
        grp = "browser" if f in V.BROWSER_FAMILIES else "mounted" if f in V.MOUNTED_FAMILIES else "none"
        keep = ("strong" if f in V.STRONG_FAMILIES else "weak" if f in V.WEAK_FAMILIES
                else "trace" if f in V.TRACE_FAMILIES else "intact" if f in (V.SCREENSHOT, V.FILE_SYSTEM) else "none")
        rows.append((f, cls, grp, keep, f"{V.FAMILY_RELIABILITY.get(f, V.OTHER_RELIABILITY):e}",
                     V.PERSISTENCE_RATING.get(f, "Unknown")))
    return rows


FAM = values("fam", "family, cls, grp, keep, rel, rating", _family_rows())
ENR = f"""enr AS (SELECT a.*, f.cls AS source_class, CAST(f.rel AS DOUBLE) AS rel, f.rating,
  CASE WHEN acq0 <> 'Unknown' THEN acq0 WHEN contains(lower(notes), '[carved]') OR contains(lower(notes), '[raw]') THEN 'E01 Image'
    WHEN f.grp = 'browser' THEN 'Browser Artifact' WHEN artifact_family = 'Screenshot' THEN 'Screenshot Capture'
    WHEN f.grp = 'mounted' THEN 'Mounted Directory' ELSE 'Unknown' END AS acquisition_source,
  CASE WHEN surf0 <> 'Unknown' THEN surf0 WHEN f.grp = 'browser' THEN 'Browser Web'
    WHEN artifact_family = 'Native Application' THEN 'Native Desktop App' ELSE 'Unknown' END AS platform_surface,
  CASE WHEN lower(artifact_subtype) LIKE 'carved\\_%' ESCAPE '\\' OR contains(lower(notes), '[carved]') THEN '{V.FRAGMENT}'
    WHEN lower(artifact_subtype) LIKE 'raw\\_%' ESCAPE '\\' OR contains(lower(notes), '[raw]') THEN '{V.WEAKLY}'
    WHEN contains(lower(artifact_subtype), 'binary scan') THEN '{V.WEAKLY}'
    WHEN keep = 'strong' AND classification = 'Direct' THEN '{V.INTACT}' WHEN keep = 'strong' THEN '{V.PARTLY}'
    WHEN keep = 'weak' AND classification = 'Direct' THEN '{V.PARTLY}' WHEN keep = 'weak' THEN '{V.WEAKLY}'
    WHEN keep = 'trace' THEN '{V.PARTLY}' WHEN keep = 'intact' THEN '{V.INTACT}' ELSE '{V.NOT_OBSERVED}' END AS persistence_state
  FROM art a JOIN fam f ON f.family = a.artifact_family)"""
HR = """hr AS (SELECT case_id, suspected_platform, date_trunc('hour', ts) AS h,
  list(struct_pack(id := record_id, fam := artifact_family) ORDER BY seq) AS members
  FROM enr WHERE ts IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""
HL = """hl AS (SELECT e.*, coalesce(list_filter(hr.members, lambda x: x.id <> e.record_id)[1:5], []) AS links1
  FROM enr e LEFT JOIN hr ON hr.case_id = e.case_id AND hr.suspected_platform = e.suspected_platform
  AND hr.h = date_trunc('hour', e.ts))"""
PL = """ff AS (SELECT case_id, suspected_platform, artifact_family, min(seq) AS fs FROM enr GROUP BY ALL),
pl AS (SELECT e.case_id, e.suspected_platform,
  (list(struct_pack(id := e.record_id, fam := e.artifact_family) ORDER BY ff.fs, e.seq))[1:9] AS members
  FROM enr e JOIN ff USING (case_id, suspected_platform, artifact_family) GROUP BY ALL
  HAVING count(DISTINCT e.artifact_family) >= 2)"""
LNK = """l2 AS (SELECT hl.*, coalesce(list_filter(pl.members, lambda x: x.id <> hl.record_id)[1:3], []) AS links2
  FROM hl LEFT JOIN pl ON pl.case_id = hl.case_id AND pl.suspected_platform = hl.suspected_platform),
lnk AS (SELECT *, list_concat(links1, list_filter(links2, lambda x: NOT list_contains(list_transform(links1, lambda y: y.id), x.id)))
  AS links FROM l2)"""
SC0 = """CASE WHEN contains(lower(notes), 'weak indicator') THEN 7e-1 ELSE 1e0 END"""
SCORE = f"""((((((rel * CASE classification WHEN 'Direct' THEN 1e0 ELSE 5e-1 END
  * CASE attribution_layer WHEN 'Model' THEN 1e0 WHEN 'Content' THEN 8e-1 ELSE 6e-1 END)
  + CASE WHEN ts IS NOT NULL AND tz_norm THEN 1e-1 WHEN ts IS NOT NULL THEN 5e-2 ELSE 0e0 END)
  * {SC0}) * CASE WHEN contains(lower(notes), 'alone is not sufficient') THEN 7e-1 ELSE 1e0 END)
  * CASE WHEN contains(lower(notes), '[carved]') THEN 6e-1 WHEN contains(lower(notes), '[raw]') THEN 5e-1 ELSE 1e0 END)
  * CASE WHEN persistence_state = '{V.FRAGMENT}' THEN 7e-1 ELSE 1e0 END)"""


def level(expr: str) -> str:
    return f"CASE WHEN {expr} >= 7e-1 THEN 'High' WHEN {expr} >= 4e-1 THEN 'Moderate' WHEN {expr} >= 15e-2 THEN 'Low' ELSE 'Unsupported' END"


SCR = f"""s1 AS (SELECT *, {SCORE} AS score FROM lnk),
s2 AS (SELECT *, {level('score')} AS c0, len(list_distinct(list_transform(links, lambda x: x.fam))) AS lf FROM s1),
s3 AS (SELECT *, CASE WHEN lf >= 3 AND c0 = 'Moderate' THEN 'High' WHEN lf >= 1 AND c0 = 'Low' THEN 'Moderate' ELSE c0 END AS c1,
  contains(lower(notes), '[carved]') OR contains(lower(notes), '[raw]') AS rec FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN rec AND c1 = 'High' THEN notes || {q(V.RECOVERY_CAP_NOTE)} ELSE notes END AS notes),
  CASE WHEN rec AND c1 = 'High' THEN 'Moderate' ELSE c1 END AS c2 FROM s3),
scr AS (SELECT s4.* REPLACE (CASE WHEN c2 = 'High' AND image_type IN {inlist(V.PARTIAL_IMAGES)}
    THEN notes || {q(V.COVERAGE_CAP_NOTE)} ELSE notes END AS notes),
  CASE WHEN c2 = 'High' AND image_type IN {inlist(V.PARTIAL_IMAGES)} THEN 'Moderate' ELSE c2 END AS confidence,
  CASE c2 WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rank0, image_type
  FROM s4 LEFT JOIN cov USING (case_id))"""
RANK = "CASE confidence WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
LEVEL_OF = "list_extract(['Unsupported', 'Low', 'Moderate', 'High'], max(" + RANK + ") + 1)"
BASE = [EV, ART, COV, FAM, ENR]
SCORED = [*BASE, HR, HL, PL, LNK, SCR]


def sessions(name: str, source: str, keys: str) -> str:
    return f"""{name}_t AS (SELECT *, lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, seq) AS prev FROM {source} WHERE ts IS NOT NULL),
{name} AS (SELECT * EXCLUDE (prev), CAST(1 + sum(CASE WHEN ts - prev > INTERVAL 2 HOURS THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM {name}_t
  UNION ALL SELECT *, CAST(1 AS BIGINT) AS session_no FROM {source} WHERE ts IS NULL)"""


EK = "case_id, suspected_platform, user_profile"


def ses(source: str) -> list[str]:
    return [f"kn AS (SELECT * FROM {source} WHERE suspected_platform <> 'Unknown')", sessions("ses", "kn", EK)]


def mode_of(name: str, source: str, keys: str, column: str, first: str) -> str:
    """Most frequent known value per key; ties go to the row that comes first."""
    return f"""{name} AS (SELECT {keys}, {column} AS {name}_v FROM (SELECT {keys}, {column}, count(*) AS c, min({first}) AS f
  FROM {source} WHERE {column} <> 'Unknown' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, f) = 1)"""


def any_word(words: list[str], column: str = "extracted_indicator") -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {q(w)})" for w in words) + ")"


EPK = EK + ", session_no"
LETTER = "nullif(split_part(trim(regexp_extract(notes, 'Evidence class: ([^.]*)', 1)), '-', 1), '')"
ORDERED = f"""ord AS (SELECT *, row_number() OVER (PARTITION BY {EPK} ORDER BY ts NULLS LAST, seq) AS place,
  {LETTER} AS letter FROM ses)"""
EPI = [
    ORDERED, mode_of("mm", "ord", EPK, "suspected_model", "place"), mode_of("am", "ord", EPK, "access_mode", "place"),
    f"""ef AS (SELECT {EPK}, count(*) AS artifacts, count(*) FILTER (WHERE classification = 'Direct') AS direct,
  count(*) FILTER (WHERE classification <> 'Direct') AS inferred, count(ts) AS timed,
  count(DISTINCT artifact_family) AS families,
  CASE WHEN count(DISTINCT source_class) FILTER (WHERE source_class <> 'Unknown') > 0
    THEN count(DISTINCT source_class) FILTER (WHERE source_class <> 'Unknown') ELSE count(DISTINCT source_class) END AS source_classes,
  epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
  [count(*) FILTER (WHERE artifact_family IN ('Browser History', 'Browser Cookies')),
   count(*) FILTER (WHERE artifact_family = 'Browser Downloads'),
   count(*) FILTER (WHERE {any_word(V.IMAGE_ACTIVITY_WORDS)}), count(*) FILTER (WHERE artifact_family = 'User Content'),
   count(*) FILTER (WHERE artifact_family = 'Native Application'),
   count(*) FILTER (WHERE {any_word(V.SEARCH_ACTIVITY_WORDS)})] AS acts,
  count(*) FILTER (WHERE {any_word(V.IMAGE_REVIEW_WORDS)}) AS rev,
  count(*) FILTER (WHERE {any_word(V.IMAGE_REVIEW_WORDS)} AND classification = 'Direct') AS revd,
  CASE WHEN bool_or(persistence_state = '{V.INTACT}') THEN '{V.INTACT}'
    WHEN bool_or(persistence_state = '{V.PARTLY}') THEN '{V.PARTLY}'
    WHEN bool_or(persistence_state = '{V.WEAKLY}') THEN '{V.WEAKLY}' ELSE '{V.NOT_OBSERVED}' END AS persistence,
  {joined("nullif(acquisition_source, 'Unknown')")} AS acquisition_sources,
  {joined("nullif(platform_surface, 'Unknown')")} AS surfaces,
  bool_or(voice) AS voice_related, bool_or(link) AS link_related, bool_or(asset) AS asset_related,
  {joined("letter")} AS evidence_classes FROM ord GROUP BY ALL)""",
    f"""epf AS (SELECT ef.* EXCLUDE (acts, rev, revd), coalesce(mm_v, 'Unknown') AS model, coalesce(am_v, 'Unknown') AS access_mode,
  CASE WHEN list_max(acts) = 0 THEN '{V.NO_ACTIVITY}'
    ELSE list_extract({arr(V.ACTIVITIES)}, list_position(acts, list_max(acts))) END AS activity,
  CASE WHEN rev = 0 THEN 'None Identified' WHEN revd > 0 THEN 'Directly Supported' WHEN rev >= 2 THEN 'Consistent With'
    ELSE 'Suggestive Of' END AS image_review
  FROM ef LEFT JOIN mm USING ({EPK}) LEFT JOIN am USING ({EPK}))""",
]
LVL = [
    f"""lv1 AS (SELECT epf.*, image_type NOT IN {inlist(V.PARTIAL_IMAGES)} AS coverage_sufficient,
  families >= 2 OR (direct >= 1 AND timed >= 2) AS ready FROM epf LEFT JOIN cov USING (case_id))""",
    f"""lv2 AS (SELECT *, CAST(CASE WHEN families >= 3 THEN 25 WHEN families = 2 THEN 15 ELSE 5 END
  + CASE WHEN source_classes >= 3 THEN 15 WHEN source_classes = 2 THEN 10 ELSE 3 END
  + CASE WHEN timed > 0 THEN 15 ELSE 0 END + CASE WHEN coverage_sufficient THEN 10 ELSE 0 END
  + CASE WHEN direct >= 2 THEN 20 WHEN direct = 1 THEN 12 ELSE 0 END + CASE WHEN families >= 2 AND ready THEN 10 ELSE 0 END
  + CASE persistence WHEN '{V.INTACT}' THEN 5 WHEN '{V.PARTLY}' THEN 3 ELSE 0 END AS BIGINT) AS score FROM lv1)""",
    """lv3 AS (SELECT *, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Moderate' WHEN score >= 20 THEN 'Low'
  ELSE 'Insufficient' END AS event_confidence,
  artifacts >= 2 AND (families >= 2 OR direct >= 2 OR len(string_split(nullif(evidence_classes, ''), '|')) >= 2) IS TRUE AS present
  FROM lv2)""",
    """epl AS (SELECT *, CAST(CASE WHEN ready AND coverage_sufficient AND event_confidence IN ('High', 'Moderate') THEN 4
  WHEN ready THEN 3 ELSE 2 END AS BIGINT) AS claim_rank,
  CASE WHEN event_confidence = 'High' AND direct >= 2 THEN 'Observed AI Use'
    WHEN event_confidence IN ('High', 'Moderate') AND ready THEN 'Corroborated AI Use'
    WHEN direct >= 1 OR artifacts >= 2 THEN 'Suspected AI Use' ELSE 'Insufficient Support' END AS confidence_class FROM lv3)""",
]
EPISODES = [*SCORED, *ses("scr"), *EPI, *LVL]
CT, BT, AX = E.CAVEAT_TEXTS, E.BOUNDARY_TEXTS, E.ALTERNATIVE_TEXTS
CLASSES = "coalesce(string_split(nullif(evidence_classes, ''), '|'), [])"
REMARKS = {
    "boundaries": texts([("true", q(BT["always"])), ("timed = 0", q(BT["untimed"])), ("model = 'Unknown'", q(BT["no_model"]))]),
    "caveats": texts([
        ("NOT coverage_sufficient", q(CT["partial"])), ("timed > 0", q(CT["window"])),
        ("event_confidence = 'Insufficient'", q(CT["insufficient"])),
        (f"persistence IN ('{V.WEAKLY}', '{V.NOT_OBSERVED}')", q(CT["weak"])), ("true", q(CT["narrative"])),
        ("families <= 1 AND artifacts >= 2", q(CT["one_family"])),
        (f"len({CLASSES}) <= 1 AND artifacts >= 2", f"{q(CT['one_class_head'])} || coalesce(nullif(replace(evidence_classes, '|', ''), ''), 'A') || {q(CT['one_class_tail'])}"),
        (f"NOT list_has_any({CLASSES}, ['D', 'E', 'F'])", q(CT["presence_only"])), ("NOT coverage_sufficient", q(CT["capped"]))]),
    "alternatives": texts([("families = 1", q(AX["one_family"])), ("direct = 0", q(AX["inferred"]))]),
}
TIMELINE = [
    "tim AS (SELECT * FROM scr WHERE ts IS NOT NULL)", sessions("cs", "tim", "case_id"),
    """tln AS (SELECT *, row_number() OVER (PARTITION BY case_id, session_no ORDER BY ts, seq) AS up,
  row_number() OVER (PARTITION BY case_id, session_no ORDER BY ts DESC, seq DESC) AS dn,
  count(*) OVER (PARTITION BY case_id, session_no) AS sz FROM cs)""",
    """tle AS (SELECT *, CASE WHEN up = 1 THEN '[Session ' || session_no || ' Start] '
    WHEN dn = 1 AND sz > 1 THEN '[Session ' || session_no || ' End] ' ELSE '' END || artifact_type AS event_type,
  concat_ws(' ', '[' || suspected_platform || ']', CASE WHEN access_mode <> 'Unknown' THEN '[' || access_mode || ']' END,
    '(' || artifact_family || ')', CASE WHEN extracted_indicator <> '' THEN extracted_indicator
    ELSE artifact_type END) AS description FROM tln)""",
]
EXH = """exh AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS exhibit_no FROM scr)"""

# --- tools -----------------------------------------------------------------------------
CATS = ["Web Assistant", "Local LLM", "IDE Extension", "Image Generator", "Native Assistant", "API Credential",
        "Terminal CLI", "AI IDE"]
TOOL = f"""tl AS (SELECT 't' || p_partkey AS tool_id, p_partkey AS n, p_name AS tool_name, {pk(CATS, 'p_partkey')} AS category,
  CASE WHEN p_partkey % 4 = 0 THEN ['macOS'] ELSE ['Windows', 'macOS'] END AS sup,
  CASE p_partkey % 5 WHEN 0 THEN ['BROWSER'] WHEN 1 THEN ['DESKTOP_APP'] WHEN 2 THEN ['DESKTOP_APP', 'BROWSER']
    WHEN 3 THEN ['TERMINAL', 'DOCKER_CONTAINER'] ELSE ['DESKTOP_APP', 'SELF_HOSTED_REMOTE'] END AS surf,
  upper({pk(["", "Remote use.", "API key file", "portable, cloud sync"], 'p_partkey')}) AS note FROM part),
tls AS (SELECT *, CASE WHEN category IN ('IDE Extension', 'Terminal CLI', 'API Credential') THEN 'IDE_CLI'
  WHEN category = 'Web Assistant' THEN 'BROWSER_FIRST' WHEN category = 'Image Generator' THEN 'LOCAL_WEBUI'
  WHEN n % 5 IN (3, 4) THEN 'LOCAL_WEBUI' WHEN n % 5 = 0 THEN 'BROWSER_FIRST'
  WHEN n % 5 = 2 AND category = 'Local LLM' THEN 'LOCAL_WEBUI' ELSE 'NATIVE_DESKTOP' END AS surface_class FROM tl)"""
TPATH = """tp AS (
  SELECT tool_id, n, 'Windows' AS os, 0 AS ord, '%LocalAppData%/Tools/t' || n AS template FROM tl WHERE n % 9 <> 0
  UNION ALL SELECT tool_id, n, 'Windows', 1, '%ProgramFiles%\\t' || n FROM tl WHERE n % 9 <> 0
  UNION ALL SELECT tool_id, n, 'Windows', 2, '%UserProfile%/.t' || n || '*/config' FROM tl WHERE n % 9 <> 0
  UNION ALL SELECT tool_id, n, 'macOS', 0, '~/Library/t' || n FROM tl
  UNION ALL SELECT tool_id, n, 'macOS', 1, '/Applications/t' || n || '.app' FROM tl)"""
COS = """cos AS (SELECT case_id, CASE case_id WHEN 'C3' THEN 'macOS' WHEN 'C2' THEN 'Linux' ELSE 'Windows' END AS os FROM cov),
prof AS (SELECT DISTINCT 'C' || (l_orderkey % 4) AS case_id, 'u' || (l_suppkey % 2) AS u FROM lineitem)"""
TCAND = """cand AS (SELECT case_id, tool_id, candidate, min(ord) AS ord FROM (SELECT cos.case_id, tool_id, ord,
  CASE WHEN tp.os = 'macOS' AND ord = 0 THEN 'Users/' || u || '/Library/t' || n WHEN tp.os = 'macOS' THEN 'Applications/t' || n || '.app'
    WHEN ord = 0 THEN 'Users/' || u || '/AppData/Local/Tools/t' || n WHEN ord = 1 THEN 'Program Files/t' || n
    ELSE 'Users/' || u || '/.t' || n || '*/config' END AS candidate
  FROM cos JOIN prof USING (case_id) JOIN tp USING (os)) GROUP BY ALL)"""
TINV = """inv AS (SELECT DISTINCT 'C' || (l_orderkey % 4) AS case_id, CASE l_linenumber
  WHEN 1 THEN 'Users/u' || (l_suppkey % 2) || '/AppData/Local/Tools/t' || l_partkey WHEN 2 THEN 'Program Files/t' || l_partkey
  WHEN 3 THEN 'Users/u' || (l_suppkey % 2) || '/.t' || l_partkey || 'x/config'
  WHEN 4 THEN 'Users/u' || (l_suppkey % 2) || '/Library/t' || l_partkey
  ELSE 'Users/u' || (l_suppkey % 2) || '/Documents/t' || l_partkey END AS path FROM lineitem)"""


def class_of(path: str) -> str:
    lines = []
    for name, words in V.EVIDENCE_CLASS_WORDS:
        tests = " OR ".join(f"contains(replace(lower({path}), '\\', '/'), {q(w)})" for w in words)
        lines.append(f"WHEN {tests} THEN {q(name)}")
    return "CASE " + " ".join(lines) + f" ELSE {q(V.DEFAULT_EVIDENCE_CLASS)} END"


# A wildcard stays inside one part of the path, so both paths have the same number of slashes.
TCHK = f"""mt AS (SELECT c.case_id, c.tool_id, c.ord, i.path FROM cand c JOIN inv i ON i.case_id = c.case_id
    AND i.path = c.candidate WHERE NOT contains(c.candidate, '*')
  UNION ALL SELECT c.case_id, c.tool_id, c.ord, min(i.path) FROM cand c JOIN inv i ON i.case_id = c.case_id AND i.path GLOB c.candidate
    AND len(string_split(i.path, '/')) = len(string_split(c.candidate, '/')) WHERE contains(c.candidate, '*')
    GROUP BY c.case_id, c.tool_id, c.ord, c.candidate),
hit AS (SELECT case_id, tool_id, min(ord) AS ord, path FROM mt GROUP BY ALL),
hits AS (SELECT case_id, tool_id, array_to_string(list(path ORDER BY ord, path), '|') AS paths, count(*) AS artifact_count,
  count(DISTINCT {class_of('path')}) AS class_count FROM hit GROUP BY ALL),
ent AS (SELECT cos.case_id, cos.os, tls.*, list_contains(sup, cos.os) AS okos FROM cos CROSS JOIN tls),
en2 AS (SELECT ent.*, coalesce(paths, '') AS paths, coalesce(artifact_count, 0) AS pc, coalesce(class_count, 0) AS class_count FROM ent
  LEFT JOIN hits ON hits.case_id = ent.case_id AND hits.tool_id = ent.tool_id AND okos AND NOT (os = 'Windows' AND n % 9 = 0)),
chk AS (SELECT *, CASE WHEN NOT okos OR (os = 'Windows' AND n % 9 = 0) THEN 'NOT_VERIFIED' WHEN pc > 0 THEN 'FOUND'
  ELSE 'NOT_FOUND' END AS status FROM en2)"""
_F, _S = "status = 'FOUND'", "len(surf) > 1"
FLAGS = f"""flg AS (SELECT *, CASE WHEN status = 'NOT_VERIFIED' THEN
    CASE WHEN okos THEN ['PARSER_LIMITATION', 'NEGATIVE_FINDING_SCOPED'] ELSE ['OS_OR_HARDWARE_LIMITATION', 'NEGATIVE_FINDING_SCOPED'] END
  ELSE list_concat(CASE surface_class
    WHEN 'BROWSER_FIRST' THEN list_concat(['BROWSER_ACCESS_ONLY'], CASE WHEN {_F} THEN ['USE_NOT_ESTABLISHED', 'REMOTE_INFERENCE_POSSIBLE']
      ELSE ['BROWSER_HISTORY_CLEARED', 'PRIVACY_OR_CLEANUP_POSSIBLE', 'NEGATIVE_FINDING_SCOPED'] END,
      CASE WHEN {_S} THEN ['MULTI_SURFACE_PRODUCT'] ELSE [] END)
    WHEN 'LOCAL_WEBUI' THEN list_concat(['LOCAL_WEBUI_LOCALHOST_ONLY'],
      CASE WHEN list_contains(surf, 'DOCKER_CONTAINER') THEN ['LOCAL_WEBUI_CONTAINER_POSSIBLE'] ELSE [] END,
      CASE WHEN {_F} THEN ['USE_NOT_ESTABLISHED'] ELSE ['PORTABLE_INSTALL_POSSIBLE', 'CUSTOM_PATH_POSSIBLE', 'NEGATIVE_FINDING_SCOPED'] END,
      CASE WHEN {_F} AND list_contains(surf, 'SELF_HOSTED_REMOTE') THEN ['REMOTE_INFERENCE_POSSIBLE'] ELSE [] END,
      CASE WHEN {_S} THEN ['MULTI_SURFACE_PRODUCT'] ELSE [] END)
    WHEN 'IDE_CLI' THEN list_concat(['IDE_CONFIG_NOT_USAGE'],
      CASE WHEN contains(note, 'API KEY') THEN ['CREDENTIAL_FILE_ONLY', 'ATTRIBUTION_NOT_ESTABLISHED'] ELSE [] END,
      CASE WHEN {_F} THEN ['USE_NOT_ESTABLISHED'] ELSE ['PORTABLE_INSTALL_POSSIBLE', 'CUSTOM_PATH_POSSIBLE', 'NEGATIVE_FINDING_SCOPED'] END,
      CASE WHEN {_S} THEN ['MULTI_SURFACE_PRODUCT'] ELSE [] END)
    ELSE list_concat(CASE WHEN list_contains(surf, 'BROWSER') THEN ['BROWSER_ACCESS_ONLY'] ELSE [] END,
      CASE WHEN contains(note, 'REMOTE') THEN ['REMOTE_INFERENCE_POSSIBLE'] ELSE [] END,
      CASE WHEN contains(note, 'PORTABLE') THEN ['PORTABLE_INSTALL_POSSIBLE', 'CLOUD_SYNC_POSSIBLE'] ELSE [] END,
      CASE WHEN contains(note, 'API KEY') THEN ['ATTRIBUTION_NOT_ESTABLISHED'] ELSE [] END,
      CASE WHEN {_S} THEN ['MULTI_SURFACE_PRODUCT'] ELSE [] END,
      CASE WHEN {_F} THEN ['USE_NOT_ESTABLISHED'] WHEN contains(note, 'PORTABLE') THEN ['NEGATIVE_FINDING_SCOPED', 'CUSTOM_PATH_POSSIBLE']
        ELSE ['NEGATIVE_FINDING_SCOPED', 'PORTABLE_INSTALL_POSSIBLE', 'CUSTOM_PATH_POSSIBLE'] END) END,
    CASE WHEN {_F} THEN ['PRESENCE_ONLY'] ELSE [] END,
    CASE WHEN {_F} AND class_count <= 1 THEN ['CORROBORATION_LEVEL_LIMITED'] ELSE [] END) END AS flags FROM chk)"""
TOOLS = [EV, COV, TOOL, TPATH, COS, TCAND, TINV, TCHK]
CAVEATS = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in V.CAVEAT_TEXT.items()) + "}"

ORACLE: dict[str, str] = {}


def line_sql(kind_order: list[tuple[str, str]], one: bool) -> str:
    rules = [(i * 1000 + j, label + r.pattern, r.platform, r.pattern, RULES.platforms().index(r.platform))
             for i, (kind, label) in enumerate(kind_order) for j, r in enumerate(of(kind))]
    body = ("SELECT line_no, platform, indicator FROM (SELECT l.line_no, r.platform, arg_min(r.label, r.ord) AS indicator, "
            "min(r.place) AS place FROM log l JOIN ru r ON contains(lower(l.line), lower(r.pattern)) GROUP BY ALL)")
    if one:
        body += " QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY place) = 1"
    return with_(EV, LOG, values("ru", "ord, label, platform, pattern, place", rules)) + body


def _build() -> None:
    o = ORACLE
    o["read_visits"] = with_(EV, VIS) + "SELECT event_id, browser, url, CAST(at_us AS BIGINT) AS at_us FROM vis"
    o["log_line_times"] = with_(EV, LOG) + """SELECT line_no, epoch_us(date_trunc('second', ts)) AS at_us,
      epoch_us(TRY_CAST('2023-' || strftime(ts, '%m-%d %H:%M:%S') AS TIMESTAMP)) AS dated_us FROM log"""
    o["read_cookies"] = with_(EV) + """SELECT case_id, CAST(user_id AS VARCHAR) AS user_profile, CASE event_id % 2 WHEN 0 THEN 'Chrome' ELSE 'Firefox' END AS browser,
      CASE event_id % 2 WHEN 0 THEN 'a.example' ELSE 'b.example' END AS host_key, CAST(event_id AS VARCHAR) AS name,
      epoch_us(ts) - CASE WHEN event_id % 2 = 0 AND (k % 3 = 0 OR k % 5 = 0) THEN 5000000 ELSE 0 END AS at_us FROM ev"""
    o["utf16_texts"] = "SELECT doc_id, md5(text) AS text_hash FROM documents"
    o["log_file_lines"] = with_(EV, LOG) + """SELECT case_id, l.line_no // 10000 AS file_no,
      row_number() OVER (PARTITION BY case_id, l.line_no // 10000 ORDER BY l.line_no) AS line_no,
      md5(strftime(l.ts, '%Y-%m-%d %H:%M:%S') || '.123 ' || line) AS line_hash FROM log l JOIN ev ON event_id = l.line_no"""
    o["install_times"] = "SELECT event_id, (epoch_us(ts) // 1000) * 1000 AS at_us FROM events"
    o["acquisition_quality"] = """WITH m AS (SELECT o_custkey AS evidence_id, CAST(floor(o_totalprice) AS BIGINT) AS sz, o_orderkey % 11 = 0 AS rem,
      CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 3 = 0 THEN '-' WHEN o_orderkey % 7 = 0 THEN '/' ELSE '+' END AS st FROM orders)
    SELECT evidence_id, CAST(coalesce(sum(sz) FILTER (WHERE NOT rem), 0) AS BIGINT) AS total,
      CAST(coalesce(sum(sz) FILTER (WHERE NOT rem AND st = '+'), 0) AS BIGINT) AS good,
      CAST(coalesce(sum(sz) FILTER (WHERE NOT rem AND st = '-'), 0) AS BIGINT) AS bad,
      CASE WHEN coalesce(sum(sz) FILTER (WHERE NOT rem AND st = '-'), 0) > 0 THEN 'Degraded'
        WHEN coalesce(sum(sz) FILTER (WHERE NOT rem), 0) > 0 THEN 'Normal' ELSE 'Unknown' END AS quality FROM m GROUP BY 1"""
    o["history_item_visits"] = """SELECT 'C' || (page_id % 4) AS case_id, 'u' || (page_id % 3) AS user_profile, page_id // 12 AS item_id, url, event_id,
      epoch_us(ts) AS ts_us FROM events JOIN pages ON page_id = event_id // 4"""
    o["annotated_downloads"] = """SELECT 'https://h' || o_custkey AS url, count(*) AS n, min('file:///f' || l_partkey) AS first_target
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey // 12 = l_suppkey // 12
        AND s_suppkey % 4 = l_orderkey % 4 AND s_suppkey % 3 = l_orderkey % 3) GROUP BY 1"""
    o["app_usage"] = with_(rule_table("ru", of("package")), f"""u AS (SELECT o_orderkey AS object_id, 'C' || (o_custkey % 4) AS case_id, 'u' || (o_custkey % 3) AS user_profile,
        {pk(S.PACKAGES, 'c_custkey')} AS bundle_id, o_custkey % 300 AS seconds FROM orders LEFT JOIN customer
        ON c_custkey = o_custkey AND c_custkey % 3 <> 0)""", first_match("m", "u", "object_id", "bundle_id", "ru", "equal")) + \
        "SELECT object_id, case_id, user_profile, bundle_id, platform, seconds FROM u JOIN m USING (object_id)"
    o["app_traffic"] = with_(EV, PKG, rule_table("ru", of("package")), first_match("m", "pkg", "event_id", "package", "ru", "suffix")) + \
        "SELECT event_id, package, platform, CAST(total_bytes AS BIGINT) AS total_bytes FROM pkg JOIN m USING (event_id) WHERE total_bytes > 0"
    o["latest_usage_rows"] = with_(EV) + """SELECT case_id, event_id, epoch_us(ts) AS ts_us FROM ev
      QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC) <= 500"""
    o["replace_by_key"] = with_(EV) + "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM ev GROUP BY 1, 2"

    dom, mod = rule_table("dom", of("domain")), rule_table("mod", of("model"))
    vm = [EV, VIS, dom, mod, first_match("p", "vis", "event_id", "url", "dom"),
          first_match("m", "vis", "event_id", "url", "mod", value="model")]
    o["visits_by_platform"] = with_(*vm) + """SELECT event_id, url, p.platform, p.pattern AS domain, coalesce(m.model, 'Unknown') AS model
      FROM vis JOIN p USING (event_id) LEFT JOIN m USING (event_id)"""
    o["page_visits"] = """WITH h AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)
      SELECT page_id, url, CASE WHEN contains(url, 'pills') THEN 'P1' WHEN contains(url, 'example.net') THEN 'P2'
        WHEN contains(url, 'example.org') THEN 'P3' END AS platform,
      CASE WHEN host = 'pills' OR suffix(host, '.pills') THEN 'P1' WHEN host = 'example.net' OR suffix(host, '.example.net') THEN 'P2'
        WHEN host = 'example.org' OR suffix(host, '.example.org') THEN 'P3' END AS host_platform FROM h"""
    o["visit_artifacts"] = with_(*vm) + """SELECT case_id,
      sha256(concat_ws('|', case_id, 'visit', user_profile, browser, coalesce(url, ''), CAST(raw_time AS VARCHAR))) AS record_id,
      user_profile, browser || ' History' AS artifact_subtype, url AS extracted_indicator, p.platform AS suspected_platform,
      coalesce(m.model, 'Unknown') AS suspected_model, 'Visit count: ' || visit_count || ', Title: ' || coalesce(title, '') AS notes,
      CAST(at_us AS BIGINT) AS ts_us, at_us IS NOT NULL AS tz_norm FROM vis JOIN p USING (event_id) LEFT JOIN m USING (event_id)"""
    o["downloads_by_platform"] = with_(EV, DOWN, dom, rule_table("nam", of("download_re")),
        first_match("a", "down", "event_id", "tab_url", "dom"), first_match("b", "down", "event_id", "name", "nam", "regex")) + \
        """SELECT event_id, coalesce(a.platform, b.platform) AS platform, target_path FROM down LEFT JOIN a USING (event_id)
        LEFT JOIN b USING (event_id) WHERE coalesce(a.platform, b.platform) IS NOT NULL"""
    o["cookies_by_platform"] = with_(EV, COOK, rule_table("ru", of("cookie_domain")),
        first_match("m", "cook", "event_id", "host_key", "ru", "cookie")) + \
        "SELECT event_id, host_key, platform FROM cook JOIN m USING (event_id)"
    o["model_mentions"] = with_(FILES, mod, first_match("m", "fil", "doc_id", "text", "mod", value="model")) + "SELECT doc_id, model FROM m"
    both = rule_table("nam", of("download_re", "export_re"))
    o["file_names_by_platform"] = with_(FILES, both, first_match("m", "fil", "doc_id", "name", "nam", "regex")) + \
        "SELECT doc_id, name, platform, pattern FROM fil JOIN m USING (doc_id)"
    o["screenshots_by_platform"] = with_(FILES, rule_table("ru", of("screenshot_re")),
        first_match("m", "fil", "doc_id", "name", "ru", "regex")) + \
        f"""SELECT doc_id, name, platform FROM fil JOIN m USING (doc_id)
        WHERE lower(regexp_extract(name, '[^.]\\.([^.]+)$', 1)) IN {inlist(V.SCREENSHOT_EXT)}"""
    o["content_remnants"] = with_(FILES, mod, rule_table("pr", of("prompt")), rule_table("re", of("response")),
        first_match("m", "fil", "doc_id", "text", "mod", value="model")) + f"""
        SELECT doc_id, 'Prompt Remnant' AS remnant, platform, 'Unknown' AS model, pattern AS indicator FROM ({per_platform('fil', 'doc_id', 's.text', 'pr')})
        UNION ALL SELECT doc_id, 'Response Remnant', platform, 'Unknown', pattern FROM ({per_platform('fil', 'doc_id', 's.text', 're')})
        UNION ALL SELECT doc_id, 'Model Reference', (SELECT min(platform) FROM mod WHERE mod.model = m.model), model, model FROM m"""
    for name, log in (("unified_log_hits", "unified_log"), ("event_log_hits", "event_log"), ("logcat_hits", "logcat")):
        o[name] = line_sql(traces.LINE_ORDERS[log], log == "logcat")
    o["packages_by_platform"] = with_(EV, PKG, rule_table("ru", of("package")), first_match("m", "pkg", "event_id", "package", "ru", "equal")) + \
        "SELECT event_id, package, platform FROM pkg JOIN m USING (event_id)"
    o["storage_keys"] = with_(FILES, rule_table("ru", of("ls_key"))) + \
        f"SELECT doc_id, platform, pattern AS indicator FROM ({per_platform('fil', 'doc_id', 's.text', 'ru')})"

    def two_step(source: str, key: str, text: str, rules: list[Rule], columns: str, test: str = "contains", where: str = "true", extra: str = "") -> str:
        return with_(EV, source, dom, rule_table("oth", rules), f"src AS (SELECT *, {text} AS txt FROM kv WHERE {where})",
                     first_match("a", "src", key, "txt", "dom"), first_match("b", "src", key, "txt", "oth", test)) + \
            f"""SELECT {columns}, coalesce(a.platform, b.platform) AS platform{extra} FROM src LEFT JOIN a USING ({key})
            LEFT JOIN b USING ({key}) WHERE coalesce(a.platform, b.platform) IS NOT NULL"""

    o["registry_values"] = two_step(KV, "event_id", "value", of("domain", "app_win", "process", "search_kw"),
        "event_id, key_label, value", extra=""", CASE key_label WHEN 'TypedURLs' THEN 'High' WHEN 'RunMRU' THEN 'Low'
        WHEN 'WordWheelQuery' THEN 'Low' ELSE 'Moderate' END AS confidence,
        CASE WHEN key_label IN ('RunMRU', 'WordWheelQuery') THEN 'Inferred' ELSE 'Direct' END AS classification""")
    o["plist_values"] = two_step(KV, "event_id", "value", of("app_mac", "bundle_id"), "event_id, value")
    o["quarantine_events"] = with_(EV, KV, dom, "src AS (SELECT event_id, concat_ws(' ', origin_url, data_url, agent) AS txt FROM kv)",
        first_match("a", "src", "event_id", "txt", "dom")) + "SELECT event_id, platform FROM a"
    o["registry_subkeys"] = two_step(KV, "event_id", "value", of("download_re", "export_re"), "event_id, value", "regex")
    o["folder_navigation"] = two_step(KV, "event_id", "value", of("domain", "app_win"), "event_id, value", where="length(value) >= 4")
    o["installed_programs"] = with_(EV, KV, rule_table("ru", of("app_win", "process", "domain")),
        "src AS (SELECT *, display_name || ' ' || install_location || ' ' || key_name AS txt FROM kv)",
        first_match("m", "src", "event_id", "txt", "ru")) + "SELECT event_id, display_name, platform FROM src JOIN m USING (event_id)"
    o["registered_applications"] = with_(EV, KV, rule_table("ru", of("app_win"))) + """SELECT DISTINCT event_id, display_name AS name, r.platform
        FROM kv JOIN ru r ON contains(lower(display_name || ' ' || value), lower(r.pattern))"""
    o["known_registry_keys"] = with_(EV, TR, rule_table("ru", of("registry_key"))) + """SELECT event_id, r.platform, r.pattern AS known
        FROM tr JOIN ru r ON lower(key_path) = lower(r.pattern) OR suffix(lower(key_path), '\\' || lower(r.pattern))"""
    o["bundle_plists"] = with_(EV, PKG, rule_table("ru", of("bundle_id"))) + \
        f"SELECT event_id, platform, pattern AS known FROM ({per_platform('pkg', 'event_id', 's.package', 'ru')})"
    o["execution_traces"] = with_(EV, TR, rule_table("ru", of("prefetch"))) + \
        "SELECT event_id, name, r.platform, r.pattern AS rule FROM tr JOIN ru r ON contains(upper(name), upper(r.pattern))"
    o["cleanup_tools"] = with_(EV, TR, values("cl", "ord, word, tool", [(i, w, t) for i, (w, t) in enumerate(V.CLEANUP_TOOLS)])) + \
        "SELECT event_id, any_value(name) AS name, arg_min(tool, ord) AS tool FROM tr JOIN cl ON contains(upper(name), word) GROUP BY event_id"
    named = [(i, r.platform, r.pattern, "re") for i, r in enumerate(of("download_re", "export_re"))]
    named += [(1000 + i, r.platform, r.pattern, "dom") for i, r in enumerate(of("domain"))]
    o["recent_files"] = with_(FILES, values("ru", "ord, platform, pattern, kind", named)) + """
        SELECT doc_id, any_value(name) AS name, r.platform, arg_min(r.pattern, r.ord) AS pattern FROM fil JOIN ru r
        ON CASE WHEN r.kind = 're' THEN regexp_matches(name, CASE WHEN r.kind = 're' THEN r.pattern ELSE '' END, 'i') ELSE contains(lower(name), replace(r.pattern, '.', '_'))
          OR contains(lower(name), replace(r.pattern, '.', '-')) END GROUP BY doc_id, r.platform"""
    o["deleted_files"] = with_(FILES, both) + f"""SELECT doc_id, name, platform, pattern FROM fil JOIN
        ({per_platform('fil', 'doc_id', '', 'nam', "regexp_matches(s.name, r.pattern, 'i')")}) USING (doc_id)"""
    chains = [(i, n, p) for i, (p, n) in enumerate(V.TOOLCHAIN_PATTERNS)]
    o["toolchain_traces"] = with_(EV, VIS, values("tc", "ord, tool, pattern", chains),
        "src AS (SELECT event_id, url, lower(coalesce(url, '') || ' ' || coalesce(title, '')) AS txt FROM vis)") + f"""
        SELECT event_id, url, 'plugin_url' AS trace, CAST(NULL AS VARCHAR) AS tool FROM src WHERE {" OR ".join(f"regexp_matches(txt, {q(p)}, 'i')" for p in V.PLUGIN_PATTERNS)}
        UNION ALL SELECT event_id, any_value(url), 'toolchain_url', arg_min(tool, ord) FROM src JOIN tc ON regexp_matches(txt, pattern, 'i') GROUP BY event_id
        UNION ALL SELECT event_id, url, 'rag_url', NULL FROM src WHERE {" OR ".join(f"regexp_matches(txt, {q(p)}, 'i')" for p in V.VECTOR_STORE_PATTERNS)}"""
    o["api_key_names"] = with_(FILES) + f"""SELECT doc_id, array_to_string(list(key ORDER BY pos), '|') AS key_names FROM (
        SELECT doc_id, key, min(pos) AS pos FROM (SELECT doc_id, unnest(keys) AS key, generate_subscripts(keys, 1) AS pos FROM (
          SELECT doc_id, regexp_extract_all(text, '(?i)({"|".join(V.API_KEY_NAMES)})') AS keys FROM fil)) GROUP BY ALL) GROUP BY doc_id"""
    words = values("mw", "ord, word, platform", [(i, w, p) for i, (w, p) in enumerate(V.MANIFEST_WORDS)])
    ids = values("ids", "id, name, platform", V.EXTENSION_IDS)
    o["browser_extensions"] = with_(EV, EXT, words, ids, """w AS (SELECT event_id, arg_min(platform, ord) AS platform FROM ext JOIN mw
        ON contains(lower(manifest), word) GROUP BY 1)""") + """SELECT event_id, ext_id, coalesce(ids.platform, w.platform) AS platform,
        CASE WHEN ids.id IS NOT NULL THEN 'Direct' ELSE 'Inferred' END AS classification,
        CASE WHEN ids.id IS NOT NULL THEN 'High' ELSE 'Moderate' END AS confidence,
        coalesce(ids.name, nullif(regexp_extract(manifest, '"name":"([^"]*)"', 1), ''), ext_id) AS ext_name
        FROM ext LEFT JOIN ids ON ids.id = ext_id LEFT JOIN w USING (event_id) WHERE coalesce(ids.platform, w.platform) IS NOT NULL"""
    o["browser_addons"] = with_(EV, EXT, values("aw", "ord, word, platform", [(i, w, p) for i, (w, p) in enumerate(V.ADDON_WORDS)])) + \
        "SELECT event_id, arg_min(platform, ord) AS platform FROM ext JOIN aw ON contains(text, word) GROUP BY 1"
    o["latest_manifests"] = with_(EV, EXT) + "SELECT case_id, ext_id, arg_max(manifest, version) AS manifest FROM ext GROUP BY 1, 2"
    o["recovered_visits"] = with_(EV, VIS, dom, "src AS (SELECT event_id, case_id, regexp_replace(url, '[0-9]+$', '') AS url, title FROM vis)",
        first_match("m", "src", "event_id", "url", "dom")) + """SELECT case_id, url, platform, title, event_id AS seq FROM src JOIN m USING (event_id)
        QUALIFY row_number() OVER (PARTITION BY case_id, url ORDER BY event_id) = 1"""
    o["recovered_cookies"] = with_(EV, COOK, rule_table("ru", of("cookie_domain")), first_match("m", "cook", "event_id", "host_key", "ru")) + \
        """SELECT case_id, host_key, name, platform, event_id AS seq FROM cook JOIN m USING (event_id)
        QUALIFY row_number() OVER (PARTITION BY case_id, host_key, name ORDER BY event_id) = 1"""
    o["recovered_downloads"] = with_(EV, DOWN, dom, """src AS (SELECT event_id, case_id, regexp_replace(target_path, '[0-9]+', '', 'g') AS target_path,
        tab_url, regexp_replace(target_path, '[0-9]+', '', 'g') || ' ' || tab_url AS txt FROM down)""",
        first_match("m", "src", "event_id", "txt", "dom")) + """SELECT case_id, target_path, tab_url, platform, event_id AS seq
        FROM src JOIN m USING (event_id) QUALIFY row_number() OVER (PARTITION BY case_id, target_path, tab_url ORDER BY event_id) = 1"""
    o["any_table_scan"] = with_(EV, KV, dom, """cells AS (SELECT DISTINCT cell FROM (SELECT unnest([key_label, value, origin_url, data_url, agent, display_name,
        install_location, key_name]) AS cell FROM kv) WHERE length(cell) >= 6)""",
        first_match("m", "cells", "cell", "cell", "dom")) + "SELECT 'key_values' AS table_name, cell, platform FROM m"
    o["context_urls"] = with_(FILES, rule_table("ru", of("domain")), """w AS (SELECT DISTINCT doc_id, r.pattern AS domain, text FROM fil
          JOIN ru r ON contains(lower(text), lower(r.pattern)))""",
        """urls AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s"''<>\\x00-\\x1f]{5,}')) AS url FROM fil)""",
        "holding AS (SELECT doc_id, domain, url AS found FROM w JOIN urls USING (doc_id) WHERE contains(lower(url), lower(domain)))") + """
        FROM holding UNION ALL SELECT doc_id, domain, domain FROM w WHERE (doc_id, domain) NOT IN (SELECT (doc_id, domain) FROM holding)"""
    o["evidence_classes"] = with_(EV, TR) + f"SELECT event_id, {class_of('path')} AS evidence_class FROM tr"
    o["rule_matches"] = with_(EV, VIS, dom) + "SELECT r.pattern, count(*) AS n FROM vis JOIN dom r ON contains(lower(url), r.pattern) GROUP BY 1"

    slugs = ["gpt-4", "gpt-4-turbo", "o-model", "claude-3-opus-x", ""]
    models = ["GPT-4", "GPT-4 Turbo", "Unknown", "Claude 3 Opus", "Unknown"]
    conv = f"""cv AS (SELECT DISTINCT conv_id, 'C' || (conv_id % 4) AS case_id, '/x/' || conv_id || '/conversations.json' AS artifact_path,
      {pk(slugs, 'conv_id')} AS slug, {pk(models, 'conv_id')} AS model, (1700000000 + conv_id * 60) * 1000000 AS created_us FROM conversations)"""
    tokens = "|".join(f"(?:{p})" for p, _ in V.HIT_TOKENS)
    o["export_replay"] = with_(conv) + """SELECT case_id, artifact_path, 'ChatGPT Conversation' AS artifact_type, 'conversation_export' AS artifact_subtype,
        model AS suspected_model, 'Conversation: ''Talk ' || conv_id || ''' (ID: ' || conv_id || ') Model: '
        || coalesce(nullif(slug, ''), 'unknown') || CASE WHEN conv_id % 3 = 0 THEN ' | Plugins: p1, p2' ELSE '' END AS extracted_indicator,
        CAST(created_us AS BIGINT) AS ts_us FROM cv
      UNION ALL SELECT case_id, artifact_path, 'ChatGPT Message', role || '_message', CASE WHEN turn % 3 = 0 THEN 'GPT-4o' ELSE model END,
        '[' || upper(role) || '] ' || CASE WHEN role = 'tool' THEN '(Tool: unknown_tool) ' ELSE '' END
        || CASE WHEN length(text) > 0 THEN regexp_replace(text, TOKENS, 'PLACE', 'g') ELSE '(empty)' END,
        CAST((1700000000 + turn * 60) * 1000000 AS BIGINT) FROM conversations JOIN cv USING (conv_id) WHERE role IN ('user', 'assistant', 'tool')
      UNION ALL SELECT case_id, artifact_path, 'ChatGPT Plugin Usage', 'plugin_reference', model,
        'Plugin: ' || p || ' in conversation ''Talk ' || conv_id || '''', CAST(created_us AS BIGINT)
        FROM cv, (VALUES ('p1'), ('p2')) t(p) WHERE conv_id % 3 = 0""".replace("TOKENS", q(tokens)).replace("PLACE", V.TOKEN_PLACEHOLDER)
    names = ["conversations.json", "User.json", "claude_conversations.json", "threads.json", "x.json"]
    o["export_files"] = f"""WITH f AS (SELECT doc_id, {pk(names, 'doc_id')} AS name, doc_id % 3 = 0 AS act FROM documents),
      g AS (SELECT *, CASE WHEN lower(name) IN ('conversations.json', 'user.json') THEN 'ChatGPT' WHEN name = 'claude_conversations.json' THEN 'Claude'
        WHEN act THEN 'Gemini' WHEN name = 'threads.json' THEN 'Perplexity' END AS platform FROM f)
      SELECT doc_id, platform, lower(platform) || '_export:' || name AS subtype FROM g WHERE platform IS NOT NULL"""
    o["provider_conversations"] = f"""SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 5 = 0 THEN 'Claude' ELSE 'ChatGPT' END AS platform,
      {pk(["GPT-4", "GPT-4 Turbo", "Unknown", "Unknown", "Unknown"], 'conv_id')} AS model_name,
      CAST((1700000000 + conv_id * 60) * 1000000 AS BIGINT) AS created_us FROM conversations"""
    o["shared_links"] = with_(FILES, f"""u AS (SELECT doc_id, regexp_extract_all(text, {q(V.SHARE_LINK_PATTERN)}) AS urls FROM fil)""",
        "x AS (SELECT doc_id, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS pos FROM u)",
        values("sp", "ord, word, platform", [(i, w, p) for i, (w, p) in enumerate(V.SHARE_LINK_PLATFORMS)])) + \
        """SELECT doc_id, CAST(pos AS BIGINT) AS pos, url, coalesce((SELECT arg_min(platform, ord) FROM sp WHERE contains(lower(url), word)), 'Unknown')
        AS platform FROM x"""
    from footmark.operators.hits import hit_patterns
    pats = [(i, k, p if k == "Platform Token" else "(?i)" + p, f) for i, (k, p, f, _) in enumerate(hit_patterns(KEYWORDS))]
    union = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS pattern_no, {q(k)} AS hit_type, {q(f)} AS platform, unnest(regexp_extract_all(text, {q(p)})) AS m FROM fil"
        for i, k, p, f in pats)
    o["hit_counts"] = with_(FILES, f"h AS ({union})") + f"""SELECT doc_id, CAST(pattern_no AS BIGINT) AS pattern_no, hit_type, platform, count(*) AS n,
        min(CASE WHEN hit_type = 'Platform Token' THEN '{V.TOKEN_PLACEHOLDER}' ELSE m END) AS first_matched FROM h GROUP BY ALL"""
    # Offset of the i-th match: the bytes of the pieces up to it and of the matches before it.
    offsets = " UNION ALL ".join(f"""SELECT doc_id, case_id, {i} AS pattern_no, {q(k)} AS hit_type, {q(f)} AS platform, p, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, case_id, string_split_regex(text, {q(p)}) AS p, regexp_extract_all(text, {q(p)}) AS m FROM fil) WHERE len(m) > 0"""
        for i, k, p, f in pats)
    ho = [FILES, f"h AS ({offsets})", f"""ho AS (SELECT doc_id, case_id, pattern_no, hit_type, platform,
        CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS BIGINT) AS "offset",
        CAST(strlen(m[i]) AS BIGINT) AS length, CASE WHEN hit_type = 'Platform Token' THEN '{V.TOKEN_PLACEHOLDER}' ELSE m[i] END AS matched FROM h)"""]
    o["hit_offsets"] = with_(*ho) + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "offset", pattern_no) - 1 AS hit_no,
        CAST(pattern_no AS BIGINT) AS pattern_no, hit_type, platform, "offset", length, matched FROM ho"""
    o["hit_artifacts"] = with_(*ho, """hx AS (SELECT *, format('0x{:x}', "offset") AS hx FROM ho)""") + """SELECT case_id,
        sha256(concat_ws('|', case_id, 'hit', doc_id, "offset", pattern_no)) AS record_id,
        CASE hit_type WHEN 'Export Marker' THEN 'User Content' ELSE 'File System' END AS artifact_family, 'raw_stream@' || hx AS artifact_path,
        matched AS extracted_indicator, platform AS suspected_platform, CASE hit_type WHEN 'Model Name Hit' THEN 'Model' WHEN 'Export Marker' THEN 'Content'
        ELSE 'Platform' END AS attribution_layer,
        '[RAW] offset=' || hx || ', len=' || length || ', type=' || hit_type || ', pattern=' || matched AS notes FROM hx"""
    o["capped_hits"] = with_(*ho) + """SELECT doc_id, CAST(pattern_no AS BIGINT) AS pattern_no, "offset", matched FROM ho
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "offset", pattern_no) <= 3"""
    o["file_hits"] = with_(*ho, """base AS (SELECT doc_id, case_id, doc_id // 500 AS file_no, coalesce(sum(strlen(text) + 1) OVER (
        PARTITION BY case_id, doc_id // 500 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM fil)""") + """
        SELECT b.case_id, b.file_no, CAST(pattern_no AS BIGINT) AS pattern_no, hit_type, platform, CAST(base + "offset" AS BIGINT) AS "offset",
          length, matched FROM ho JOIN base b USING (doc_id)"""
    o["file_sizes"] = with_(FILES) + """SELECT case_id, doc_id // 500 AS file_no, 'txt' AS ext, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
        FROM fil GROUP BY ALL"""
    o["keyword_offsets"] = """SELECT doc_id, CAST(0 AS BIGINT) AS pattern_no,
      CAST(strlen(left(text, position('token' IN lower(text)) - 1)) AS BIGINT) AS "offset" FROM documents WHERE contains(lower(text), 'token')"""
    tokens = "|".join(f"(?:{p})" for p, _ in V.HIT_TOKENS)
    o["redacted_text"] = with_(FILES, f"""r AS (SELECT doc_id, regexp_replace(text, {q(tokens)}, '{V.TOKEN_PLACEHOLDER}', 'g') AS t FROM fil)""") + "SELECT doc_id, md5(t) AS text_hash, length(t) AS chars FROM r"
    o["secrets_left"] = """SELECT 'text' AS place, CAST(0 AS BIGINT) AS "left" FROM documents HAVING count(*) > 0
      UNION ALL SELECT 'context', 0 FROM documents HAVING count(*) > 0"""
    o["redacted_keys"] = with_(FILES, f"""r AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(V.MEMORY_KEY_PATTERN)})) AS key FROM fil)""") + """
        SELECT DISTINCT doc_id, left(key, 8) || '...' || right(key, 4) AS redacted, sha256(key) AS key_hash,
          CASE WHEN starts_with(key, 'sk-ant') THEN 'Claude' WHEN starts_with(key, 'sk-') THEN 'ChatGPT' WHEN starts_with(key, 'AIza') THEN 'Gemini'
          ELSE 'Unknown' END AS platform FROM r"""
    least = {"domain": 0, "cookie_domain": 0, "model": 4, "ls_key": 4, "process": 5}
    wanted = [r for k, n in least.items() for r in of(k) if len(r.pattern) >= n]
    o["first_rule_hits"] = with_(FILES, rule_table("ru", wanted)) + """SELECT case_id AS source, r.kind, r.platform, r.pattern,
        CAST(min(position(lower(r.pattern) IN lower(text))) AS BIGINT) AS "offset" FROM fil JOIN ru r ON contains(lower(text), lower(r.pattern)) GROUP BY ALL"""
    heads = "list_extract(['%PDF-1.7' || chr(10), '<html>', '# ', '{\"', '[{\"title\":', 'GIF8', 'PK' || chr(3) || chr(4), '', 'BM'], CAST(doc_id % 9 AS INTEGER) + 1)"
    tails = "list_extract(['%%EOF', '</html>', '', chr(0) || ';'], CAST(doc_id % 4 AS INTEGER) + 1)"
    plain = [(n, bytes.fromhex(h), bytes.fromhex(f), 1 if v else 0) for n, _, h, f, v in V.BLOB_RULES if n not in ("JPEG", "PNG")]

    def ascii_sql(data: bytes) -> str:
        return " || ".join(q(chr(b)) if b >= 32 else f"chr({b})" for b in data) or "''"

    rules_sql = "br(rule, header, footer, val) AS (VALUES " + ", ".join(
        f"({q(n)}, {ascii_sql(h)}, {ascii_sql(f)}, {v})" for n, h, f, v in plain) + ")"
    markers = "CASE " + " ".join(f"WHEN contains(lower(c), {q(w)}) THEN {q(p)}" for w, p in V.BLOB_MARKERS) + " ELSE 'Unknown' END"
    o["blob_formats"] = with_(FILES, f"bl AS (SELECT doc_id, {heads} || text || {tails} AS c FROM fil)", rules_sql) + f"""
        SELECT doc_id, rule, CASE WHEN val = 0 THEN 'Not Validated' WHEN starts_with(c, 'PK' || chr(3) || chr(4)) AND strlen(c) > 30 THEN 'Partial Structure'
          ELSE 'Header Only' END AS validation, {markers} AS platform,
        CASE WHEN footer <> '' AND contains(substring(c, length(header) + 1), footer) THEN 'Complete' ELSE 'Partial' END AS recovery_status,
        CASE WHEN footer <> '' AND contains(substring(c, length(header) + 1), footer) THEN 'Moderate' ELSE 'Low' END AS confidence_hint
        FROM bl JOIN br ON starts_with(c, header) AND strlen(c) > strlen(header)"""
    o["generated_assets"] = with_(FILES, f"""a AS (SELECT doc_id, lower(name) AS nm, lower(regexp_extract(name, '[^.]\\.([^.]+)$', 1)) AS ext,
        CASE doc_id % 9 WHEN 0 THEN 'c2pa ' || text WHEN 1 THEN '{{"prompt": "x", "size": 3}}' ELSE text END AS c FROM fil)""", f"""b AS (SELECT *,
        CASE WHEN {" OR ".join(f"contains(nm, {q(n)})" for n in V.ASSET_NAMES)} THEN 'filename_match'
          WHEN ext IN {inlist(V.ASSET_IMAGE_EXT)} AND ({" OR ".join(f"contains(c, {q(m)})" for m in V.CREDENTIAL_MARKERS)}) THEN 'c2pa_manifest'
          WHEN ext = 'json' AND doc_id % 9 = 1 THEN 'metadata_sidecar' END AS method FROM a)""",
        values("ap", "ord, word, platform", [(i, w, p) for i, (w, p) in enumerate(V.ASSET_PLATFORMS)])) + f"""
        SELECT doc_id, method, CASE WHEN ext IN {inlist(V.ASSET_IMAGE_EXT)} THEN 'image' ELSE 'document' END AS asset_type,
        coalesce((SELECT arg_min(platform, ord) FROM ap WHERE contains(nm, word)), 'Unknown') AS platform, sha256(c) AS file_hash
        FROM b WHERE method IS NOT NULL"""
    o["stripped_images"] = "SELECT doc_id, 'dall-e-' || doc_id || '.jpg' AS name, n_chars AS size FROM documents WHERE doc_id % 3 <> 0"
    found = [1, 1, 0, 0, 1, 1, 1]
    o["manifests"] = f"""SELECT doc_id, d AS ai_detected, platform, CASE WHEN d THEN 'High' ELSE 'Moderate' END AS confidence,
      CASE WHEN d THEN 'Direct' ELSE 'Inferred' END AS classification FROM (SELECT doc_id, {pk(S.MANIFEST_RESULTS, 'doc_id')} AS platform,
      list_extract({found}, CAST(doc_id % 7 AS INTEGER) + 1) = 1 AS d FROM documents)"""
    o["transcripts"] = with_(FILES, f"""t AS (SELECT doc_id, {pk(S.TRANSCRIPT_NAMES, 'doc_id')} AS nm, CASE doc_id % 6 WHEN 1 THEN ''
        WHEN 3 THEN 'said ' || doc_id ELSE text END AS said FROM fil)""",
        values("tw", "ord, word, platform", [(i, w, p) for i, (w, p) in enumerate(V.TRANSCRIPT_WORDS)]),
        "m AS (SELECT doc_id, arg_min(platform, ord) AS platform FROM t JOIN tw ON contains(lower(said || ' ' || nm), word) GROUP BY 1)") + """
        SELECT doc_id, coalesce(platform, 'Unknown') AS platform, CASE WHEN said <> '' THEN 'Direct' ELSE 'Inferred' END AS classification,
        CASE WHEN said <> '' THEN 'Moderate' ELSE 'Low' END AS confidence, length(said) AS chars FROM t LEFT JOIN m USING (doc_id)"""

    tree_names = ["Windows", "Users", "Library", "System", "HomeDomain", "Applications", "ProgramData", "data"]
    tree = f"""tree AS (SELECT DISTINCT 'E' || user_id AS case_id,
      {pk(tree_names, '(event_id + user_id * 3) % (user_id % 5 + 1)')} AS name FROM events)"""
    o["operating_systems"] = with_(tree, f"""s AS (SELECT case_id, count(*) FILTER (WHERE name IN {inlist(V.WINDOWS_NAMES)}) AS w,
        count(*) FILTER (WHERE name IN {inlist(V.MAC_NAMES)}) AS m, count(*) FILTER (WHERE name IN {inlist(V.PHONE_NAMES)}) AS p FROM tree GROUP BY 1)""") + \
        "SELECT case_id, CASE WHEN p > 0 AND p >= m THEN 'iPhone' WHEN m > w THEN 'macOS' WHEN w > 0 THEN 'Windows' ELSE 'Unknown' END AS os FROM s"
    o["image_types"] = with_(tree) + """SELECT case_id, CASE WHEN bool_or(name IN ('Windows', 'System')) THEN 'Full Disk Image'
        WHEN bool_or(name = 'Users') THEN 'Logical Image' ELSE 'Partial Evidence Container' END AS image_type FROM tree GROUP BY 1"""
    users = ["Public", "alice", "Shared", "Default User", "bob", "All Users"]
    o["profiles"] = f"""WITH u AS (SELECT DISTINCT 'E' || user_id AS case_id, {pk(users, 'user_id % 4 + event_id % 2')} AS user_profile FROM events),
      f AS (SELECT *, bool_or(lower(user_profile) NOT IN {inlist(V.SYSTEM_PROFILES)}) OVER (PARTITION BY case_id) AS anyp FROM u)
      SELECT case_id, user_profile FROM f WHERE (anyp AND lower(user_profile) NOT IN {inlist(V.SYSTEM_PROFILES)})
        OR (NOT anyp AND lower(user_profile) NOT IN {inlist(V.MAC_SYSTEM_PROFILES)})"""
    browsers = [b for b, _ in V.BROWSER_DIRS] + [None]
    o["browsers_found"] = with_(EV, f"""b AS (SELECT case_id, list_extract([{", ".join(q(b) for b in browsers)}],
        CAST((event_id % (user_id % 4 + 1)) % {len(browsers)} AS INTEGER) + 1) AS b FROM ev)""") + \
        f"SELECT case_id, {joined('b')} AS browsers FROM b GROUP BY 1 HAVING count(b) > 0"

    o["enriched_artifacts"] = with_(*BASE) + "SELECT record_id, source_class, acquisition_source, platform_surface, persistence_state FROM enr"
    o["base_confidence"] = with_(*BASE) + f"SELECT record_id, round({SCORE}, 9) AS score, {level(SCORE)} AS confidence FROM enr"
    ids_of = "array_to_string(list_transform({}, lambda x: x.id), '|')"
    o["hourly_links"] = with_(*BASE, HR, HL) + f"SELECT record_id, {ids_of.format('links1')} AS links FROM hl"
    o["all_links"] = with_(*BASE, HR, HL, PL, LNK) + f"""SELECT record_id, {ids_of.format('links')} AS links,
        CAST(len(list_distinct(list_transform(links, lambda x: x.fam))) AS BIGINT) AS families FROM lnk"""
    o["final_confidence"] = with_(*SCORED) + "SELECT record_id, confidence, initial_confidence, notes FROM scr"
    o["acquisition_ceiling"] = with_(EV) + f"""SELECT event_id, CASE WHEN hint = 'High' AND case_id IN ('C1', 'C2') THEN 'Moderate'
        WHEN hint = 'Medium' THEN 'Moderate' ELSE hint END AS confidence_hint
        FROM (SELECT *, {pk(["High", "Moderate", "Low", "Unsupported", "Medium"], 'k')} AS hint FROM ev)"""

    upload = "(" + any_word(["image", "upload"]) + " OR contains(lower(artifact_type), 'screenshot'))"
    fc = R.FOOTPRINT_CAVEATS
    PK = "case_id, suspected_platform"
    o["platform_usage"] = with_(*SCORED, "kn AS (SELECT * FROM scr WHERE suspected_platform <> 'Unknown')", sessions("ses", "kn", PK),
        mode_of("mm", "kn", PK, "suspected_model", "seq"), mode_of("am", "kn", PK, "access_mode", "seq"), f"""fp AS (SELECT {PK}, count(*) AS total,
        count(*) FILTER (WHERE classification = 'Direct') AS direct, count(*) FILTER (WHERE classification = 'Inferred') AS inferred,
        epoch_us(min(ts)) AS earliest_us, epoch_us(max(ts)) AS latest_us,
        CASE WHEN count(ts) = 0 THEN 0 ELSE max(session_no) END AS sessions, count(*) FILTER (WHERE {upload}) AS image_indicators,
        count(*) FILTER (WHERE artifact_family IN ('Browser Downloads', 'User Content')) AS export_indicators,
        count(*) FILTER (WHERE contains(lower(artifact_subtype), 'prompt')) AS prompt_remnants,
        count(*) FILTER (WHERE contains(lower(artifact_subtype), 'response')) AS response_remnants, {LEVEL_OF} AS overall_confidence
        FROM ses GROUP BY ALL)""") + f"""SELECT {PK}, total, direct, inferred, earliest_us, latest_us, CAST(sessions AS BIGINT) AS sessions,
        image_indicators, export_indicators, prompt_remnants, response_remnants, coalesce(mm_v, 'Unknown') AS model,
        coalesce(am_v, 'Unknown') AS access_mode, overall_confidence,
        array_to_string({texts([("direct = 0", q(fc['inferred'])), ("mm_v IS NULL", q(fc['no_model'])), ("NOT full_disk_available", q(fc['not_full']))])}, '|') AS caveats
        FROM fp LEFT JOIN mm USING ({PK}) LEFT JOIN am USING ({PK}) LEFT JOIN cov USING (case_id)"""
    o["platform_summaries"] = with_(*BASE) + f"""SELECT {PK}, count(*) AS total, count(*) FILTER (WHERE classification = 'Direct') AS direct,
        count(*) FILTER (WHERE classification = 'Inferred') AS inferred, epoch_us(min(ts)) AS earliest_us, epoch_us(max(ts)) AS latest_us,
        {joined('artifact_family')} AS families, {joined('access_mode')} AS access_modes FROM enr WHERE suspected_platform <> 'Unknown' GROUP BY ALL"""
    o["episode_sessions"] = with_(EV, ART, *ses("art")) + "SELECT record_id, session_no FROM ses"
    o["episode_members"] = with_(EV, ART, *ses("art")) + f"""SELECT {EPK}, CASE WHEN classification = 'Direct' THEN 'direct' ELSE 'corroborating' END AS role,
        count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ses GROUP BY ALL"""
    o["episode_facts"] = with_(*BASE, *ses("enr"), *EPI) + "SELECT * FROM epf"
    o["episode_levels"] = with_(*BASE, *ses("enr"), *EPI, *LVL) + f"""SELECT {EPK}, ready, score, event_confidence, claim_rank, confidence_class,
        present, coverage_sufficient FROM epl"""
    o["episode_remarks"] = with_(*BASE, *ses("enr"), *EPI, *LVL) + f"SELECT {EPK}, " + ", ".join(
        f"CAST(len({x}) AS BIGINT) AS n_{n}, md5(array_to_string({x}, '|')) AS {n}" for n, x in REMARKS.items()) + " FROM epl"
    claims = "list_extract(" + arr([V.CLAIM_LEVELS[i] for i in (1, 2, 3, 4)]) + ", CAST(coalesce(claim_rank, 1) AS INTEGER))"
    o["artifact_claims"] = with_(*BASE, *ses("enr"), *EPI, *LVL, f"own AS (SELECT record_id, {EPK} FROM ses)") + f"""SELECT enr.record_id,
        {claims} AS claim_level FROM enr LEFT JOIN own USING (record_id) LEFT JOIN epl ON own.case_id = epl.case_id
        AND own.suspected_platform = epl.suspected_platform AND own.user_profile = epl.user_profile AND own.session_no = epl.session_no"""
    o["confidence_classes"] = with_(*BASE, *ses("enr"), *EPI, *LVL) + "SELECT case_id, confidence_class, count(*) AS episodes FROM epl GROUP BY ALL"
    o["case_timeline"] = with_(*SCORED, *TIMELINE) + """SELECT case_id, record_id, epoch_us(ts) AS ts_us, event_type, description, initial_confidence,
        confidence FROM tle"""
    o["sorted_timeline"] = with_(*SCORED, *TIMELINE) + "SELECT case_id, epoch_us(ts) AS ts_us, CAST(seq AS BIGINT) AS seq, record_id, event_type FROM tle"
    o["first_timeline_events"] = with_(*SCORED, *TIMELINE) + """SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) AS row_no,
        record_id, event_type FROM tle QUALIFY row_no <= 50"""
    o["history_gaps"] = """WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev,
        count(*) OVER (PARTITION BY user_id) AS total FROM events),
      h AS (SELECT *, epoch_us(ts) - epoch_us(prev) AS d, row_number() OVER (PARTITION BY user_id ORDER BY prev) AS gap_no FROM g
        WHERE total >= 10 AND ts - prev > INTERVAL 24 HOURS)
      SELECT user_id, gap_no, epoch_us(prev) AS gap_start_us, epoch_us(ts) AS gap_end_us,
        'Gap of ' || (d // 86400000000) || 'd ' || ((d % 86400000000) // 3600000000) || 'h' AS gap FROM h WHERE gap_no <= 5"""
    o["future_stamps"] = """SELECT user_id, count(*) AS future_count FROM events WHERE ts > TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1"""

    relevance = "CASE WHEN " + any_word(V.RELEVANCE_IMAGE_WORDS) + f" THEN {q(V.RELEVANCE_IMAGE)} WHEN " + \
        any_word(["prompt", "response"], "artifact_subtype") + f" THEN {q(V.RELEVANCE_INTERACTIVE)} ELSE coalesce(" + \
        "map_extract(MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in V.RELEVANCE_BY_FAMILY.items()) + "}, artifact_family)[1], " + \
        f"{q(V.RELEVANCE_OTHER)}) END"
    o["comparison_matrix"] = with_(*SCORED) + f"""SELECT record_id, suspected_platform || CASE WHEN suspected_model <> 'Unknown' THEN ' / ' || suspected_model
        ELSE '' END AS tool_or_model, CASE WHEN classification = 'Direct' AND confidence = 'High' THEN 'Strong' WHEN classification = 'Direct' THEN 'Moderate'
        WHEN confidence IN ('High', 'Moderate') THEN 'Supportive' ELSE 'Weak' END AS evidence_value,
        CASE WHEN ts IS NULL THEN 'Absent' WHEN tz_norm THEN 'Good - UTC normalized' ELSE 'Fair - timestamp present, normalization uncertain' END AS time_quality,
        rating AS persistence_text, {relevance} AS relevance,
        concat_ws(' ', CASE WHEN NOT full_disk_available THEN {q(V.NOT_FULL_DISK)} END, CASE WHEN NOT carving_enabled THEN {q(V.NO_CARVING)} END) AS coverage_caveat,
        notes AS comments, confidence FROM scr JOIN cov USING (case_id)"""
    o["exhibits"] = with_(*SCORED, EXH) + """SELECT case_id, exhibit_no, record_id, artifact_family || ' — ' || suspected_platform AS title,
        artifact_type || ' artifact indicating ' || suspected_platform || ' access' AS description,
        strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS exhibit_time FROM exh"""
    o["first_exhibits"] = with_(*SCORED, EXH) + """SELECT case_id, suspected_platform, exhibit_no, record_id FROM exh
        QUALIFY row_number() OVER (PARTITION BY case_id, suspected_platform ORDER BY exhibit_no) <= 10"""
    o["image_findings"] = with_(*SCORED, EXH) + f"""SELECT record_id, extracted_indicator AS finding, confidence,
        min(exhibit_no) OVER (PARTITION BY case_id, suspected_platform, artifact_path) AS exhibit_no FROM exh
        QUALIFY {any_word(V.IMAGE_REVIEW_WORDS)}"""
    o["event_exhibits"] = with_(*SCORED, EXH) + "SELECT record_id, epoch_us(ts) AS ts_us, exhibit_no FROM exh WHERE ts IS NOT NULL"
    o["exhibit_hashes"] = "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents"
    o["case_totals"] = with_(EV, ART) + """SELECT case_id, CASE WHEN GROUPING(suspected_platform) = 1 AND GROUPING(artifact_family) = 1 THEN 'case'
        WHEN GROUPING(artifact_family) = 1 THEN 'platform' ELSE 'family' END AS level, coalesce(suspected_platform, artifact_family, 'all') AS value,
        count(*) AS artifacts, count(ts) AS timed, epoch_us(min(ts)) AS earliest_us, epoch_us(max(ts)) AS latest_us FROM art
        GROUP BY GROUPING SETS ((case_id), (case_id, suspected_platform), (case_id, artifact_family))"""
    o["json_export"] = o["case_totals"]
    o["platform_counts"] = with_(EV, ART) + "SELECT suspected_platform, count(*) AS n FROM art GROUP BY 1 ORDER BY 2 DESC, 1"
    o["top_confidence"] = with_(*SCORED) + f"""SELECT {PK}, count(*) AS total, count(*) FILTER (WHERE classification = 'Direct') AS direct,
        count(*) FILTER (WHERE classification <> 'Direct') AS other, {LEVEL_OF} AS highest_confidence FROM scr
        WHERE suspected_platform <> 'Unknown' GROUP BY ALL"""
    runs = f"""rn AS (SELECT DISTINCT 'C' || (c_custkey % 4) AS case_id, 'X' || c_nationkey AS extractor,
        {pk(S.EXTRACTOR_STATUS, 'c_nationkey')} AS status FROM customer)"""
    by = [(n, st) for n, st in zip(("succeeded", "failed", "not_applicable", "stubs"), S.EXTRACTOR_STATUS)]
    rolled = [EV, ART, COV, runs, "rs AS (SELECT case_id, " + ", ".join(
        joined(f"CASE WHEN status = {q(st)} THEN extractor END") + f" AS {n}" for n, st in by) + " FROM rn GROUP BY 1)",
        "fo AS (SELECT case_id, list_distinct(list(artifact_family)) AS fams FROM art GROUP BY 1)", f"""cr AS (SELECT cov.*, rs.* EXCLUDE (case_id),
        array_to_string(list_sort(fams), '|') AS families_found,
        list_filter({arr(sorted(V.EXPECTED_FAMILIES))}, lambda f: NOT list_contains(fams, f)) AS miss,
        array_to_string({texts([(f"image_type IN {inlist(V.PARTIAL_IMAGES)}", q(R.LIMITATION_PARTIAL)), ("profiles = 0", q(R.LIMITATION_NO_PROFILE))])}, '|') AS limitations
        FROM cov JOIN rs USING (case_id) JOIN fo USING (case_id))"""]
    o["coverage_rollup"] = with_(*rolled) + """SELECT case_id, image_type, succeeded, failed, not_applicable, stubs, families_found,
        array_to_string(miss, '|') AS families_missing, limitations FROM cr"""
    o["drift_register"] = with_(runs) + "SELECT case_id, extractor AS component, '1.0.0' AS version, '2024-02-01' AS last_validated FROM rn"
    o["run_ledgers"] = with_(runs) + """SELECT case_id, extractor, CASE status WHEN 'Success' THEN 'coverage' WHEN 'Failed' THEN 'failure' ELSE 'gap' END AS ledger
        FROM rn WHERE status <> 'Not Applicable'"""
    o["governance_facts"] = with_(*rolled, FAM, ENR, f"""gv AS (SELECT case_id, {joined('source_class')} AS source_classes,
        {joined('platform_surface')} AS surfaces, {joined("nullif(suspected_platform, 'Unknown')")} AS platforms,
        list_distinct(list(acquisition_source)) AS acq, count(*) FILTER (WHERE classification = 'Direct') AS direct,
        count(*) FILTER (WHERE classification <> 'Direct') AS other FROM enr GROUP BY 1)""") + f"""SELECT case_id, source_classes, surfaces, platforms,
        array_to_string({texts([("NOT list_contains(acq, 'Provider Export')", "'provider_export'"), ("NOT list_contains(acq, 'Transcript Capture')", "'voice'")])}, '|') AS acquisition_gaps,
        array_to_string(list_concat({texts([("NOT full_disk_available", "'not_full_disk'"), ("NOT carving_enabled", "'no_carving'")])},
          list_transform(miss, lambda f: 'missing: ' || f)), '|') AS blind_spots, direct, other FROM gv JOIN cr USING (case_id)"""
    parsers = "parser_used"
    o["requirement_status"] = with_(EV, ART, f"""c AS (SELECT case_id, count(DISTINCT CASE WHEN artifact_family LIKE 'Browser%' THEN 'B' WHEN artifact_family LIKE 'OS %' THEN 'O'
        WHEN artifact_family LIKE 'User %' THEN 'U' WHEN artifact_family LIKE 'Native%' THEN 'N' END) AS grp, count(ts) AS timed,
        bool_or({parsers} = 'ExportReplay') AS ex, bool_or({parsers} = 'ManifestExtractor') AS mf, bool_or({parsers} = 'TamperDetector') AS tp,
        count(DISTINCT artifact_family) AS fam, bool_or(artifact_type LIKE 'ChatGPT Plugin%') AS ch, bool_or(suspected_platform <> 'Unknown') AS ep
        FROM art GROUP BY 1)""", values("rq", "id, title", V.REQUIREMENTS)) + f"""SELECT case_id, id AS requirement, title, CASE id
        WHEN 'FR-1' THEN CASE WHEN grp >= 3 THEN '{V.FULL}' ELSE '{V.PARTIAL}' END
        WHEN 'FR-2' THEN CASE WHEN ex AND ep THEN '{V.FULL}' WHEN timed > 0 THEN '{V.PARTIAL}' ELSE '{V.GAP}' END
        WHEN 'FR-3' THEN '{V.PARTIAL}' WHEN 'FR-4' THEN CASE WHEN mf THEN '{V.FULL}' ELSE '{V.PARTIAL}' END WHEN 'FR-5' THEN '{V.PARTIAL}'
        WHEN 'FR-6' THEN CASE WHEN tp OR fam > 2 THEN '{V.FULL}' ELSE '{V.PARTIAL}' END WHEN 'FR-7' THEN CASE WHEN ch THEN '{V.FULL}' ELSE '{V.PARTIAL}' END
        ELSE '{V.FULL}' END AS status FROM c, rq"""
    o["platform_blind_spots"] = with_(EV, ART, values("bs", "platform, spot", V.BLIND_SPOTS)) + f"""SELECT case_id, suspected_platform,
        '[' || suspected_platform || '] ' || coalesce(spot, {q(V.NO_PROFILE_HEAD)} || suspected_platform || {q(V.NO_PROFILE_TAIL)}) AS blind_spot
        FROM (SELECT DISTINCT case_id, suspected_platform FROM art WHERE suspected_platform <> 'Unknown') LEFT JOIN bs ON platform = suspected_platform"""
    caps = [(p, int("export" in f), int("voice" in f), c) for p, f, c in V.CAPABILITIES]
    o["capability_features"] = with_(EV, ART, values("cp", "platform, ex, vo, conf", caps)) + """SELECT suspected_platform, n, coalesce(ex = 1, false) AS export,
        coalesce(vo = 1, false) AS voice, coalesce(conf, 'low') AS capability_confidence
        FROM (SELECT suspected_platform, count(*) AS n FROM art GROUP BY 1) LEFT JOIN cp ON platform = suspected_platform"""
    o["tamper_counts"] = with_(EV, ART) + "SELECT case_id, " + ", ".join(
        f"count(*) FILTER (WHERE artifact_type = {q(t)}) AS {n}" for n, t in R.TAMPER_TYPES.items()) + \
        " FROM art WHERE parser_used = 'TamperDetector' GROUP BY 1"
    val = [EV, ART, """lb AS (SELECT CAST(doc_id % 150 AS VARCHAR) AS case_id, max(quality) AS ql, max(toxic) AS tx, min(doc_id) AS doc_id FROM labels GROUP BY 1)""",
           """ac AS (SELECT user_profile AS case_id, count(*) AS artifacts, list_sort(list_distinct(list(suspected_platform)
             FILTER (WHERE suspected_platform <> 'Unknown'))) AS actual FROM art GROUP BY 1)""", f"""vr AS (SELECT lb.case_id, doc_id % 5 AS phase,
             {texts([("ql = 1", "'ChatGPT'"), ("tx = 1", "'Claude'"), ("doc_id % 7 = 0", "'Poe'")])} AS expected, coalesce(actual, []) AS actual,
             coalesce(artifacts, 0) AS artifacts, doc_id FROM lb LEFT JOIN ac USING (case_id))""",
           """vx AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN artifacts <= 60 ELSE list_has_all(actual, expected) AND artifacts >= doc_id % 90 END AS passed FROM vr)"""]
    o["validation_results"] = with_(*val) + """SELECT case_id, phase, array_to_string(expected, '|') AS expected, array_to_string(actual, '|') AS actual,
        artifacts, passed FROM vx"""
    o["validation_summary"] = with_(*val) + """SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
        array_to_string(list_sort(list_distinct(list(phase))), '|') AS phases, CASE WHEN count(*) FILTER (WHERE NOT passed) = 0 THEN 'Validated'
        WHEN count(*) FILTER (WHERE passed) > 0 THEN 'Partially Validated' ELSE 'Not Validated' END AS state FROM vx"""
    o["store_health"] = f"""WITH p AS (SELECT o_custkey AS e, {pk(["MBR", "GPT", "None Detected", "Unknown"], 'o_custkey')} AS sch,
        CASE o_custkey % 6 WHEN 0 THEN 'Intact' WHEN 1 THEN 'Corrupt' ELSE {pk(["Intact", "Degraded", "Corrupt", "Unknown"], 'o_orderkey')} END AS h FROM orders),
      s AS (SELECT e, list(DISTINCT h) AS hs, bool_or(sch IN ('MBR', 'GPT')) AS has FROM p GROUP BY 1),
      t AS (SELECT *, CASE WHEN hs = ['Intact'] THEN 'Full Forensic Access' WHEN list_has_any(hs, ['Intact', 'Degraded']) THEN 'Partial Filesystem Access'
        ELSE 'Raw Stream Only' END AS tier FROM s)
      SELECT e AS evidence_id, CASE WHEN tier = 'Raw Stream Only' AND NOT has THEN 'Carving Only' WHEN hs = ['Intact'] THEN 'Intact'
        WHEN list_contains(hs, 'Intact') THEN 'Degraded' WHEN list_contains(hs, 'Degraded') THEN 'Partially Readable'
        WHEN list_contains(hs, 'Corrupt') THEN 'Corrupt' ELSE 'Unknown' END AS health, tier FROM t"""
    o["recovery_audit"] = f"""WITH a AS (SELECT o_custkey AS e, count(*) AS n FROM orders GROUP BY 1),
      b AS (SELECT CAST(l_suppkey AS BIGINT) AS e, count(*) AS n FROM lineitem GROUP BY 1),
      c AS (SELECT c_custkey AS e, count(*) AS n FROM customer GROUP BY 1),
      ids AS (SELECT e FROM a UNION SELECT e FROM b UNION SELECT e FROM c)
      SELECT ids.e AS evidence_id, coalesce(a.n, 0) AS carved, coalesce(b.n, 0) AS raw_hits, coalesce(c.n, 0) AS partitions,
      array_to_string({texts([("c.n > 0", "'partition_scan'"), ("a.n > 0", "'signature_carving'"), ("b.n > 0", "'raw_scan'")])}, '|') AS modes
      FROM ids LEFT JOIN a ON a.e = ids.e LEFT JOIN b ON b.e = ids.e LEFT JOIN c ON c.e = ids.e"""
    o["artifact_drilldown"] = with_(EV, ART) + """SELECT record_id, user_profile, epoch_us(ts) AS ts_us FROM art
        WHERE case_id = 'C1' AND suspected_platform = 'Claude'"""

    o["tool_surfaces"] = with_(TOOL) + "SELECT tool_id, surface_class FROM tls"
    o["tool_path_templates"] = with_(TOOL, TPATH) + "SELECT tool_id, os, CAST(ord AS BIGINT) AS ord, template FROM tp"
    o["tool_candidates"] = with_(EV, COV, TOOL, TPATH, COS, TCAND) + "SELECT case_id, tool_id, candidate, CAST(ord AS BIGINT) AS ord FROM cand"
    n = "CASE WHEN status = 'FOUND' THEN pc ELSE 0 END"
    o["tool_checklist"] = with_(*TOOLS) + f"""SELECT case_id, tool_id, status, paths, {n} AS artifact_count, class_count,
        CASE WHEN {n} >= 2 AND class_count >= 2 THEN 'LEVEL_2_CONFIGURATION_OR_WORKSPACE_INDICATORS' ELSE 'LEVEL_1_PRESENCE_OR_ACCESS_ONLY' END AS corroboration,
        CASE WHEN surf = ['BROWSER'] THEN 'DEVICE_LEVEL_ONLY' WHEN status = 'FOUND' THEN 'USER_PROFILE_LINKED'
          ELSE 'PERSON_ATTRIBUTION_NOT_ESTABLISHED' END AS attribution_scope,
        CASE WHEN category IN ('Local LLM', 'Image Generator') THEN 'LOCAL' WHEN category = 'Web Assistant' THEN 'REMOTE' ELSE 'UNKNOWN' END AS inference_location,
        CASE WHEN {n} >= 2 THEN 'HIGH' WHEN {n} = 1 THEN 'MEDIUM' ELSE 'N/A' END AS tool_confidence,
        CASE WHEN status = 'NOT_VERIFIED' THEN 'NOT_COVERED' ELSE 'COVERED' END AS coverage_status FROM chk"""
    o["tool_caveats"] = with_(*TOOLS, FLAGS) + f"""SELECT case_id, tool_id, array_to_string(flags, '|') AS caveat_flags,
        md5(array_to_string(list_transform(flags, lambda f: coalesce(map_extract({CAVEATS}, f)[1], f)), '|')) AS texts FROM flg"""
    o["tool_ledgers"] = with_(*TOOLS, FLAGS) + """SELECT case_id, tool_id, CASE status WHEN 'FOUND' THEN 'coverage' ELSE 'gap' END AS ledger,
        CASE status WHEN 'FOUND' THEN array_to_string(string_split(paths, '|'), ', ') ELSE 'NOT_FOUND: ' || tool_name END AS place,
        CASE status WHEN 'FOUND' THEN pc ELSE 0 END AS evidence_count, array_to_string(flags, '; ') AS caveats FROM flg WHERE status <> 'NOT_VERIFIED'"""


    timed_by_k = "count(*) FILTER (WHERE k % 10 <> 0)"
    every: list[str] = []

    def counted(name: str, key: str, family: str, kind: str, parser: str, timed: str, platform: str = "x.platform", where: str = "true") -> None:
        side = "(SELECT event_id, case_id, k FROM ev)" if key != "doc_id" else "(SELECT doc_id, 'C' || (doc_id % 4) AS case_id, 0 AS k FROM documents)"
        on = "e.event_id = x.line_no" if key == "line_no" else f"e.{key} = x.{key}"
        every.append(f"""SELECT case_id, {q(family)} AS artifact_family, {kind} AS artifact_type, {platform} AS suspected_platform,
            {q(parser)} AS parser_used, count(*) AS n, {timed} AS timed FROM ({ORACLE[name]}) x JOIN {side} e ON {on} WHERE {where} GROUP BY ALL""")

    counted("visits_by_platform", "event_id", V.HISTORY, "'URL Visit'", "VisitExtractor", timed_by_k)
    counted("downloads_by_platform", "event_id", V.DOWNLOADS, "'Download'", "DownloadExtractor", timed_by_k)
    counted("cookies_by_platform", "event_id", V.COOKIES, "'Cookie'", "CookieExtractor", timed_by_k)
    counted("toolchain_traces", "event_id", V.HISTORY, """CASE trace WHEN 'plugin_url' THEN 'ChatGPT Plugin/Custom GPT'
        WHEN 'toolchain_url' THEN 'AI Tool-Chain Trace' ELSE 'RAG Infrastructure Trace' END""", "ToolChainExtractor", "0",
        "CASE trace WHEN 'plugin_url' THEN 'ChatGPT' ELSE 'Unknown' END")
    counted("file_names_by_platform", "doc_id", V.CONTENT, "'AI Export/Download File'", "ContentExtractor", "count(*)")
    counted("screenshots_by_platform", "doc_id", V.SCREENSHOT, "'Screenshot'", "ContentExtractor", "count(*)")
    # Contents are read for files that are text by their extension.
    tails = [t[1:].lower() for t in S.FILE_TAILS]
    counted("content_remnants", "doc_id", V.CONTENT, "'Content Indicator'", "ContentExtractor", "count(*)",
            where=f"{pk(tails, 'x.doc_id // 5')} IN {inlist(V.TEXT_EXT)}")
    counted("storage_keys", "doc_id", V.LOCAL_STORAGE, "'Local Storage Key'", "StorageKeyExtractor", "0")
    counted("shared_links", "doc_id", V.HISTORY, "'Shared AI Link'", "SharedLinkExtractor", "0")
    counted("execution_traces", "event_id", V.EXECUTION, "'Prefetch'", "ExecutionExtractor", "count(*)")
    counted("cleanup_tools", "event_id", V.EXECUTION, "'Cleanup Tool Execution'", "TamperDetector", "count(*)", "'Unknown'")
    counted("unified_log_hits", "line_no", V.UNIFIED_LOG, "'macOS Unified Log'", "LogLineExtractor", "count(*)")
    o["case_artifacts"] = with_(EV) + "SELECT * REPLACE (CAST(timed AS BIGINT) AS timed) FROM (" + "\nUNION ALL ".join(every) + ")"


_build()
