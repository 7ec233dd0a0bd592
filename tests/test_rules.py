from pyspark.sql import functions as F

from footmark.functions import matching as M
from footmark.functions.rules import Rule, RuleBook, default_rules
from footmark.operators import content, hits, traces, visits
from footmark.sources import rules as rule_sources


def platforms(spark, rules, texts, kind="domain"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(M.match_platform(F.lower("t"), rules.of(kind))).collect()]


def test_domains(spark, rules):
    urls = ["https://chatgpt.com/c/1", "https://CLAUDE.ai/chat", "https://gemini.google.com/app", "https://www.perplexity.ai",
            "https://example.com", None, "https://mail.google.com", "https://a.example/?u=claude.ai&v=openai.com"]
    assert platforms(spark, rules, urls) == ["ChatGPT", "Claude", "Gemini", "Perplexity", None, None, None, "ChatGPT"]


def test_domain_is_a_substring_unless_the_host_is_asked_for(spark, rules):
    df = spark.createDataFrame([("https://max.ai/x",), ("https://api.x.ai/v1",)], "url string")
    assert platforms(spark, rules, ["https://max.ai/x"]) == ["Grok"]
    strict = [r[0] for r in df.select(M.match_host_suffix(F.col("url"), rules.of("domain"))).collect()]
    assert strict == [None, "Grok"]


def test_shorter_model_name_comes_first(spark, rules):
    df = spark.createDataFrame([("uses gpt-4o",), ("Claude 3.5 Sonnet",), ("none",)], "t string")
    assert [r[0] for r in df.select(M.match_model(F.lower("t"), rules.of("model"))).collect()] == ["GPT-4", "Claude 3.5 Sonnet", None]


def test_order_is_data(spark):
    book = RuleBook([Rule("model", 0, "gpt-4o", "ChatGPT", "GPT-4o"), Rule("model", 1, "gpt-4", "ChatGPT", "GPT-4")])
    df = spark.createDataFrame([("gpt-4o",)], "t string")
    assert df.select(M.match_model(F.lower("t"), book.of("model"))).first()[0] == "GPT-4o"


def test_catalogue_size(rules):
    assert len(rules.platforms()) == 17
    assert len(rules.of("domain")) == 72
    per_platform = {p: sum(r.platform == p for r in rules.of("domain")) for p in rules.platforms()}
    assert list(per_platform.values()) == [7, 5, 6, 4, 8, 5, 4, 3, 4, 4, 4, 3, 3, 3, 3, 3, 3]
    assert {r.pattern for r in rules.of("prefetch") if r.platform == "Copilot"} == {"COPILOT.EXE", "MICROSOFT.COPILOT.EXE"}
    assert [r.pattern for r in rules.of("app_dir") if r.platform == "Tidio"] == ["AppData/Local/Tidio", "AppData/Roaming/Tidio"]


def test_rules_as_table(spark, rules):
    back = RuleBook.from_df(rule_sources.rules(spark))
    assert [r.pattern for r in back.of("domain")] == [r.pattern for r in rules.of("domain")]
    own = spark.createDataFrame([("domain", 99, "own.example", "Own", None)], rule_sources.RULE_SCHEMA)
    book = RuleBook.from_df(rule_sources.rules(spark, own))
    assert platforms(spark, book, ["https://own.example/x", "https://openai.com"]) == ["Own", "ChatGPT"]


def test_cookie_hosts(spark, rules):
    hosts = [".chatgpt.com", "chatgpt.com", ".google.com", "mail.google.com", "google.com", "CHATGPT.com", ".example.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [r[0] for r in df.select(M.match_cookie_host(F.col("h"), rules.of("cookie_domain"))).collect()]
    assert got == ["ChatGPT", "ChatGPT", "Gemini", "Gemini", "Gemini", None, None]


def test_file_names(spark, rules):
    df = spark.createDataFrame([(n,) for n in ["ChatGPT_x.pdf", "claude_export.txt", "message_feed", "photo.jpg", "conversations.json"]], "name string")
    got = {r.name: (r.platform, r.pattern) for r in content.match_filename(df, rules).collect()}
    assert got["ChatGPT_x.pdf"] == ("ChatGPT", r"chat[-_]?gpt.*\.(?:txt|json|md|pdf|html|csv)")
    assert got["claude_export.txt"][0] == "Claude"
    assert got["message_feed"] == ("ChatGPT", "message_feed")
    assert "photo.jpg" not in got


def test_screenshot_needs_an_image(spark, rules):
    df = spark.createDataFrame([("claude shot.PNG",), ("claude shot.txt",), ("claude",)], "name string")
    assert [(r.name, r.platform) for r in content.match_screenshot(df, rules).collect()] == [("claude shot.PNG", "Claude")]


def test_content_one_row_per_sort(spark, rules):
    df = spark.createDataFrame([(1, "You said: hi. ChatGPT said: no. I'm Claude. gpt-4-turbo"), (2, "nothing")], "id int, text string")
    got = {(r.remnant, r.platform, r.indicator) for r in content.scan_content(df, rules).collect()}
    assert got == {("Prompt Remnant", "ChatGPT", "You said:"), ("Response Remnant", "ChatGPT", "ChatGPT"),
                   ("Response Remnant", "Claude", "Claude"), ("Model Reference", "ChatGPT", "GPT-4")}
    assert content.scan_content(df, rules, max_chars=10).count() == 0


def test_log_lines(spark, rules):
    df = spark.createDataFrame([(1, "x claude.ai y chatgpt.com"), (2, "com.openai.chatgpt and com.anthropic.claude"), (3, "idle")], "n int, line string")
    got = [(r.n, r.platform, r.indicator) for r in traces.classify_lines(df, rules, "unified_log").collect()]
    assert (1, "Claude", "Domain: claude.ai") in got and (1, "ChatGPT", "Domain: chatgpt.com") in got
    one = [(r.n, r.platform, r.indicator) for r in traces.classify_lines(df, rules, "logcat").collect()]
    assert one == [(1, "ChatGPT", "Domain: chatgpt.com"), (2, "ChatGPT", "Package: com.openai.chatgpt")]


def test_traffic_needs_bytes(spark, rules):
    df = spark.createDataFrame([("com.openai.chatgpt", 0, 0, None, 0), ("x.com.openai.chatgpt", None, 5, None, 0)],
                               "package string, wifi_in int, wifi_out int, wwan_in int, wwan_out int")
    assert [(r.package, r.total_bytes) for r in traces.match_traffic(df, rules).collect()] == [("x.com.openai.chatgpt", 5)]
    assert traces.match_package(df, rules).count() == 1


def test_evidence_class(spark):
    paths = ["a/.env", "a/Export/x", "a/globalStorage/x", "a/Config/x", "Prefetch", "zzz", "C:\\App\\Chat\\x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0][0] for r in df.select(content.evidence_class(F.col("p"))).collect()]
    assert got == ["F", "E", "A", "B", "C", "A", "D"]


def test_extensions_and_manifests(spark):
    df = spark.createDataFrame([("bfhkfdnddlhfippjbflipboognpdpoeh", "{}"), ("zz", '{"name":"My Claude"}'), ("yy", '{"name":"x"}')],
                               "ext_id string, manifest string")
    got = {r.ext_id: (r.platform, r.classification, r.ext_name) for r in visits.classify_extensions(df).collect()}
    assert got == {"bfhkfdnddlhfippjbflipboognpdpoeh": ("Unknown", "Direct", "Copilot Sidebar"), "zz": ("Claude", "Inferred", "My Claude")}


def test_keys_are_redacted(spark):
    key = "sk-" + "a1B2" * 6
    df = spark.createDataFrame([("s", f"x {key} y {key} AIza{'b' * 35}")], "source string, text string")
    got = [(r.redacted, r.platform) for r in hits.memory_keys(df, "source", "text").orderBy("redacted").collect()]
    assert got == [("AIzabbbb...bbbb", "Gemini"), (key[:8] + "..." + key[-4:], "ChatGPT")]
    assert df.select(hits.redact_text(F.col("text"))).first()[0].startswith("x [REDACTED_TOKEN] y [REDACTED_TOKEN]")
    many = [f"sk-abcde{n:02d}{'x' * 20}zzzz" for n in range(15)]
    df = spark.createDataFrame([("s", " ".join(many))], "source string, text string")
    assert hits.memory_keys(df, "source", "text").count() == 15
    assert hits.memory_keys(df, "source", "text", most=10).count() == 10


def test_long_cells_stay_apart(spark, rules):
    long = "https://claude.ai/" + "a" * 200
    df = spark.createDataFrame([(long + "1", 1), (long + "2", 2), (long + "1", 3), ("short", 4)], "c string, n int")
    assert {r.cell for r in visits.scan_table(df, "t", rules).collect()} == {long + "1", long + "2"}


def test_default_rules_are_stable():
    assert default_rules().of("model") == default_rules().of("model")
