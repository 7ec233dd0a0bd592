"""Decontamination, language identification, chat formatting."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from llm_helpers import DOCS, documents, hard_documents
from pyspark.sql import functions as F

from footmark.llm import chat, decontamination, language
from footmark.llm.common import table

SF = "/root/testdata/sf0.001"


# --- decontamination ---
def lowered_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ITEMS = [(1, "Ab, cd. AB cd ab cd ab CD ab cd!"), (2, "One two"), (10, "one TWO three"), (3, None), (4, " ?! "), (None, "straße déjà"),
         (2, "five"), (5, "xyz xyz")]


def test_contamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in ITEMS:
        w = lowered_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add("null" if item is None else str(item))
    want = []
    for doc, text, *_ in hard_documents():
        w, hit, items = lowered_words(text), set(), set()
        for key, names in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i:i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    items |= names
        want.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    found = decontamination.contamination_report(documents(spark), bench)
    assert Counter(tuple(r)[:6] for r in found.collect()) == Counter(want)
    assert sum(w[2] for w in want) > 100
    spans = {(r.doc_id, s.start, s.end) for r in found.collect() for s in r.spans}
    texts = {d: t for d, t, *_ in hard_documents()}
    assert all(texts[d][s:e] == texts[d][s:e].strip() for d, s, e in spans if d not in (None, 0, 3))
    clean = decontamination.clean_documents(documents(spark), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[5]) and clean.columns == documents(spark).columns
    for empty in (bench.limit(0), bench.where("text IS NULL")):
        assert decontamination.find_contamination(documents(spark), empty).where("n_hit > 0").isEmpty()
    assert decontamination.contamination_report(spark.createDataFrame([], DOCS), bench).isEmpty()


# --- language ---
def test_held_out_accuracy(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert found.where("rejected").count() <= 2


def test_language_edge_cases(spark):
    rows = language.identify(documents(spark)).collect()
    assert len(rows) == len(hard_documents())
    by_text = {d: t for d, t, *_ in hard_documents()}
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred in ("en", "de", "und"))
        if r.doc_id is not None and r.doc_id != 3 and not re.search(r"\w", by_text[r.doc_id] or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert language.identify(spark.createDataFrame([], DOCS)).isEmpty()
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(-1, "漢字仮名交じり文を読む " * 40), (-2, "zzqx xqzz qxzq " * 80)], "doc_id long, text string")
    model = language.fit(docs)
    assert {r.rejected for r in language.predict(odd, model).collect()} == {True}
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 1


def test_languages_not_learned_are_rejected(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents").where("lang IS NOT NULL")
    for left_out, least in (("de", 0.9), ("fr", 0.9), ("es", 0.9), ("en", 0.9)):
        found = language.predict(docs.where(F.col("lang") == left_out), language.fit(docs.where(F.col("lang") != left_out)))
        assert found.agg(F.avg(F.col("rejected").cast("int"))).first()[0] > least
    model = language.fit(docs)
    assert language.predict(docs, model).where("rejected").count() == 0
    words = {w for r in docs.select("text").limit(20).collect() for w in r.text.split()[:5] if w.isascii() and w.isalpha()}
    assert len(words) > 20 and not any(model.predict(" ".join([w] * 300))[2] for w in words)
    assert model.predict("это просто русский текст который модель не знает " * 10)[2]


def test_several_centroids():
    import numpy as np
    rows = np.eye(6)[[0, 0, 1, 1, 2, 2, 2]]
    assert np.allclose(np.sort(language.spherical_kmeans(rows, 3) @ np.eye(6)[:3].T, axis=0)[-1], 1)


# --- chat ---
TEXTS = ["</s>[INST] ok [/INST]", "\\s\\b\\a \\\\ [", "", None, "a<b>c</s>", "\n\n", "plain", "<image:0.1>"]


def test_round_trip(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", "system", "assistant", None, "[INST]", "tool", "user"], TEXTS))]
    rows += [(3, None, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "assistant", None)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(9))
    made = chat.format_conversations(given.withColumn("parts", chat.text_part(F.col("text"))))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    read = made.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("runs")))
    for r in read.collect():
        turns = sorted(want[r.conv_id])
        assert [tuple(x) for x in r.read] == [x[1:] for x in turns]
        assert r.loss == "".join(x for _, role, x in turns if role == "assistant")
        assert "".join(x.text for x in r.runs) == r.formatted and r.n_turns == len(turns)
        assert r.formatted.count("</s>") == len(turns) and r.formatted.count("[INST]") == len(turns)
    assert read.count() == 5
    assert chat.read_back(made.limit(0)).isEmpty()


def test_parts_become_placeholders(spark):
    part = "struct<kind: string, text: string, ref: string, tokens: long>"
    rows = [(1, 0, "user", [("text", "see [", None, None), ("image", None, "s3/a.png", None), ("text", " and ", None, None), ("audio", None, "b.wav", 12)]),
            (1, 1, "assistant", [(None, "fine", None, None), ("document", None, None, None)]), (1, 2, "user", None), (2, None, None, [])]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).collect()}
    assert [(a.placeholder, a.kind, a.ref, a.tokens) for a in made[1].attachments] == [
        ("<image:0.1>", "image", "s3/a.png", 576), ("<audio:0.3>", "audio", "b.wav", 12), ("<document:1.1>", "document", None, 1024)]
    assert "see \\b<image:0.1> and <audio:0.3>" in made[1].formatted and made[1].attachment_tokens == 576 + 12 + 1024
    assert made[2].attachments == [] and made[2].n_turns == 1


def test_native_plan(spark):
    messages = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat.read_back(chat.format_conversations(messages.withColumn("parts", chat.text_part(F.col("text")))))
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())


def test_letters_of_every_script_and_nothing_else():
    from unicodedata import category
    for text in ("。。。", "、", "́", "̧́", "１２３", "🙂", "", "½", "—"):
        assert language.trigram_counts(text) is None, text
    for text in ("ﬁ ﬂ", "Ａｂｃ", "𝐚𝐛", "𐌰𐌱", "ﻻﷲ", "漢", "が", "ｱ", "𠀀", "é", "ª"):
        assert language.trigram_counts(text) is not None, text
    table = language.letter_table()
    assert all((table[i] == 2) == (category(chr(i))[0] == "L") for i in range(0, 0x110000, 7))
    assert np.array_equal(language.trigram_counts("。漢。"), language.trigram_counts(" 漢 "))
