import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caselake.config import Chunking, Sections
from caselake.functions import text as T
from caselake.operators import extract as X
from caselake.operators import sections as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalisation(spark):
    assert one(spark, "　 a\r\nb\rc \t d\n\n\n\ne  ", T.normalize_text) == "a\nb\nc d\n\ne"
    assert one(spark, "--- page 1 ---\r\n　主 文 \n\n-第1頁，共9頁-\nx y", T.clean_lines) == ["主 文", "x", "y"]
    assert one(spark, None, T.clean_lines) is None
    assert one(spark, "甲 乙\n-第 1 頁，共 2 頁-丙--- page 3 ---", T.evidence) == "甲乙丙"
    assert one(spark, "「甲乙…」", T.evidence_quote) == "甲乙"
    assert one(spark, "abcd  efgh", lambda c: T.compact_text(F.split(c, "x"), 5)) == "abcd..."
    assert one(spark, 'a<b>: "c" . ', T.safe_path_part) == "a_b__ _c_"
    assert one(spark, " ..", T.safe_path_part) == "unknown"


def test_snippet(spark):
    row = lambda text, q: spark.createDataFrame([(text, q)], "t string, q string").select(T.snippet(F.col("t"), F.col("q"), 3)).first()[0]
    assert row("0123456789", "45") == "...12345678..."
    assert row("0123", "12") == "0123"
    assert row("abcdefghij", "X") == "abcdef"
    assert row(None, "x") is None and row("", "x") is None


@pytest.mark.parametrize(
    "holding, meta, want",
    [
        ("相對人應給付申請人", None, "有理由"),
        ("相對人應再給付，其餘請求駁 回", None, "部分有理由"),
        ("本件不予受理", "x", "不受理"),
        ("尚難有利申請人之認定", "x", "無理由"),
        ("", "全部", None),
        (None, " 撤回 ", "撤回"),
    ],
)
def test_outcome(spark, holding, meta, want):
    df = spark.createDataFrame([(meta, holding)], "m string, h string")
    assert df.select(T.outcome(F.col("m"), F.col("h"))).first()[0] == want


def test_dates_and_links(spark):
    assert one(spark, "115.01.09", T.roc_to_date) == datetime.date(2026, 1, 9)
    assert one(spark, "115.02.31", T.roc_to_date) is None and one(spark, "x", T.roc_to_date) is None
    assert one(spark, "../get?article= a%20b&x=1", lambda c: T.normalize_link(c, "https://h.example/p")) == "https://h.example/p/get?article=a+b"
    df = spark.sql("select date'2024-01-15' a, date'2024-03-02' b")
    assert [(r.start.day, r.end.day) for r in df.select(T.month_ranges(F.col("a"), F.col("b"))).first()[0]] == [(15, 31), (1, 29), (1, 2)]
    assert [(r.start.day, r.end.day) for r in df.select(T.day_ranges(F.col("a"), F.col("b"), 30)).first()[0]] == [(15, 13), (14, 2)]


def test_ids(spark):
    import hashlib

    assert one(spark, "115年評字第000001號", T.case_id) == "case_" + hashlib.sha1("115年評字第000001號".encode()).hexdigest()[:16]
    assert one(spark, "c", lambda c: T.chunk_id(c, F.lit(3))) == "chunk_" + hashlib.sha1(b"c:3").hexdigest()[:16]


def test_tokens(spark):
    assert one(spark, "AB c 癌x症 住", T.tokens) == ["ab", "癌症", "症住", "癌症住"]
    assert one(spark, "! ?", T.tokens) == ["!", "?"]


def test_cited_laws(spark):
    text = "依保險法第 54 條第 2 項，及保單條款第 3 條、附約第5條。保險法第54條第2項。民法第 一百\n八十四條"
    assert one(spark, text, T.cited_laws) == ["保險法第 54 條第 2 項"]
    assert one(spark, "民法第1條 民法第2條 刑法第3條", lambda c: T.cited_laws(c, most=2)) == ["民法第1條", "民法第2條"]
    assert one(spark, "，".join(f"民法第{k % 7} 條" for k in range(4000)) + "，民法第2條", T.cited_laws) == [f"民法第{k} 條" for k in range(7)]
    assert str(T.cited_laws(F.col("t"))).count("regexp_extract_all") == 1  # a text is searched once and not once for each citation


def test_statement_filters(spark):
    assert one(spark, "112/01/02 3,000 4,500 112/02/03 9,999", T.is_table_like) is True
    assert one(spark, "申請人主張相對人應給付保險金三十萬元並加計利息等語。", T.is_table_like) is False
    assert one(spark, "甲稱：「乙。", T.quotes_balanced) is False
    assert one(spark, "甲。」", T.ends_complete) is True


DECISION = "評議書\n申請人 甲\n主 文\n相對人應給付。\n事 實 及 理 由\n一、程序事項：略\n二、申請人之主張：\n(一)請求給付。\n三、相對人之主張：\n不同意。\n四、兩造不爭執之事實：無\n五、本件爭點：有無理由\n六、判斷理由：\n查保險契約成立。\n七、綜上所述，有理由。\n八、據上論結，決定如主文。\n中 華 民 國 115 年\n"


def test_sections_rebuild_the_text():
    got = S.cut_sections(DECISION)
    assert "".join(s["content"] for s in got) == DECISION
    assert [s["section_type"] for s in got] == ["basic_info", "holding", "procedure", "applicant_claim", "respondent_claim", "undisputed_facts", "issues", "reasoning", "conclusion", "disposition", "notice"]
    assert [s["section_type"] for s in S.cut_sections("沒有標題")] == ["other"]
    shifted = "二、實體事項\n請求\n三、相對⼈之主張\n否認\n二、申請人主張\n引用"
    assert [s["section_type"] for s in S.cut_sections(shifted)] == ["applicant_claim", "respondent_claim"]


def test_sections_over_rows(spark):
    df = spark.createDataFrame([(1, DECISION), (2, ""), (3, None)], "i long, t string")
    cut = S.split_sections(df, "t", ["i"])
    assert cut.where("i = 1").count() == 11
    assert {r.i: r.complete for r in S.section_coverage(cut, df, "i", "t").collect()} == {1: True, 2: True, 3: True}


def test_chunks(spark):
    rules = Chunking(target=90, overlap=25, least=20)
    text = "\n".join(f"第{k}行：" + "保險事故之說明文字，" * 4 + "完。" for k in range(6))
    got = S.cut_chunks(text, rules)
    assert len(got) > 2
    for a, b in zip(got, got[1:]):
        assert b["char_start"] < a["char_end"]
    assert all(text[c["char_start"] : c["char_end"]] == c["chunk_text"] for c in got)
    hints = S.cut_chunks(DECISION, Chunking(target=60, overlap=10, least=10))
    assert hints[0]["section_hint"] == "主文" and hints[-1]["section_hint"] == "本件爭點"
    with pytest.raises(ValueError):
        S.cut_chunks("x", Chunking(target=5, overlap=5))
    df = spark.createDataFrame([("c", " \r\n" + text + " "), ("d", None), ("e", " ")], "case_id string, t string")
    assert [r.chunk_text for r in S.chunk_documents(df, "t", "case_id", rules=rules).collect()] == [c["chunk_text"] for c in got]


def test_exact_pieces_rebuild_the_text():
    text = "甲乙丙。丁戊；" * 50 + "尾"
    got = S.cut_exact(text, 23)
    assert "".join(p["text"] for p in got) == text and max(len(p["text"]) for p in got) <= 23
    assert all(p["text"][-1] in "。；" for p in got[:-1])


def test_sentences_and_quotes():
    assert S.cut_sentences("甲「乙。丙」丁。戊！己") == ["甲「乙。丙」", "丁。", "戊！"] or S.cut_sentences("甲「乙。丙」丁。戊！己") == ["甲「乙。丙」丁。", "戊！"]
    assert S.cut_sentences("x" * 301 + "。甲。") == ["甲。"]
    source = "前句。申請人請求相對人給付保險金並加計利息。後句。"
    assert S.grow_quote("相對人給付", source) == "申請人請求相對人給付保險金並加計利息。"
    assert S.grow_quote("沒有", source) == "沒有"


SUMMARIES = [
    ("主文\n甲\n事實及理由\n二、申請人之主張：\n乙\n三、相對人之主張：\n丙\n六、判斷理由：\n丁\n七、綜上所述\n戊", ("甲", "乙", "丁")),
    ("主 文\n甲\n事實及理由\n二、 實體事項\n乙\n三、相對人主張\n丙\n五、 判斷理由\n丁\n八、據上論結\n戊", ("甲", "乙", "丁")),
    ("二、申請人主張\n乙\n三、 相對人主張", (None, "乙", None)),
    (None, (None, None, None)),
]


@pytest.mark.parametrize("text, want", SUMMARIES)
def test_rule_summary(spark, text, want):
    assert tuple(one(spark, text, X.rule_summary)) == want


def test_rule_summary_caps(spark):
    got = one(spark, "主文\n" + "甲" * 600 + "\n事實及理由", X.rule_summary)
    assert got.holding == "甲" * 500 + "..."


def test_panel_citations(spark):
    rows = [
        (1, "reasoning_1", "reasoning", "判斷理由", 0, "按保險法第54條第2項規定，又依金保法第30條。爰依保險法第54條第2項。依前開說明及民法第184條。依某某條例第3條"),
        (1, "respondent_claim_1", "respondent_claim", "相對人主張", 50, "依銀行法第1條"),
    ]
    packets = spark.createDataFrame(rows, "case_id long, section_id string, section_type string, title string, start_offset int, text string")
    got = [(r.law_name, r.article) for r in X.panel_citations(packets, "case_id").orderBy("start_offset", "place").collect()]
    assert got == [("保險法", "第54條第2項"), ("金融消費者保護法", "第30條"), ("民法", "第184條"), ("某某條例", "第3條")]


def test_grounding(spark):
    sections = spark.createDataFrame([(1, "reasoning_1", "reasoning", "按金保法第30條，申請人請求有理由。")], "case_id long, section_id string, section_type string, content string")
    evidence = spark.createDataFrame([(1, "a", "reasoning_1", "reasoning", "申請人請求 有理由"), (1, "b", "reasoning_1", "background", "無理由"), (1, "c", "zzz", "reasoning", "x"), (1, "d", "reasoning_1", "reasoning", " ")], "case_id long, item string, section_id string, category string, evidence_quote string")
    citations = spark.createDataFrame([(1, "e", "reasoning_1", "金融消費者保護法", "第30條"), (1, "f", "reasoning_1", "保單條款", "第1條")], "case_id long, item string, section_id string, law_name string, article string")
    got = {(r.item, r.violation) for r in X.grounding_violations(evidence, citations, sections, "case_id").collect()}
    assert got == {("b", "wrong_category"), ("b", "unsupported_quote"), ("c", "unknown_section"), ("d", "missing_field"), ("d", "unsupported_quote"), ("f", "bad_law_name"), ("f", "policy_reference"), ("f", "unsupported_citation")}


REASONS = "查申請人於投保時已告知病史並經相對人核保承保在案。從而申請人請求相對人給付保險金三十萬元即屬有據，應予准許。均無法確認其於事故當時之健康狀況為何，足認相對人抗辯不可採。"


def test_reasoning_statements(spark):
    cut = spark.createDataFrame([(1, "reasoning_1", "reasoning", "判斷理由", REASONS, 0)], "case_id long, section_id string, section_type string, title string, content string, start_offset int")
    got = {r.text: r.signal_score for r in X.reasoning_statements(cut, "case_id").collect()}
    assert got == {"從而申請人請求相對人給付保險金三十萬元即屬有據，應予准許。": 17, "均無法確認其於事故當時之健康狀況為何，足認相對人抗辯不可採。": 6}


def test_reasoning_statements_take_no_source_along(spark):
    """Of texts of any shape the sentences that the plain expression finds, without Python and without a copy of the text for each."""
    bits = ["從而" + "甲" * 350 + "。", "乙" * 19 + "。", "從而" + "丙" * 18 + "；", "𠮷" * 299 + "從而。", "「從而" + "丁" * 298 + "」。", "均無法確認" + "足認" + "戊" * 20 + "。", "己" * 30 + "，" + "均無法確認" + "足認" + "戊" * 20 + "。", "從而" + "庚" * 5000]
    texts = ["".join(bits[(k * 5 + j * (k % 3 + 1)) % 8] for j in range(6)) for k in range(12)]
    cut = spark.createDataFrame([(k, "r", "reasoning", "t", x, 0) for k, x in enumerate(texts)], "case_id long, section_id string, section_type string, title string, content string, start_offset int")
    found = X.reasoning_statements(cut, "case_id")
    want = set()
    for k, x in enumerate(texts):
        for place, m in enumerate(re.findall("[^。！？；]{20,300}[。！？；]", x)):
            if m.startswith("均無法確認"):
                start = max(x.rfind(c, 0, x.index(m)) for c in "。；") + 1
                m = x[start : x.index(m) + len(m)] if x.index(m) + len(m) - start <= 300 else m
            if re.search("從而|足認", m) and m.count("「") == m.count("」"):
                want.add((k, place, m))
    assert want and {(r.case_id, r.place, r.text) for r in found.collect()} == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_dedup_and_balance(spark):
    rows = [(1, k, c, q, q, False, 0, False, False) for k, (c, q) in enumerate([("reasoning", "甲乙"), ("background", "甲乙丙"), ("reasoning", "甲乙丙丁"), ("reasoning", "戊"), *[("core_issue", f"爭點{k}號") for k in range(6)]])]
    df = spark.createDataFrame(rows, "case_id long, ordinal int, category string, text string, quote string, rule_based boolean, signal_score int, party boolean, fallback boolean")
    kept = sorted((r.ordinal, r.quote) for r in X.dedup_statements(df, "case_id").collect())
    assert kept[:3] == [(0, "甲乙丙丁"), (1, "甲乙丙"), (3, "戊")]
    got = X.balance_per_category(df, "case_id").groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in got}["core_issue"] == 4


def test_extractive_summary(spark):
    text = DECISION.replace("(一)請求給付。", "申請人請求相對人給付保險金三十萬元。病歷不明。").replace("查保險契約成立。", REASONS)
    df = spark.createDataFrame([(1, text), (2, None)], "case_id long, t string")
    got = {r.case_id: r for r in X.extractive_summary(df, "case_id", "t").collect()}
    bare = "".join(text.split())
    assert len(got[1].reasoning) == 1 and "從而申請人請求相對人給付保險金三十萬元即屬有據，應予准許。" in got[1].reasoning[0]
    assert got[1].applicant_position == ["申請人請求相對人給付保險金三十萬元。"]
    assert all(e.text in bare for e in got[1].evidence)
    assert got[2].reasoning == [] and len(got[2].source_sha256) == 64
    assert X.same_display("本件有理由", "本件有理由。") and not X.same_display("有理由", "應給付三十萬元")


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("holding", "主文本中心就申請人之請求尚難為有利之認定。", "本中心就申請人之請求尚難為有利之認定。"),
        ("undisputed_facts", "四、兩造不爭執之事實：相對人同意恢復保單效力。", "相對人同意恢復保單效力。"),
        ("undisputed_facts", "(二)保單於投保後曾辦理借款。", "保單於投保後曾辦理借款。"),
        ("issues", "五、本件爭點：申請人請求恢復保單效力，是否有據？", "申請人請求恢復保單效力，是否有據？"),
        ("respondent_claim", "(二)陳述：相對人已同意恢復保單效力。", "相對人已同意恢復保單效力。"),
        ("applicant_claim", "二、申請人之主張：(一)請求標的：1.請求返還利息。", "請求返還利息。"),
        ("applicant_claim", "請求返還利息。2.請求懲罰性賠償。(二)陳述：1.相對人以保單借款方式收取利息。", "請求返還利息。 請求懲罰性賠償。 相對人以保單借款方式收取利息。"),
        ("issues", "(一)借款是否約定利率？(二)懲罰性賠償是否有據？", "借款是否約定利率？ 懲罰性賠償是否有據？"),
        ("reasoning", "3.由上可知，雙方已約定借款利率。", "由上可知，雙方已約定借款利率。"),
        ("conclusion", "七、綜上所述，本中心尚難為有利之認定。兩造其餘陳述及攻擊防禦方法，經審酌與結果不生影響，爰不一一論述，併予敘明。", "本中心尚難為有利之認定。"),
        ("respondent_claim", "(3)申請人已承認全部債務，故其請求無理由。", "申請人已承認全部債務，故其請求無理由。"),
        ("respondent_claim", "，經檢視病歷，未見立即手術之必要。", "經檢視病歷，未見立即手術之必要。"),
        ("respondent_claim", "而相對人諮詢醫療顧問後，認為不符給付要件。", "相對人諮詢醫療顧問後，認為不符給付要件。"),
        ("disposition", "八、據上論結，本件評議申請為無理由。", "本件評議申請為無理由。"),
        ("holding", "主文", "主文"),
        ("other", "(一)不變。", "(一)不變。"),
    ],
)
def test_display_text(kind, text, want):
    assert X.display_text(text, kind) == want


def _items(*rows):
    return [{"section_id": f"{k}_1", "section_type": k, "text": t} for k, t in rows]


def test_shown_items_of_a_decision():
    made = X.shown_items("decision_result", _items(("holding", "主文本中心尚難為有利之認定。"), ("conclusion", "七、綜上所述，本中心尚難為有利之認定。"), ("disposition", "八、據上論結，本件評議申請為無理由。")), 2)
    assert [x["shown"] for x in made] == ["本中心尚難為有利之認定。", "本件評議申請為無理由。"]
    assert made[1]["text"] == "八、據上論結，本件評議申請為無理由。"
    made = X.shown_items("decision_result", _items(("holding", "主文本中心尚難為有利申請人之認定。"), ("conclusion", "申請人請求相對人給付系爭保險金，本中心尚難為有利申請人之認定。")), 2)
    assert [x["shown"] for x in made] == ["申請人請求相對人給付系爭保險金，本中心尚難為有利申請人之認定。"]
    assert X.same_display("本中心就申請人之請求尚難為有利於申請人之認定。", "本中心就申請人之請求尚難為有利申請人之認定。")
    assert X.same_display("申請人請求解除房屋買賣契約之部分，不受理。", "申請人請求解除房屋買賣契約之部分不受理；申請人其餘請求為無理由。")
    assert not X.same_display("相對人應給付申請人新臺幣一萬元。", "申請人逾一萬元之請求為無理由。")


def test_reasons_that_restate_the_issue():
    reason, issue, other = "是以，依現有資料可知治療不符一般醫療常規，請求難謂有據。", "準此，本件爭點厥為：申請人接受手術有無醫療必要性？", "是本件爭點應為申請人的治療是否有必要性？"
    shown = lambda *t: [x["text"] for x in X.shown_items("reasoning", _items(*(("reasoning", x) for x in t)), 3)]
    assert shown(issue, reason, other) == [reason]
    assert shown(issue) == [issue]


def test_history_of_the_policy_is_shown_once(spark):
    from caselake.config import Display, Statements

    claim, history, told = "申請人主張相對人拒絕理賠並無理由。", "申請人於108年9月23日向相對人投保保險契約，並附加醫療附約。", "申請人於108年9月23日投保系爭保險契約。"
    rows = [(1, [claim, history], [told]), (2, [history], [told]), (3, [claim, history], []), (4, [], [told])]
    item = "array<struct<section_id:string,text:string,shown:string>>"
    df = spark.createDataFrame([(k, [("s", t, t) for t in a], [("s", t, t) for t in b]) for k, a, b in rows], f"id int, a {item}, b {item}")
    got = {r.id: [x.shown for x in r.kept] for r in df.select("id", X._without_history(F.col("a"), F.col("b"), Statements(), Display()).alias("kept")).collect()}
    assert got == {1: [claim], 2: [history], 3: [claim, history], 4: []}


def test_chunk_rows_in_small_blocks(spark, monkeypatch):
    texts = [None, "", "a" * 30, ("Ein Satz steht hier. " * 200), "x\n" * 900, "b. " * 700]
    rows = [(n if n else None, t, Decimal("1.50"), [n]) for n, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "case long, body string, price decimal(6,2), chunk_text array<int>").coalesce(1)
    rules = Chunking(marks="\n.;", hints=())
    want = sorted((n, c["chunk_index"], c["chunk_text"], c["char_start"], c["char_end"]) for n, t in enumerate(texts) for c in S.cut_chunks((df.sparkSession.createDataFrame([(t,)], "t string").select(T.chunk_source(F.col("t"))).first()[0]), rules))
    for most in (1, 1 << 22):
        monkeypatch.setattr(S, "OUT_CHARS", most)
        got = S.chunk_documents(df, "body", "case", ["case", "price"], rules).collect()
        assert sorted((r.case, r.chunk_index, r.chunk_text, r.char_start, r.char_end) for r in got) == sorted(want * 2)
        assert {r.price for r in got} == {Decimal("1.50")}
    assert S.chunk_documents(df.limit(0), "body", "case").count() == 0
    with pytest.raises(ValueError):
        S.chunk_documents(df, "body", "case", ["case", "chunk_text"], rules)
