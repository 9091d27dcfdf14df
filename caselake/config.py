"""Rules that depend on the language and the kind of document, as frozen presets."""

from __future__ import annotations

from dataclasses import dataclass, field

#: What Python's \s and str.strip treat as white space, for use inside a Java character class.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where Python's str.splitlines ends a line, once carriage returns are gone.
LINE_END = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Fixed values of the data model: page marks, numbered headings, statutes, signals and their weights.
PAGE_MARK = r"^(--- page \d+ ---|-第\d+頁，共\d+頁-)$"
PAGE_ARTIFACT = r"(?i)-第\s*\d+\s*頁，共\s*\d+\s*頁-|---\s*page\s*\d+\s*---"
NUMERAL = "一二三四五六七八九十"
ARTICLE_NUMBER = r"[一二三四五六七八九十百千零〇0-9\-]+"
LAW_ENDING = "法|條例|規則|辦法|準則|要點"


# The presets state the patterns, word lists, titles, caps and weights that results depend on.


@dataclass(frozen=True)
class Outcome:
    favorable: str = r"應(?:再)?給付|應恢復|確認.*契約.*存在|評議申請為有理由|請求為有理由"
    rejected: str = r"尚難為?有利|無理由|駁回"
    inadmissible: str = r"不予受理|不受理"
    partial_label: str = "部分有理由"
    favorable_label: str = "有理由"
    inadmissible_label: str = "不受理"
    rejected_label: str = "無理由"
    unset: str = "全部"


@dataclass(frozen=True)
class Chunking:
    target: int = 1000
    overlap: int = 180
    least: int = 250
    share: float = 0.65
    marks: str = "\n。；"
    hints: tuple[tuple[str, str], ...] = (
        ("主文", r"^主\s*文\s*$"),
        ("事實及理由", r"^事實及理由\s*$"),
        ("程序事項", r"^[一二三四五六七八九十]+、\s*程序事項"),
        ("申請人主張", r"^[一二三四五六七八九十]+、\s*申請人(?:之)?主張"),
        ("相對人主張", r"^[一二三四五六七八九十]+、\s*相對人(?:之)?主張"),
        ("兩造不爭執之事實", r"^[一二三四五六七八九十]+、\s*兩造不爭執"),
        ("本件爭點", r"^[一二三四五六七八九十]+、\s*本件爭點"),
        ("判斷理由", r"^[一二三四五六七八九十]+、\s*判斷理由"),
        ("結論", r"^[一二三四五六七八九十]+、\s*(綜上所述|據上論結)"),
    )


@dataclass(frozen=True)
class Sections:
    holding: str = r"(?m)^[ \t]*主[ \t]*文[ \t]*$"
    facts: str = r"(?m)^[ \t]*事[ \t]*實[ \t]*及[ \t]*理[ \t]*由[ \t]*$"
    numbered: str = r"(?m)^[ \t]*([一二三四五六七八九十]{1,3})[、，,.．][ \t]*(.+?)[ \t]*$"
    notice: str = r"(?m)^[ \t]*中[ \t]*華[ \t]*民[ \t]*國[ \t]*"
    rules: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("procedure", ("程序事項",)),
        ("applicant_claim", ("申請人之主張", "申請人主張")),
        ("respondent_claim", ("相對人之主張", "相對人主張")),
        ("undisputed_facts", ("兩造不爭執之事實", "兩造不爭執事實", "兩造不爭執事項")),
        ("issues", ("本件爭點",)),
        ("reasoning", ("判斷理由",)),
        ("conclusion", ("綜上所述",)),
        ("disposition", ("據上論結",)),
    )
    # (number, start of the heading, section) that stands in for a missing heading
    stand_ins: tuple[tuple[str, str, str], ...] = (("二", "實體事項", "applicant_claim"),)
    titles: dict = field(
        default_factory=lambda: {
            "basic_info": "案件基本資料",
            "holding": "主文",
            "procedure": "程序事項",
            "applicant_claim": "申請人主張",
            "respondent_claim": "相對人主張",
            "undisputed_facts": "兩造不爭執事項",
            "issues": "本件爭點",
            "reasoning": "判斷理由",
            "conclusion": "綜上所述",
            "disposition": "據上論結",
            "notice": "決定書附註與權利說明",
            "other": "其他原文內容",
        }
    )
    packets: tuple[str, ...] = ("holding", "applicant_claim", "respondent_claim", "undisputed_facts", "issues", "reasoning", "conclusion", "disposition")
    packet_chars: int = 3000
    packet_marks: str = "。！？；"


@dataclass(frozen=True)
class RuleSummary:
    holding: tuple[str, ...] = ("主文",)
    holding_end: tuple[str, ...] = ("事實及理由",)
    claim: tuple[str, ...] = ("二、申請人之主張", "二、申請人主張", "二、實體事項")
    claim_end: tuple[str, ...] = ("三、相對人之主張", "三、相對人主張")
    reasoning: tuple[str, ...] = ("六、判斷理由",)
    reasoning_tail: str = "判斷理由"
    reasoning_stop: tuple[str, ...] = ("七、", "八、")
    heading: str = r"^[一二三四五六七八九十]+、"
    caps: tuple[int, int, int] = (500, 1200, 1600)


@dataclass(frozen=True)
class Laws:
    whitelist: tuple[str, ...] = ("保險法", "民法", "刑法", "金融消費者保護法", "消費者保護法", "個人資料保護法", "醫療法", "全民健康保險法", "優生保健法", "毒品危害防制條例", "道路交通管理處罰條例", "道路交通安全規則")
    known: tuple[str, ...] = (
        "金融服務業提供金融商品或服務前說明契約重要內容及揭露風險辦法",
        "金融服務業確保金融商品或服務適合金融消費者辦法",
        "金融消費爭議處理機構評議委員資格條件聘任解任及評議程序辦法",
        "金融消費爭議處理機構設立及管理辦法",
        "保險業招攬及核保理賠辦法",
        "強制汽車責任保險法",
        "金融消費者保護法",
        "個人資料保護法",
        "消費者保護法",
        "全民健康保險法",
        "行政程序法",
        "證券交易法",
        "勞工保險條例",
        "保險法",
        "銀行法",
        "公司法",
        "醫療法",
        "信託法",
        "民法",
        "刑法",
    )
    aliases: tuple[tuple[str, str], ...] = (("金保法", "金融消費者保護法"),)
    triggers: tuple[str, ...] = ("次按", "又依", "爰依", "依據", "依照", "按", "依")
    policy: str = "保單|附約|契約條款|保險契約條款"
    sections: tuple[str, ...] = ("holding", "reasoning", "conclusion", "disposition")
    unknown_chars: int = 12


@dataclass(frozen=True)
class Statements:
    ends: str = "。！？；?!"
    breaks: str = "。！？；"
    longest: int = 300
    categories: dict = field(
        default_factory=lambda: {
            "holding": "decision_result",
            "applicant_claim": "applicant_position",
            "respondent_claim": "respondent_position",
            "undisputed_facts": "background",
            "issues": "core_issue",
            "reasoning": "reasoning",
            "conclusion": "decision_result",
            "disposition": "decision_result",
        }
    )
    caps: dict = field(default_factory=lambda: {"background": 4, "applicant_position": 4, "respondent_position": 4, "core_issue": 4, "reasoning": 6, "decision_result": 4})
    fields: dict = field(default_factory=lambda: {"background": 3, "applicant_position": 2, "respondent_position": 2, "core_issue": 4, "reasoning": 3, "decision_result": 2})
    reasoning_signal: str = "經查|從而|是以|準此|足認|應認|尚難|尚非無據|本中心|職故|綜上"
    application_signal: str = "由上可知|從而|足認|難認|尚難|尚非無據|無請求權|有據|無理由|有理由"
    position_signal: str = "請求|主張|拒絕|爭議|無理由|應給付|應返還|不同意"
    applicant_signal: str = "請求標的|請求事項|請求|主張|拒絕理賠|不服|應給付|應返還|應溯自|爰提起|評議申請"
    respondent_signal: str = "不符合|不符|未見|並無|尚難|無據|無理由|已給付|已賠付|不負|拒絕|歉難|故|因此|是以|從而"
    generic_respondent: str = "申請人之?請求(?:應)?為無理由[。！？；?!]$"
    subject: str = "相對人|本公司|申請人|病歷|醫療顧問|已給付|未見"
    contract_quote: str = "(?:保單|附約).{0,20}條款|契約條款"
    compensation: str = "衡酌本件事實情狀及證據取捨，爰依[^。]{1,220}?(?:補償|給付)[^。]{0,120}。"
    collective: tuple[str, ...] = ("均無法確認", "均難以確認", "均難確認")
    weights: tuple[tuple[str, int], ...] = (("從而", 8), ("難認", 6), ("有據", 5), ("由上可知", 4), ("足認", 4), ("無請求權", 4), ("申請人", 2), ("相對人", 2))
    compensation_score: int = 30


#: A section's number, a fixed value.
NUMBER = "[一二三四五六七八九十百零〇0-9]+"


@dataclass(frozen=True)
class Display:
    """What a shown statement leaves out of its source text, by section."""

    # fixed values: labels at the start, taken off one after the other
    starts: dict = field(
        default_factory=lambda: {
            "holding": ("主文[：:]?",),
            "applicant_claim": (rf"(?:{NUMBER}、\s*)?申請人之?主張[：:]", rf"[（(]{NUMBER}[）)]\s*(?:請求標的|請求事項|陳述)[：:]", r"\d+[.、]", f"[（(]{NUMBER}[）)]"),
            "respondent_claim": (rf"(?:{NUMBER}、\s*)?相對人之?主張[：:]", rf"[（(]{NUMBER}[）)]\s*(?:請求標的|請求事項|陳述)[：:]", r"\d+[.、]", f"[（(]{NUMBER}[）)]"),
            "undisputed_facts": (rf"(?:{NUMBER}、\s*)?(?:兩造)?不爭執(?:之事實|事項)?[：:]", f"[（(]{NUMBER}[）)]"),
            "issues": (rf"(?:{NUMBER}、\s*)?本件爭點[：:]", f"[（(]{NUMBER}[）)]"),
            "reasoning": (rf"(?:{NUMBER}、\s*)?判斷理由[：:]", rf"(?:[（(]{NUMBER}[）)]|\d+[.、])"),
            "conclusion": (rf"(?:{NUMBER}、\s*)?據上論結[，,:：]?", rf"(?:{NUMBER}、\s*)?綜上所述[，,:：]?"),
            "disposition": ("主文[：:]?", rf"(?:{NUMBER}、\s*)?據上論結[，,:：]?"),
        }
    )
    # fixed values: labels of later points, right after the end of a sentence
    within: dict = field(
        default_factory=lambda: {
            "applicant_claim": (rf"[（(]{NUMBER}[）)]\s*(?:請求標的|請求事項|陳述)[：:]\s*(?:\d+[.、])?", r"\d+[.、]"),
            "respondent_claim": (rf"[（(]{NUMBER}[）)]\s*(?:請求標的|請求事項|陳述)[：:]\s*(?:\d+[.、])?", r"\d+[.、]"),
            "issues": (f"[（(]{NUMBER}[）)]",),
        }
    )
    # fixed values: how a continued sentence begins, by section; closing formulas; characters that don't tell texts apart; restated issues; outcomes; policy history
    continued: dict = field(default_factory=lambda: {"respondent_claim": (r"[，,；;]\s*", "而(?=相對人)")})
    closing: dict = field(default_factory=lambda: {"conclusion": r"\s*兩造其餘陳述及攻擊防禦方法，.*?併予敘明。\s*$"})
    restated: str = "(?:準此，|是)?本件爭點(?:厥為|應為|為|如下)"
    blanks: str = r"[ \t\n\r　，,。；;：:]"
    negative: str = "本中心(?:就申請人之請求)?尚難為有利(?:於)?申請人之認定"
    history: str = "^申請人於.{0,80}(?:向相對人)?投保.{0,240}(?:保險契約|附加)"
    history_word: str = "投保"


@dataclass(frozen=True)
class Similarity:
    same_type: int = 60
    same_result: int = 15
    same_category: int = 5
    per_term: int = 6
    most_terms: int = 30
    lexicon: tuple[str, ...] = (
        "癌症", "住院", "手術", "門診", "理賠", "保險金", "醫療", "必要性", "除外責任", "告知義務", "停效", "復效", "寬限期間", "催告", "意外傷害",
        "失能", "身故", "重大傷病", "豁免", "保險費", "保單價值", "生存保險金", "契約變更", "診斷", "病理", "既往症", "等待期間", "自費", "實支實付",
    )


#: Presets for text in Latin letters, as the benchmark tables hold it.
LATIN_CHUNKING = Chunking(marks="\n.;", hints=())
LATIN_SIMILARITY = Similarity(lexicon=("the", "and", "that", "this", "with", "from", "pour", "avec", "dans", "elle", "der", "die", "und", "ein", "von", "que", "los", "las", "una", "por"))
LATIN_OUTCOME = Outcome("retition|theand", "andthe|erof", "notfound", "partial", "favorable", "inadmissible", "rejected", "all")
LATIN_STATEMENTS = Statements(ends=".;?!", breaks=".;", application_signal="the|and|der|que|pour")
