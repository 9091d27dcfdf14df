"""Column expressions for texts, dates, links and ids; all stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LINE_END, PAGE_ARTIFACT, PAGE_MARK, SPACE, Laws, Outcome, Statements

MOJIBAKE = r"[\u0400-\u04ff\ufffd]"
CJK = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+\\z", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def without_space(c: Column) -> Column:
    """c without white space; nearly all of it is spaces and line ends, which need no pattern."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), f"[{SPACE}]+", "")


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, runs of spaces and tabs as one space, at most one empty line in a row, nothing at the ends."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "[ \t]+", " "), "\n{3,}", "\n\n"))


def chunk_source(c: Column) -> Column:
    """The text that is cut into chunks."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"))


def clean_lines(c: Column) -> Column:
    """Stripped lines without blank ones and page marks; null for null."""
    lines = F.split(F.replace(c, F.lit("\r"), F.lit("")), LINE_END)
    return F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.rlike(PAGE_MARK))


def compact_text(lines: Column, most: int) -> Column:
    """Lines joined, cut to `most` characters with an ellipsis; null if there is nothing."""
    text = strip(F.array_join(lines, "\n"))
    return F.when(text == "", None).when(F.char_length(text) <= most, text).otherwise(F.concat(rstrip(F.substring(text, 1, most)), F.lit("...")))


def evidence(c: Column) -> Column:
    """Text without page artefacts and white space, for comparing evidence."""
    return without_space(F.regexp_replace(F.coalesce(c, F.lit("")), PAGE_ARTIFACT, ""))


def evidence_quote(c: Column) -> Column:
    """evidence() without wrapping quotation marks and trailing ellipses."""
    bare = F.regexp_replace(F.regexp_replace(evidence(c), "^[「」『』\"'“”‘’]+", ""), "[「」『』\"'“”‘’]+\\z", "")
    return F.regexp_replace(bare, r"(?:…|\.{3})+\z", "")


def embedding_text(parts: list[Column]) -> Column:
    """The stripped, non-blank parts, one to a line."""
    return F.concat_ws("\n", *(F.when(strip(p.cast("string")) != "", strip(p.cast("string"))) for p in parts))


def snippet(text: Column, query: Column, radius: int = 70) -> Column:
    """The surroundings of the query's first occurrence, with dots where text is cut off; else the text's beginning."""
    at, size, n = F.position(query, text) - 1, F.char_length(query), F.char_length(text)
    low, high = F.greatest(at - radius, F.lit(0)), F.least(at + size + radius, n)
    middle = strip(F.substr(text, low + 1, high - low))
    dots = lambda cut: F.when(cut, "...").otherwise("")
    found = F.concat(dots(low > 0), middle, dots(high < n))
    return F.when(n > 0, F.when(at < 0, strip(F.substring(text, 1, 2 * radius))).otherwise(found))


def outcome(metadata: Column, holding: Column, rules: Outcome = Outcome()) -> Column:
    """The outcome that the holding states, else the one in the metadata."""
    text = without_space(F.coalesce(holding, F.lit("")))
    good, bad, not_heard = (text.rlike(p) for p in (rules.favorable, rules.rejected, rules.inadmissible))
    meta = strip(F.coalesce(metadata, F.lit("")))
    return (
        F.when(good & (bad | not_heard), rules.partial_label)
        .when(good, rules.favorable_label)
        .when(not_heard & ~bad, rules.inadmissible_label)
        .when(bad, rules.rejected_label)
        .when((meta != "") & (meta != rules.unset), meta)
    )


def case_id(number: Column) -> Column:
    return F.concat(F.lit("case_"), F.substring(F.sha1(number), 1, 16))


def chunk_id(case: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha1(F.concat_ws(":", case, index.cast("string"))), 1, 16))


def summary_id(case: Column, model: Column, prompt_version: Column, source_hash: Column) -> Column:
    return F.concat(F.lit("aisum_"), F.substring(F.sha2(F.concat_ws("\x1f", case, model, prompt_version, source_hash), 256), 1, 24))


def roc_to_date(c: Column) -> Column:
    """'115.01.09' as a date; null where it isn't one."""
    part = F.split(c, r"\.")
    ok = c.rlike(r"^\d{2,3}\.\d{1,2}\.\d{1,2}$")
    return F.when(ok, F.to_date(F.try_make_timestamp(part[0].cast("int") + 1911, part[1].cast("int"), part[2].cast("int"), F.lit(0), F.lit(0), F.lit(0))))


def date_to_roc(d: Column) -> Column:
    return F.format_string("%03d.%02d.%02d", F.year(d) - 1911, F.month(d), F.dayofmonth(d))


def month_ranges(start: Column, end: Column) -> Column:
    """Array of (start, end) for each calendar month of a date range, clipped to it."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end"))))


def day_ranges(start: Column, end: Column, days: int) -> Column:
    """Array of (start, end) pieces of at most `days` days."""
    starts = F.sequence(start, end, F.expr(f"interval {int(days)} day"))
    return F.when(start <= end, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, int(days) - 1), end).alias("end"))))


def normalize_link(link: Column, base: str, parameter: str = "article") -> Column:
    """An absolute link whose query is the trimmed, newly encoded parameter; others stay but for the base."""
    full = F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).otherwise(F.concat(F.lit(base.rstrip("/")), F.lit("/"), F.regexp_replace(link, "^[./]*", "")))
    value = F.regexp_extract(full, f"[?&]{parameter}=([^&#]*)", 1)
    decoded = strip(F.coalesce(F.try_url_decode(value), value))
    return F.when(value != "", F.concat(F.regexp_extract(full, "^[^?#]*", 0), F.lit(f"?{parameter}="), F.url_encode(decoded))).otherwise(full)


def text_source(normalized: Column, raw: Column, prefer: str = "normalized") -> Column:
    """struct(text, source, fallback): the preferred text if it isn't empty, else the other."""
    first, second, names = (normalized, raw, ("normalized", "raw")) if prefer == "normalized" else (raw, normalized, ("raw", "normalized"))
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    text = F.coalesce(a, b)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.when(a.isNotNull() | b.isNull(), names[0]).otherwise(names[1]).alias("source"), (a.isNull() & b.isNotNull()).alias("fallback"))


def rounded(c: Column, decimals: int) -> Column:
    """Rounded half up; a negative number that rounds to zero keeps its sign, as IEEE rounding and SQL engines do."""
    return F.signum(c) * F.round(F.abs(c), decimals)


def similarity_percent(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100).cast("int")


def safe_path_part(c: Column) -> Column:
    cleaned = strip(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    part = F.regexp_replace(F.regexp_replace(cleaned, f"[{SPACE}]+", " "), r"[. ]+\z", "")
    return F.when(part == "", "unknown").otherwise(part)


def is_mojibake(c: Column) -> Column:
    return F.coalesce(c.rlike(MOJIBAKE), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words of two characters or more, then two- and three-grams of the CJK characters taken together."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    signs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))

    def grams(n: int) -> Column:
        starts = F.when(F.size(signs) >= n, F.sequence(F.lit(1), F.size(signs) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(signs, i, n), ""))

    every = F.concat(words, grams(2), grams(3))
    return F.when(F.size(every) > 0, every).otherwise(F.regexp_extract_all(low, F.lit(f"[^{SPACE}]"), F.lit(0)))


ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def search_terms(c: Column) -> Column:
    """Full-text terms: runs of letters and digits in lower case without accents."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), *ACCENTS), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cited_laws(text: Column, laws: Laws = Laws(), most: int = 8) -> Column:
    """Citations of the listed laws in order of appearance, cleaned, distinct but for spaces."""
    number = r"[0-9一二三四五六七八九十百千]+(?:\s*之\s*[0-9一二三四五六七八九十]+)?"
    pattern = rf"(?:{'|'.join(laws.whitelist)})\s*第\s*{number}\s*條(?:\s*第\s*{number}\s*(?:項|款|目))*"

    def cleaned(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, r"(?i)---\s*page\s+\d+\s*---", " "), r"-第\s*\d+\s*頁[^-]*-", " ")
        tidy = strip(F.regexp_replace(F.regexp_replace(bare, f"[{SPACE}]+", " "), r"([㐀-鿿]) (?=[㐀-鿿])", "$1"))
        return F.when(x.rlike(f"[-{SPACE}]"), tidy).otherwise(x)  # all that is taken out begins with one of these

    def listed(s: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(s.keys), 1, most), lambda k: F.element_at(s.found, F.array_position(s.keys, k).cast("int")))

    # equal citations are cleaned once; each list is an array's element, so that it is made once and not for each of its citations
    once = lambda x, fn: F.get(F.transform(F.array(x), fn), 0)
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), cleaned)
    keyed = once(found, lambda f: F.struct(f.alias("found"), F.transform(f, without_space).alias("keys")))
    return once(keyed, listed)


def is_table_like(c: Column) -> Column:
    """At least 20 characters, at least ten digits, few CJK characters."""
    text = evidence(c)
    n = F.char_length(text)
    digits = F.lit(r"\p{Nd}")
    # the text is only cleaned where it has so many digits at all
    return F.when(F.regexp_count(c, digits) >= 10, (n >= 20) & (F.regexp_count(text, digits) >= 10) & (F.regexp_count(text, F.lit(r"[一-鿿]")) / n < 0.35)).otherwise(False)


def ends_complete(c: Column, rules: Statements = Statements()) -> Column:
    text = evidence_quote(c)
    return (text != "") & F.substring(text, -1, 1).isin(list(rules.ends))


def quotes_balanced(c: Column) -> Column:
    text = evidence(c)
    count = lambda q: F.char_length(text) - F.char_length(F.replace(text, F.lit(q), F.lit("")))
    checks = [count(a) == count(b) for a, b in ("「」", "『』", "“”", "‘’")]
    return checks[0] & checks[1] & checks[2] & checks[3]
