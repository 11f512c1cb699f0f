"""Column functions over text: trimming, term lists, substring counts, relevance, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written so that Java and RE2 both read it.
BLANKS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIM = rf"^{BLANKS}+|{BLANKS}+$"
#: The same, character by character.
BLANK_CHARS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Fixed values that results depend on: the pattern of a query's tokens (Latin words with hyphens, numbers with an optional
# percent sign), words that carry no meaning in a query, and the words that decide its category.
TOKENS = r"[A-Za-z]+(?:-[A-Za-z0-9]+)*|\d+(?:\.\d+)?%?"
STOP_WORDS = ["的", "了", "是", "在", "有", "和", "与", "及", "或", "什么", "怎么", "如何", "多少", "请问", "请", "方面", "情况", "一个", "这个", "那个"]
STOP_TERMS = ["什么", "多少", "如何", "哪些"]
CATEGORIES = {
    "市场行情": ["市场份额", "销量", "海外", "出口", "AUM", "直销占比", "产能", "管理面积"],
    "风险合规": ["综合成本率", "不良率", "现金短债比", "净息差"],
}
OTHER_CATEGORY = "证券投研"
RECALL_TEMPLATES = {"price_surge": "%s 涨幅 原因 分析 利好", "price_drop": "%s 下跌 风险 利空 跟踪", "volume_anomaly": "%s 成交量 异动 资金"}


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def distinct_terms(query: Column) -> Column:
    """Bigrams of the query without white space, and its tokens; each once, without the stop terms."""
    compact = F.regexp_replace(query, BLANKS, "")
    pairs = F.when(F.length(compact) >= 2, F.transform(F.sequence(F.lit(1), F.length(compact) - 1), lambda i: F.substr(compact, i, F.lit(2))))
    tokens = F.regexp_extract_all(query, F.lit(TOKENS), F.lit(0))
    every = F.array_union(F.coalesce(pairs, F.array().cast("array<string>")), tokens)
    return F.array_except(every, F.array(*map(F.lit, STOP_TERMS)))


def segments(query: Column) -> Column:
    """Terms in order with repeats: words, and bigrams of unspaced scripts; longer than one character, no stop words.

    A dictionary segmenter can be put in its place through ``operators.retrieval.Segmenter``.
    """
    words = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    han = r"^\p{IsHan}+$"
    cut = F.transform(
        words,
        lambda w: F.when(w.rlike(han) & (F.length(w) > 2), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array(w)),
    )
    return F.filter(F.flatten(cut), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a substring; 0 for an empty one."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def is_relevant(content: Column, must_contain: Column, any_of: Column) -> Column:
    """All of the first terms occur, and one of the second unless there are none."""
    found = lambda t: F.contains(content, t)
    return F.forall(must_contain, found) & ((F.size(any_of) == 0) | F.exists(any_of, found))


def category(query: Column, rules: dict[str, list[str]] | None = None, default: str = OTHER_CATEGORY) -> Column:
    """The first category one of whose words occurs."""
    out = None
    for name, words in (rules or CATEGORIES).items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(query, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def recall_query(signal: Column, name: Column, symbol: Column) -> Column:
    """The query text for a market signal."""
    name, symbol = F.coalesce(name, F.lit("")), F.coalesce(symbol, F.lit(""))
    out = None
    for kind, template in RECALL_TEMPLATES.items():
        text = F.format_string(template, name)
        out = F.when(signal == kind, text) if out is None else out.when(signal == kind, text)
    return out.otherwise(F.concat_ws(" ", name, symbol, F.lit("分析")))


def parsed_vector(text: Column) -> Column:
    """Numbers separated by commas or white space, as an array of floats."""
    return F.transform(F.filter(F.split(text, r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("float"))


def three_decimals(value: Column) -> Column:
    return F.format_string("%.3f", value)


def decoded_url(text: Column) -> Column:
    """``+`` and percent escapes as UTF-8; null where the escapes are broken."""
    return F.try_url_decode(text)
