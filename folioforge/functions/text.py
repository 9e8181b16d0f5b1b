"""Column functions over text: tokens, keywords, sentences, normalised keys and rule-based labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that state an obligation, in the order in which they are looked for.
OBLIGATIONS = ["必须", "应", "应当", "不得", "禁止", "严禁", "原则上应", "宜", "可", "鼓励", "参照", "结合实际"]
HAN = "[\\u4e00-\\u9fa5]"
LATIN_TOKEN, NUMBER = "[a-z0-9]+", r"-?[0-9]+(?:\.[0-9]+)?"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case runs of latin letters and digits, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(LATIN_TOKEN), F.lit(0))


def han_characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HAN), F.lit(0))


def pairs_of(items: Column) -> Column:
    """Neighbours in an array of strings, joined."""
    n = F.size(items)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.element_at(items, i), F.element_at(items, F.least(i + 1, n))))).otherwise(F.array().cast("array<string>"))


#: The kinds of lexical tokens.
RUNS, CODES, DOTTED, ARTICLES = "[a-z]+[0-9]+|[0-9]+(?:[.\\-~][0-9]+)*|[a-z]{2,}", "[A-Za-z][0-9]{1,3}", "[一二三四五六七八九十百0-9]+(?:\\.[0-9]+)+", "第[一二三四五六七八九十百零0-9]+条"


def search_tokens(text: Column) -> Column:
    """Tokens of the lexical index, with repeats: lower-case runs, codes in capitals, dotted numbers, articles, Han characters and pairs of them."""
    han = han_characters(text)
    found = [F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0)), F.transform(F.regexp_extract_all(text, F.lit(CODES), F.lit(0)), lambda c: F.upper(c))]
    return F.concat(*found, F.regexp_extract_all(text, F.lit(DOTTED), F.lit(0)), F.regexp_extract_all(text, F.lit(ARTICLES), F.lit(0)), han, pairs_of(han))


def embedding_tokens(text: Column) -> Column:
    han = han_characters(text)
    return F.concat(words(text), han, pairs_of(han))


def keywords(text: Column, stop: Sequence[str] = (), most: int = 40) -> Column:
    """The first ``most`` distinct words of three letters or more that are no stop words, in order."""
    long = F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.isin(*(stop or [""])))
    return F.slice(F.array_distinct(long), 1, most)


def sentences(text: Column) -> Column:
    """Trimmed sentences with their closing mark; empty ones are dropped."""
    parts = F.split(text, r"(?<=[。；;！!？?])")
    return F.filter(F.transform(parts, squeezed), lambda s: s != "")


def squeezed(text: Column) -> Column:
    """Blanks of any script at the ends removed, runs inside made one."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def exact_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def join_han(text: Column) -> Column:
    """Blanks between two Han characters removed."""
    return F.regexp_replace(text, f"(?<={HAN})[ \\t\\u3000]+(?={HAN})", "")


def has_number_with_unit(text: Column) -> Column:
    return text.rlike(r"[0-9]+(?:\.[0-9]+)?\s*(?:%|km|m2|m|kg|公里|平方米|米|公顷|万人|人|个|处|层|%)")


def article_number(text: Column) -> Column:
    """A dotted number or an article mark at the beginning, else null."""
    dotted = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)+)", 1)
    article = F.regexp_extract(text, "^\\s*(第[0-9一二三四五六七八九十百]+条)", 1)
    return F.coalesce(F.nullif(dotted, F.lit("")), F.nullif(article, F.lit("")))


def list_mark(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*([一二三四五六七八九十]+、|[0-9]+[.)]|[（(][0-9一二三四五六七八九十]+[)）]|[①-⑳]|[-•·])", 1), F.lit(""))


def is_page_number(text: Column) -> Column:
    return squeezed(text).rlike("^(?:[—–-]\\s*[0-9]{1,4}\\s*[—–-]|第\\s*[0-9]+\\s*页|[0-9]{1,4})$")


def obligations(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in OBLIGATIONS]), lambda w: F.contains(text, w))


def normal_date(text: Column) -> Column:
    """Year, month and day as ISO text; anything else trimmed."""
    pattern = "([0-9]{4})[年./-]([0-9]{1,2})(?:[月./-]([0-9]{1,2})日?)?"
    year, month, day = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    day = F.when(day == "", F.lit("1")).otherwise(day)
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).otherwise(squeezed(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def letter_pairs(text: Column) -> Column:
    """Distinct two-character pieces of the lower-case text without blanks and punctuation, in one go over its characters."""
    letters = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", ""), "")
    part = lambda own, first: F.slice(own, F.lit(first), F.size(own) - 1)
    return let(letters, lambda own: F.array_distinct(F.zip_with(part(own, 1), part(own, 2), lambda a, b: F.concat(a, b))))


def support(claim: Column, evidence: Column) -> Column:
    """Share of the claim's pairs of characters that the evidence has too."""
    share = lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, letter_pairs(evidence))) / F.size(own)).otherwise(F.lit(0.0))
    return let(letter_pairs(claim), share)


def markup_stripped(html: Column) -> Column:
    """Text of a page: scripts, styles and tags gone, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
