"""Expressions on text: tokens, normalization, numbers, amounts, citations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What Python's ``str.strip`` takes for white space, as a Java regex class.
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Word lists that decide how a question is read.
NUMERIC_WORDS = r"(?i)\b(total|amount|due|sum|balance|qty|quantity|price|fee|fees|tax|subtotal|grand\s*total)\b"
MODE_TOTAL = r"\b(total|amount|sum|grand total|balance due)\b"
MODE_LIST = r"\b(list|show|summarize|summarise|items|line items)\b"
MODE_CLAUSE = r"\b(payment terms|termination|limitation of liability|governing law|confidentiality|clause)\b"
GREETINGS = r"^(hi|hello|hey|howdy|yo|good morning|good afternoon|good evening)"
ENRICH = [
    (["invoice", "line item"], ["line items", "total", "amount", "due date"]),
    (["expense", "fees", "receipt"], ["category", "table", "amount", "total"]),
    (["contract", "clause", "term", "obligation"], ["section", "clause", "obligation", "termination"]),
]
LABELLED_TOTAL = r"(?i)\b(grand\s*total|total\s*amount|amount\s*due|total)\b[:\s]*([₹$]?\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"
CURRENCY_NUMBER = r"([₹$]?\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"
MONEY = r"(?i)(?<!\w)(?:₹|rs\.?\s*|usd\s*\$|\$)?\s*([0-9]{1,3}(?:[,\s][0-9]{2,3})*(?:\.[0-9]{1,2})|[0-9]+(?:\.[0-9]{1,2})?)"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """``strip(c) != ''``: whether there is more than white space. Ends at the first such character,
    where ``strip`` goes through the whole text."""
    return c.rlike(f"[^{SPACE[1:]}")


def est_tokens(c: Column, floor: int = 0) -> Column:
    """Four characters a token, rounded up."""
    return F.greatest(F.lit(floor), F.ceil(F.length(_empty(c)) / 4)).cast("int")


def norm_text(c: Column) -> Column:
    """Hard blanks to blanks, lines trimmed, empty lines dropped."""
    lines = F.transform(F.split(F.translate(_empty(c), " ", " "), "\r\n|\n|\r"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def token_set(c: Column, least: int = 1) -> Column:
    """Distinct lower-cased ASCII alphanumeric tokens, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(_empty(c)), "[^A-Za-z0-9]+"), lambda x: F.length(x) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_numeric_question(c: Column) -> Column:
    return _empty(c).rlike(NUMERIC_WORDS)


def answer_mode(c: Column) -> Column:
    s = F.lower(_empty(c))
    return F.when(s.rlike(MODE_TOTAL), "NUMERIC_TOTAL").when(s.rlike(MODE_LIST), "LIST").when(s.rlike(MODE_CLAUSE), "CLAUSE").otherwise("DEFAULT")


def is_greeting(c: Column) -> Column:
    return F.lower(strip(_empty(c))).rlike(GREETINGS)


def enrich_query(c: Column) -> Column:
    """The question and the words that its subject calls for, each once."""
    s = strip(_empty(c))
    low = F.lower(s)
    extra = [F.when(_any(low, hints), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for hints, words in ENRICH]
    words = F.array_distinct(F.concat(*extra))
    return F.when((s == "") | (F.size(words) == 0), s).otherwise(F.concat_ws(" ", s, F.array_join(words, " ")))


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def any_of(low: Column, words: list[str]) -> Column:
    """True where the text holds any of the words as a substring."""
    return _any(low, words)


def any_word(low: Column, words: list[str]) -> Column:
    """True where the text holds any of the words (or phrases) by itself, in the plural or as a verb's form."""
    return low.rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{'|'.join(words)})(?:e?s|e?d|ing)?(?![\p{{L}}\p{{M}}\p{{N}}_])")


def table_shape(rows: Column) -> Column:
    """(rows, cols) of an array of arrays of cells."""
    return F.struct(F.size(rows).alias("rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("cols"))


def looks_like_table(c: Column) -> Column:
    """(is_table, cols): two lines with two bars each, or two lines with a double blank."""
    lines = F.filter(F.split(_empty(c), "\r\n|\n|\r"), filled)
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    barred = F.filter(lines, lambda x: bars(x) >= 2)
    wide = F.filter(lines, lambda x: x.contains("  "))
    return F.when(F.size(barred) >= 2, F.struct(F.lit(True).alias("is_table"), F.greatest(F.lit(2), bars(F.get(barred, F.lit(0)))).alias("cols"))).otherwise(
        F.struct((F.size(wide) >= 2).alias("is_table"), F.lit(0).alias("cols"))
    )


def parse_amount(c: Column) -> Column:
    return F.trim(F.translate(c, ",₹$", "")).try_cast("double")


def labelled_totals(c: Column) -> Column:
    """All amounts that follow a total's label."""
    return F.filter(F.transform(F.regexp_extract_all(_empty(c), F.lit(LABELLED_TOTAL), F.lit(2)), parse_amount), lambda x: x.isNotNull())


def currency_numbers(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(_empty(c), F.lit(CURRENCY_NUMBER), F.lit(1)), parse_amount), lambda x: x > 0)


def sum_numbers(c: Column) -> Column:
    """Sum of the positive money-like numbers if there are two at least, two decimals."""
    found = F.flatten(F.transform(F.split(_empty(c), "\r\n|\n|\r"), lambda line: F.regexp_extract_all(line, F.lit(MONEY), F.lit(1))))
    values = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[,\s]", "").try_cast("double")), lambda x: x > 0)
    return F.when(F.size(values) >= 2, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 2))


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_empty(c), F.lit(r"\b\d+(?:[\.,]\d+)?\b"), F.lit(0)))


def citation_numbers(c: Column) -> Column:
    """The n of each [^n], once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_empty(c), F.lit(r"\[\^(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def groundedness(answer: Column, context: Column) -> Column:
    """0.4 of the answer's tokens found in the context and 0.6 of its numbers (of its tokens where
    it has none), three decimals; 0 without tokens."""
    ours, theirs = token_set(answer, 3), token_set(context, 3)
    base = F.size(F.array_intersect(ours, theirs)) / F.greatest(F.lit(1), F.size(ours))
    mine, yours = numbers_in(answer), numbers_in(context)
    number = F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, yours)) / F.greatest(F.lit(1), F.size(mine))).otherwise(base)
    return F.when(F.size(ours) == 0, F.lit(0.0)).otherwise(F.round(0.4 * base + 0.6 * number, 3))


def embed_text(meta: Column, text: Column) -> Column:
    """What stands for a chunk in the vector index: a tag for tables and lists, headers, text."""
    types = meta["types"]
    tag = F.when(F.array_contains(types, "table"), F.format_string("[table rows=%s cols=%s]", F.coalesce(meta["rows"].cast("string"), F.lit("?")), F.coalesce(meta["cols"].cast("string"), F.lit("?")))).when(F.array_contains(types, "list"), F.lit("[list]"))
    headers = F.when(F.size(meta["context_headers"]) > 0, F.array_join(meta["context_headers"], " / "))
    head = F.concat_ws(" ", tag, headers)
    return F.concat_ws("\n\n", F.when(head != "", head), text)
