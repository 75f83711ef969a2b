"""Routing of questions, facts looked up without a search, and fields of structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import parse_date
from ..functions.text import any_of, any_word, currency_numbers, labelled_totals, strip

#: Hints that decide how a question is routed.
NUMERIC_HINTS = ["total", "amount", "sum", "balance", "grand total", "amount due", "fees", "fee", "tax", "subtotal"]
LIST_HINTS = ["list", "show", "summarize", "items", "line items"]
CLAUSE_HINTS = ["payment terms", "termination", "limitation of liability", "governing law", "confidentiality", "clause"]
#: The number must hold a digit, and a prefix such as INV- belongs to it.
INVOICE = r"(?i)\b((?:inv(?:oice)?[-_/])[A-Za-z0-9_/-]*[0-9][A-Za-z0-9_/-]*)|\binv(?:oice)?[\s:#-]+(?:no\.?|number)?[\s:#-]*([A-Za-z0-9_/-]*[0-9][A-Za-z0-9_/-]*)"
STUDENT = r"(?i)\bstudent\s*name\b"
FEES = r"(?i)\bfees?\b|\bamount due\b|\btotal\b"
STUDENT_LINE = r"(?i)\bstudent\s*name\b[:\s-]*([A-Za-z][A-Za-z .'-]{1,80})"
AMOUNT = r"(?i)\b(total(?:\s*amount)?|amount\s*due|subtotal|grand\s*total)\b[:\s]*[$₹€£]?\s*([-+]?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"
CURRENCY = r"(?i)\b(USD|INR|EUR|GBP|JPY|AUD|CAD)\b"
NUMBER = r"(?i)\binvoice\s*(?:no|number)\b[:#.\s]*([A-Za-z0-9\-_/]+)"
DATE = r"([0-3]?[0-9][-/](?:[0-1]?[0-9]|[A-Za-z]{3,9})[-/][0-9]{2,4}|[0-9]{4}-[0-1][0-9]-[0-3][0-9])"


def route(queries: DataFrame) -> DataFrame:
    """Adds flavor, intent, fact_kind and invoice_no by rules. Hints are words of the question: "sum" is none of "sumac"."""
    q = F.coalesce("q", F.lit(""))
    low = F.lower(q)
    number = F.coalesce(F.nullif(F.regexp_extract(q, INVOICE, 1), F.lit("")), F.nullif(F.regexp_extract(q, INVOICE, 2), F.lit("")))
    student = q.rlike(STUDENT) | (q.rlike(FEES) & low.contains("student"))
    flavor = F.when(any_word(low, NUMERIC_HINTS), "NUMERIC").when(any_word(low, LIST_HINTS), "LIST").when(any_word(low, CLAUSE_HINTS), "CLAUSE").otherwise("DEFAULT")
    kind = F.when(number.isNotNull(), "invoice_total").when(student, "student_fees")
    return queries.withColumns({"flavor": flavor, "fact_kind": kind, "invoice_no": number, "intent": F.when(kind.isNotNull(), "FACT_LOOKUP").otherwise("HYBRID")})


def invoice_total_facts(queries: DataFrame, invoices: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, answer, value, doc_id, chunk_id, confidence) for routed invoice questions.

    The invoice of that very number (.9), else the first labelled total (.7), else the first
    amount, of chunks that name both an invoice and the number. Ties: the least chunk_id.
    """
    asked = queries.filter("fact_kind = 'invoice_total'").select("query_id", "invoice_no")
    known = invoices.groupBy(F.col("invoice_number").alias("invoice_no")).agg(F.min(F.struct(F.col("invoice_id").cast("string").alias("doc_id"), F.col("total").cast("double").alias("value"))).alias("m"))
    exact = asked.join(known, "invoice_no").select("query_id", "invoice_no", "m.value", "m.doc_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.9).alias("confidence"))
    rest = asked.join(exact.select("query_id"), "query_id", "left_anti")
    low = F.lower(F.coalesce("text", F.lit("")))
    # A number is looked up by the words of the text that are like one: an equi-join, no scan a question.
    words = chunks.filter(low.contains("invoice")).select("chunk_id", "doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z0-9_/-]*[0-9][a-z0-9_/-]*"), F.lit(0)))).alias("w"))
    met = rest.join(words, F.lower("invoice_no") == F.col("w"))
    value = F.coalesce(F.get(labelled_totals(F.col("text")), F.lit(0)), F.get(currency_numbers(F.col("text")), F.lit(0)))
    score = F.when(F.size(labelled_totals(F.col("text"))) > 0, 2).otherwise(1)
    best = met.withColumns({"value": value, "s": -score}).filter("value is not null").groupBy("query_id", "invoice_no").agg(F.min(F.struct("s", "chunk_id", "doc_id", "value")).alias("m"))
    found = best.select("query_id", "invoice_no", "m.value", F.col("m.doc_id").cast("string").alias("doc_id"), F.col("m.chunk_id").cast("string").alias("chunk_id"), F.lit(0.7).alias("confidence"))
    out = exact.unionByName(found)
    return out.select("query_id", F.concat(F.lit("Invoice "), "invoice_no", F.lit(" total: "), F.format_string("%.2f", "value"), F.lit(".")).alias("answer"), "value", "doc_id", "chunk_id", "confidence")


def student_fee_facts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, student, value, confidence): the first student's name and the first labelled total
    of all chunks, by chunk_id; questions that find neither have no row."""
    q = F.coalesce("q", F.lit(""))
    asked = queries.filter("fact_kind = 'student_fees'").select("query_id", q.rlike(STUDENT).alias("want_name"), q.rlike(FEES).alias("want_total"))
    name = strip(F.regexp_extract("text", STUDENT_LINE, 1))
    total = F.get(labelled_totals(F.col("text")), F.lit(0))
    first = chunks.select("chunk_id", name.alias("name"), total.alias("total")).agg(F.min(F.when(F.col("name") != "", F.struct("chunk_id", "name"))).alias("n"), F.min(F.when(F.col("total").isNotNull(), F.struct("chunk_id", "total"))).alias("t"))
    out = asked.crossJoin(F.broadcast(first)).select("query_id", F.when(F.col("want_name"), F.col("n.name")).alias("student"), F.when(F.col("want_total"), F.col("t.total")).alias("value"))  # one row
    conf = F.when(F.col("student").isNotNull(), 0.35).otherwise(0.0) + F.when(F.col("value").isNotNull(), 0.45).otherwise(0.0)
    return out.filter("student is not null or value is not null").withColumn("confidence", F.least(F.lit(0.95), conf))


def gate_facts(queries: DataFrame, facts: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(facts to use, questions left for the search, with a warning where a fact fell short)."""
    used = facts.filter(F.col("confidence") >= least)
    weak = facts.filter(F.col("confidence") < least).select("query_id").distinct().withColumn("warning", F.lit("fact_below_confidence"))
    return used, queries.join(used.select("query_id"), "query_id", "left_anti").join(weak, "query_id", "left")


def last_user_turn(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, q): the last turn of the user in each conversation."""
    return conversations.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("q"))


def classify_docs(blocks: DataFrame) -> DataFrame:
    """(doc_id, doc_class): contract, invoice or generic, by the first 30 blocks."""
    first = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    text = F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= 30, F.struct("_n", F.substring("text", 1, 400).alias("t"))))), lambda x: x["t"]), "\n"))
    got = first.groupBy("doc_id").agg(text.alias("t"), F.bool_or(F.col("type") == "table").alias("table"))
    contract = any_of(F.col("t"), ["agreement", "party", "effective date", "term"])
    return got.select("doc_id", F.when(contract, "contract").when(F.col("t").contains("invoice") | F.col("table"), "invoice").otherwise("generic").alias("doc_class"))


def _text_of(blocks: DataFrame, types: list[str] | None) -> DataFrame:
    rows = blocks if types is None else blocks.filter(F.col("type").isin(*types))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))


def _labelled_date(label: str) -> Column:
    return parse_date(F.nullif(F.regexp_extract("t", rf"(?i)\b{label}\b[:\s]*" + DATE, 1), F.lit("")))


def extract_invoices(blocks: DataFrame) -> DataFrame:
    """Invoice header fields of each document; what isn't found is null."""
    t = _text_of(blocks, ["header", "paragraph", "list"])
    lines = F.filter(F.transform(F.split("t", "\n"), strip), lambda x: (x != "") & ~F.lower(x).startswith("invoice"))
    date = F.coalesce(*[_labelled_date(x) for x in ("issued", "date", r"invoice\s*date")])
    value = F.regexp_replace(F.nullif(F.regexp_extract("t", AMOUNT, 2), F.lit("")), ",", "").try_cast("decimal(14,2)")
    return t.select(F.col("doc_id").alias("invoice_id"), F.get(lines, F.lit(0)).alias("vendor"), F.nullif(F.regexp_extract("t", NUMBER, 1), F.lit("")).alias("invoice_number"), date.alias("invoice_date"), F.coalesce(_labelled_date(r"due\s*date"), _labelled_date("due")).alias("due_date"), value.alias("total"), F.upper(F.nullif(F.regexp_extract("t", CURRENCY, 1), F.lit(""))).alias("currency"))


def _holds(word: str):
    return lambda x: x.contains(word)


def extract_line_items(blocks: DataFrame) -> DataFrame:
    """(invoice_id, n, description, qty, unit_price, amount) of each document's first table."""
    first = blocks.filter("type = 'table'").groupBy("doc_id").agg(F.min_by("text", "pos").alias("t"))
    rows = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    cells = lambda r: F.transform(F.split(r, r"\|"), lambda x: F.trim(x))
    base = first.select("doc_id", cells(F.lower(F.get(rows, F.lit(0)))).alias("h"), F.posexplode(F.slice(rows, 2, 100_000)).alias("n", "r")).select("doc_id", "h", "n", cells(F.col("r")).alias("c"))

    def column(*names):
        spots = [F.array_position(F.transform("h", _holds(w)), True) for w in names]
        return F.coalesce(*[F.when(p > 0, p) for p in spots])

    value = lambda p: F.when(p <= F.size("c"), F.get("c", (p - 1).cast("int")))
    number = lambda p, t: F.regexp_replace(value(p), ",", "").try_cast(t)
    out = base.filter(F.size(F.filter("c", lambda x: x != "")) >= 2)
    out = out.select(F.col("doc_id").alias("invoice_id"), "n", value(column("description", "item")).alias("description"), number(column("qty", "quantity"), "decimal(14,4)").alias("qty"), number(column("unit price", "price"), "decimal(14,4)").alias("unit_price"), number(column("amount", "total"), "decimal(14,2)").alias("amount"))
    return out.filter("description is not null or qty is not null or unit_price is not null or amount is not null")


def extract_contracts(blocks: DataFrame) -> DataFrame:
    """Parties and effective date of each document."""
    t = _text_of(blocks, None)
    rx = r"(?i)between\s+(.+?)\s+and\s+(.+?)\s"
    date = lambda label: parse_date(strip(F.nullif(F.regexp_extract("t", rf"(?i){label}[:\s]*" + DATE, 1), F.lit(""))))
    return t.select(F.col("doc_id").alias("contract_id"), F.nullif(F.trim(F.regexp_extract("t", rx, 1)), F.lit("")).alias("party_a"), F.nullif(F.trim(F.regexp_extract("t", rx, 2)), F.lit("")).alias("party_b"), F.coalesce(date("date of commencement"), date("dated"), date("effective date")).alias("effective_date"))
