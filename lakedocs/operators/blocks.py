"""From pages and texts to artifacts and blocks.

artifact: doc_id, pos, type, text, page_idx, level, headers, caption, rows, cols, items, ordered, html
block: block_id, doc_id, pos, page, span_start, span_end, type, text, meta
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import stable_id
from ..functions.text import filled

ARTIFACT = "doc_id string, pos int, type string, text string, page_idx int, level int, caption string, rows int, cols int, items int, ordered boolean, html string"
LEVELS = range(1, 7)
#: Characters of pages that a task parses before it gives their parts away.
PARSED = 4_000_000


class _Page(HTMLParser):
    """Collects the typed parts of one page in document order."""

    SKIP, HOLD = {"script", "style", "noscript"}, {"table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.page, self.skip = [], None, 0
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "section" and "data-page" in a:
            self.page = int(a["data-page"]) if (a["data-page"] or "").isdigit() else None
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "figure") or tag in self.HOLD:
            held = any(x["tag"] in self.HOLD for x in self.open)
            if not held or tag in self.HOLD:
                self.open.append({"tag": tag, "text": [], "rows": [], "items": [], "alt": None, "caption": []})
        elif tag == "img":
            if self.open and self.open[-1]["tag"] == "figure":
                self.open[-1]["alt"] = a.get("alt")
            elif not any(x["tag"] in self.HOLD for x in self.open):
                self.add("image", a.get("alt") or "", caption=a.get("alt"))
        elif self.open:
            top = self.open[-1]
            if tag == "li":
                top["items"].append([])
            elif tag == "tr":
                top["rows"].append([])
            elif tag in ("td", "th"):
                (top["rows"] or top["rows"].append([]) or top["rows"])[-1].append([])
            elif tag == "figcaption":
                top["in_caption"] = True
            elif tag == "br":
                self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "section":
            self.page = None
        elif self.open and tag == "figcaption":
            self.open[-1]["in_caption"] = False
        elif any(x["tag"] == tag for x in self.open):
            while True:
                part = self.open.pop()
                self.close(part)
                if part["tag"] == tag:
                    break

    def handle_data(self, data):
        if self.skip or not self.open:
            return
        top = self.open[-1]
        if top["tag"] == "table":
            if top["rows"] and top["rows"][-1]:
                top["rows"][-1][-1].append(data)
        elif top["tag"] in ("ul", "ol"):
            if top["items"]:
                top["items"][-1].append(data)
        elif top.get("in_caption"):
            top["caption"].append(data)
        else:
            top["text"].append(data)

    def close(self, part=None):
        if part is None:
            super().close()
            while self.open:
                self.close(self.open.pop())
            return
        tag, join = part["tag"], lambda x: " ".join("".join(x).split())
        if tag == "table":
            rows = [r for r in ([join(c) for c in row] for row in part["rows"]) if any(r)]
            if rows:
                self.add("table", "\n".join(" | ".join(r) for r in rows), rows=len(rows), cols=max(map(len, rows)), html="".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows))
        elif tag in ("ul", "ol"):
            items = [x for x in map(join, part["items"]) if x]
            if items:
                self.add("list", "\n".join(items), items=len(items), ordered=tag == "ol")
        elif tag == "pre":
            text = "".join(part["text"]).strip("\n")
            if text.strip():
                self.add("code", text)
        elif tag == "figure":
            caption = join(part["caption"]) or part["alt"] or ""
            self.add("image", caption, caption=caption)
        else:
            text = join(part["text"])
            if text:
                self.add("header" if tag[0] == "h" else "paragraph", text, level=int(tag[1]) if tag[0] == "h" else None)

    def add(self, kind, text, level=None, caption=None, rows=None, cols=None, items=None, ordered=None, html=None):
        self.out.append((kind, text, self.page, level, caption, rows, cols, items, ordered, html))


def html_to_artifacts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Artifacts of HTML pages, 0 to n a page; null html has none. Only the markup is read row by
    row; all that follows is DataFrame work."""

    most = PARSED

    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ARTIFACT.split(", ")]).astype({c: "Int32" for c in ("page_idx", "level", "rows", "cols", "items")} | {"ordered": "boolean"})

    def read(pdfs):
        for pdf in pdfs:
            rows, chars = [], 0
            for doc, html in zip(pdf["doc_id"], pdf["html"], strict=True):
                page = _Page()
                page.feed(html or "")
                page.close()
                rows += [(doc, k, *x) for k, x in enumerate(page.out)]
                chars += len(html or "")
                if chars >= most:
                    yield frame(rows)
                    rows, chars = [], 0
            yield frame(rows)

    return pages.select(F.col(id_col).cast("string").alias("doc_id"), F.col(html_col).cast("string").alias("html")).mapInPandas(read, ARTIFACT)


def text_to_artifacts(docs: DataFrame, split: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain text as one code artifact, or with ``split='line'`` a paragraph for each line that isn't blank."""
    doc = F.col(id_col).cast("string").alias("doc_id")
    if split == "line":
        rows = docs.select(doc, F.posexplode(F.split(text_col, "\n")).alias("pos", "text")).filter(F.trim("text") != "")
        kind = F.lit("paragraph")
    else:
        rows = docs.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(doc, F.lit(0).alias("pos"), F.col(text_col).alias("text"))
        kind = F.lit("code")
    null = lambda t: F.lit(None).cast(t)
    return rows.select("doc_id", "pos", kind.alias("type"), "text", F.lit(0).alias("page_idx"), null("int").alias("level"), null("string").alias("caption"), null("int").alias("rows"), null("int").alias("cols"), null("int").alias("items"), null("boolean").alias("ordered"), null("string").alias("html"))


def with_header_chain(artifacts: DataFrame) -> DataFrame:
    """Adds ``headers``: the headers that a part stands under, outermost first, skipped levels ''.

    A header of level k cuts the chain to k - 1 and adds itself; its own chain leaves it out.
    The chain starts anew on each page section.
    """
    over = Window.partitionBy("doc_id", "page_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("level", F.lit(1))
    header = F.col("type") == "header"
    # Of each level the latest header before the part, each window once.
    last = [f"_h{k}" for k in LEVELS]
    out = artifacts.withColumns({c: F.last(F.when(header & (level == k), F.struct("pos", "text")), ignorenulls=True).over(over) for c, k in zip(last, LEVELS, strict=True)})
    # It stands unless a header of an outer level came later.
    for k, c in enumerate(last[1:], 1):
        outer = F.greatest(*[F.col(f"{x}.pos") for x in last[:k]]) if k > 1 else F.col(f"{last[0]}.pos")
        out = out.withColumn(f"_ok{k + 1}", F.col(c).isNotNull() & (outer.isNull() | (outer < F.col(f"{c}.pos"))))
    out = out.withColumn("_ok1", F.col(last[0]).isNotNull())
    depth = F.greatest(*[F.when(F.col(f"_ok{k}"), k).otherwise(0) for k in LEVELS])
    own = F.when(header, level - 1).otherwise(depth)
    out = out.withColumn("_depth", own)
    chain = F.slice(F.array(*[F.when(F.col(f"_ok{k}"), F.col(f"{c}.text")).otherwise("") for k, c in zip(LEVELS, last, strict=True)]), F.lit(1), F.col("_depth"))
    return out.withColumn("headers", chain).drop("_depth", *last, *[f"_ok{k}" for k in LEVELS])


def artifact_stats(artifacts: DataFrame) -> DataFrame:
    """Counts and densities of each document."""
    chars = F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long")
    pages = F.greatest(F.lit(1), F.countDistinct("page_idx"))
    return artifacts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("artifact_total"), chars.alias("text_chars"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "image").alias("images"),
        F.count_if(F.col("type") == "header").alias("headers"), F.count_if(F.col("type") == "paragraph").alias("paragraphs"), F.count_if(F.col("type") == "list").alias("lists"),
        pages.cast("long").alias("pages_detected"), F.round(chars / pages, 2).alias("text_density_chars_per_page"),
    )


def normalization_warnings(stats: DataFrame) -> DataFrame:
    """Adds ``warnings`` on thin results; stats may be null for documents without artifacts."""
    total, chars, tables = (F.coalesce(c, F.lit(0)) for c in ("artifact_total", "text_chars", "tables"))
    found = F.array_compact(F.array(F.when(total == 0, "no_artifacts_detected"), F.when(chars == 0, "canonical_empty"), F.when(chars < 200, "low_text_coverage"), F.when((tables > 0) & (chars < 100), "sparse_text")))
    return stats.withColumn("warnings", F.array_distinct(found))


def choose_parse(stats: DataFrame) -> DataFrame:
    """(doc_id, tool) of the better of two parses.

    stats: doc_id, tool (first, second, ocr), tables, text_chars. The second wins when the first
    has no table or under 500 characters and the second has more tables or half as much text
    again; OCR wins when the first has under 400 characters and OCR has more.
    """
    of = lambda tool, c: F.max(F.when(F.col("tool") == tool, F.col(c)))
    one = stats.groupBy("doc_id").agg(*[of(t, c).alias(f"{t}_{c}") for t in ("first", "second", "ocr") for c in ("tables", "text_chars")])
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    second = F.col("second_text_chars").isNotNull() & ((v("first_tables") == 0) | (v("first_text_chars") < 500)) & ((v("second_tables") > v("first_tables")) | (v("second_text_chars") > 1.5 * v("first_text_chars")))
    ocr = F.col("ocr_text_chars").isNotNull() & (v("first_text_chars") < 400) & (v("ocr_text_chars") > v("first_text_chars"))
    return one.select("doc_id", F.when(second, "second").when(ocr, "ocr").when(F.col("first_text_chars").isNotNull(), "first").when(F.col("second_text_chars").isNotNull(), "second").otherwise("ocr").alias("tool"))


def strip_repeated_edges(blocks: DataFrame, variant: str = "manifest") -> DataFrame:
    """Drops paragraphs and headers that repeat as the first or last text of pages.

    manifest: the two most common edge texts of a document if on two pages at least; html: the
    five most common if on max(3, a fifth of the pages). Ties go to the smaller text.
    """
    text = F.col("type").isin("paragraph", "header", "list", "text") & (F.trim("text") != "")
    edges = blocks.filter(text).groupBy("doc_id", "page").agg(F.min_by("text", "pos").alias("a"), F.max_by("text", "pos").alias("b"))
    seen = edges.select("doc_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("text")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    most, least = (2, F.lit(2)) if variant == "manifest" else (5, F.greatest(F.lit(3), (F.col("pages") * 0.2).cast("int")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "text"))
    drop = seen.join(pages, "doc_id").withColumn("rank", rank).filter((F.col("rank") <= most) & (F.col("n") >= least)).select("doc_id", "text")
    edge = F.col("type").isin("paragraph", "header")
    return blocks.filter(~edge).unionByName(blocks.filter(edge).join(drop, ["doc_id", "text"], "left_anti").select(*blocks.columns))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def artifacts_to_blocks(artifacts: DataFrame) -> DataFrame:
    """Blocks without spans: types mapped, images described, empty parts dropped.

    Takes the artifacts of every reader: columns that one doesn't have count as null. A table's text
    is its Markdown, else its text, else its rows with bars between the cells.
    """
    a = artifacts
    kind = F.when(F.col("type") == "text", "paragraph").otherwise(F.col("type"))
    caption, html = _column(a, "caption", "string"), F.coalesce(_column(a, "html", "string"), _column(a, "table_html", "string"))
    body = _column(a, "table_body", "array<array<string>>")
    cells = F.array_join(F.transform(body, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    full = lambda c: F.when(filled(c), c)
    plain = F.coalesce("text", F.lit(""))
    table = F.coalesce(full(_column(a, "table_markdown", "string")), full(plain), full(cells), F.lit(""))
    image = F.when(F.coalesce(caption, F.col("text"), F.lit("")) != "", F.concat(F.lit("[Image: "), F.coalesce(F.nullif(caption, F.lit("")), F.col("text")), F.lit("]"))).otherwise("[Image]")
    text = F.when(F.col("type") == "image", image).when(F.col("type") == "table", table).otherwise(plain)
    headers = F.coalesce(_column(a, "headers", "array<string>"), F.array().cast("array<string>"))
    rows = F.coalesce(_column(a, "rows", "int"), F.when(F.size(body) > 0, F.size(body)))
    cols = F.coalesce(_column(a, "cols", "int"), F.array_max(F.transform(body, lambda r: F.size(r))))
    meta = F.struct(_column(a, "level", "int").alias("level"), headers.alias("headers"), rows.alias("rows"), cols.alias("cols"), _column(a, "items", "int").alias("items"), _column(a, "ordered", "boolean").alias("ordered"), html.alias("html"), caption.alias("caption"), F.col("type").alias("origin_type"))
    out = a.select(stable_id(F.col("doc_id"), F.col("pos"), kind).alias("block_id"), "doc_id", "pos", (_column(a, "page_idx", "int") + 1).alias("page"), kind.alias("type"), text.alias("text"), meta.alias("meta"))
    return out.filter((F.col("type") == "image") | filled(F.col("text")))


def with_spans(blocks: DataFrame) -> DataFrame:
    """Adds span_start and span_end in the document's text: parts two characters apart, images none."""
    gap = F.length("text") + F.when(F.col("type") == "image", 0).otherwise(2)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("span_start", F.coalesce(F.sum(gap).over(before), F.lit(0)).cast("int")).withColumn("span_end", (F.col("span_start") + F.length("text")).cast("int"))


def check_blocks(blocks: DataFrame, artifacts: DataFrame, cap: int = 1_000_000) -> DataFrame:
    """(doc_id, status, warnings): parity of tables, overlaps, order, cap, coverage of each document."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumns({
        "_back": F.coalesce(F.col("span_start") < F.lag("span_end").over(by_doc), F.lit(False)),
        "_over": F.coalesce((F.col("type") != "table") & (F.col("span_start") < F.max(F.when(F.col("type") == "table", F.col("span_end"))).over(before)), F.lit(False)),
        "_good": F.length(F.regexp_replace("text", r"[^\p{Print}\s]", "")),
    })
    ours = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "table").alias("tables"), F.max("_back").alias("back"), F.max("_over").alias("over"), F.sum(F.length("text")).alias("chars"), F.sum("_good").alias("good"))
    theirs = artifacts.groupBy("doc_id").agg(F.count_if(F.col("type") == "table").alias("a_tables"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("a_chars"))
    j = theirs.join(ours, "doc_id", "full")
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.array_compact(F.array(
        F.when(v("n") == 0, "no_blocks"), F.when(v("tables") != v("a_tables"), "table_count_mismatch"), F.when(F.col("over"), "table_span_overlap"), F.when(F.col("back"), "span_regression"),
        F.when(v("n") > cap, "blocks_capped"), F.when((v("n") > 0) & (v("good") < 0.05 * v("chars")), "low_printable_ratio"), F.when((v("n") > 0) & (v("chars") < 0.6 * v("a_chars")), "low_coverage"),
    ))
    return j.select("doc_id", F.when(F.size(found) > 0, "WARN").otherwise("OK").alias("status"), found.alias("warnings"))


#: Frequent words by which a language is told.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "que", "pour", "dans"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "den", "mit", "von", "ein"],
    "es": ["el", "los", "las", "y", "del", "que", "por", "con", "una", "como"],
}


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def with_language(docs: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """Adds ``language``: that of most stop words, ties to the earlier name; null without any. A vote
    by known words, not a detector. ``most``: vote on so many first characters alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.lower(text if most is None else F.substring(text, 1, most)), r"[^\p{L}]+")
    votes = F.array(*[F.struct(F.size(F.filter(words, _among(s))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, s) in enumerate(sorted(STOP_WORDS.items()))])
    best = F.array_max(votes)
    return docs.withColumn("language", F.when(best["n"] > 0, best["lang"]))
