"""Typed document elements: extraction, tagged-text round trip, filters, formatting, assembly.

All row-local expressions (regex, split, posexplode) except the per-document
reassembly, which is one shuffle by document.  Regexes avoid look-around and
back-references so the same patterns run in an RE2 engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference.
#   allow-list (notebook): Table, Title, NarrativeText, ListItem
#   deny-list (ingestion job): Header, Footer, PageBreak
#   tagged block: "\n[{category}] (page {page})\n{text}\n"; table block: "\n=== TABLE (page {page}) ===\n{html or text}"
#   plain table block: "=== TABLE ===\n{html}"; missing page prints as N/A
ALLOW = ["Table", "Title", "NarrativeText", "ListItem"]
DENY = ["Header", "Footer", "PageBreak"]
NO_PAGE = "N/A"

SEP, MID, END = "\u0001", "\u0003", "\u0002"

_STRIP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
# tags that end one element and begin the next; all other tags are part of a line of text
_BLOCK = (r"(?i)<(/?(?:title|h[1-6]|p|li|navli|footer|table|div|pre|blockquote|section|article|aside|main|header|nav"
          r"|ul|ol|dl|dt|dd|form|figure|figcaption|head|body|html))(?:\s[^>]*)?/?>")
_WS = r"[\t\n\f\r ]+"

# Our own choice of tag -> category: headings Title, p NarrativeText, li ListItem, table Table,
# footer Footer, an item inside <nav> Header; text in any other place is Uncategorized.
_TAG_CATEGORY = [("title", "Title"), *((f"h{i}", "Title") for i in range(1, 7)),
                 ("p", "NarrativeText"), ("li", "ListItem"), ("navli", "Header"),
                 ("footer", "Footer"), ("table", "Table")]


def _unescape(c: Column) -> Column:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def _mark_nav_items(html: Column) -> Column:
    """Rename '<li' to '<navli' inside every <nav>...</nav> region.

    Split at '</nav>': in each segment the part after its '<nav' is navigation.
    Pure expressions on one row: no window, no shuffle.
    """
    def seg(s):
        outside = F.substring_index(s, "<nav", 1)
        inside = F.substring(s, F.length(outside) + 1, F.lit(1 << 30))
        return F.concat(outside, F.regexp_replace(inside, r"(?i)<li\b", "<navli"))

    return F.array_join(F.transform(F.split(html, "</nav>"), seg), "</nav>")


def element_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment: tags to spaces, entities decoded, whitespace collapsed."""
    return F.trim(F.regexp_replace(_unescape(F.regexp_replace(fragment, "<[^>]*>", " ")), _WS, " "))


def extract_elements(pages: DataFrame, *, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Raw HTML pages -> elements(doc, pos, category, page, text, html).

    Script, style and comments are removed first (scripts may contain '</p>').
    Every block tag, opening or closing, ends the element before it; an opening tag names the
    category of the text that follows, and text after a closing tag, before the first tag or in a tag
    without a category is kept as Uncategorized: no visible text is lost, in whatever letter case the
    tags are.  Narrow stage: every page is processed in the task that reads it.
    """
    clean = _mark_nav_items(F.regexp_replace(F.col(html), _STRIP, ""))
    marked = F.concat(F.lit(END), F.regexp_replace(clean, _BLOCK, SEP + "$1" + END))  # the first piece has no tag
    pieces = pages.select(F.col(doc).alias("doc"), F.posexplode(F.split(marked, SEP)).alias("pos", "piece"))
    body = F.substring("piece", F.instr("piece", END) + 1, F.lit(1 << 30))
    p = pieces.select("doc", "pos", F.lower(F.substring_index("piece", END, 1)).alias("tag"), body.alias("body"))
    category = F.lit("Uncategorized")
    for t, c in reversed(_TAG_CATEGORY):
        category = F.when(F.col("tag") == t, F.lit(c)).otherwise(category)
    out = p.select(
        "doc", "pos", category.alias("category"), F.lit(None).cast("int").alias("page"),
        element_text(F.col("body")).alias("text"),
        F.when(F.col("tag") == "table", F.concat(F.lit("<table>"), F.col("body"), F.lit("</table>"))).alias("html"),
    )
    return out.where(F.col("text") != "")


# ------------------------------------------------------------------ tagged text round trip

_CATS_BY_LINE = ["Title", "NarrativeText", "ListItem", "Table", "Footer"]


def tagged_corpus(documents: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixture writer: each line of a document becomes one tagged block.

    Category by line index % 5 (Title, NarrativeText, ListItem, Table, Footer);
    page = index div 10 + 1, written as N/A when index % 7 = 6.  Narrow stage.
    """
    def block(line, i):
        cat = F.element_at(F.array(*[F.lit(c) for c in _CATS_BY_LINE]), (i % 5 + 1).cast("int"))
        page = F.when(i % 7 == 6, F.lit(NO_PAGE)).otherwise((F.floor(i / 10) + 1).cast("string"))
        return F.when(
            i % 5 == 3, F.concat(F.lit("\n=== TABLE (page "), page, F.lit(") ===\n"), line)
        ).otherwise(F.concat(F.lit("\n["), cat, F.lit("] (page "), page, F.lit(")\n"), line, F.lit("\n")))

    return documents.select(
        F.col(doc).alias("doc"),
        F.array_join(F.transform(F.split(F.col(text), "\n"), block), "\n").alias("text"),
    )


def parse_tagged(tagged: DataFrame, *, doc: str = "doc", text: str = "text") -> DataFrame:
    """Tagged text -> elements(doc, pos, category, page, text, html)."""
    m = F.regexp_replace(F.col(text), r"\n\[([A-Za-z]+)\] \(page ([^)\n]*)\)\n", SEP + "$1" + MID + "$2" + END)
    m = F.regexp_replace(m, r"\n=== TABLE \(page ([^)\n]*)\) ===\n", SEP + "Table" + MID + "$1" + END)
    pieces = tagged.select(F.col(doc).alias("doc"), F.posexplode(F.split(m, SEP)).alias("pos", "piece"))
    pieces = pieces.where(F.col("pos") > 0)
    head = F.substring_index("piece", END, 1)
    body = F.substring("piece", F.instr("piece", END) + 1, 1 << 30)
    return pieces.select(
        "doc", "pos",
        F.substring_index(head, MID, 1).alias("category"),
        F.expr(f"try_cast(substring_index(substring_index(piece, '{END}', 1), '{MID}', -1) AS INT)").alias("page"),
        F.regexp_replace(body, r"\n+$", "").alias("text"),
        F.lit(None).cast("string").alias("html"),
    )


# ------------------------------------------------------------------ filters / formatting

def filter_allow(elements: DataFrame, allow=ALLOW) -> DataFrame:
    """P3 (notebook rule): keep listed categories."""
    return elements.where(F.col("category").isin(list(allow)))


def filter_deny(elements: DataFrame, deny=DENY) -> DataFrame:
    """P3 (ingestion rule): drop listed categories; NULL category is kept."""
    return elements.where(~F.coalesce(F.col("category"), F.lit("")).isin(list(deny)))


def format_element(allow=ALLOW) -> Column:
    """Tagged block text, or NULL for categories outside the allow-list.

    Tables prefer non-empty HTML, else the text (D2: always falls back).
    """
    page = F.coalesce(F.col("page").cast("string"), F.lit(NO_PAGE))
    table = F.concat(F.lit("\n=== TABLE (page "), page, F.lit(") ===\n"),
                     F.coalesce(F.nullif(F.col("html"), F.lit("")), F.col("text")))
    other = F.concat(F.lit("\n["), F.col("category"), F.lit("] (page "), page, F.lit(")\n"), F.col("text"), F.lit("\n"))
    rest = [c for c in allow if c != "Table"]
    return F.when(F.col("category") == "Table", table).when(F.col("category").isin(rest), other)


def format_plain() -> Column:
    """P4 (ingestion style): tables as '=== TABLE ===' + HTML-or-text, others bare text."""
    return F.when(
        F.col("category") == "Table",
        F.concat(F.lit("=== TABLE ===\n"), F.coalesce(F.nullif(F.col("html"), F.lit("")), F.col("text"))),
    ).otherwise(F.col("text"))


def format_elements(elements: DataFrame) -> DataFrame:
    return elements.select("doc", "pos", "category", format_element().alias("formatted"))


def assemble_documents(elements: DataFrame, style: str = "tagged") -> DataFrame:
    """P5: one text per document from its ordered elements (one shuffle by doc).

    style='tagged': allow-list, tagged blocks joined by '\\n' (notebook writer).
    style='plain': deny-list, bare blocks joined by '\\n\\n' (ingestion writer).
    """
    if style == "tagged":
        e = elements.select("doc", "pos", format_element().alias("s")).where(F.col("s").isNotNull())
        sep = "\n"
    else:
        e = filter_deny(elements).select("doc", "pos", format_plain().alias("s"))
        sep = "\n\n"
    g = e.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_e"), F.count(F.lit(1)).alias("n_elements"))
    return g.select("doc", F.array_join(F.transform("_e", lambda x: x["s"]), sep).alias("text"), "n_elements")


def element_stats(elements: DataFrame, allow=ALLOW) -> DataFrame:
    """Per-document counts by kept category, everything else as 'ignored'."""
    aggs = [F.count_if(F.col("category") == c).cast("bigint").alias(c) for c in allow]
    aggs.append(F.count_if(~F.coalesce(F.col("category"), F.lit("")).isin(list(allow))).cast("bigint").alias("ignored"))
    return elements.groupBy("doc").agg(*aggs)


# ------------------------------------------------------------------ names and previews

def file_names(df: DataFrame, url: str = "url", key: str | None = None) -> DataFrame:
    """File name, stem and parsed-text name from a URL or path.

    The stem drops only the last suffix (``Path.stem``), unlike a replace-anywhere rename.
    """
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    keep = [key] if key else []
    return df.select(*keep, path.alias("path"), name.alias("file_name"), stem.alias("stem"),
                     F.concat(stem, F.lit(".txt")).alias("txt_name"))


def previews(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Fixed-length previews in code points; the 300-char one always ends in '...'."""
    t = F.col(text)
    keep = [key] if key else []
    return df.select(*keep,
        F.substring(t, 1, 100).alias("preview_100"), F.substring(t, 1, 80).alias("preview_80"),
        F.concat(F.substring(t, 1, 300), F.lit("...")).alias("answer_preview"),
        F.substring(t, 1, 60).alias("preview_60"),
    )


# ------------------------------------------------------------------ page furniture by repetition

def furniture(elements: DataFrame, sites: DataFrame, *, doc: str = "doc", site: str = "site", share: float = 0.5, min_pages: int = 5) -> DataFrame:
    """``elements`` with blocks that most pages of a site repeat as Header or Footer, whatever their tag.

    ``sites`` says which site each page belongs to.  A block's text (letters only, in lower case) that stands on at least ``share`` of
    a site's pages, and on ``min_pages``, is furniture: Header where it mostly stands in the upper half of the page, Footer
    else.  Pages are counted per site and text, so a site of any size is partial aggregation; elements without a site stay.
    """
    text = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    placed = elements.join(sites.select(doc, site), doc, "left").withColumn("_key", F.when(text != "", F.xxhash64(text)))
    last = elements.groupBy(doc).agg(F.max("pos").alias("_last"))
    pages = sites.groupBy(site).agg(F.countDistinct(doc).alias("_pages"))
    seen = placed.where(F.col(site).isNotNull() & F.col("_key").isNotNull()).join(last, doc)
    # once per page and text, so that a text repeated within one page counts once
    once = seen.groupBy(site, "_key", doc).agg(F.min(F.col("pos") / F.greatest("_last", F.lit(1))).alias("_place"))
    found = once.groupBy(site, "_key").agg(F.count(F.lit(1)).alias("_n"), F.avg("_place").alias("_at")).join(pages, site)
    repeated = found.where((F.col("_n") >= min_pages) & (F.col("_n") >= share * F.col("_pages"))).select(
        site, "_key", F.when(F.col("_at") < 0.5, "Header").otherwise("Footer").alias("_furniture"))
    out = placed.join(repeated, [site, "_key"], "left")
    category = F.coalesce("_furniture", "category").alias("category")
    return out.select(*[category if c == "category" else F.col(c) for c in elements.columns])
