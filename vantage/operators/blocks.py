"""Pages as blocks with kinds and heading paths, and chunks of whole units of them.

A unit is never split: a sentence, a list with the paragraph that leads to it, a group of table rows below its header, a code block (or
its parts between blank lines, where it is longer than a chunk). Everything is column expressions over one document's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators.evidence import QUALIFIERS, sentences

_OUT = r"(?is)<(script|style|nav|head|footer)\b.*?</\1>"
_BLOCK = r"(?i)<(/?)(h[1-6]|p|li|table|pre|div|article|section|blockquote|ul|ol|dl|dt|dd)\b[^>]*>"
BLOCK = "array<struct<pos:int,kind:string,text:string>>"
MARK, ROW, CELL = "\x01", "\x03", "\x04"
UNIT = "struct<text:string,n:int,glued:boolean>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, also if it is read at every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(html: Column) -> Column:
    """Array of (pos, kind, text) of a page: kind is h1 to h6, p, li, table or pre; other elements are p. Null: none.

    White space is one space but in pre. A table's rows stand on lines of their own, its cells apart by ` | `. Scripts, styles, navigation, head and
    footer are left out, and tags inside a block are dropped.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _OUT, " "), r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(F.translate(body, MARK + ROW + CELL, ""), r"(?i)<tr\b[^>]*>", ROW), r"(?i)<t[dh]\b[^>]*>", CELL)
    marked = F.regexp_replace(body, _BLOCK, f"{MARK}$1$2{MARK}")
    # parts alternate: text, tag, text, tag; what follows a closing tag is a paragraph of its own
    places = lambda parts: F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int"))
    pair = lambda parts: lambda k: F.struct(k.alias("pos"), F.lower(F.get(parts, 2 * k - 1)).alias("tag"), F.get(parts, 2 * k).alias("raw"))
    pairs = _once(F.split(marked, MARK), lambda parts: F.transform(places(parts), pair(parts)))

    def block(x: Column) -> Column:
        tag = F.coalesce(x["tag"], F.lit(""))
        kind = F.when(tag.rlike("^(h[1-6]|li|table|pre)$"), tag).otherwise("p")
        bare = _unescaped(F.regexp_replace(x["raw"], r"(?s)<[^>]*>", ""))
        flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
        rows = F.filter(F.transform(F.split(bare, ROW), lambda r: flat(F.array_join(F.filter(F.transform(F.split(r, CELL), flat), lambda c: c != ""), " | "))), lambda r: r != "")
        text = F.when(kind == "pre", F.regexp_replace(bare, r"^\n+|\s+$", "")).when(kind == "table", F.array_join(rows, "\n")).otherwise(flat(F.translate(bare, ROW + CELL, "  ")))
        return F.struct(x["pos"].alias("pos"), kind.alias("kind"), text.alias("text"))

    return F.filter(F.transform(pairs, block), lambda b: F.trim(b["text"]) != "").cast(BLOCK)


def _unescaped(text: Column) -> Column:
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def with_headings(found: Column) -> Column:
    """blocks() as (pos, kind, text, path, section): path holds the headings above a block, section counts the h1 and h2 up to it."""
    item = "array<struct<pos:int,kind:string,text:string,path:array<struct<level:int,title:string>>,section:int>>"
    start = F.struct(F.array().cast(item).alias("out"), F.array().cast("array<struct<level:int,title:string>>").alias("path"), F.lit(0).alias("section"))

    def step(a: Column, b: Column) -> Column:
        level = F.when(b["kind"].rlike("^h[1-6]$"), F.substring(b["kind"], 2, 1).cast("int"))
        above = F.filter(a["path"], lambda h: h["level"] < level)
        path = F.when(level.isNull(), a["path"]).otherwise(F.concat(above, F.array(F.struct(level.alias("level"), b["text"].alias("title")))))
        section = a["section"] + F.when(level <= 2, 1).otherwise(0)
        row = F.struct(b["pos"].alias("pos"), b["kind"].alias("kind"), b["text"].alias("text"), path.alias("path"), section.alias("section"))
        return F.struct(F.when(level.isNull(), F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"), path.alias("path"), section.alias("section"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def _count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _grouped(lines: Column, header: Column, between: str, most: int) -> Column:
    """Lines packed in order up to `most` words, each group below the header; a longer line stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        n = _count(x)
        fits = (a["t"] == "") | (a["n"] + n + _count(header) <= most)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["t"]))).alias("done"), F.when(a["t"] == "", x).when(fits, F.concat(a["t"], F.lit(between), x)).otherwise(x).alias("t"), F.when(fits, a["n"] + n).otherwise(n).alias("n"))

    groups = F.aggregate(lines, start, step, lambda a: F.when(a["t"] != "", F.concat(a["done"], F.array(a["t"]))).otherwise(a["done"]))
    return F.transform(groups, lambda g: F.when(header != "", F.concat(header, F.lit(between), g)).otherwise(g))


def units(block: Column, target: int, most: int) -> Column:
    """The units of a block: (text, n, glued); glued ones open with a qualifier and stay with the unit before."""
    body = lambda x: F.when(F.size(x) > 1, F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(1)))).otherwise(x)
    head = lambda x: F.when(F.size(x) > 1, x[0]).otherwise("")
    table = _once(F.split(block["text"], "\n"), lambda x: _once(head(x), lambda h: _grouped(body(x), h, "\n", target)))
    code = F.when(_count(block["text"]) <= most, F.array(block["text"])).otherwise(_grouped(F.split(block["text"], r"\n\s*\n"), F.lit(""), "\n\n", most))
    found = F.when(block["kind"] == "table", table).when(block["kind"] == "pre", code).when(block["kind"] == "li", F.array(block["text"])).otherwise(sentences(block["text"]))
    opens = lambda t: F.array_contains(F.array(*[F.startswith(t, F.lit(q)) for q in QUALIFIERS]), True)
    return F.transform(found, lambda t: F.struct(t.alias("text"), _count(t).alias("n"), opens(t).alias("glued")).cast(UNIT))


def _with_lists(found: Column, most: int) -> Column:
    """Blocks with the items of each list joined to the paragraph before them that ends with a colon, while `most` words hold."""
    start = F.array().cast("array<struct<pos:int,kind:string,text:string,path:array<struct<level:int,title:string>>,section:int>>")

    def step(a: Column, b: Column) -> Column:
        last = F.element_at(a, -1)
        leads = (F.size(a) > 0) & (b["kind"] == "li") & (last["section"] == b["section"]) & ((last["kind"] == "list") | ((last["kind"] == "p") & last["text"].endswith(":")))
        fits = leads & (_count(last["text"]) + _count(b["text"]) <= most)
        both = F.struct(last["pos"].alias("pos"), F.lit("list").alias("kind"), F.concat(last["text"], F.lit("\n- "), b["text"]).alias("text"), last["path"].alias("path"), last["section"].alias("section"))
        return F.when(fits, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(b)))

    return F.when(F.size(found) > 0, F.aggregate(found, start, step)).otherwise(found)


def block_chunks(pages: DataFrame, key: str = "page_id", html: str = "html", target: int = 400, least: int = 120, most: int = 512) -> DataFrame:
    """(key, chunk, breadcrumb, n_tokens, chunk_text): units packed in order up to `target` words, within a section below an h1 or h2.

    A unit that opens with a qualifier joins the chunk before it while `most` words hold; a unit longer than that is a chunk of its own. A section of less than `least`
    words joins the next one while `target` words hold. breadcrumb is the heading path of a chunk's first unit; headings are no part of the texts.
    """
    # each step is a column of its own: a step that reads the one before it twice doesn't work it out twice
    steps = pages.select(key, blocks(F.col(html)).alias("found")).select(key, with_headings(F.col("found")).alias("found"))
    steps = steps.select(key, _with_lists(F.col("found"), most).alias("found"))
    listed = F.col("found")
    unit = "array<struct<text:string,n:int,glued:boolean,crumb:string,section:int>>"
    crumb = lambda b: F.array_join(F.transform(b["path"], lambda h: h["title"]), " › ")
    whole = lambda b: F.array(F.struct(b["text"].alias("text"), _count(b["text"]).alias("n"), F.lit(False).alias("glued")).cast(UNIT))
    made = lambda b: F.transform(F.when(b["kind"] == "list", whole(b)).otherwise(units(b, target, most)), lambda u: F.struct(u["text"].alias("text"), u["n"].alias("n"), u["glued"].alias("glued"), crumb(b).alias("crumb"), b["section"].alias("section")))
    all_units = F.flatten(F.transform(listed, made)).cast(unit)
    chunk = "struct<text:string,n:int,crumb:string,section:int,merged:boolean>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("now"))

    def step(a: Column, u: Column) -> Column:
        now = a["now"]
        apart = now["section"] != u["section"]
        total = now["n"] + u["n"]
        joins = F.when(now.isNull(), False).when(apart, (now["n"] < least) & ~now["merged"] & (total <= target)).otherwise(total <= F.when(u["glued"], most).otherwise(target))
        fresh = F.struct(u["text"].alias("text"), u["n"].alias("n"), u["crumb"].alias("crumb"), u["section"].alias("section"), F.lit(False).alias("merged"))
        more = F.struct(F.concat(now["text"], F.lit("\n"), u["text"]).alias("text"), total.alias("n"), now["crumb"].alias("crumb"), u["section"].alias("section"), (now["merged"] | apart).alias("merged"))
        done = F.when(joins | now.isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(joins, more).otherwise(fresh).cast(chunk).alias("now"))

    packed = F.aggregate("units", start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    rows = steps.select(key, all_units.alias("units")).select(key, F.posexplode(packed).alias("chunk", "c"))
    return rows.select(key, "chunk", F.col("c.crumb").alias("breadcrumb"), F.col("c.n").cast("long").alias("n_tokens"), F.col("c.text").alias("chunk_text"))
