"""Pages as trees: one pass of a tag stack gives a page's elements and strings, rules over them are column expressions.

An element knows which elements and which strings lie inside it, as ranges of their numbers, so that a rule asks for ancestors
and texts by comparing numbers, and a tree is as long as its page, however deep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ELEMENT = "struct<tag:string,classes:array<string>,href:string,inner:int,first:int,last:int>"
_PARTS = {"tag": pa.string(), "classes": pa.list_(pa.string()), "href": pa.string(), "inner": pa.int32(), "first": pa.int32(), "last": pa.int32()}
#: Tags that never have an end, and those whose text is not read.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
UNREAD = frozenset(("script", "style", "template"))
#: Pages held as objects at a time.
ROWS = 64
#: The tabs of a study's page, by the end of their address, and the pages whose fields make a study.
TABS = ("administrative-details", "methodological-aspects", "data-management", "study-documents")


class Tree(HTMLParser):
    """Elements in the order of their start tags, and the strings between tags without outer white space.

    An end tag closes its nearest open element and all that was opened inside; without one it closes nothing. What the page leaves
    open ends with the page.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # a list for each part of an element
        self.tag, self.classes, self.href, self.inner, self.first, self.last = ([] for _ in _PARTS)
        self.strings: list[str] = []
        self.stack: list[int] = []
        self.opened: dict[str, int] = {}
        self.silent = 0
        self.run: list[str] = []
        self.feed(html)
        self.close()
        self.cut()
        self.shut(len(self.stack))

    def cut(self) -> None:
        text = "".join(self.run).strip()
        self.run.clear()
        if text and not self.silent:
            self.strings.append(text)

    def shut(self, n: int) -> None:
        for _ in range(n):
            i = self.stack.pop()
            self.opened[self.tag[i]] -= 1
            self.silent -= self.tag[i] in UNREAD
            self.inner[i], self.last[i] = len(self.tag), len(self.strings)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.cut()
        told = {k: v or "" for k, v in reversed(attrs)} if attrs else {}
        self.stack.append(len(self.tag))
        self.tag.append(tag)
        self.classes.append(told.get("class", "").split())
        self.href.append(told.get("href"))
        self.first.append(len(self.strings))
        self.inner.append(0)
        self.last.append(0)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.silent += tag in UNREAD
        if tag in VOID:
            self.shut(1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(1)

    def handle_endtag(self, tag: str) -> None:
        self.cut()
        if self.opened.get(tag):
            depth = next(k for k, i in enumerate(reversed(self.stack)) if self.tag[i] == tag)
            self.shut(depth + 1)

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self.cut()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _many(lists: list[list], values: pa.Array) -> pa.ListArray:
    """Lists of the lengths of lists, of the values one after the other."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), values)


def trees(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, elements, strings of pages; a page without markup text has empty ones.

    Element i holds the elements from i + 1 to before inner and the strings from first to before last (all from 0).
    """
    own = pages.select(key, html)
    shape = f"{own.schema[key].simpleString()}, elements array<{ELEMENT}>, strings array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                read = [Tree(x or "") for x in part.column(1).to_pylist()]
                flat = [pa.array(list(chain.from_iterable(getattr(t, n) for t in read)), kind) for n, kind in _PARTS.items()]
                elements = _many([t.tag for t in read], pa.StructArray.from_arrays(flat, names=list(_PARTS)))
                yield pa.RecordBatch.from_arrays([part.column(0), elements, pa.array([t.strings for t in read], pa.list_(pa.string()))], names=[key, "elements", "strings"])

    return own.mapInArrow(run, shape)


def text_of(element: Column) -> Column:
    """The strings inside an element, with spaces between them."""
    return F.array_join(F.slice("strings", element["first"] + 1, element["last"] - element["first"]), " ")


def inside(element: Column) -> Column:
    """The elements inside one that carries its number as i."""
    return F.slice("elements", element["i"] + 2, F.greatest(element["inner"] - element["i"] - 1, F.lit(0)))


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), where the rule reads the value several times and it is computed once."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def having(elements: Column, tag: str) -> Column:
    return F.filter(elements, lambda e: e["tag"] == tag)


def tagged(tree: DataFrame, tags: tuple[str, ...], key: str = "page_id") -> DataFrame:
    """key, ord, tag, href, text of the elements with one of the tags; ord is the place among a page's elements of the tag, from 0."""

    def told(e: Column, i: Column) -> Column:
        return F.struct(i.alias("ord"), e["tag"].alias("tag"), e["href"].alias("href"), text_of(e).alias("text"))

    by_tag = F.flatten(F.array(*(F.transform(having(F.col("elements"), t), told) for t in tags)))
    return tree.select(key, F.explode(by_tag).alias("x")).select(key, "x.*")


def fields(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ord, label, values of every dl that has a dt and a dd, also inside another.

    The first dt names it; values are the texts of the field items in the first dd, or else the dd's own text, empty ones
    included. Of equal labels the last counts in a study's record; here all are rows.
    """
    return with_fields(tree).select(key, F.explode("_fields").alias("x")).select(key, "x.*")


def with_fields(tree: DataFrame) -> DataFrame:
    """tree with _fields, the rows of fields() as an array of a page's own row, so that no tree is copied for each of its lists."""

    def numbered(e: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), *(e[n].alias(n) for n in ("tag", "classes", "inner", "first", "last")))

    def within(x: Column) -> Column:
        return F.slice("_e", x["i"] + 2, F.greatest(x["inner"] - x["i"] - 1, F.lit(0)))

    def pair(dl: Column, n: Column) -> Column:
        return F.struct(n.alias("ord"), *(F.get(having(within(dl), t), F.lit(0)).alias(t) for t in ("dt", "dd")))

    def told(x: Column) -> Column:
        items = F.filter(within(x["dd"]), lambda e: F.array_contains(e["classes"], "field__item"))
        values = F.when(F.size(items) > 0, F.transform(items, text_of)).otherwise(F.array(text_of(x["dd"])))
        return F.struct(x["ord"].alias("ord"), T.norm(text_of(x["dt"])).alias("label"), values.alias("values"))

    every = tree.withColumn("_e", F.transform("elements", numbered))
    pairs = every.withColumn("_pairs", F.filter(F.transform(having(F.col("_e"), "dl"), pair), lambda x: x["dt"].isNotNull() & x["dd"].isNotNull()))
    return pairs.withColumn("_fields", F.transform("_pairs", told)).drop("_e", "_pairs")


def resolved(base: str, href: Column) -> Column:
    """An address on a site: absolute ones as they are, those from the root or of a page after its host."""
    root = base.rstrip("/")
    return F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(root.split("//")[0]), href)).when(href.startswith("/"), F.concat(F.lit(root), href)).when(href == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), href))


def study_records(pages: DataFrame, base: str, key: str = "study_id", part: str = "part", html: str = "html") -> DataFrame:
    """One row per study of its pages (key, part: 0 details, 1 methods, 2 data, html).

    Fields of later parts replace those of earlier ones. error is STUDY_NOT_FOUND where the labelled id is not the asked one or the
    title is missing, and the rest is null then. Tabs are the links of the details that end in a tab's name, the last of each.
    """
    whole = F.struct(F.col(key).alias("k"), F.col(part).alias("p"))
    # pages are dealt before they are parsed, since a small table of them may lie in one piece, and each is parsed once
    tree = trees(pages.select(whole.alias("_k"), html).repartition("_k"), "_k", html).withColumns({"k": F.col("_k.k"), "p": F.col("_k.p")})

    def row(kind: int, name: Column, ord: Column, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), ord.alias("ord"), values.alias("values"))

    def bare(x: Column) -> Column:
        return F.rtrim(x["href"], F.lit("/"))

    def last_piece(x: Column) -> Column:
        return F.element_at(F.split(bare(x), "/"), -1)

    links = F.transform(F.filter("elements", lambda e: (e["tag"] == "a") & e["href"].isNotNull()), lambda e, i: F.struct(i.alias("i"), e["href"].alias("href")))
    # a last piece without anything before it is no tab
    tabs = F.filter(links, lambda x: last_piece(x).isin(*TABS) & bare(x).contains("/"))
    own = F.transform(tabs, lambda x: row(1, last_piece(x), x["i"], F.array(resolved(base, x["href"]))))
    told = F.transform("_fields", lambda x: row(0, x["label"], x["ord"], x["values"]))
    # a row without a name stands for the study itself
    asked = F.array(row(2, F.lit(None).cast("string"), F.lit(0), F.array().cast("array<string>")))
    each = with_fields(tree).select("k", "p", F.explode(F.concat(told, F.when(F.col("p") == 0, own).otherwise(F.slice(own, 1, 0)), asked)).alias("x")).select("k", "p", "x.*")
    # both groupings below are by the study first, so rows move once
    last = each.repartition("k").groupBy("k", "kind", "name").agg(F.max_by("values", F.struct("p", "ord")).alias("values"))
    of = lambda kind, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", value.alias("v"))))))
    rows = last.groupBy("k").agg(of(0, F.col("values")).alias("f"), of(1, F.get("values", F.lit(0))).alias("tabs"))
    many = lambda *names: F.coalesce(*(F.col("f")[n] for n in names), F.array().cast("array<string>"))
    one = lambda name: F.array_join(many(name), " ")
    ok = (one("study id") == F.col("k").cast("string")) & (one("official title and acronym") != "")
    record = {
        "title": one("official title and acronym"), "eupas_number": F.nullif(one("eu pas number"), F.lit("")), "description": one("study description"), "study_type": one("study type"),
        "study_designs": many("non interventional study design"), "status": one("study status"),
        "darwin_eu": F.when(one("darwin eu study") == "Yes", True).when(one("darwin eu study") == "No", False), "countries": many("study countries"),
        "data_source_types": many("data sources types", "data source type"), "catalogue_data_sources": many("data sources", "data source s"),
        "source_url": F.concat(F.lit(base.rstrip("/") + "/study/"), F.col("k").cast("string")), "tabs": F.col("tabs"),
    }
    return rows.select(F.col("k").alias(key), *(F.when(ok, c).alias(n) for n, c in record.items()), F.when(~ok, F.lit("STUDY_NOT_FOUND")).alias("error"))


def file_cards(tree: DataFrame, container: str, base: str, key: str = "page_id") -> DataFrame:
    """key, ord, document_url, title, kind, version, document_date, published_date of the PDF files that a page offers.

    A file is a link inside an element one of whose classes holds the container's name; its card is the nearest element around
    it of class bcl-file, or else of class field__item, and without a card it is none. The container's class says whether the
    file is an update. An address that occurs twice has the place of its first link and the record of its last.
    """
    def numbered(e: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), e["tag"].alias("tag"), e["classes"].alias("classes"), e["href"].alias("href"), e["inner"].alias("inner"), e["first"].alias("first"), e["last"].alias("last"))

    def of(*classes: str) -> Column:
        return F.filter("e", lambda x: F.arrays_overlap(x["classes"], F.array(*map(F.lit, classes))))

    def within(outer: Column, x: Column) -> Column:
        return (x["i"] > outer["i"]) & (x["i"] < outer["inner"])

    def around(link: Column, cards: Column) -> Column:
        return F.try_element_at(F.filter(cards, lambda c: within(c, link)), F.lit(-1))

    def text_in(card: Column, marked: Column) -> Column:
        return once(F.get(F.filter(marked, lambda x: within(card, x)), F.lit(0)), text_of)

    # small arrays of one row are compared with each other, so that no tree is copied for each of its links
    boxed = F.filter("e", lambda x: F.array_join(x["classes"], " ").contains(container))
    every = tree.select(key, "strings", F.transform("elements", numbered).alias("e"))
    parts = {"boxes": F.transform(boxed, lambda b: F.struct(b["i"].alias("i"), b["inner"].alias("inner"), F.array_join(b["classes"], " ").contains("-upd").alias("updated"))), "links": F.filter("e", lambda x: (x["tag"] == "a") & x["href"].isNotNull()), "files": of("bcl-file"), "items": of("field__item"), "titles": of("file-title"), "metadata": of("file-metadata")}

    def files(of: Column) -> Column:
        def link(b: Column, n: Column, a: Column) -> Column:
            return F.struct(n.alias("box"), b["updated"].alias("updated"), a["i"].alias("i"), a["href"].alias("href"), F.coalesce(around(a, of["files"]), around(a, of["items"])).alias("card"))

        found = F.flatten(F.transform(of["boxes"], lambda b, n: F.transform(F.filter(of["links"], lambda a: within(b, a)), lambda a: link(b, n, a))))
        return F.transform(F.filter(found, lambda x: x["card"].isNotNull()), lambda x: F.struct(*(x[n].alias(n) for n in ("box", "updated", "i", "href")), *(text_in(x["card"], of[n]).alias(m) for n, m in (("titles", "title"), ("metadata", "metadata")))))

    # what the lambdas read is bound once for a page: a column that they named would be put into them and computed for every link
    told = once(F.struct(*(c.alias(n) for n, c in parts.items())), files)
    links = every.select(key, F.explode(told).alias("x")).select(key, "x.*").withColumn("document_url", resolved(base, F.col("href")))
    links = links.withColumn("_url", F.coalesce(F.try_url_decode(F.replace("document_url", F.lit("+"), F.lit("%2B"))), "document_url")).where(F.lower(F.element_at(F.split("_url", r"\?"), 1)).endswith(".pdf"))
    # records are made of a page's last link to an address only, and both groupings are by the page first, so links move once
    links = links.repartition(key).groupBy(key, "document_url").agg(F.min(F.struct("box", "i")).alias("_at"), F.max_by(F.struct("updated", "title", "metadata", "_url"), F.struct("box", "i")).alias("x")).select(key, "document_url", "_at", "x.*")
    told = links.withColumn("title", F.coalesce("title", F.element_at(F.split("_url", "/"), -1))).select(
        key, "document_url", "_at", "title", F.when(F.col("updated"), "updated").otherwise("initial").alias("kind"),
        F.nullif(F.regexp_extract("title", r"(?i)(?:\bversion\s*|\bv|_v)(\d+(?:\.\d+)*)", 1), F.lit("")).alias("version"), T.parse_date(F.col("title")).alias("document_date"), T.parse_date(F.col("metadata")).alias("published_date"),
    )
    return told.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_at")).alias("ord"), "document_url", "title", "kind", "version", "document_date", "published_date")
