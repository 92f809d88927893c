"""Records from landed HTML pages.

One ``mapInPandas`` pass reads each page once and returns what every selector
finds; which of the findings counts is decided by column expressions, so no
shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import canonical_schema
from recordloom.functions.text import strip
from recordloom.sinks.snapshots import cut
from recordloom.sources.selectors import (
    DETAIL_SELECTORS,
    PAGE_COUNTY,
    PAGE_SOURCE,
    RESULT_ROWS,
    RESULT_TABLES,
    compile_selector,
)


def _reader(asks: list[tuple], link: list):
    """The function that reads batches of pages; nested in one piece, so that it
    travels with the task."""
    from html.parser import HTMLParser

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    # Elements that end when one of their kind begins, and what they do not end across.
    closes = {
        "li": ({"li"}, {"ul", "ol", "table"}),
        "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}),
    }
    ends_p = {"article", "aside", "div", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "nav"}
    ends_p |= {"ol", "p", "section", "table", "ul"}

    class Page(HTMLParser):
        def __init__(self, html: str):
            super().__init__(convert_charrefs=True)
            self.nodes, self.open, self.roots = [], [], []
            self.feed(html or "")
            self.close()

        def shut(self, tags: set, barrier: set) -> None:
            for depth in range(len(self.open) - 1, -1, -1):
                tag = self.nodes[self.open[depth]]["tag"]
                if tag in tags:
                    del self.open[depth:]
                    return
                if tag in barrier:
                    return

        def handle_starttag(self, tag, attrs):
            if tag in closes:
                self.shut(*closes[tag])
            if tag in ends_p:
                self.shut({"p"}, {"table", "td", "th", "button"})
            parent = self.open[-1] if self.open else None
            (self.roots if parent is None else self.nodes[parent]["kids"]).append(len(self.nodes))
            self.nodes.append(
                {"tag": tag, "attrs": dict(attrs), "parent": parent, "kids": [], "text": [], "own": []}
            )
            if tag not in void:
                self.open.append(len(self.nodes) - 1)

        def handle_endtag(self, tag):
            self.shut({tag}, {"table"} if tag in ("p", "li") else set())

        def handle_data(self, data):
            if self.open and self.nodes[self.open[-1]]["tag"] not in ("script", "style"):
                self.nodes[self.open[-1]]["own"].append(data)
                for n in self.open:
                    self.nodes[n]["text"].append(data)

        def text(self, n: int) -> str:
            return " ".join("".join(self.nodes[n]["text"]).split())

        def fits(self, n: int, test: dict) -> bool:
            node = self.nodes[n]
            attrs, words = node["attrs"], (node["attrs"].get("class") or "").split()
            return (
                test.get("tag", node["tag"]) == node["tag"]
                and ("id" not in test or attrs.get("id") == test["id"])
                and all(c in words for c in test.get("classes", ()))
                and ("attr" not in test or test["attr"] in attrs)
                and test.get("class_part", "") in (attrs.get("class") or "")
                and ("contains" not in test or test["contains"] in self.text(n))
                and ("own" not in test or test["own"] in "".join(node["own"]))
                and ("child" not in test or self.has_child(n, *test["child"]))
            )

        def children(self, n) -> list[int]:
            return self.roots if n is None else self.nodes[n]["kids"]

        def has_child(self, n: int, tag: str, own: str) -> bool:
            kids = (self.nodes[k] for k in self.children(n))
            return any(k["tag"] == tag and own in "".join(k["own"]) for k in kids)

        def inside(self, n: int, top: int) -> bool:
            while (n := self.nodes[n]["parent"]) is not None:
                if n == top:
                    return True
            return False

        def related(self, start: int | None, relation: str, test: dict) -> list[int]:
            if relation == " ":
                pool = [n for n in range(len(self.nodes)) if start is None or self.inside(n, start)]
            elif relation == ">":
                pool = [n for n in self.children(start) if self.fits(n, test)]
                return pool[test["nth"] - 1 : test["nth"]]
            else:
                after = [n for n in self.children(self.nodes[start]["parent"]) if n > start]
                pool = after[:1] if relation == "+" else after
            return [n for n in pool if self.fits(n, test)]

        def all(self, steps: list, start: int | None = None) -> list[int]:
            found = [start]
            for relation, test in steps:
                found = sorted({m for n in found for m in self.related(n, relation, test)})
            return found

        def first(self, steps: list, start: int | None = None) -> int | None:
            found = self.all(steps, start)
            return found[0] if found else None

    def value(page, node, mode, attr):
        if node is None:
            return None
        return page.text(node) if mode == "text" else page.nodes[node]["attrs"].get(attr) or ""

    def answer(page, mode, selectors, attr):
        if mode == "rows":
            return [value(page, page.first(link, row), mode, attr) for row in page.all(selectors[0])]
        return [value(page, page.first(s), mode, attr) for s in selectors]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {name: [] for name, *_ in asks}
            for html in batch["html"]:
                page = Page(html)
                for name, mode, selectors, attr in asks:
                    found[name].append(answer(page, mode, selectors, attr))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], **found})

    return read


def find(
    pages: DataFrame,
    texts: dict[str, list[str]] | None = None,
    attributes: dict[str, tuple[list[str], str]] | None = None,
    row_links: dict[str, str] | None = None,
) -> DataFrame:
    """``page_id``, ``url`` and one array column per request.

    ``texts`` and ``attributes`` (selectors, attribute name) give one element
    per selector: the text or attribute of its first element, null if there is
    none. ``row_links`` gives, for each element that the row selector finds, the
    target of its first link, null if it has none.
    """
    asks = [(name, "text", [compile_selector(s) for s in sels], None) for name, sels in (texts or {}).items()]
    asks += [(n, "attr", [compile_selector(s) for s in sels], a) for n, (sels, a) in (attributes or {}).items()]
    asks += [(n, "rows", [compile_selector(s)], "href") for n, s in (row_links or {}).items()]
    id_type = pages.schema["page_id"].dataType
    schema = T.StructType(
        [T.StructField("page_id", id_type), T.StructField("url", T.StringType())]
        + [T.StructField(name, T.ArrayType(T.StringType())) for name, *_ in asks]
    )
    read = _reader(asks, compile_selector("a[href]"))
    return pages.select("page_id", "url", "html").mapInPandas(read, schema)


def first_filled(found: Column, default: str = "") -> Column:
    """The first finding that is not blank, trimmed; else the default."""
    trimmed = F.transform(found, strip)
    return F.coalesce(F.get(F.filter(trimmed, lambda t: t != ""), F.lit(0)), F.lit(default))


def extract_texts(pages: DataFrame, selectors: dict[str, list[str]], default: str = "") -> DataFrame:
    """One text column per field: the first selector that finds text decides."""
    found = find(pages, texts=selectors)
    return found.select("page_id", "url", *[first_filled(F.col(f), default).alias(f) for f in selectors])


def extract_attributes(
    pages: DataFrame, selectors: dict[str, tuple[list[str], str]], default: str = ""
) -> DataFrame:
    """The same for attributes, given as (selectors, attribute name)."""
    found = find(pages, attributes=selectors)
    return found.select("page_id", "url", *[first_filled(F.col(f), default).alias(f) for f in selectors])


def element_exists(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """One boolean per selector: whether the page has such an element."""
    found = find(pages, texts={k: [s] for k, s in selectors.items()})
    return found.select("page_id", "url", *[F.get(F.col(k), F.lit(0)).isNotNull().alias(k) for k in selectors])


def page_records(
    pages: DataFrame,
    selectors: dict[str, list[str]] = DETAIL_SELECTORS,
    source: str = PAGE_SOURCE,
    county: str = PAGE_COUNTY,
    extracted_at: Column | None = None,
) -> DataFrame:
    """Canonical records; pages with neither owner name nor parcel id give none."""
    stamp = extracted_at if extracted_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    got = extract_texts(pages, selectors)
    const = {
        "county": F.lit(county),
        "source": F.lit(source),
        "source_url": F.col("url"),
        "extracted_at": stamp,
    }
    columns = [
        const.get(f, F.col(f) if f in selectors else F.lit("")).alias(f) for f in canonical_schema().names
    ]
    return got.select("page_id", *columns).filter("owner_name <> '' or parcel_id <> ''")


def absolute_url(href: Column, base_url: Column) -> Column:
    """``http…`` stays; else the base up to its last slash, a slash, and the
    target without leading slashes."""
    folder = F.regexp_replace(base_url, "/[^/]*$", "")
    return F.when(href.startswith("http"), href).otherwise(
        F.concat(folder, F.lit("/"), F.regexp_replace(href, "^/+", ""))
    )


def page_links(
    pages: DataFrame,
    base_url: str | None = None,
    rows: str = RESULT_ROWS,
    max_links: int | None = None,
    tables: list[str] = RESULT_TABLES,
) -> DataFrame:
    """(page_id, url, pos, link): the first link of each of the first
    ``max_links`` result rows, made absolute against ``base_url`` (by default
    the page's own url). A page without a result table has none."""
    found = find(pages, texts={"_table": tables} if tables else None, row_links={"_links": rows})
    if tables:
        found = found.filter(F.exists("_table", lambda t: t.isNotNull()))
    each = found.select("page_id", "url", F.posexplode("_links").alias("pos", "_href"))
    if max_links is not None:
        each = each.filter(F.col("pos") < max_links)
    base = F.lit(base_url) if base_url is not None else F.col("url")
    return each.filter("_href <> ''").select(
        "page_id", "url", "pos", absolute_url(F.col("_href"), base).alias("link")
    )


def crawl_records(
    listing: DataFrame,
    pages: DataFrame,
    max_records: int,
    base_url: str | None = None,
    selectors: dict[str, list[str]] = DETAIL_SELECTORS,
    links_per_listing: int | None = None,
    **link_options,
) -> DataFrame:
    """Records of the pages that the listings link to, in link order, at most
    ``max_records``; when no listing has a link, they are read as records.

    Links meet the landed pages by url. ``link_options`` go to ``page_links``.
    """
    links = page_links(listing, base_url, max_links=links_per_listing or max_records, **link_options)
    ordered = links.select(F.struct(F.col("page_id").alias("listing"), "pos").alias("_at"), "link")
    linked = ordered.join(page_records(pages, selectors), F.col("link") == F.col("source_url")).drop("link")
    has_links = links.agg(F.count("*") > 0).scalar()
    at = F.struct(F.col("page_id").alias("listing"), F.lit(0).alias("pos")).alias("_at")
    direct = page_records(listing, selectors).filter(~has_links).select(at, "*")
    return linked.unionByName(direct).orderBy("_at", "page_id").limit(max_records).drop("_at")


def crawl_all(
    listing: DataFrame,
    pages: DataFrame,
    selectors: dict[str, list[str]] = DETAIL_SELECTORS,
    base_url: str | None = None,
    rows: str = RESULT_ROWS,
    tables: list[str] = RESULT_TABLES,
    source: str = PAGE_SOURCE,
    county: str = PAGE_COUNTY,
    extracted_at: Column | None = None,
) -> DataFrame:
    """Records of all pages that any listing links to: listing, pos, page_id and the canonical fields.

    Listings and pages are read together, once, for links, result table and fields; what was
    found is written down, and the rest is a join of two small tables by url. A link that
    nothing was landed for gives no record, and a page that is linked twice gives two. When
    no listing has a link, the listings are read as records.
    """
    id_type = pages.schema["page_id"].dataType

    def marked(df: DataFrame, mark: str) -> DataFrame:
        return df.select(F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("page_id"), "url", "html")

    texts = dict(selectors) | ({"_table": tables} if tables else {})
    found = cut(find(marked(listing, "l").unionByName(marked(pages, "p")), texts=texts, row_links={"_links": rows}), "crawled")
    found = found.withColumns({"_lists": F.col("page_id").startswith("l"), "page_id": F.expr("substr(page_id, 2)").cast(id_type)})
    stamp = extracted_at if extracted_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    const = {"county": F.lit(county), "source": F.lit(source), "source_url": F.col("url"), "extracted_at": stamp}
    fields = {f: const.get(f, first_filled(F.col(f)) if f in selectors else F.lit("")) for f in canonical_schema().names}
    records = found.select("_lists", "page_id", *[c.alias(f) for f, c in fields.items()]).filter("owner_name <> '' or parcel_id <> ''")

    lists = found.filter("_lists")
    lists = lists.filter(F.exists("_table", lambda t: t.isNotNull())) if tables else lists
    base = F.lit(base_url) if base_url is not None else F.col("url")
    links = lists.select(F.col("page_id").alias("listing"), "url", F.posexplode("_links").alias("pos", "_href")).filter("_href <> ''")
    links = links.select("listing", "pos", absolute_url(F.col("_href"), base).alias("link"))
    if links.isEmpty():
        return records.filter("_lists").select(F.col("page_id").alias("listing"), F.lit(0).alias("pos"), *records.columns).drop("_lists")
    landed = records.filter("not _lists").drop("_lists")
    return links.join(landed, F.col("link") == F.col("source_url")).drop("link")
