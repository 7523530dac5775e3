"""Landed pages: one parse per page, then columns; enrichment of postings from their links."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import SOURCE_B
from ..functions import html as H
from ..functions import text as tx
from ..util import col, contains_any, empty_to_null, first_per_key, spread, strip

# An element: its ancestors from the outside in, its classes, and the places of its texts among the page's (``kept``: of those outside boilerplate below it).
ELEMENT = "node int, parent int, tag string, attrs map<string,string>, up array<int>, up_tags array<string>, names array<string>, at array<int>, kept array<int>"
# fixed values: elements whose text is no content, and table labels with another name in the schema
SILENT = ("script", "style", "template")
BOILERPLATE = ("script", "style", "noscript", "nav", "footer", "header")
TABLE_LABELS = {"closes": "closing_date", "advert_id": "job_ref"}
ENRICH_MARK = "--- [added from posting page] ---"
# fixed values: section titles worth keeping, and hosts of the two portals
SECTION_TITLES = (r"(?i)(RESPONSIBILIT|REQUIREMENT|SKILL|QUALIFICATION|EXPERIENCE|ABOUT\s+THE\s+ROLE|PERSON\s+SPECIFICATION|"
                  r"ESSENTIAL|DESIRABLE|EDUCATION|COMPETENC)")
PORTAL_A_HOSTS = ("jobs.ac.uk",)
PORTAL_B_HOSTS = ("adzuna.co.uk", "adzuna.com")


def page_elements(pages: DataFrame) -> DataFrame:
    """Pages with ``el``, their elements in page order (see ``ELEMENT``), and ``pieces``, their texts, which elements name by place.

    Each page is parsed once, where its rows are: only the pages themselves are shuffled, so that rows of one ``page_id`` meet. Their nodes count together;
    a page without an id says nothing.
    """
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("el", T.ArrayType(T.StructType.fromDDL(ELEMENT)))])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                yield from batch.slice(k, 64).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for page, same in groupby(rows(batches), key=lambda r: r["page_id"]):
            if page is None:
                out += [{**r, "pieces": [], "el": []} for r in same]
            else:
                same = list(same)
                pieces, el = H.elements([r["html"] for r in same], SILENT, BOILERPLATE)
                out += [{**r, "pieces": pieces, "el": el} for r in same]
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)
    # Pages without an id are spread.
    placed = spread(pages, F.coalesce("page_id", F.xxhash64(*names))).sortWithinPartitions("page_id")
    return placed.mapInArrow(run, schema)


def _text(e: Column, sep: str = "", kept: bool = False) -> Column:
    """Text of an element: its pieces side by side; ``kept``: without those that stand in boilerplate below it."""
    return F.array_join(F.transform(e["kept" if kept else "at"], lambda i: F.get("pieces", i)), sep)


def _where(test: Callable[[Column], Column], of: str | Column = "el") -> Column:
    return F.filter(of, test)


def _first(test: Callable[[Column], Column], value: Callable[[Column], Column] = _text) -> Column:
    """Value of the first such element on the page; empty text counts as none."""
    return _let(_let(F.get(_where(test), F.lit(0)), lambda e: value(e)), lambda v: empty_to_null(v))


def _tag(*tags: str) -> Callable[[Column], Column]:
    return lambda e: e["tag"].isin(*tags)


def _inside(e: Column, tags: Sequence[str]) -> Column:
    return F.arrays_overlap(e["up_tags"], F.array(*map(F.lit, tags)))


def _named(e: Column, name: str) -> Column:
    return F.array_contains(e["names"], name)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(rows: Column) -> Column:
    """Map of (k, v) structs; of one key the last, at its own place."""
    last = lambda r: F.filter(r, lambda e, i: ~F.exists(F.slice(r, i + 2, F.greatest(F.size(r), F.lit(1))), lambda f: f["k"] == e["k"]))
    return _let(rows, lambda r: F.map_from_entries(last(r)))


def _sections(openers: Column, stops: Column, body: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    """(k, v) of each opener (node, parent, title): the ``body`` elements up to the next stop (node, parent) among the same parent's children."""
    def one(o: Column) -> Column:
        behind = lambda e: e["parent"].eqNullSafe(o["parent"]) & (e["node"] > o["node"])
        under = lambda end: F.filter("el", lambda e: behind(e) & (end.isNull() | (e["node"] < end)) & body(e))
        end = F.array_min(F.transform(F.filter(stops, behind), lambda s: s["node"]))
        return F.struct(o["title"].alias("k"), _let(end, lambda n: F.transform(under(n), text)).alias("b"))
    found = F.filter(F.transform(openers, one), lambda s: F.size(s["b"]) > 0)
    return F.transform(found, lambda s: F.struct(s["k"].alias("k"), F.array_join(s["b"], "\n").alias("v")))


def _lists(tag: str) -> Column:
    """Items grouped by the list they stand in, lists in page order."""
    def items(head: Column) -> Column:
        same = F.size(_where(lambda e: _tag(tag)(e) & (e["node"] == head)))  # rows of one page_id count together
        return F.flatten(F.transform(_where(lambda e: _tag("li")(e) & (e["parent"] == head) & (_text(e) != "")), lambda e: F.array_repeat(_text(e), same)))
    heads = F.array_distinct(F.transform(_where(_tag(tag)), lambda e: e["node"]))
    return F.filter(F.transform(heads, items), lambda x: F.size(x) > 0)


def _table() -> Column:
    """(k, v) of each row inside a table: its first heading and its first data cell."""
    row = lambda e: F.array_max(F.transform(F.filter(F.arrays_zip(e["up"], e["up_tags"]), lambda x: x["up_tags"] == "tr"), lambda x: x["up"]))
    cells = F.transform(_where(lambda e: _tag("th", "td")(e) & _inside(e, ("table",))), lambda e: F.struct(row(e).alias("row"), e["tag"].alias("tag"), _text(e).alias("text")))

    def rows(cells: Column) -> Column:
        first = lambda r, t: F.get(F.filter(cells, lambda c: (c["row"] == r) & (c["tag"] == t)), F.lit(0))["text"]
        ids = F.array_sort(F.array_distinct(F.transform(F.filter(cells, lambda c: c["row"].isNotNull()), lambda c: c["row"])))
        return F.filter(F.transform(ids, lambda r: F.struct(first(r, "th").alias("th"), first(r, "td").alias("td"))), lambda x: (x["th"] != "") & (x["td"] != ""))
    return F.transform(_let(cells, rows), lambda x: F.struct(F.replace(F.lower(strip(F.replace(x["th"], F.lit(":"), F.lit("")))), F.lit(" "), F.lit("_")).alias("k"), x["td"].alias("v")))


def _place(e: Column, title: Column) -> Column:
    return F.struct(e["node"].alias("node"), e["parent"].alias("parent"), title.alias("title"))


def _upper_sections() -> Column:
    """An upper-case marker names what follows its parent, up to the next element that holds a marker."""
    marks = F.filter(F.transform(_where(_tag("strong")), lambda e: F.struct(e["parent"].alias("parent"), e["up"].alias("up"), _text(e).alias("text"))),
                     lambda m: (F.upper(m["text"]) == m["text"]) & (F.lower(m["text"]) != m["text"]))

    def cut(marks: Column, holding: Column) -> Column:
        title = lambda e: F.get(F.reverse(F.filter(marks, lambda m: (m["parent"] == e["node"]) & (F.char_length(m["text"]) >= 5))), F.lit(0))["text"]
        holders = F.array_distinct(F.transform(_where(lambda e: F.array_contains(holding, e["node"]) & e["parent"].isNotNull()), lambda e: _place(e, title(e))))
        body = lambda e: e["parent"].isNotNull() & ~F.array_contains(holding, e["node"]) & (F.char_length(_text(e)) > 10)
        return _let(holders, lambda h: _sections(F.filter(h, lambda x: x["title"].isNotNull()), h, body, lambda e: _text(e)))
    return _let(marks, lambda m: _let(F.array_distinct(F.flatten(F.transform(m, lambda x: x["up"]))), lambda h: cut(m, h)))


def _heading_sections() -> Column:
    """A heading names what follows itself, up to the next heading."""
    own = lambda e: _text(e, " ")
    content = lambda e: _text(e, "\n", True)
    heads = _where(lambda e: _tag("h2", "h3")(e) & ~_inside(e, BOILERPLATE) & (own(e) != "") & (F.char_length(own(e)) <= 220))
    stops = F.transform(_where(_tag("h1", "h2", "h3")), lambda e: _place(e, F.lit("")))
    body = lambda e: ~_tag("h1", "h2", "h3", *BOILERPLATE)(e) & (F.char_length(content(e)) > 15)
    return _let(stops, lambda s: _sections(F.array_distinct(F.transform(heads, lambda e: _place(e, own(e)))), s, body, content))


def _chips() -> Column:
    """Values of pressed category buttons by the kind that the label paragraph before them says."""
    kind = lambda e: F.when(_text(e, " ").rlike(r"(?i)Type\s*/\s*Role"), "job_type").when(_text(e, " ").rlike(r"(?i)Subject\s*Area\(s\)"), "subcategory")
    said = F.reverse(F.filter(F.transform(_where(_tag("p")), lambda e: F.struct(e["node"].alias("node"), kind(e).alias("of"))), lambda x: x["of"].isNotNull()))
    buttons = _where(lambda e: _tag("input")(e) & (e["attrs"]["type"] == "button") & _named(e, "j-form-input__disabled-cat") & (strip(e["attrs"]["value"]) != ""))
    chips = _let(said, lambda s: F.transform(buttons, lambda b: F.struct(F.get(F.filter(s, lambda x: x["node"] < b["node"]), F.lit(0))["of"].alias("k"), strip(b["attrs"]["value"]).alias("v"))))
    of = lambda c, k: F.array_join(F.array_distinct(F.transform(F.filter(c, lambda x: x["k"] == k), lambda x: x["v"])), ", ")
    return _let(chips, lambda c: F.map_filter(F.create_map(F.lit("job_type"), of(c, "job_type"), F.lit("subcategory"), of(c, "subcategory")), lambda k, v: v != ""))


def _container(rank: Callable[[Column], Column]) -> Column:
    """Text of the first container of the surest kind."""
    live = _where(lambda e: ~_tag(*BOILERPLATE)(e) & ~_inside(e, BOILERPLATE) & rank(e).isNotNull())
    best = F.array_min(F.transform(live, lambda e: F.struct(rank(e).alias("rank"), e["node"].alias("node"), e["kept"].alias("kept"))))
    return _let(_let(best, lambda e: _text(e, "\n", True)), lambda v: empty_to_null(v))


def parse_pages(pages: DataFrame, resolve_links: bool = False) -> DataFrame:
    """Add to every page (page_id, url, html) what it says: titles, tags, tables, sections, lists, links, texts.

    Everything is an expression over the page's own elements, computed only where it is asked for.
    """
    attr = lambda n: (lambda e: e["attrs"][n])
    df = page_elements(pages.select("page_id", "url", "html"))
    og = _where(lambda e: _tag("meta")(e) & e["attrs"]["property"].startswith("og:") & (F.char_length(e["attrs"]["property"]) > 3) & (e["attrs"]["content"] != ""))
    og = F.transform(og, lambda e: F.struct(F.substring(e["attrs"]["property"], 4, 1 << 20).alias("k"), e["attrs"]["content"].alias("v")))
    # Containers by how surely they hold the text.
    box = lambda e: (F.when(e["attrs"]["data-testid"] == "job-description", 0).when(e["attrs"]["data-testid"] == "description", 1)
                     .when(_tag("div")(e) & F.exists(e["names"], lambda c: c.rlike("(?i)job-description|JobDescription")), 2).when(e["attrs"]["id"] == "job-description", 3).when(_named(e, "job-description"), 4))
    main = lambda e: F.when(_tag("main")(e), 0).when(_tag("article")(e), 1).when(e["attrs"]["id"] == "content", 2).when(_named(e, "content"), 3).when(_tag("body")(e), 4)
    renames = F.create_map(*(F.lit(x) for pair in TABLE_LABELS.items() for x in pair))
    other = lambda k: F.try_element_at(renames, k)
    tables = _let(_map(_table()), lambda m: F.transform_keys(m, lambda k, v: F.when(~F.map_contains_key(m, F.coalesce(other(k), F.lit(""))), F.coalesce(other(k), k)).otherwise(k)))
    paragraph = lambda e: _tag("p")(e) & ~_inside(e, ("script", "style", "nav", "footer", "header")) & (F.char_length(_text(e)) >= 20)
    target = (lambda e: resolve("url", e["attrs"]["href"])) if resolve_links else attr("href")
    links = F.transform(_where(lambda e: _tag("a")(e) & F.map_contains_key(e["attrs"], "href")), lambda e: F.struct(target(e).alias("url"), _text(e).alias("text"), F.coalesce(e["attrs"]["title"], F.lit("")).alias("title")))
    reference = lambda e: _tag("input")(e) & (e["attrs"]["type"] == "hidden") & (e["attrs"]["name"] == "job_ref")
    return df.select(
        "page_id", "url", "html", _first(_tag("title")).alias("title"), _first(lambda e: _tag("meta")(e) & (e["attrs"]["name"] == "description"), attr("content")).alias("meta_description"),
        _map(og).alias("og"), tables.alias("tables"), _map(_upper_sections()).alias("upper_sections"), _map(_heading_sections()).alias("heading_sections"),
        F.transform(_where(paragraph), lambda e: _text(e)).alias("paragraphs"), _lists("ul").alias("ul"), _lists("ol").alias("ol"), links.alias("links"),
        F.coalesce(_container(main), F.lit("")).alias("main_text"), _let(_container(box), lambda t: F.when(F.char_length(t) > 80, t)).alias("description_box"),
        _first(_tag("h1")).alias("h1"), _first(lambda e: _tag("p")(e) & _named(e, "lead")).alias("lead"),
        F.coalesce(_first(lambda e: _named(e, "j-advert__employer")), _first(lambda e: _named(e, "j-advert_employer"))).alias("employer_item"),
        _first(reference, attr("value")).alias("job_ref_input"), _first(lambda e: _tag("a")(e) & (e["attrs"]["id"] == "apply-link"), attr("href")).alias("apply_link"), _chips().alias("chips"))


def resolve(base: str | Column, link: Column) -> Column:
    """An absolute URL for a link on the page ``base``."""
    b = col(base)
    scheme, root = F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(b, "^([^?#]*)", 1)
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    joined = F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).when(
        link == "", b).when(link.startswith("?"), F.concat(bare, link)).when(link.startswith("#"), F.concat(F.regexp_extract(b, "^([^#]*)", 1), link)).otherwise(F.concat(folder, F.regexp_replace(link, r"^(\./)+", "")))
    up = joined
    for _ in range(4):  # one step up for each ``../``
        up = F.regexp_replace(up, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^/?#]+)*?)/(?!\.\./)[^/?#]+/\.\./", "$1/")
    return F.when(b.isNull() | (root == ""), link).otherwise(up)


def script_variable(html: str | Column, name: str) -> Column:
    return empty_to_null(F.regexp_extract(col(html), rf"var\s+{name}\s*=\s*[\"']([^\"']*)[\"']", 1))


def embedded_job(html: str | Column) -> Column:
    """JSON text of ``var job = {...};`` (its inner ``job`` object when there is one)."""
    raw = empty_to_null(F.regexp_extract(col(html), r"(?s)var\s+job\s*=\s*(\{.*?\})\s*;", 1))
    return F.coalesce(F.get_json_object(raw, "$.job"), F.when(F.get_json_object(raw, "$").isNotNull(), raw))


def json_ld(html: str | Column) -> Column:
    """JSON text of the first JobPosting block."""
    blocks = F.regexp_extract_all(col(html), F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.get(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"), F.lit(0))


def _json(c: str, path: str) -> Column:
    return empty_to_null(F.get_json_object(c, path))


def _embedded_salary() -> Column:
    sym = F.coalesce(F.get_json_object("_js", "$.salary_currency_symbol"), F.lit("£"))
    lo, hi, note = _json("_js", "$.salary_min"), _json("_js", "$.salary_max"), F.get_json_object("_js", "$.salary_comment")
    lo = F.when(lo != "0", lo)
    text = F.concat_ws(" ", F.concat(sym, lo), F.when((hi != lo) & (hi != "0"), F.concat(F.lit("to "), sym, hi)), empty_to_null(note))
    return F.when(lo.isNotNull(), text).otherwise(empty_to_null(strip(note)))


def _ld_salary() -> Column:
    sym = F.when(F.upper(F.get_json_object("_ld", "$.baseSalary.currency")) == "GBP", "£").otherwise("$")
    lo = F.get_json_object("_ld", "$.baseSalary.value.minValue").try_cast("double")
    hi = F.get_json_object("_ld", "$.baseSalary.value.maxValue").try_cast("double")
    whole = lambda x: F.concat(sym, F.format_number(x.try_cast("bigint").cast("double"), 0))
    return F.when(lo.isNotNull(), F.when(hi.isNotNull() & (hi != lo), F.concat(whole(lo), F.lit(" to "), whole(hi))).otherwise(whole(lo)))


def posting_record(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Posting fields of a portal page: embedded JSON first, then JSON-LD, then the page itself; ``keep``: further columns."""
    df = parsed.withColumn("_js", embedded_job("html")).withColumn("_ld", json_ld("html"))
    types = F.from_json(F.get_json_object("_js", "$.job_types"), "array<struct<category_name:string>>")
    areas = F.map_values(F.from_json(F.get_json_object("_js", "$.subject_areas"), "map<string,struct<category_name:string>>"))
    names = lambda a: empty_to_null(F.array_join(F.filter(F.transform(a, lambda x: x["category_name"]), lambda x: F.coalesce(x != "", F.lit(False))), ", "))
    kinds = tx.split_list(F.get_json_object("_ld", "$.employmentType"), ",")
    t, up = F.col("tables"), F.col("upper_sections")
    sep = F.when(F.col("lead").contains("–"), "–").otherwise("-")
    lead_parts = F.split("lead", F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), 2)
    lead_ok = F.col("lead").contains(sep)
    item = F.split("employer_item", r"\s*[–-]\s*", 2)
    has_json_employer = F.coalesce(_json("_js", "$.employer_name"), _json("_ld", "$.hiringOrganization.name"))
    lead_employer = F.when(has_json_employer.isNull() & lead_ok, empty_to_null(strip(lead_parts[0])))
    item_on = has_json_employer.isNull() & lead_employer.isNull()

    def tab(k):
        return F.try_element_at(t, F.lit(k))

    def sec(k):
        return F.try_element_at(up, F.lit(k))
    quals = F.array_join(F.map_values(F.map_filter(up, lambda k, v: contains_any(k, ("QUALIFICATION", "EXPERIENCE", "REQUIREMENT")))), "\n\n")
    fields = {
        "title": F.coalesce(_json("_js", "$.title"), _json("_ld", "$.title"), F.col("h1"), tab("title")),
        "employer": F.coalesce(has_json_employer, lead_employer, F.when(item_on, empty_to_null(strip(item[0]))), script_variable("html", "institution_name"), tab("employer")),
        "department": F.coalesce(_json("_js", "$.department"), F.when(lead_employer.isNotNull(), strip(F.get(lead_parts, F.lit(1)))),
                                 F.when(item_on, empty_to_null(strip(F.get(item, F.lit(1))))), tab("department")),
        "location": F.coalesce(_json("_js", "$.location"), _json("_ld", "$.jobLocation.address.addressLocality"), tab("location")),
        "salary": F.coalesce(_embedded_salary(), _ld_salary(), tab("salary")),
        "hours": F.coalesce(_json("_js", "$.hours"), F.get(kinds, F.lit(0)), tab("hours")),
        "contract_type": F.coalesce(_json("_js", "$.contract"), F.get(kinds, F.lit(1)), tab("contract_type")),
        "job_type": F.coalesce(names(types), tab("job_type"), F.try_element_at("chips", F.lit("job_type"))),
        "subcategory": F.coalesce(names(areas), tab("subcategory"), F.try_element_at("chips", F.lit("subcategory"))),
        "placed_on": F.coalesce(_json("_js", "$.go_live_date"), _json("_ld", "$.datePosted"), tab("placed_on")),
        "closing_date": F.coalesce(_json("_js", "$.closing_date"), _json("_ld", "$.validThrough"), tab("closing_date")),
        "job_ref": F.coalesce(_json("_js", "$.reference"), strip("job_ref_input"), tab("job_ref")),
        "apply_url": F.coalesce(_json("_js", "$.apply_url"), tab("apply_url"), F.col("apply_link")),
        "full_description": F.coalesce(empty_to_null(F.array_join("paragraphs", "\n\n")), tab("full_description")),
        "responsibilities": F.coalesce(tab("responsibilities"), sec("RESPONSIBILITIES")),
        "requirements": F.coalesce(tab("requirements"), sec("ESSENTIAL QUALIFICATIONS/EXPERIENCES"), sec("REQUIREMENTS"), empty_to_null(quals)),
    }
    cleaned = {k: F.when(v.isNotNull(), tx.clean_text(v)) for k, v in fields.items()}
    return df.select("page_id", "url", *[v.alias(k) for k, v in cleaned.items()], F.col("upper_sections").alias("sections"), *keep)


def host(url: str | Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")))


def host_class(url: str | Column) -> Column:
    h = host(url)
    ends = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: h.endswith(n))
    return F.when(ends(PORTAL_A_HOSTS), "portal_a").when(ends(PORTAL_B_HOSTS), "portal_b").otherwise("generic")


def page_fields(parsed: DataFrame) -> DataFrame:
    """Fields by host: full record for portal A, description box and sections elsewhere."""
    rec = posting_record(parsed, keep=("description_box", "main_text", "heading_sections"))
    portal = host_class("url") == "portal_a"
    return rec.select(
        "page_id", "url", host_class("url").alias("host_class"), F.when(portal, F.col("requirements")).alias("requirements"),
        F.when(portal, F.col("responsibilities")).alias("responsibilities"),
        F.when(portal, F.col("full_description")).otherwise(F.coalesce("description_box", "main_text")).alias("full_description"),
        F.when(portal, F.col("sections")).otherwise(F.col("heading_sections")).alias("sections"))


def supplement(df: DataFrame) -> Column:
    """Requirement-related text of a page without repeats."""
    kept = F.transform(F.filter(F.map_entries("sections"), lambda e: (strip(e["value"]) != "") & e["key"].rlike(SECTION_TITLES)),
                       lambda e: F.concat(F.lit("["), strip(e["key"]), F.lit("]\n"), strip(e["value"])))
    own = F.array(*[strip(c) for c in ("requirements", "responsibilities", "full_description")])
    chunks = F.filter(F.concat(own, F.coalesce(kept, F.array().cast("array<string>"))), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_join(F.array_distinct(chunks), "\n\n")


def candidate_links(postings: DataFrame) -> DataFrame:
    """Links of a posting in the order they are tried, without repeats."""
    order = F.when(F.lower(strip("source")) == SOURCE_B, F.array("redirect_url", "apply_url", "url")).otherwise(F.array("url"))
    urls = F.array_distinct(F.filter(F.transform(order, strip), lambda u: F.coalesce(u.startswith("http"), F.lit(False))))
    return postings.select("job_id", F.posexplode(urls).alias("pos", "url"))


def needs_enrichment(mark: str = ENRICH_MARK) -> Column:
    has_link = F.lit(False)
    for c in ("url", "redirect_url", "apply_url"):
        has_link = has_link | F.coalesce(F.trim(c) != "", F.lit(False))
    return has_link & tx.requirements_empty("requirements") & (F.coalesce(F.locate(mark, F.col("full_description")), F.lit(0)) == 0)


def enrich(postings: DataFrame, fields: DataFrame, min_chars: int = 200, mark: str = ENRICH_MARK) -> DataFrame:
    """Per posting the text of its first link with enough to add, and the outcome."""
    texts = fields.withColumn("supplement", supplement(fields)).select("url", "supplement")
    links = candidate_links(postings)
    tried = links.join(texts, "url", "left").withColumn(
        "state", F.when(F.col("supplement").isNull(), "missing").when(F.char_length("supplement") < min_chars, "too_short").otherwise("ok"))
    best = first_per_key(tried, ["job_id"], [F.col("state") != "ok", F.col("pos")]).select("job_id", "state", "supplement", F.col("url").alias("used_url"))
    base = strip(F.coalesce("full_description", F.lit("")))
    new = F.when(F.col("state") == "ok", F.when(base != "", F.concat(base, F.lit(f"\n\n{mark}\n\n"), F.col("supplement"))).otherwise(F.col("supplement")))
    return postings.join(best, "job_id", "left").withColumn("new_description", new).withColumn(
        "outcome", F.coalesce("state", F.lit("no_http_url"))).drop("state")


def outcome_report(enriched: DataFrame) -> DataFrame:
    g = enriched.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few rows of the report, so that pages are read once
    return g.withColumn("rate", F.round(F.try_divide(F.col("n").cast("double"), total), 6))


def link_table(parsed: DataFrame, pattern: str | None = None) -> DataFrame:
    rows = parsed.select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.text", "l.title")
    return rows.filter(F.col("url").rlike(pattern)) if pattern else rows
