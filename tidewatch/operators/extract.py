"""Declarative extraction: list and article scans of HTML, XML and JSON payloads.

A specification names rows and, for each field, a chain of sources with transforms. Python only finds the raw values of HTML sources, one
array of candidates for each field, in Arrow batches. Everything after that is a column expression: transforms, templates,
concatenations, the first value of a chain that isn't null, required fields and filters.

    {"row_selector": "ul > li", "row_required_selector": ..., "exclude_selector": ...,
     "fields": {"title": [{"from": "css", "selector": "a", "transform": [["collapse_ws"]]}], ...}}

Sources: css (selector, joiner, html, pick, match), attr (selector, attr), class_present (selector, class, negate), json (path), const,
template, concat. Later fields may use earlier ones, and `site` and `board`.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import dom
from tidewatch.functions.transforms import chain

STANDARD = ("post_id", "title", "url", "published_at", "author", "category", "summary", "cover_image")
IN_PYTHON = ("css", "attr", "class_present")


def _sources(spec: dict) -> dict[str, list[dict]]:
    return {name: (x if isinstance(x, list) else [x]) for name, x in spec["fields"].items()}


def check(spec: dict) -> None:
    """Refuses unknown sources, transforms and selectors as the plan is built."""
    fields = _sources(spec)
    if not {"post_id", "title"} <= set(fields):
        raise ValueError("post_id and title are required")
    seen = {"site", "board"}
    for name, sources in fields.items():
        for s in sources:
            if s["from"] not in (*IN_PYTHON, "json", "const", "template", "concat"):
                raise ValueError(f"unknown source {s['from']!r}")
            if s["from"] in IN_PYTHON and s.get("selector", "") not in dom.SELF:
                dom.compile_selector(s["selector"])
            if s["from"] == "template" and (missing := set(re.findall(r"\{(\w+)\}", s["value"])) - seen):
                raise ValueError(f"{name} uses {sorted(missing)} before they are known")
            chain(F.lit(""), s.get("transform", []))
        seen.add(name)


# --- HTML -----------------------------------------------------------------------------------------------------------------------


def _value(row: dom.Node, source: dict, compiled: list | None) -> str | None:
    found = [row] if compiled is None else dom.select(row, compiled)

    def of(node: dom.Node) -> str | None:
        if "attr" in source:
            return node.attrs.get(source["attr"])
        return node.outer() if source.get("html") or source.get("text") is False else node.text(source.get("joiner", " ")).strip()

    if source["from"] == "class_present":
        present = any(source["class"] in n.classes for n in found)
        return "true" if present != bool(source.get("negate")) else "false"
    pattern = re.compile(source["match"]) if "match" in source else None
    for node in found:
        value = of(node)
        if pattern is None or (value is not None and pattern.search(value)):
            return value
        if source.get("pick") != "first_matching":
            return None
    return None


def html_rows(pages: DataFrame, spec: dict, keys: tuple[str, ...] = ("page_id", "url"), body: str = "html") -> DataFrame:
    """keys, row_no and raw: for each field the candidates of its HTML sources (null for others), for every row that a page has."""
    check(spec)
    fields = _sources(spec)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {(n, k): dom.compile_selector(s["selector"]) for n, ss in fields.items() for k, s in enumerate(ss) if s["from"] in IN_PYTHON and s.get("selector", "") not in dom.SELF}
        rows_of, required, excluded = (dom.compile_selector(spec[c]) if spec.get(c) else None for c in ("row_selector", "row_required_selector", "exclude_selector"))
        kind = pa.list_(pa.string())
        for batch in batches:
            origin, number, values = [], [], {n: [] for n in fields}
            for k, text in enumerate(batch.column(body)):
                root = dom.parse(text.as_py() or "")
                out = {id(n) for n in dom.select(root, excluded)} if excluded else set()
                at = 0
                for row in dom.select(root, rows_of) if rows_of else [root]:
                    if id(row) in out or (required and next(dom.select(row, required), None) is None):
                        continue
                    at += 1
                    origin.append(k)
                    number.append(at)
                    for n, ss in fields.items():
                        found = []
                        for j, s in enumerate(ss):
                            try:
                                found.append(_value(row, s, compiled.get((n, j))) if s["from"] in IN_PYTHON else None)
                            except (ValueError, KeyError, re.error):  # in a chain, a source that fails is a null
                                found.append(None)
                        values[n].append(found)
            kept = batch.select(list(keys)).take(pa.array(origin, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), *(pa.array(v, kind) for v in values.values())], [*keys, "row_no", *(f"raw_{n}" for n in fields)])

    schema = T.StructType([pages.schema[c] for c in keys] + [T.StructField("row_no", T.IntegerType())] + [T.StructField(f"raw_{n}", T.ArrayType(T.StringType())) for n in fields])
    return pages.select(*keys, body).mapInArrow(scan, schema)


# --- expressions ----------------------------------------------------------------------------------------------------------------


def json_path(item: Column, path: list) -> Column:
    """A value of a JSON text by keys and indexes; negative indexes count from the end, and any miss is null."""
    for step in path:
        if isinstance(step, int) and step < 0:
            item = F.try_element_at(F.from_json(item, "array<string>"), F.lit(step))
        else:
            item = F.get_json_object(item, f"$[{step}]" if isinstance(step, int) else "$['" + str(step).replace("'", "\\'") + "']")
    return item


def _template(text: str, known: dict[str, Column]) -> Column:
    """Null where a named value is null."""
    parts = [F.lit(p) if k % 2 == 0 else known.get(p, F.lit(None).cast("string")) for k, p in enumerate(re.split(r"\{(\w+)\}", text))]
    return F.concat(*parts)


def _one(source: dict, raw: Column | None, k: int, item: Column | None, known: dict[str, Column]) -> Column:
    match source["from"]:
        case "json":
            value = json_path(item, source["path"])
        case "const":
            value = F.lit(source["value"]).cast("string")
        case "template":
            value = _template(source["value"], known)
        case "concat":
            value = F.concat(*(F.lit(p["const"]) if "const" in p else known[p["field"]] if "field" in p else _one(p, raw, k, item, known) for p in source["parts"]))
        case _:
            value = raw[k]
    return chain(value, source.get("transform", []))


def fields_of(rows: DataFrame, spec: dict, item: str | None = None, site: str = "", board: str = "") -> DataFrame:
    """The rows with a column for each field; each is the first source of its chain that isn't null."""
    known = {"site": F.lit(site), "board": F.lit(board)}
    for name, sources in _sources(spec).items():
        raw = F.col(f"raw_{name}") if f"raw_{name}" in rows.columns else None
        value = F.coalesce(*(_one(s, raw, k, F.col(item) if item else None, known) for k, s in enumerate(sources)))
        rows = rows.withColumn(name, value)
        known[name] = F.col(name)
    return rows


def posts_of(rows: DataFrame, spec: dict, keys: tuple[str, ...], page_size: int | None = None) -> DataFrame:
    """Rows with a post_id; an empty title where there is none; fields beyond the standard ones in the map `raw`."""
    names = list(_sources(spec))
    extra = [n for n in names if n not in STANDARD]
    out = rows.where(F.coalesce(F.trim("post_id"), F.lit("")) != "")
    if page_size:  # of the rows that stay
        out = out.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))).where(F.col("_place") <= page_size)
    raw = F.map_filter(F.create_map(*(x for n in extra for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    return out.select(*keys, "row_no", *(F.coalesce("title", F.lit("")).alias("title") if n == "title" else F.col(n) for n in names if n in STANDARD), raw.alias("raw"))


def scan_html(pages: DataFrame, spec: dict, site: str = "", board: str = "", page_size: int | None = None) -> DataFrame:
    """A list scan of HTML or XML pages (page_id, url, html)."""
    return posts_of(fields_of(html_rows(pages, spec), spec, site=site, board=board), spec, ("page_id", "url") if "url" not in spec["fields"] else ("page_id",), page_size)


def _succeeded(spec: dict, body: str) -> Column:
    gate = spec.get("success_when")
    return json_path(F.col(body), gate["path"]).eqNullSafe(F.lit(str(gate["equals"]))) if gate else F.lit(True)


def failed_payloads(payloads: DataFrame, spec: dict, body: str = "body") -> DataFrame:
    """The payloads that don't pass the specification's success test, with what they had instead. scan_json leaves them out, and whoever
    scans can count, keep or refuse them."""
    gate = spec.get("success_when", {"path": []})
    return payloads.where(~_succeeded(spec, body)).withColumn("found", json_path(F.col(body), gate["path"]))


def scan_json(payloads: DataFrame, spec: dict, body: str = "body", keys: tuple[str, ...] = ("page_id",), site: str = "", board: str = "", page_size: int | None = None) -> DataFrame:
    """A list scan of JSON payloads: success test, list path, values of an object as a list, item sub-path, allowed types, fields."""
    check(spec)
    rows = payloads.where(_succeeded(spec, body))
    found = json_path(F.col(body), spec.get("list_path", [])) if spec.get("list_path") else F.col(body)
    if spec.get("list_values"):
        items = F.map_values(F.from_json(found, "map<string,string>"))
    else:
        items = F.from_json(found, "array<string>")
    rows = rows.select(*keys, F.posexplode(items).alias("_k", "_item")).withColumn("row_no", (F.col("_k") + 1).cast("int"))
    if spec.get("item_subpath"):
        rows = rows.withColumn("_item", json_path(F.col("_item"), spec["item_subpath"]))
    if spec.get("type_field"):
        rows = rows.where(json_path(F.col("_item"), [spec["type_field"]]).isin(*spec["type_allow"]))
    return posts_of(fields_of(rows, spec, "_item", site, board), spec, keys, page_size)


def merged(current: Column, enriched: Column, overwrite: bool = False) -> Column:
    """re_extract (overwrite) takes the new value where there is one; enrich only where the current one is null or empty."""
    return F.coalesce(enriched, current) if overwrite else F.coalesce(F.nullif(current, F.lit("")), enriched)


def with_articles(posts: DataFrame, articles: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Posts with what their article pages add (joined by url); columns: name -> overwrite."""
    own = [c for c in posts.columns if c not in columns]
    a = articles.select(F.col("url").alias("_url"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = posts.join(a, F.col("url") == F.col("_url"), "left")
    return joined.select(*own, *(merged(F.col(c) if c in posts.columns else F.lit(None), F.col(f"_{c}"), over).alias(c) for c, over in columns.items()))


def decoded(body: Column, charset: str) -> Column:
    """Bytes as text in any of Python's charsets; bytes that don't fit are replaced. Spark's own decode knows few, and fails on such bytes."""
    codecs.lookup(charset)  # an unknown one is refused as the plan is built

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return text(body)
