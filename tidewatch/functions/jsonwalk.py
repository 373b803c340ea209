"""Finding lists and bodies in JSON documents whose shape isn't known."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Keys that name a row's title, identity and URL.
TITLE_KEYS = ("title", "name", "subject", "headline")
ID_KEYS = ("id", "articleId", "noticeId", "no", "slug", "uid", "uuid", "code", "feedId", "postId", "articleNo", "contentId", "seq")
URL_KEYS = ("url", "link", "href", "permalink", "link_url", "path")
ID_KEY = re.compile(r"^(?:[a-z][a-z0-9]*_id|[a-zA-Z][a-zA-Z0-9]*[a-z]Id)$")
TITLE_KEY = re.compile(r"^(?:[a-z][a-z0-9]*_(?:title|name|subject|headline)|[a-zA-Z][a-zA-Z0-9]*(?:Title|Name|Subject|Headline))$")

LEAST_ROWS = 5
MOST_STEPS = 50


def _identity(value: object, url: bool) -> bool:
    if isinstance(value, bool):
        return False
    if isinstance(value, int):
        return True
    shape = r"[A-Za-z0-9._\-/:%?&=+,~@#]{2,512}" if url else r"[A-Za-z0-9._\-]{2,128}"
    return isinstance(value, str) and bool(re.fullmatch(shape, value.strip()))


def looks_like_row(x: object) -> bool:
    """An object with a title key and an identity."""
    if not isinstance(x, dict) or not any(k in TITLE_KEYS or TITLE_KEY.match(k) for k in x):
        return False
    return any((k in URL_KEYS and _identity(v, True)) or ((k in ID_KEYS or ID_KEY.match(k)) and _identity(v, False)) for k, v in x.items())


def lists_in(document: object) -> Iterator[tuple[str, int, str | None]]:
    """(path, length, envelope key) of every array of rows."""
    stack = [("$", document)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, list):
            if len(x) >= LEAST_ROWS and isinstance(x[0], dict):
                inner = None if looks_like_row(x[0]) else next((k for k, v in x[0].items() if looks_like_row(v)), "")
                if inner != "":
                    yield path, len(x), inner
            stack += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(x[:MOST_STEPS])))]
        elif isinstance(x, dict):
            stack += [(f"{path}.{k}", v) for k, v in reversed(x.items())]


def find_lists(payloads: DataFrame) -> DataFrame:
    """page_id, path, n, item_subpath of the arrays of rows in each payload (page_id, body); bad JSON has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, body in zip(batch.column("page_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    out += [(page_id, *found) for found in lists_in(json.loads(body or "null"))]
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string()))], ["page_id", "path", "n", "item_subpath"])

    return payloads.select("page_id", "body").mapInArrow(scan, "page_id long, path string, n int, item_subpath string")


def long_bodies(payloads: DataFrame, least: int = 200, depth: int = 7, budget: int = 5000) -> DataFrame:
    """page_id, path, length of the long strings in each payload; HTML or a telling key need only 60 characters."""
    hint = re.compile(r"(?i)content|body|html|text|article|description")

    def walk(document: object) -> Iterator[tuple[str, int]]:
        stack, left = [("$", "", document, 0)], budget
        while stack and left:
            path, key, x, level = stack.pop()
            left -= 1
            if isinstance(x, str):
                if len(x) >= least or (len(x) >= 60 and ("</" in x or hint.search(key))):
                    yield path, len(x)
            elif level < depth and isinstance(x, dict | list):
                pairs = x.items() if isinstance(x, dict) else enumerate(x)
                stack += [(f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]", str(k), v, level + 1) for k, v in reversed(list(pairs))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, body in zip(batch.column("page_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    out += [(page_id, *found) for found in walk(json.loads(body or "null"))]
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["page_id", "path", "length"])

    return payloads.select("page_id", "body").mapInArrow(scan, "page_id long, path string, length int")
