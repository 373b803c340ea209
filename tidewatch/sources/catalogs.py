"""Catalogues of sites in YAML files: entries with a name and a URL, what is wrong with them, and URLs that several catalogues have.

The files are read by Spark as whole texts, so that they may lie in any store that it reaches. Of YAML, the part that such catalogues use is
read: comments, block mappings and lists, plain and quoted scalars, empty lists, document starts. Anything else is an error of its file,
as a row beside the entries of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = 2
#: The longest name and URL.
MOST_NAME, MOST_URL = 200, 1000
ENTRY = "catalog string, pos int, name string, url string, error string"

_KEY = re.compile(r"""([A-Za-z_][\w-]*|"[^"]*"|'[^']*')\s*:(?:\s+(.*)|$)""")


def scalar(text: str) -> object:
    """A scalar's value: a text, a whole number, a boolean or None. Raises ValueError on what isn't read here."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        quote = text[0]
        pattern = r"'((?:[^']|'')*)'\s*(?:#.*)?" if quote == "'" else r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?'
        if not (m := re.fullmatch(pattern, text)):
            raise ValueError(f"unbalanced quotes: {text}")
        escapes = {"n": "\n", "t": "\t"}
        return m[1].replace("''", "'") if quote == "'" else re.sub(r"\\(.)", lambda x: escapes.get(x[1], x[1]), m[1])
    text = re.split(r"\s#", text, maxsplit=1)[0].strip()
    if text[:1] in tuple("&*!|>%@`{") or text[:1] == "[" and text != "[]":
        raise ValueError(f"not read here: {text}")
    if text == "[]":
        return []
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if re.fullmatch(r"[-+]?[0-9]+", text) else text


def parse(text: str) -> object:
    """The document: mappings as dicts, lists as lists. Raises ValueError where it can't be read."""
    lines = []
    for line in text.removeprefix("﻿").splitlines():
        bare = line.rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or bare in ("---", "..."):
            continue
        if "\t" in bare[: len(bare) - len(bare.lstrip())]:
            raise ValueError("a tab indents a line")
        lines.append((len(bare) - len(bare.lstrip()), bare.strip()))
    if not lines:
        return None
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"unexpected indentation: {lines[at][1]}")
    return value


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The list or mapping that begins at a line, and the line behind it."""
    if lines[at][1] == "-" or lines[at][1].startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:].strip()
            inner = indent + len(lines[at][1]) - len(rest) if rest else None
            if rest and (_KEY.match(rest) or rest.startswith("- ")):
                lines[at] = (inner, rest)  # the item's own block begins behind its dash
                value, at = _block(lines, at, inner)
            elif rest:
                value, at = scalar(rest), at + 1
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                value, at = _block(lines, at + 1, lines[at + 1][0])
            else:
                value, at = None, at + 1
            out.append(value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == indent:
        if not (m := _KEY.fullmatch(lines[at][1])):
            if found or at + 1 < len(lines):
                raise ValueError(f"no key: {lines[at][1]}")
            return scalar(lines[at][1]), at + 1
        key = scalar(m[1])
        if key in found:
            raise ValueError(f"key {key!r} twice")
        rest, at = (m[2] or "").strip(), at + 1
        if rest and not rest.startswith("#"):
            found[key] = scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
            found[key], at = _block(lines, at, lines[at][0])
        else:
            found[key] = None
    return found, at


def checked(text: str) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
    """(pos, name, url, error) of a catalogue's entries; a catalogue that can't be read is one row without a position."""
    try:
        document = parse(text)
    except ValueError as e:
        yield None, None, None, f"not YAML: {e}"
        return
    if not isinstance(document, dict):
        yield None, None, None, "no mapping"
    elif document.get("schema") != SCHEMA or isinstance(document.get("schema"), bool):
        yield None, None, None, f"schema {document.get('schema')!r}"
    elif not isinstance(document.get("entries"), list):
        yield None, None, None, "entries are no list"
    else:
        seen = set()
        for pos, entry in enumerate(document["entries"]):
            name, url = (entry.get("name"), entry.get("url")) if isinstance(entry, dict) else (None, None)
            fine_url = isinstance(url, str) and url.startswith(("http://", "https://"))
            if not isinstance(entry, dict):
                error = "no mapping"
            elif not isinstance(name, str) or not name.strip():
                error = "no name"
            elif len(name) > MOST_NAME:
                error = "name too long"
            elif not fine_url:
                error = "no http URL"
            elif len(url) > MOST_URL:
                error = "URL too long"
            else:
                error = "URL twice" if url in seen else None
                seen.add(url)
            yield pos, name.strip() if isinstance(name, str) else None, url if isinstance(url, str) else None, error


def read_entries(files: DataFrame) -> DataFrame:
    """catalog, pos, name, url, error of the entries of files (path, value): `error` says what is wrong with one, null if nothing is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], *row) for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True) for row in checked(text or "")]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["catalog", "pos", "name", "url", "error"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("value").cast("string").alias("value")).mapInArrow(read, ENTRY)


def catalogs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the YAML files of a folder, with what is wrong with each. Files without a byte are none to Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").load(path)
    return read_entries(files.select("path", F.col("content").alias("value")))


def across(entries: DataFrame) -> DataFrame:
    """The entries, of which a URL that an earlier catalogue (by name) has without fault gets the error `URL in <catalogue>`."""
    first = F.first("catalog").over(Window.partitionBy("url").orderBy("catalog", "pos"))
    fine = entries.where("error is null").withColumn("error", F.when(first != F.col("catalog"), F.concat(F.lit("URL in "), first)))
    return fine.unionByName(entries.where("error is not null"))
