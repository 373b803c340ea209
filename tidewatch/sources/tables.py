"""Tables and files as frames, and frames as tables and files. All paths are Spark's own, so any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """A database table read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)


def file_stem() -> Column:
    """Name of a row's file without its last extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


#: Endings of marker files that lie beside state files.
MARKERS = ("FAILED", "REJECTED", "BUG", "BROKEN")


def state_files(spark: SparkSession, folder: str, schema: str, slugs: list[str] | None = None) -> DataFrame:
    """One row a state document, slug from the file's name; markers and broken JSON are left out."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.url_decode(file_stem()).alias("slug"), "value")
    rows = rows.where(~F.col("slug").rlike(rf"\.({'|'.join(MARKERS)})$"))
    rows = rows.where(F.col("slug").isin(*slugs)) if slugs else rows
    return rows.select("slug", F.from_json("value", schema).alias("s")).where("s is not null").select("slug", "s.*")


def marker_files(spark: SparkSession, folder: str) -> DataFrame:
    """slug, kind and payload of the marker files."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(file_stem().alias("stem"), F.col("value").alias("payload"))
    kind = F.regexp_extract("stem", rf"\.({'|'.join(MARKERS)})$", 1)
    return rows.where(kind != "").select(F.regexp_replace("stem", rf"\.({'|'.join(MARKERS)})$", "").alias("slug"), kind.alias("kind"), "payload")


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    """slug and text of each configuration document."""
    return spark.read.text(f"{folder}/*.json", wholetext=True).select(file_stem().alias("slug"), F.col("value").alias("config"))


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """name, header (the lines between the first two rulers) and body of Markdown files."""
    rows = spark.read.text(f"{folder}/*.md", wholetext=True)
    return rows.select(file_stem().alias("name"), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1).alias("header"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; malformed ones are left out."""
    fields = T.StructType.fromDDL(schema).add("_broken", "string")
    return spark.read.schema(fields).option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken is null").drop("_broken")


def line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: lines of a JSON log, and how many of them are malformed."""
    fields = T.StructType.fromDDL(schema).add("_broken", "string")
    # through the text, as a count of the corrupt column alone can't be read from JSON
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", fields, {"columnNameOfCorruptRecord": "_broken"}).alias("x"))
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col("x._broken").isNotNull()).alias("n_malformed"))


def trace_parts(lines: DataFrame, trace_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows of one trace's log (type, trace_id, ...) that describe it, and its spans."""
    own = lines.where(F.col("trace_id") == trace_id)
    return own.where("type = 'trace'").drop("type"), own.where("type = 'span'").drop("type")


def newest_lines(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n lines by a time column, oldest first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def trace_index(events: DataFrame) -> DataFrame:
    """Start and end events (event, trace_id, kind, ts, ok) folded to a row a trace."""
    start, end = F.col("event") == "start", F.col("event") == "end"
    return events.groupBy("trace_id").agg(
        F.max(F.when(start, F.col("kind"))).alias("kind"), F.min(F.when(start, F.col("ts"))).alias("started"), F.max(F.when(end, F.col("ts"))).alias("ended"), F.bool_and(F.when(end, F.col("ok"))).alias("ok")
    )


def har_entries(spark: SparkSession, path: str) -> DataFrame:
    """no, method, url, status, mime, text of a HAR file's entries; base64 bodies are decoded."""
    content = "content:struct<text:string,encoding:string,mimeType:string>"
    schema = f"log struct<entries:array<struct<request:struct<method:string,url:string>,response:struct<status:int,{content}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("log.entries").alias("no", "e"))
    body = F.col("e.response.content")
    text = F.when(body["encoding"] == "base64", F.decode(F.unbase64(body["text"]), "UTF-8")).otherwise(body["text"])
    return rows.select("no", F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.col("e.response.status").alias("status"), F.split_part(body["mimeType"], F.lit(";"), F.lit(1)).alias("content_type"), text.alias("text"))


def robots(files: DataFrame) -> DataFrame:
    """host, crawl_delay, disallow (30 at most), sitemaps (10 at most) of robots.txt texts (host, text)."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.split_part(x, F.lit("#"), F.lit(1))))

    def values(name: str, most: int) -> Column:
        hit = F.filter(lines, lambda x: x.rlike(rf"(?i)^{name}\s*:\s*\S"))
        return F.slice(F.transform(hit, lambda x: F.regexp_extract(x, r"^[^:]*:\s*(\S+)", 1)), 1, most)

    return files.select("host", F.try_element_at(values("crawl-delay", 1), F.lit(1)).try_cast("double").alias("crawl_delay"), values("disallow", 30).alias("disallow"), values("sitemap", 10).alias("sitemaps"))


def sitemap_urls(files: DataFrame, start: DataFrame, levels: int = 2, most: int = 500) -> DataFrame:
    """root, loc, lastmod of the pages that a root sitemap lists, through index files down to `levels`.

    files has url and text of every fetched sitemap, start the root urls; each level is one join.
    """
    text = F.col("text")
    located = F.regexp_extract_all(text, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    parsed = files.select("url", text.rlike("<sitemapindex").alias("is_index"), F.posexplode(located).alias("k", "x"))
    parsed = parsed.select("url", "is_index", "k", F.trim(F.regexp_extract("x", r"(?s)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", 1)).alias("loc"), F.nullif(F.trim(F.regexp_extract("x", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"))
    level, out = start.select(F.col("url").alias("root"), F.col("url").alias("at"), F.lit("").alias("path")), None
    for _ in range(levels + 1):
        rows = level.join(parsed, F.col("at") == F.col("url")).withColumn("path", F.concat_ws("/", "path", F.lpad(F.col("k").cast("string"), 6, "0")))
        found = rows.where(~F.col("is_index")).select("root", "loc", "lastmod", "path")
        out = found if out is None else out.unionByName(found)
        level = rows.where("is_index").select("root", F.col("loc").alias("at"), "path")
    numbered = out.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("path")))
    return numbered.where(F.col("n") <= most).select("root", "loc", "lastmod")


# --- sinks ----------------------------------------------------------------------------------------------------------------------


def publish(rows: DataFrame, path: str) -> None:
    """Replaces a table by a new state that doesn't read it."""
    rows.write.mode("overwrite").parquet(path)


def append_json(rows: DataFrame, path: str, *by: str) -> None:
    """Appends lines of JSON, a folder for each value of `by`."""
    (rows.write.partitionBy(*by) if by else rows.write).mode("append").json(path)


def append_traces(traces: DataFrame, spans: DataFrame, folder: str) -> None:
    """Appends traces and spans as lines of JSON, a folder for each trace, and a start and an end line for each trace to the index."""
    both = traces.withColumn("type", F.lit("trace")).unionByName(spans.withColumn("type", F.lit("span")), allowMissingColumns=True)
    append_json(both, f"{folder}/traces", "trace_id")
    ends = F.explode(F.array(F.struct(F.lit("start").alias("event"), F.col("started").alias("ts")), F.struct(F.lit("end").alias("event"), F.col("ended").alias("ts"))))
    append_json(traces.select("trace_id", "kind", "ok", ends.alias("e")).select("trace_id", "kind", "ok", "e.event", "e.ts").where("ts is not null"), f"{folder}/index")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
