"""Article bundles and text documents from files.

A bundle is ``<hash>/identifiers.json`` with ``<hash>/source/<provider>/`` files and a ``tables/`` folder below it. Listing and joining are
DataFrame operations on paths; contents are parsed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import document_id
from quillstone.sources.markup import article_markdown

KNOWN = ("pmid", "doi", "pmcid")
PATH = r"([^/]+)/source/([^/]+)/(.+)$"


def source_files(spark: SparkSession, root: str, providers: list[str] | None = None) -> DataFrame:
    """path, hash_id, provider, name and content of all source files; providers are compared in lower case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,xml,pdf}").load(root)
    part = lambda i: F.regexp_extract("path", PATH, i)
    found = files.select("path", part(1).alias("hash_id"), part(2).alias("provider"), part(3).alias("name"), "content").where("hash_id <> ''")
    return found.where(F.lower("provider").isin([p.lower() for p in providers])) if providers else found


def primary(provider: Column, name: Column) -> Column:
    """True for the files that hold an article: the publishers' fixed names, else any file beside the tables."""
    fixed = F.when(F.lower(provider) == "elsevier", name == "content.xml").when(F.lower(provider) == "pubget", name == "article.xml")
    return F.coalesce(fixed, ~name.contains("/") & name.rlike(r"\.(html|xml|pdf)$"))


def identifiers(spark: SparkSession, root: str) -> DataFrame:
    """hash_id and its identifiers, trimmed, null for blank ones; ``store`` is the first of the other keys, a store's own id."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "identifiers.json").text(root)
    parsed = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/identifiers\.json$", 1).alias("hash_id"), F.from_json("value", "map<string,string>").alias("i"))
    others = F.map_filter("i", lambda k, v: ~k.isin(*KNOWN) & (F.trim(v) != ""))
    store = F.try_element_at(others, F.array_min(F.map_keys(others))).alias("store")
    clean = [*(F.nullif(F.trim(F.try_element_at("i", F.lit(k))), F.lit("")).alias(k) for k in KNOWN), F.trim(store).alias("store")]
    return parsed.select("hash_id", *clean)


def discover(spark: SparkSession, root: str, providers: list[str] | None = None) -> DataFrame:
    """One row an article: hash_id, provider, path, name, document_id, content and tables (name, content); in the order of hash and provider.

    Without identifiers the hash stands in.
    """
    files = source_files(spark, root, providers)
    articles = files.where(primary(F.col("provider"), F.col("name")))
    tables = files.where(F.col("name").rlike(r"(^|/)tables/.*\.(html|xml)$")).groupBy("hash_id", "provider").agg(
        F.sort_array(F.collect_list(F.struct("name", F.decode("content", "UTF-8").alias("content")))).alias("tables")
    )
    named = articles.join(tables, ["hash_id", "provider"], "left").join(identifiers(spark, root), "hash_id", "left")
    made = document_id(F.col("pmid"), F.col("doi"), F.col("pmcid"), F.col("store"), F.col("hash_id"))
    return named.withColumn("document_id", made).drop("pmid", "doi", "pmcid", "store")


def extract(bundles: DataFrame, pdf_reader=None) -> DataFrame:
    """hash_id, provider, document_id, path and markdown. ``pdf_reader`` (bytes to markdown) is a plug-in; without it PDFs raise."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.name.lower().endswith(".pdf"):
                    if pdf_reader is None:
                        raise ValueError(f"no PDF reader is registered for {r.path}")
                    out.append(pdf_reader(bytes(r.content)))
                    continue
                tables = [(t["name"], t["content"]) for t in r.tables] if r.tables is not None else []
                out.append(article_markdown(r.name, bytes(r.content).decode("utf-8", "ignore"), tables))
            yield pd.DataFrame({c: frame[c] for c in ("hash_id", "provider", "document_id", "path")} | {"markdown": out})

    return bundles.mapInPandas(run, "hash_id string, provider string, document_id string, path string, markdown string")


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """document_id, text and source_path of markdown, text and JSON files; sidecars (.metadata.json, .abbreviations.json) are left out.

    JSON gives its first non-blank text field, else its sections joined by blank lines.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,json}").text(root)
    rows = files.select("value", F.col("_metadata.file_path").alias("source_path")).where(~F.col("source_path").rlike(r"\.(metadata|abbreviations)\.json$"))
    stem = F.regexp_extract("source_path", r"([^/]+)\.[^./]+$", 1)
    is_json = F.col("source_path").endswith(".json")
    pick = lambda *names: F.coalesce(*(F.when(F.trim(F.get_json_object("value", f"$.{n}")) != "", F.get_json_object("value", f"$.{n}")) for n in names))
    parts = F.from_json(F.get_json_object("value", "$.sections"), "array<string>")
    said = F.transform(parts, lambda s: F.coalesce(F.get_json_object(s, "$.text"), F.get_json_object(s, "$.content"), s))
    text = F.coalesce(pick(*"text markdown content document_text full_text".split()), F.nullif(F.array_join(F.filter(said, lambda s: F.trim(s) != ""), "\n\n"), F.lit("")))
    text = F.coalesce(text, F.raise_error(F.concat(F.lit("no text in "), "source_path")))
    name = F.coalesce(pick(*"document_id doc_id id metadata.document_id".split()), stem)
    return rows.select(F.when(is_json, name).otherwise(stem).alias("document_id"), F.when(is_json, text).otherwise(F.col("value")).alias("text"), "source_path")


def abbreviation_pairs(files: DataFrame) -> DataFrame:
    """document_id, short and long of abbreviation files (document_id, value: JSON with a list of short and long); those that would do harm go.

    Dropped: blank or equal forms, long forms with bars or line breaks, short forms of one character, and of two in lower case. Text that is no JSON has no pairs.
    """
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.abbreviations"), "array<struct<short:string,long:string>>"), F.from_json("value", "array<struct<short:string,long:string>>"))
    pairs = files.select("document_id", F.inline(listed)).select("document_id", F.trim("short").alias("short"), F.trim("long").alias("long"))
    short, long = F.col("short"), F.col("long")
    harmless = (long != "") & (F.lower(short) != F.lower(long)) & ~long.rlike(r"[|\n\r]") & (F.length(short) > 1) & ~((F.length(short) <= 2) & (F.lower(short) == short) & (F.upper(short) != short))
    return pairs.where(harmless)
