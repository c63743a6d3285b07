"""Readers and writers: JSON stages, catalog dumps as XML and JSON lines, Parquet catalogs."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from citeweave.functions import text as T

# The element types of a DBLP dump.
DBLP_TAGS = ["article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "www"]
OAI = "header struct<identifier:string>, metadata struct<arXivRaw:struct<id:string,title:string,authors:string,abstract:string,`journal-ref`:string,comments:string,categories:string,doi:string,version:array<struct<date:string>>>>"
WORK = """id string, title string, display_name string, doi string, publication_year int, type string,
    authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>,
    primary_location struct<source:struct<display_name:string,id:string,type:string>,raw_source_name:string,landing_page_url:string>,
    best_oa_location struct<source:struct<display_name:string,id:string,type:string>,raw_source_name:string,landing_page_url:string>, indexed_in array<string>"""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last version `v=<n>` under a folder that was written as a whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    whole = [int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{path}/v={max(whole)}")


def read_json_stage(spark: SparkSession, path: str, schema: str | Y.StructType, optional: bool = False, array: bool = True) -> DataFrame:
    """A JSON array of objects, or what write_json_stage wrote (array=False); a missing optional file is an empty relation; broken JSON is an error."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=array)


def write_json_stage(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept, in as many files as the rows have partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Fixed columns under a header; missing ones are empty, quotes inside values are doubled."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Pages of OAI records; rows without an id or a title are left out."""
    raw = spark.read.format("xml").option("rowTag", "record").schema(OAI).load(path)
    r = lambda c: T.normalize_space(F.col(f"metadata.arXivRaw.`{c}`"))
    first_date = F.filter(F.transform("metadata.arXivRaw.version", lambda v: F.regexp_extract(F.coalesce(v["date"], F.lit("")), r"\b(19\d{2}|20\d{2})\b", 1)), lambda y: y != "")
    year = F.coalesce(F.get(first_date, 0), F.regexp_extract(r("journal-ref"), r"\b(19\d{2}|20\d{2})\b", 1))
    out = raw.select(
        r("id").alias("record_id"), F.col("header.identifier").alias("oai_identifier"), r("title").alias("title"), r("authors").alias("authors"), r("abstract").alias("abstract"),
        r("journal-ref").alias("venue"), r("comments").alias("comments"), r("categories").alias("categories"), T.normalize_doi(r("doi")).alias("doi"), year.alias("year"),
    )
    return out.where("record_id != '' and title != ''").withColumn("url", F.concat(F.lit("https://arxiv.org/abs/"), "record_id"))


def dump_path(spark: SparkSession, base: str) -> str:
    """The plain dump `base`.xml if it is there, else the gzipped one."""
    for path in (f"{base}.xml", f"{base}.xml.gz"):
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"neither {base}.xml nor {base}.xml.gz")


def unescaped(c: Column) -> Column:
    """Texts of XML with named and numbered characters decoded, but for `<`, which becomes a private character until markup has gone."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(re.sub("&(?:lt|#60|#x3[cC]);", "\ue000", x)))

    return run(c)


def read_dblp(spark: SparkSession, path: str, tags: list[str] = DBLP_TAGS) -> DataFrame:
    """A dump's publications of all types, plain or gzipped, in one pass; editors stand in for missing authors.

    The dump is read as text that is split at the records' key attributes, so a plain one is read by many tasks. Markup inside fields
    goes; all of HTML's named characters are known, as the dump's document type declares them. Records without a title are left out.
    """
    raw = spark.read.option("lineSep", ' key="').text(path)
    end = "|".join(tags)
    raw = raw.withColumn("value", unescaped(F.col("value")))
    raw = raw.select(F.regexp_extract("value", '^([^"]*)"', 1).alias("key"), *(F.regexp_extract("value", rf'(?s)^[^"]*"[^>]*>(.*?)</({end})>', k).alias(c) for k, c in ((1, "body"), (2, "type")))).where("type != ''")
    field = lambda c: rf"(?s)<{c}(?:\s[^>]*)?>(.*?)</{c}>"
    plain = lambda c: T.normalize_space(F.translate(F.regexp_replace(c, "<[^>]*>", ""), "\ue000", "<"))
    first = lambda c: plain(F.regexp_extract("body", field(c), 1))
    every = lambda c: F.filter(F.transform(F.regexp_extract_all("body", F.lit(field(c)), F.lit(1)), plain), lambda x: x != "")
    rows = raw.select(
        plain(F.col("key")).alias("record_id"), "type", first("title").alias("title"), every("author").alias("authors"), every("editor").alias("editors"),
        F.coalesce(*(T.nonempty(first(c)) for c in ("journal", "booktitle", "school", "publisher")), F.lit("")).alias("venue"), first("year").alias("year"), every("ee").alias("links"),
    ).where("title != ''")
    dois = F.filter(F.transform("links", T.extract_doi_in_link), lambda x: x != "")
    return rows.select(
        "record_id", "type", "title", T.normalize_title(F.col("title")).alias("title_normalized"), F.array_join(F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("editors")), "; ").alias("authors"),
        "venue", T.normalize_venue(F.col("venue")).alias("venue_normalized"), "year", F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("ee"), F.coalesce(F.get(dois, F.lit(0)), F.lit("")).alias("doi"),
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzipped, under updated_date= folders; blank and broken lines are left out."""
    raw = spark.read.schema(WORK).option("mode", "DROPMALFORMED").json(path)
    where = F.coalesce("primary_location", "best_oa_location")
    names = F.filter(F.transform("authorships", lambda a: F.coalesce(T.nonempty(a["author"]["display_name"]), a["raw_author_name"])), lambda x: F.coalesce(x, F.lit("")) != "")
    return raw.where("id is not null").select(
        F.col("id").alias("record_id"), F.coalesce(T.nonempty(F.col("title")), F.col("display_name"), F.lit("")).alias("title"), F.coalesce(F.array_join(names, "; "), F.lit("")).alias("authors"),
        T.normalize_doi(F.col("doi")).alias("doi"), F.coalesce(F.col("publication_year").cast("string"), F.lit("")).alias("publication_year"),
        F.coalesce(where["source"]["display_name"], where["raw_source_name"], F.lit("")).alias("venue"), F.coalesce(where["landing_page_url"], F.lit("")).alias("landing_page_url"), F.col("type"),
    )


def recent_runs(spark: SparkSession, glob: str, limit: int = 8) -> DataFrame:
    """The latest tagged summaries, newest first."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    tag = F.regexp_extract("path", r"report_summary_(.+)\.json$", 1)
    return files.withColumn("tag", tag).where("tag != ''").orderBy(F.desc("modificationTime"), "tag").limit(limit)


def build_catalog(records: DataFrame, path: str, rebuild: bool = False) -> None:
    """Records and postings as Parquet, by catalog; what is there stays unless rebuild."""
    from citeweave.operators.catalog import postings

    mode = "overwrite" if rebuild else "ignore"
    records.write.mode(mode).partitionBy("db").parquet(f"{path}/records")
    postings(records).write.mode(mode).parquet(f"{path}/title_words")
