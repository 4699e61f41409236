"""Readers and writers: site configuration, page index, collections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "struct<url: string, title: string, content: string, estimatedWords: int, lastModified: string, breadcrumbs: array<string>, siteKey: string, siteName: string, depth: int, crawledAt: string>"
STATS = "struct<totalPages: int, averageWords: int, duration: bigint, requestCount: int, averageResponseTime: double, pagesPerSecond: double>"
INDEX = f"generated string, sites map<string, struct<name: string, baseUrl: string, lastCrawled: string, stats: {STATS}, pages: array<{PAGE}>>>"
FILTERS = "struct<removeScripts: boolean, removeStyles: boolean, removeComments: boolean, removeEmptyElements: boolean, minWordCount: int, maxCodeBlockLength: int>"
SITE = f"struct<name: string, baseUrl: string, maxDepth: int, maxPages: int, selectors: struct<title: string, content: string>, excludePatterns: array<string>, contentFilters: {FILTERS}, seedUrls: array<string>, type: string, fileUrl: string>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A page index as page rows: one JSON object of sites, or (lines) an object on each line. A
    missing file is an empty index."""
    raw = spark.read.schema(INDEX).json(path, multiLine=not lines) if exists(spark, path) else spark.createDataFrame([], INDEX)
    return raw.select(F.explode("sites").alias("site_key", "site")).select("site_key", "site.name", "site.baseUrl", F.explode("site.pages").alias("page")).select("site_key", "name", "baseUrl", "page.*")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Site configuration with its order; /body/flags patterns become regular expressions."""
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([("{}",)], "value string")
    sites = F.from_json("value", f"map<string, {SITE}>")
    rows = text.select(F.posexplode(F.map_entries(sites)).alias("ordinal", "e")).select("ordinal", F.col("e.key").alias("site_key"), "e.value.*")
    pattern = lambda p: F.concat(F.when(F.regexp_extract(p, r"^/(.*)/([a-z]*)$", 2).contains("i"), "(?i)").otherwise(""), F.coalesce(F.nullif(F.regexp_extract(p, r"^/(.*)/([a-z]*)$", 1), F.lit("")), p))
    return rows.withColumn("excludePatterns", F.transform("excludePatterns", pattern))


def write_index(pages: DataFrame, path: str, generated: str = "1970-01-01T00:00:00.000Z", most: int = 256) -> None:
    """A page index as JSON objects, one a line, each of one site and at most `most` of its pages, so
    that no line and no task holds a whole site; read_index(lines=True) puts a site's objects together."""
    page = F.struct("url", "title", "content", F.col("estimated_words").cast("int").alias("estimatedWords"), F.col("last_modified").alias("lastModified"), F.split("breadcrumbs", "[|]").alias("breadcrumbs"),
                    F.col("site_key").alias("siteKey"), F.col("site_name").alias("siteName"), F.col("depth").cast("int").alias("depth"), F.lit(generated).alias("crawledAt"))
    site = F.struct(F.first("site_name").alias("name"), F.lit(None).cast("string").alias("baseUrl"), F.lit(generated).alias("lastCrawled"), F.collect_list(page).alias("pages"))
    cut = pages.withColumn("_cut", F.floor(F.monotonically_increasing_id() / most))  # rows of one partition that follow each other
    rows = cut.groupBy("site_key", "_cut").agg(site.alias("site"))
    rows.select(F.lit(generated).alias("generated"), F.create_map("site_key", "site").alias("sites")).write.json(path)


def write_config(sites: DataFrame, path: str) -> None:
    """The configuration of sites (one row each, few) as one JSON object in their order."""
    site = F.struct("name", F.col("base_url").alias("baseUrl"), F.col("max_depth").cast("int").alias("maxDepth"), F.col("max_pages").cast("int").alias("maxPages"),
                    F.struct(F.lit("h1, title").alias("title"), F.col("selectors").alias("content")).alias("selectors"), F.col("excluded").alias("excludePatterns"))
    row = F.sort_array(F.collect_list(F.struct("ordinal", "site_key", site.alias("site"))))
    entries = F.transform(row, lambda x: F.struct(x["site_key"].alias("key"), x["site"].alias("value")))
    sites.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """Collections as text, a folder for each site: its sections (site, part, n, section) in order,
    cut into files by ranges, so that a large site is many files whose names keep the order."""
    at = sections.select("site", "part", "n", F.regexp_replace("section", r"\n\z", "").alias("value"))
    rows = at.repartitionByRange("site", "part", "n").sortWithinPartitions("site", "part", "n")
    rows.select("site", "value").write.partitionBy("site").mode("overwrite").text(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """The lines (site, value) of what write_sections wrote."""
    return spark.read.schema("value string, site string").text(path)


def write_compressed(df: DataFrame, path: str, most: float = 0.9) -> bool:
    """A compressed copy beside text that is written at path; it stays only if it is under `most` of
    the original's size. Returns whether it stayed."""
    spark = df.sparkSession
    fs = lambda p: (at := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration())
    size = lambda p: fs(p).getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(p)).getLength()
    df.write.mode("overwrite").text(path)
    df.write.mode("overwrite").option("compression", "gzip").text(path + ".gz")
    if size(path + ".gz") < most * size(path):
        return True
    fs(path).delete(spark._jvm.org.apache.hadoop.fs.Path(path + ".gz"), True)
    return False


def write_collections(collections: DataFrame, path: str) -> None:
    """One text per source: rows (source, content), partitioned by source."""
    collections.select("source", F.col("content").alias("value")).write.partitionBy("source").mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, compact: bool = True) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", str(compact).lower()).json(path)
