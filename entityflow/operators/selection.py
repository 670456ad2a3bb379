"""From decisions to sites: first-wins selection with lineage, and the tables that are exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.urls import hostname, site_key


def sites(resolutions: DataFrame) -> DataFrame:
    """Confirmed rows (query, discovered_url, name, url) each with its site: site_name, site_url and
    site_query, site_source (those of the site's founder).

    A name belongs to the url key of its first row; the first name of a url key founds the site. Two
    windows, one over the rows of a name and one over first rows of a key, replace the sequential scan.
    """
    order = ["query", "discovered_url"]
    key = F.when(hostname(F.col("url")) == "", F.raise_error(F.concat(F.lit("invalid_entrypoint: "), F.col("url"))).cast("string")).otherwise(site_key(F.col("url")))
    rows = resolutions.filter("status = 'confirmed'").select(*order, "name", "url", key.alias("url_key"))
    firsts = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter("_rn = 1")
    founder = Window.partitionBy("url_key").orderBy(*order)
    named = firsts.select("name", *(F.first(c).over(founder).alias(f"site_{a}") for c, a in (("name", "name"), ("url", "url"), ("query", "query"), ("discovered_url", "source"))))
    return rows.join(named, "name").select(*order, "name", "url", "site_name", "site_url", "site_query", "site_source")


def collisions(founders: DataFrame) -> DataFrame:
    """Directory names (slug) that several sites would have, or that are empty."""
    return founders.select("site_name", slug(F.col("site_name")).alias("slug")).distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or slug = ''")


def alternatives(chosen: DataFrame) -> DataFrame:
    """site_name, pos, name, url: other spellings and addresses of a site, each once, in order."""
    other = chosen.filter("name <> site_name or url <> site_url")
    first = other.groupBy("site_name", "name", "url").agg(F.min(F.struct("query", "discovered_url")).alias("at"))
    return first.select("site_name", F.row_number().over(Window.partitionBy("site_name").orderBy("at")).cast("long").alias("pos"), "name", "url")


def provenance(chosen: DataFrame) -> DataFrame:
    """site_name, sources: ordered array of struct(query, discovered_url, name, url)."""
    return chosen.groupBy("site_name").agg(F.array_sort(F.collect_list(F.struct("query", "discovered_url", "name", "url"))).alias("sources"))


def counts(resolutions: DataFrame, n_sites: int) -> DataFrame:
    """One row: sites, confirmed, duplicates, pending, skipped."""
    of = lambda s: F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).cast("long").alias(s)
    got = resolutions.agg(of("confirmed"), of("pending"), of("skipped"))
    return got.select(F.lit(n_sites).cast("long").alias("sites"), "confirmed", (F.col("confirmed") - n_sites).alias("duplicates"), "pending", "skipped")


def completeness(progress: DataFrame, pending: int, interrupted: bool = False) -> DataFrame:
    """One row: search_complete (there are queries and all are complete), partial."""
    whole = (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.coalesce(F.col("status") == "complete", F.lit(False))), F.lit(False))
    got = progress.agg(whole.alias("search_complete"))
    return got.withColumn("partial", F.lit(interrupted) | ~F.col("search_complete") | F.lit(pending > 0))


def companies(resolutions: DataFrame) -> DataFrame:
    """CompanyName, URL, SearchQuery: the first confirmed row of each (url, query)."""
    first = F.row_number().over(Window.partitionBy("url", "query").orderBy("query", "discovered_url"))
    rows = resolutions.filter("status = 'confirmed'").withColumn("_rn", first).filter("_rn = 1")
    return rows.select(F.col("name").alias("CompanyName"), F.col("url").alias("URL"), F.col("query").alias("SearchQuery"), "discovered_url")
