"""Level-wise crawl over known links, and what a run counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import robots as R
from tessera.scratch import stored
from tessera.settings import Settings


def crawl(links: DataFrame, seeds: DataFrame, settings: Settings, robots: DataFrame | None = None) -> DataFrame:
    """``site, url, depth``: the pages that a crawl of each site visits.

    ``links`` has ``src, dst`` (repeats do no harm), ``seeds`` has ``url``; a site is the
    host of a seed, and only its pages are visited, each once, at the lowest depth.
    Links have to pass the filters and the robots files; of a level that goes
    beyond ``max_pages`` the first addresses in order are taken.  Every level is a
    stored table, so plans don't grow with depth and no level reaches the driver.
    """
    host = lambda c: F.try_parse_url(c, F.lit("AUTHORITY"))
    level = seeds.select(host(F.col("url")).alias("site"), "url").filter("site is not null").distinct()
    level = stored(_at_most(level, None, settings.max_pages).withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, settings.max_depth):
        found = level.select("site", F.col("url").alias("src")).join(links.select("src", F.col("dst").alias("url")), "src").select("site", "url").distinct()
        found = found.filter(S.may_crawl(F.col("url"), F.col("site"), F.lit(depth), settings.max_depth, settings.allowed_domains, settings.excluded_domains, settings.excluded_extensions))
        found = found.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        if robots is not None and not settings.ignore_robots_txt:
            found = R.with_robots(found, robots, agent=settings.user_agent).filter("may_fetch").select("site", "url")
        level = stored(_at_most(found, seen, settings.max_pages).withColumn("depth", F.lit(depth)))
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    return seen


def _at_most(found: DataFrame, seen: DataFrame | None, most: int) -> DataFrame:
    """Of each site the first pages in order, so many that ``most`` are not passed."""
    if seen is not None:
        found = found.join(seen.groupBy("site").agg(F.count("*").alias("before")), "site")
    else:
        found = found.withColumn("before", F.lit(0))
    place = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    return found.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") + F.col("before") <= most).select("site", "url")


def run_counters(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row of what a run counted; ``results`` has ``emails, contacts, failed`` of each page."""
    n, bad = F.count("*"), F.count_if("failed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = [n.alias("pages_crawled"), total("emails").alias("emails_found"), total("contacts").alias("contacts_found"), bad.alias("failed_pages"), F.when(n > 0, (n - bad) / n * 100).otherwise(0.0).alias("success_rate")]
    return results.agg(*out, *([(n / F.lit(float(seconds))).alias("pages_per_second")] if seconds else []))


def batch_summary(results: DataFrame, site: Column) -> DataFrame:
    """``sites, succeeded``: of how many sites at least one page could be read."""
    by = results.groupBy(site.alias("site")).agg(F.bool_or(~F.col("failed")).alias("ok"))
    return by.agg(F.count("*").alias("sites"), F.count_if("ok").alias("succeeded"))
