"""A page corpus laid out by canonical URL, so that crawls and lookups meet it where it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import url

BUCKETS = 200


def lay_out(pages: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Save pages (page_id, url, html) as a table of the warehouse, bucketed and sorted by canonical URL, and read it.

    Of several pages of a URL that with the smallest page_id stays (null ids last); null URLs count as ''. A join or
    grouping by url of as many partitions as there are buckets needs no exchange of the corpus. A table of that name is
    replaced.
    """
    keyed = pages.select("page_id", url.canonical("url").alias("url"), "html")
    first = keyed.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), F.struct(F.col("page_id").isNull(), "page_id", F.xxhash64("html"))).alias("p"))
    rows = first.select("p.page_id", "url", "p.html").repartition(buckets, "url")
    rows.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").format("parquet").saveAsTable(name)
    return opened(pages.sparkSession, name)


def opened(spark: SparkSession, name: str) -> DataFrame:
    """page_id, url (canonical), html of a corpus that was laid out."""
    return spark.table(name).select("page_id", "url", "html")
