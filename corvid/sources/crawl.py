"""The crawler's data steps over fetched pages: link scan, URL test, frontier and file names. Fetching is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions import html as H
from corvid.functions.text import hrefs, is_doc_url, url_filename
from corvid.session import prepare


def page_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, link): the distinct absolute links of each page: targets that begin with '/' (joined to the site's root) or with
    the root itself; others are no links of the site. Null pages and URLs have none."""
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    raw = pages.where(F.col(url).isNotNull()).select(key, root.alias("root"), F.explode(F.array_distinct(hrefs(html))).alias("href")).where("root <> ''")
    link = F.when(F.col("href").startswith("/"), F.concat("root", "href")).when(F.col("href").startswith(F.col("root")), F.col("href"))
    return raw.select(key, link.alias("link")).where("link IS NOT NULL").distinct()


def doc_urls(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(key, url, kept): whether each URL is a documentation page of its own site."""
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    return pages.where(F.col(url).isNotNull()).select(key, url, is_doc_url(url, root).alias("kept"))


def frontier(links: DataFrame, visited: DataFrame, link: str, max_pages: int) -> DataFrame:
    """The next ``max_pages`` links that were not visited, in order of URL."""
    return links.select(link).distinct().join(visited.select(link).distinct(), link, "left_anti").orderBy(link).limit(max_pages)


def file_names(pages: DataFrame, key: str, url: str) -> DataFrame:
    return pages.where(F.col(url).isNotNull()).select(key, url_filename(url).alias("filename"))


def page_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, content): the text of the first content region, lines of more than ten characters; '' for null."""
    import pyarrow as pa

    prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([H.page_content(p) for p in b.column(1).to_pylist()], pa.string())], [key, "content"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, content string")


def latest_pages(pages: DataFrame, *columns: str, key: str = "page_id", at: str = "fetched_at") -> DataFrame:
    """Each page once, in its latest fetch, ties by the columns in order; null keys are dropped. Only the key, the time and the
    named ``columns`` (all, without any) are read and shuffled, so name no content where none is needed."""
    rest = [c for c in columns or pages.columns if c not in (key, at)]
    x = pages.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("x"))
    return x.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in columns or pages.columns])
