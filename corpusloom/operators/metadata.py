"""Bibliographic works: identity, licence, places to fetch from, eligibility, the metadata record.

A missing field is null; missing citations count as none, a missing year as allowed. Null or empty lists of
places have no licence, no score and nothing to fetch, so such works aren't eligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import AcquireConfig
from corpusloom.functions import constants as C
from corpusloom.functions.text import let, strip

#: The fields of a work that are read.
WORK_SCHEMA = """
id STRING, doi STRING, title STRING, type STRING, language STRING, publication_year INT, publication_date STRING,
cited_by_count INT, is_retracted BOOLEAN, open_access STRUCT<is_oa: BOOLEAN>,
authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING, id: STRING>>>,
primary_location STRUCT<source: STRUCT<display_name: STRING, host_organization_name: STRING>>,
locations ARRAY<STRUCT<pdf_url: STRING, landing_page_url: STRING, is_oa: BOOLEAN, license: STRING, version: STRING,
source: STRUCT<display_name: STRING, type: STRING>>>
"""


def work_id(id_: Column, doi: Column, title: Column) -> Column:
    """The last segment of the id, else 16 hexadecimal digits of the DOI's or the title's SHA-1."""
    filled = lambda x: F.when(x != "", x)
    segment = F.element_at(F.split(F.rtrim(filled(id_), F.lit("/")), "/"), -1)
    digest = lambda x: F.substring(F.sha1(x.cast("binary")), 1, 16)
    return F.coalesce(segment, digest(filled(doi)), digest(F.coalesce(title, F.lit(""))))


def web_url(url: Column) -> Column:
    """The stripped URL if it is of http or https, else null."""
    url = strip(url)
    return F.when(url.startswith("http://") | url.startswith("https://"), url)


def license_of(locations: Column) -> Column:
    """The most wanted of the locations' licences, else the first named, else null."""
    names = F.array_distinct(F.filter(F.transform(locations, lambda x: F.lower(strip(x["license"]))), lambda x: x.isNotNull() & (x != "")))

    def chosen(own: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in reversed(C.LICENSES):
            found = F.when(F.array_contains(own, name), name).otherwise(found)
        return F.coalesce(found, F.try_element_at(own, F.lit(1)))

    return let(names, chosen)


def fetchable(locations: Column) -> Column:
    """Locations with a URL of a file or of a page, flattened to seven fields."""
    rows = F.transform(
        locations,
        lambda x: F.struct(
            web_url(x["pdf_url"]).alias("pdf_url"), web_url(x["landing_page_url"]).alias("landing_page_url"), x["source"]["display_name"].alias("source"),
            x["source"]["type"].alias("source_type"), F.coalesce(x["is_oa"], F.lit(False)).alias("is_oa"), x["license"].alias("license"), x["version"].alias("version"),
        ),
    )
    return F.filter(rows, lambda x: x["pdf_url"].isNotNull() | x["landing_page_url"].isNotNull())


def _low(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit("")))


def _score_of_urls(pdf: Column, page: Column) -> Column:
    """What a place's URLs, in lower case, say of it."""
    score = F.lit(0)
    for host in C.REPOSITORIES:
        score += F.when(pdf.contains(host), 100).when(page.contains(host), 80).otherwise(0)
    for host in C.OPEN_PUBLISHERS:
        score += F.when(pdf.contains(host), 50).otherwise(0)
    for host in C.CLOSED_PUBLISHERS:
        score -= F.when(pdf.contains(host), 50).otherwise(0)
    return score + F.when(pdf != "", 30).otherwise(0)


def _score_of_kind(source_type: Column, is_oa: Column) -> Column:
    return F.when(source_type == "repository", 80).otherwise(0) + F.when(is_oa, 20).otherwise(0)


def location_score(pdf: Column, page: Column, source_type: Column, is_oa: Column) -> Column:
    """How promising a place is: repositories and open publishers first, those behind a paywall last."""
    urls = F.struct(_low(pdf).alias("pdf"), _low(page).alias("page"))
    return let(urls, lambda u: _score_of_urls(u["pdf"], u["page"])) + _score_of_kind(source_type, is_oa)


def ranked_places(works: DataFrame, key_col: str, locations_col: str = "locations") -> DataFrame:
    """key, place (from 0, the most promising first), score and the fields of each place to fetch from.

    In long form, a row for each location, as rank_locations() and fetchable() do on arrays: scores are columns of
    their own, and a work's places are ranked where its rows are.
    """
    x = lambda name: F.col(f"_l.{name}")
    rows = works.select(key_col, F.posexplode(locations_col).alias("_i", "_l")).select(
        key_col, "_i", web_url(x("pdf_url")).alias("pdf_url"), web_url(x("landing_page_url")).alias("landing_page_url"), x("source.display_name").alias("source"),
        x("source.type").alias("source_type"), F.coalesce(x("is_oa"), F.lit(False)).alias("is_oa"), x("license").alias("license"), x("version").alias("version"),
    )
    rows = rows.where("pdf_url is not null or landing_page_url is not null").withColumns({"_pdf": _low(F.col("pdf_url")), "_page": _low(F.col("landing_page_url"))})
    rows = rows.withColumn("score", _score_of_urls(F.col("_pdf"), F.col("_page")) + _score_of_kind(F.col("source_type"), F.col("is_oa")))
    order = Window.partitionBy(key_col).orderBy(F.desc("score"), "_i")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("_i", "_pdf", "_page")


def scored_locations(locations: Column) -> Column:
    """Locations `x` with their `score`, from the most promising on; equal ones keep their order."""

    def ranked(all_: Column) -> Column:
        scored = F.transform(all_, lambda x, i: F.struct((-location_score(x["pdf_url"], x["landing_page_url"], x["source_type"], x["is_oa"])).alias("s"), i.alias("i")))
        # sorted by two numbers each, without a comparison of our own; then fetched by place
        return F.transform(F.array_sort(scored), lambda z: F.struct((-z["s"]).alias("score"), F.element_at(all_, z["i"] + 1).alias("x")))

    return let(locations, ranked)


def rank_locations(locations: Column) -> Column:
    """Locations from the most promising on; equal ones keep their order."""
    return F.transform(scored_locations(locations), lambda z: z["x"])


def is_eligible(config: AcquireConfig | None = None) -> Column:
    """Works (by the columns of WORK_SCHEMA) that are wanted: not retracted, open, recent, cited, fetchable, licensed."""
    config = config or AcquireConfig()
    year = F.coalesce("publication_year", F.lit(0))
    ok = ~F.coalesce("is_retracted", F.lit(False)) & F.coalesce("open_access.is_oa", F.lit(False))
    ok &= ((year == 0) | (year >= config.min_year)) & (F.coalesce("cited_by_count", F.lit(0)) >= config.min_citations)
    ok &= F.coalesce(F.exists("locations", lambda x: web_url(x["pdf_url"]).isNotNull() | web_url(x["landing_page_url"]).isNotNull()), F.lit(False))
    if not config.licenses:
        return ok
    others = [x for x in config.licenses if x not in C.LICENSES]
    if not set(C.LICENSES) <= set(config.licenses):
        return ok & F.coalesce(license_of(F.col("locations")).isin(*config.licenses), F.lit(False))
    # each of the wanted ones is allowed, so one of them is enough, whichever would be chosen
    good = F.coalesce(F.exists("locations", lambda x: F.lower(strip(x["license"])).isin(*C.LICENSES)), F.lit(False))
    return ok & (good | F.coalesce(license_of(F.col("locations")).isin(*others), F.lit(False)) if others else good)


def metadata_record(works: DataFrame) -> DataFrame:
    """The record that is kept of each work; nothing has been fetched yet. Its fields' names are fixed values."""
    authors = F.transform(F.filter("authorships", lambda a: a["author"].isNotNull()), lambda a: F.struct(a["author"]["display_name"].alias("name"), a["author"]["id"].alias("openalex_id")))
    none = F.lit(None).cast("string")
    return works.select(
        work_id(F.col("id"), F.col("doi"), F.col("title")).alias("id"), F.col("id").alias("openalex_id"), "title", F.coalesce(authors, F.array()).alias("authors"), F.col("publication_year").alias("year"),
        "publication_date", "doi", "type", "language", F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.col("primary_location.source.display_name").alias("journal"),
        F.col("primary_location.source.host_organization_name").alias("publisher"), F.lit(True).alias("open_access"), license_of(F.col("locations")).alias("license"),
        rank_locations(fetchable(F.col("locations"))).alias("oa_locations"), F.array().cast("array<string>").alias("attempted_urls"), none.alias("successful_url"), none.alias("download_source"),
        F.lit(False).alias("downloaded"), none.alias("error"),
    )
