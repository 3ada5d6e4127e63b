"""Which links a crawl takes, level by level, with a reason for each that it doesn't.

profiles: name, ord, seeds, allowed_domains, include_paths, listing_paths, max_depth, follow_links; a configuration's few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_urls, host_of, path_of
from .mentions import checked

PROFILE = "name string, ord int, seeds array<string>, allowed_domains array<string>, include_paths array<string>, listing_paths array<string>, max_depth int, follow_links string"


def matches(patterns: str, path: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.rlike(path, p))


def accepts(path: Column) -> Column:
    """U2 without the host: a profile with no include_paths takes every path, else one of its patterns must match."""
    return (F.size(F.coalesce("include_paths", F.array())) <= 0) | matches("include_paths", path) | matches("listing_paths", path)


def listings(pages: DataFrame, profiles: DataFrame, url: str = "url", source: str = "source") -> DataFrame:
    """Adds is_listing, whether the path matches a listing pattern of the page's own profile."""
    own = checked(profiles.select(F.col("name").alias(source), F.col("listing_paths").alias("_listing")))
    return pages.join(own, source, "left").withColumn("is_listing", F.coalesce(F.exists("_listing", lambda p: F.rlike(path_of(F.col(url)), p)), F.lit(False))).drop("_listing")


def sourced(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """U4: adds `source`, `limit_depth` and `listing` for links (id, url, declared): the declaring profile if it accepts, else the first that does."""
    domains = profiles.select("*", F.explode("allowed_domains").alias("_host"))
    rows = links.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    met = rows.join(checked(domains), "_host").where(accepts(F.col("_path")))
    first = F.struct((F.coalesce(F.col("declared") == F.col("name"), F.lit(False))).cast("int") * -1, "ord")
    pick = F.struct(F.col("name").alias("source"), F.col("max_depth").alias("limit_depth"), matches("listing_paths", F.col("_path")).alias("listing"))
    best = met.groupBy("id").agg(F.min_by(pick, first).alias("p")).select("id", "p.*")
    return links.join(best, "id", "left")


def added(links: DataFrame, profiles: DataFrame, seen: DataFrame | None, max_depth: int) -> DataFrame:
    """Links (id, link, depth, declared) with url, source and the first reason that keeps one out, null for those that
    are enqueued. The smallest id of an address wins; `seen` has addresses of earlier levels."""
    rows = sourced(links.withColumn("url", canonical_urls(F.col("link"))), profiles)
    early = (
        F.when(F.col("depth") > max_depth, "depth_limit")
        .when(F.col("url").isNull(), "invalid_url")
        .when(F.col("source").isNull(), "outside_source_policy")
        .when(F.col("depth") > F.coalesce("limit_depth", F.lit(max_depth)), "depth_limit")
        .when((F.col("depth") > 0) & F.col("listing"), "listing_not_seed")
    )
    rows = rows.withColumn("reason", early)
    again = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), "url").orderBy("id")) > 1
    rows = rows.withColumn("_again", F.col("reason").isNull() & again)
    if seen is not None:
        rows = rows.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left").withColumn("_again", F.col("_again") | (F.col("reason").isNull() & F.coalesce("_seen", F.lit(False)))).drop("_seen")
    return rows.withColumn("reason", F.when(F.col("_again"), "duplicate_url").otherwise(F.col("reason"))).select("id", "link", "depth", "url", "source", "listing", "reason")


def follow(pages: DataFrame, links: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links to add, links not followed) of taken pages (url, source, listing, depth). links: page_url, pos, link."""
    how = checked(profiles.select(F.col("name").alias("source"), F.coalesce("follow_links", F.lit("all")).alias("_how")))
    rows = pages.select("url", "source", "listing", "depth").join(how, "source").join(links, F.col("url") == F.col("page_url"))
    shut = (F.col("_how") == "listings") & ~F.col("listing")
    return rows.where(~shut).select("page_url", "pos", "link", (F.col("depth") + 1).alias("depth")), rows.where(shut).select("page_url", "pos", "link", F.lit("links_not_followed").alias("reason"))


def budgeted(queue: DataFrame, per_source: int, total: int) -> DataFrame:
    """U8: adds a reason to queued rows (id, source) beyond the budgets; rows that a source's budget skips don't use up the total."""
    turn = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    rows = queue.withColumn("_over", turn > per_source)
    # the first `total` of the rest are taken: their last id is the edge
    edge = rows.where("NOT _over").select("id").orderBy("id").limit(total).agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    full = F.lit(edge.n >= total) & (F.col("id") > F.lit(edge.last if edge.last is not None else -1))
    return rows.withColumn("reason", F.when(full, "total_page_limit").when(F.col("_over"), "source_page_limit")).drop("_over")


def seeds(profiles: DataFrame) -> DataFrame:
    """Seeds of all profiles in round robin as links (id, link, depth, declared)."""
    rows = profiles.select("name", "ord", F.posexplode("seeds").alias("turn", "link"))
    return rows.select((F.row_number().over(Window.orderBy("turn", "ord")) - 1).cast("long").alias("id"), "link", F.lit(0).alias("depth"), F.col("name").alias("declared"))  # a configuration's rows


def expand(profiles: DataFrame, links: DataFrame, max_depth: int, keep=lambda df, name: df) -> DataFrame:
    """All links a crawl meets, breadth first, with the level's reason; links is a table (page_url, pos, link). `keep`
    writes and rereads a level, so a level's plan doesn't hold the ones before it. Budgets come after, by `budgeted`."""
    got = keep(added(seeds(profiles), profiles, None, max_depth), "level0")
    every, level = got, got.where("reason IS NULL")
    for depth in range(1, max_depth + 2):
        more, shut = follow(level, links, profiles)
        base = every.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
        order = level.select(F.col("url").alias("page_url"), F.col("id").alias("_from"))
        from ..operators.store import with_ids

        numbered = with_ids(more.join(order, "page_url").withColumn("declared", F.lit(None).cast("string")), base - 1, ["_from", "pos"], "id")
        got = keep(added(numbered.select("id", "link", "depth", "declared"), profiles, every.where("reason IS NULL"), max_depth), f"level{depth}")
        none = shut.select(F.lit(None).cast("long").alias("id"), "link", F.lit(depth).alias("depth"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("listing"), "reason")
        every = every.unionByName(got).unionByName(none)
        level = got.where("reason IS NULL")
        if level.isEmpty():
            break
    return every


def redirected(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds `error` where the final address of a page (id, final_url, source) left its source's policy."""
    rows = pages.withColumn("_final", canonical_urls(F.col("final_url")))
    own = checked(profiles.withColumnRenamed("name", "source"))
    inside = rows.join(own, "source").where(F.array_contains("allowed_domains", host_of(F.col("_final"))) & accepts(path_of(F.col("_final")))).select("id").withColumn("_in", F.lit(True))
    return rows.join(inside, "id", "left").withColumn("error", F.when(F.col("_in").isNull(), "Redirect left source policy")).drop("_in", "_final")
