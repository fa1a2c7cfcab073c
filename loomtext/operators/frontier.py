"""Crawl priorities: buckets, costs, inheritance, scope and limits, over tables of links and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.session import cut

HIGHEST, HIGH, MEDIUM, NORMAL = 0, 1, 2, 3
BOUNDS = (500.0, 5000.0, float("inf"))
MOST = 50_000.0
SEED_PERPLEXITY = 2.0


def directive(perp: Column, bounds: tuple[float, float, float] = BOUNDS) -> Column:
    """1, 2 or 3 by ascending bounds, null to reject: values of at most 1, over the last bound, or not finite where that is finite."""
    odd = perp.isNull() | F.isnan(perp) | (F.abs(perp) == float("inf"))
    last = F.lit(NORMAL) if bounds[2] == float("inf") else F.lit(None).cast("int")
    out = F.when(odd, last).when(perp <= 1, F.lit(None))
    for level, bound in zip((HIGH, MEDIUM, NORMAL), bounds):
        out = out.when(perp <= bound, F.lit(level))
    return out.cast("int")


def cost(perp: Column, level: Column, bounds: tuple[float, float, float] = BOUNDS, most: float = MOST) -> Column:
    """1, 4 and 8 for the upper levels; the normal one costs 64 to 127, growing with the logarithm of the value."""
    top = min(bounds[2], most)
    scale = (F.log1p(perp) - F.log1p(F.lit(bounds[1]))) * 63 / (F.log1p(F.lit(top)) - F.log1p(F.lit(bounds[1]))) + 64
    normal = F.when(perp.isNull() | F.isnan(perp) | (perp >= top), F.lit(127)).otherwise(F.ceil(scale))
    return F.when(level == HIGHEST, 1).when(level == HIGH, 4).when(level == MEDIUM, 8).when(level == NORMAL, normal).cast("int")


def prioritize(links: DataFrame, bounds: tuple[float, float, float] = BOUNDS) -> DataFrame:
    """``links`` (perp, whatever else) with directive, cost and rejected."""
    level = directive(F.col("perp"), bounds)
    out = links.withColumn("directive", level)
    return out.withColumns({"cost": cost(F.col("perp"), F.col("directive"), bounds), "rejected": F.col("directive").isNull()})


def resolve(links: DataFrame, ends: Column) -> DataFrame:
    """uri, target and hops: the nearest page, the uri itself or up its ``via`` chain, for which ``ends`` holds, and how far it is.

    Pointers jump to their pointers' pointers each round, so a chain of n links takes log2 n rounds. Chains that
    end, or run in circles, without such a page have null.
    """
    ended = F.coalesce(ends, F.lit(False))
    state = cut(links.select("uri", F.when(ended, F.col("uri")).otherwise(F.col("via")).alias("target"), F.when(ended, 0).otherwise(1).cast("long").alias("hops"), ended.alias("done")))
    open_ = ~F.col("done") & F.col("target").isNotNull()
    for _ in range(state.count().bit_length() + 1):
        if state.where(open_).isEmpty():
            break
        up = state.select(F.col("uri").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"), F.col("done").alias("up_done"))
        joined = state.join(up, "target", "left")
        jump = lambda new, old: F.when(open_, new).otherwise(old)
        state = cut(joined.select("uri", jump(F.col("next"), F.col("target")).alias("target"), jump(F.col("hops") + F.col("more"), F.col("hops")).alias("hops"), jump(F.coalesce("up_done", F.lit(False)), F.col("done")).alias("done")))
    return state.select("uri", F.when(F.col("done"), F.col("target")).alias("target"), F.when(F.col("done"), F.col("hops")).alias("hops"))


def nearest_scored(links: DataFrame) -> DataFrame:
    """uri, source and perp: the nearest page, the uri itself or up its ``via`` chain, that has a perplexity, or null."""
    found = resolve(links, F.col("perp").isNotNull()).select("uri", F.col("target").alias("source"))
    return found.join(links.select(F.col("uri").alias("source"), "perp"), "source", "left").select("uri", "source", "perp")


def schedule(links: DataFrame, bounds: tuple[float, float, float] = BOUNDS, most: float = MOST) -> DataFrame:
    """uri, perp_via, directive, cost and rejected, of links (uri, via, perp, is_seed, is_robots, is_prerequisite) that are to be fetched.

    A seed has a perplexity of its own. Any other link inherits from the nearest page up its chain that has one; a seed without one passes
    on 3 and one more for each step, a robots file the worst that isn't rejected. Each step makes a link cheaper by one, down to
    nothing; a prerequisite goes one level up. Links whose chains lead nowhere have null.
    """
    ends = F.col("perp").isNotNull() | F.col("is_seed") | F.col("is_robots")
    found = resolve(links, ends).withColumnRenamed("uri", "via")
    pages = links.select(F.col("uri").alias("target"), F.col("perp").alias("target_perp"), F.col("is_seed").alias("target_seed"))
    walked = links.join(found, "via", "left").join(pages, "target", "left")
    steps = F.when(F.col("is_seed"), 0).when(F.col("target_perp").isNotNull(), F.col("hops")).otherwise(F.col("hops") + 1)
    value = F.when(F.col("is_seed"), F.lit(SEED_PERPLEXITY)).when(F.col("target_perp").isNotNull(), F.col("target_perp"))
    value = value.when(F.col("target_seed"), F.col("hops") + SEED_PERPLEXITY + 1).when(F.col("target").isNotNull(), F.lit(min(most, bounds[2]) - 1))
    known = walked.select("uri", "is_prerequisite", value.alias("perp_via"), steps.alias("steps"))
    level = F.when(F.col("perp_via").isNotNull(), directive(F.col("perp_via"), bounds))
    priced = known.withColumn("level", level).withColumn("cost", F.greatest(cost(F.col("perp_via"), F.col("level"), bounds, most) - F.col("steps"), F.lit(0)).cast("int"))
    up = F.when(F.col("is_prerequisite"), F.greatest(F.col("level") - 1, F.lit(HIGHEST))).otherwise(F.col("level"))
    return priced.select("uri", "perp_via", up.cast("int").alias("directive"), F.when(F.col("level").isNotNull(), F.col("cost")).alias("cost"), F.col("level").isNull().alias("rejected"))


def halved(cost_: Column, cheaper: Column) -> Column:
    """The older rule: redirects and prerequisites cost half."""
    return F.when(cheaper, F.floor(cost_ / 2)).otherwise(cost_).cast("int")


def fetched(status: Column, size: Column, extracted: Column) -> Column:
    """Whether a page was fetched with content and its links were extracted."""
    return extracted & (size > 0) & status.between(200, 207)


KINDS = {"robots": (r"(?i)/robots\.txt$", r"^text/plain"), "html": (r"(?i)(\.x?html?|/|/[^./]*)$", r"(?i)^(text/html|application/xhtml)"), "pdf": (r"(?i)\.pdf$", r"(?i)^application/pdf")}


def content_kind(path: Column, content_type: Column) -> Column:
    """robots, html or pdf by the type that the server declares, or by the path where it declares none; else other."""
    out = F.when(path.rlike(KINDS["robots"][0]), F.lit("robots"))
    for name in ("html", "pdf"):
        by_path, by_type = KINDS[name]
        out = out.when(F.when(content_type.isNotNull(), content_type.rlike(by_type)).otherwise(path.rlike(by_path)), F.lit(name))
    return out.otherwise(F.lit("other"))


def assigned(prioritized: DataFrame) -> DataFrame:
    """How many links each directive has; rejected ones have directive 0."""
    return prioritized.groupBy(F.coalesce("directive", F.lit(0)).alias("directive")).agg(F.count("*").alias("n"))


def in_scope(url: Column, rules: list[tuple[bool, Column]]) -> Column:
    """Decision of the last rule that applies; nothing applies: rejected. A rule is (accept, condition)."""
    return F.coalesce(*[F.when(condition, F.lit(accept)) for accept, condition in reversed(rules)], F.lit(False))


def default_scope(url: Column, hops: int = 20) -> list[tuple[bool, Column]]:
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    return [(True, url.rlike("^https?://")), (False, slashes > hops), (False, url.rlike(r"(?i)\.(jpe?g|png|gif|mp[34]|avi|zip|exe)$")), (False, F.length(url) > 2000)]


def domain_limit(pages: DataFrame, most: int, order: str) -> DataFrame:
    """``pages`` with domain, its rank by first sight, and accepted: the first ``most`` domains."""
    first = pages.withColumn("domain", X.domain(F.col("url"))).groupBy("domain").agg(F.min(order).alias("first"))
    ranked = first.orderBy("first", "domain").limit(most).select("domain").withColumn("accepted", F.lit(True))
    return pages.withColumn("domain", X.domain(F.col("url"))).join(ranked, "domain", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def next_urls(prioritized: DataFrame, host: Column, k: int) -> DataFrame:
    """The ``k`` cheapest accepted links of each host."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy("directive", "cost", "uri"))
    return prioritized.where("not rejected").withColumn("host", host).withColumn("rank", rank).where(F.col("rank") <= k)
