"""Titles, contents and links from crawled pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.functions.scale import cut_lineage, lookup_join
from newsloom.functions.text import article_quality, element_quality, sql_list
from newsloom.functions.urls import resolve_url
from newsloom.operators.quality import with_model_quality
from newsloom.operators.selectors import KEY

# Texts for missing parts, default block selectors, class words of discovery.
NO_TITLE = "No title"
ARTICLE, TITLE, CONTENT, LINK = "article", "h2", "p", "a"
TITLE_CLASSES = "title|heading|header"
CONTENT_CLASSES = "content|article|post|entry"
MIN_PARAGRAPHS = 3

PATTERN = ["selector_type", "selector"]


def page_nodes(pages: DataFrame) -> DataFrame:
    """`pages` with `text` and `nodes` in place of `html`. Written down: parsing is the dear part."""
    return cut_lineage(html.parse_pages(pages))


def selector_candidates(
    nodes: DataFrame, patterns: DataFrame, *, min_content_length: int = 100, min_title_length: int = 1, **limits
) -> DataFrame:
    """What every pattern of its source finds on a page, and whether it is long enough.

    One row per page and pattern: `page_id, KEY, order, text, passes`; `order` sorts the
    patterns of a target, best score first.
    """
    compiled = patterns.select(
        *KEY, F.struct((-F.col("score")).alias("score"), "id").alias("order"),
        html.selector_steps("selector_type", "selector").alias("steps"),
    )
    tried = lookup_join(nodes.select("page_id", "source_id", "text", "nodes"), compiled, ["source_id"], "inner", spread=["page_id"], **limits)
    found = tried.withColumn("found", html.matching("steps"))
    is_title = F.col("target_element") == "title"
    first = html.text_of("text", F.get("found", F.lit(0)))
    every = F.array_join(F.transform("found", lambda n: html.text_of("text", n)), "\n")
    # A pattern of unsupported syntax finds nothing on every page, and so is logged as a failed trial.
    texts = found.select(
        "page_id", *KEY, "order", F.when(F.size("found") > 0, F.when(is_title, first).otherwise(every)).alias("value")
    )
    least = F.when(F.col("target_element") == "title", min_title_length).otherwise(min_content_length)
    return texts.withColumn("passes", F.coalesce(F.length("value") >= least, F.lit(False))).withColumnRenamed("value", "text")


def first_passing(candidates: DataFrame) -> DataFrame:
    """The first pattern that passes: `page_id, source_id, target_element, text, PATTERN, quality`."""
    best = F.min_by(F.struct("text", *PATTERN, "order"), "order")
    won = candidates.where("passes").groupBy("page_id", "source_id", "target_element").agg(best.alias("b"))
    return won.select(
        "page_id", "source_id", "target_element", "b.*",
        element_quality("target_element", F.col("b.text")).alias("quality"),
    )


def trials_of(candidates: DataFrame, winners: DataFrame, *, as_of) -> DataFrame:
    """Log rows for every pattern that was tried: those up to the winner, all without one."""
    won = winners.select("page_id", "target_element", F.col("order").alias("won"))
    tried = candidates.drop("text").join(won, ["page_id", "target_element"], "left")
    return tried.where("won is null or order <= won").select(
        *KEY, F.lit(as_of).cast("timestamp").alias("ts"),
        F.coalesce(F.col("order") == F.col("won"), F.lit(False)).alias("success"),
    )


def extract_with_selectors(pages: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """First passing pattern per page and target."""
    return first_passing(selector_candidates(page_nodes(pages), patterns, **options))


def select_all(nodes: DataFrame, selectors: list[str], selector_type: str = "css") -> DataFrame:
    """Every selector of the list on every page, as a browser's `querySelectorAll` would run it.

    One row per page and selector: `page_id, selector, supported, n_matches, first_text, all_text`;
    the texts of the matches are stripped and joined by a line break in document order, each element
    once. Unsupported syntax (see `html.compile_css`) gives `supported` false and no match; no match
    gives null texts. The selectors are compiled once, on the driver, and travel with the plan: no join.
    """
    rows = F.array(*[
        F.struct(F.lit(sel).alias("selector"), html.selector_steps(f"'{selector_type}'", sql_list([sel])).alias("steps"))
        for sel in selectors
    ])
    tried = nodes.select("page_id", "text", "nodes", F.explode(rows).alias("s"))
    found = tried.select(
        "page_id", "text", F.col("s.selector").alias("selector"), F.col("s.steps").isNotNull().alias("supported"),
        html.matching("s.steps").alias("found"),
    )
    texts = F.transform("found", lambda n: html.text_of("text", n))
    n = F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size("found"))
    return found.select(
        "page_id", "selector", "supported", n.cast("long").alias("n_matches"),
        F.when(n > 0, F.get(texts, F.lit(0))).alias("first_text"),
        F.when(n > 0, F.array_join(texts, "\n")).alias("all_text"),
    )


def _steps(nodes: DataFrame, name: str, default: str) -> Column:
    """Selector of a block part: the source's own (a column of the pages) or the default."""
    given = f"coalesce({name}, {sql_list([default])})" if name in nodes.columns else sql_list([default])
    return html.selector_steps("'css'", given)


def blocks_of(
    nodes: DataFrame, *, article: str = ARTICLE, title: str = TITLE, content: str = CONTENT, link: str = LINK,
    max_items: int = 10,
) -> DataFrame:
    """`page_id, source_id, position, title, content, url` of the first blocks of every page.

    Works inside each row; nothing is shuffled.
    """
    keys = [c for c in ("page_id", "source_id") if c in nodes.columns]
    compiled = nodes.select(
        *keys, "url", "text", "nodes",
        _steps(nodes, "article_selector", article).alias("article_steps"),
        _steps(nodes, "title_selector", title).alias("title_steps"),
        _steps(nodes, "content_selector", content).alias("content_steps"),
        _steps(nodes, "link_selector", link).alias("link_steps"),
    )
    found = compiled.select(
        "*",
        F.posexplode(F.slice(html.matching("article_steps"), 1, max_items)).alias("position", "block"),
    )
    first = lambda steps: F.get(html.matching(steps, "block"), F.lit(0))
    parts = found.select(
        *keys, "url", "text", "position",
        first("title_steps").alias("t"), first("content_steps").alias("c"), first("link_steps").alias("l"),
    )
    return parts.select(
        *keys, "position",
        F.coalesce(html.text_of("text", F.col("t")), F.lit(NO_TITLE)).alias("title"),
        F.coalesce(html.text_of("text", F.col("c")), F.lit("")).alias("content"),
        resolve_url("l.href", "url").alias("url"),
    )


def extract_blocks(pages: DataFrame, **options) -> DataFrame:
    return blocks_of(page_nodes(pages), **options)


def discover_selectors(nodes: DataFrame, winners: DataFrame) -> DataFrame:
    """New selectors seen on pages where title and content were found, in order, no repeats.

    `page_id, source_id, target_element, position, selector_type, selector`.
    """
    per_page = winners.groupBy("page_id").agg(
        *[
            F.max(F.when(F.col("target_element") == t, F.struct(*PATTERN))).alias(t)
            for t in ("title", "content")
        ]
    ).where("title is not null and content is not null")
    pages = nodes.select("page_id", "source_id", "nodes").join(per_page, "page_id")
    steps = lambda t: html.selector_steps(f"{t}.selector_type", f"{t}.selector").alias(f"{t}_steps")
    pages = pages.select("page_id", "source_id", "nodes", steps("title"), steps("content"))
    hit = lambda t: F.get(html.matching(f"{t}_steps"), F.lit(0))
    pages = pages.select("page_id", "source_id", "nodes", hit("title").alias("t"), hit("content").alias("c"))

    parent = lambda n: F.get(F.col("nodes"), n["parent"])
    first_class = lambda n: F.get(n["classes"], F.lit(0))
    own_id = lambda n: F.when(n["id"].isNotNull(), F.concat(F.lit("#"), n["id"]))
    by_class = lambda n, names: F.transform(
        F.filter(n["classes"], lambda c: F.lower(c).rlike(names)), lambda c: F.concat(F.lit("."), c)
    )
    under = lambda n: F.when(
        parent(n)["tag"] != "body", F.concat(F.lit("."), first_class(parent(n)), F.lit(" "), n["tag"])
    )
    none = F.array().cast("array<string>")
    title = F.concat(F.array(own_id(F.col("t"))), F.coalesce(by_class(F.col("t"), TITLE_CLASSES), none), F.array(under(F.col("t"))))

    paragraphs = F.filter(html.within("nodes", F.col("c")), lambda n: n["tag"] == "p")
    pages = pages.withColumn("over", F.filter(F.transform(paragraphs, under), lambda s: s.isNotNull())).withColumn(
        "n_paragraphs", F.size(paragraphs)
    )
    votes = F.transform(
        F.array_distinct("over"),
        lambda s, i: F.struct(F.size(F.filter("over", lambda x: x == s)).alias("n"), (-i).alias("at"), s.alias("s")),
    )
    common = F.when(F.col("n_paragraphs") >= MIN_PARAGRAPHS, F.array_max(votes)["s"])
    content = F.concat(F.array(own_id(F.col("c"))), F.coalesce(by_class(F.col("c"), CONTENT_CLASSES), none), F.array(common))

    distinct = lambda a: F.array_distinct(F.filter(a, lambda s: s.isNotNull()))
    found = pages.select(
        "page_id", "source_id",
        F.explode(F.array(
            F.struct(F.lit("title").alias("target"), distinct(title).alias("s")),
            F.struct(F.lit("content").alias("target"), distinct(content).alias("s")),
        )).alias("e"),
    )
    return found.select(
        "page_id", "source_id", F.col("e.target").alias("target_element"),
        F.posexplode("e.s").alias("position", "selector"),
    ).withColumn("selector_type", F.lit("css"))


@dataclass
class Extraction:
    articles: DataFrame  # page_id, source_id, title, content, url, published, extraction_quality
    trials: DataFrame  # rows for the log of selector trials
    attempts: DataFrame  # rows for the log of source attempts
    discovered: DataFrame  # new selectors
    samples: DataFrame  # rows for the training samples


def adaptive_extract(
    pages: DataFrame,
    patterns: DataFrame,
    *,
    as_of,
    fallback: bool = True,
    min_content_length: int = 100,
    min_title_length: int = 1,
    max_items: int = 10,
    model: PipelineModel | None = None,
    **block_selectors,
) -> Extraction:
    """Known selectors first, generic blocks for pages where they do not find both parts.

    `pages` is `page_id, source_id, url, html` (and block selectors of the source, if any). With a
    trained quality model, its probability takes the place of the content rules.
    """
    nodes = page_nodes(pages)
    candidates = cut_lineage(selector_candidates(
        nodes, patterns, min_content_length=min_content_length, min_title_length=min_title_length
    ))
    winners = cut_lineage(first_passing(candidates))
    part = lambda t: F.max(F.when(F.col("target_element") == t, F.struct("text", *PATTERN, "quality"))).alias(t)
    both = (
        winners.groupBy("page_id", "source_id")
        .agg(part("title"), part("content"))
        .where("title.text <> '' and content.text <> ''")
    )
    content_quality = F.col("content.quality")
    if model is not None:
        both = with_model_quality(both, model, text=F.col("content.text"), name="model_quality")
        content_quality = F.col("model_quality")
    stamp = F.lit(as_of).cast("timestamp")
    known = both.join(nodes.select("page_id", "url"), "page_id").select(
        "page_id", "source_id",
        F.col("title.text").alias("title"), F.col("content.text").alias("content"), "url",
        stamp.alias("published"),
        article_quality("title.quality", content_quality).alias("extraction_quality"),
    )
    articles = known
    if fallback:
        rest = blocks_of(nodes.join(both.select("page_id"), "page_id", "left_anti"), max_items=max_items, **block_selectors)
        articles = known.unionByName(
            rest.drop("position").withColumn("published", stamp), allowMissingColumns=True
        )
    articles = cut_lineage(articles)
    done = articles.select("page_id").distinct().withColumn("ok", F.lit(True))
    attempts = pages.select("page_id", "source_id").join(done, "page_id", "left").select(
        "source_id", stamp.alias("ts"), F.coalesce("ok", F.lit(False)).alias("success")
    )
    pair = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in PATTERN]).alias(t)
    samples = both.join(pages.select("page_id", "url", "html"), "page_id").select(
        "source_id", "url", "html", F.col("content.text").alias("article_content"),
        F.col("title.text").alias("article_title"), F.struct(pair("title"), pair("content")).alias("successful_selectors"),
    )
    full = winners.join(both.select("page_id"), "page_id", "left_semi")
    return Extraction(
        articles, trials_of(candidates, winners, as_of=as_of), attempts, discover_selectors(nodes, full), samples
    )
