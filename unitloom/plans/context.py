"""Each item's context, rendered at the richest level its token budget allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.functions.templates import (
    FRAMEWORKS, INPUT_BUDGET, LANGUAGE, LEVELS, NO_RELATIONS, code_block, member_title, placeholders, render_levels,
    token_parts,
)
from unitloom.functions.tokens import TokenCounter, choose_level, count_tokens, token_count
from unitloom.operators.ordered import ordered_lines, ordered_parts
from unitloom.session import cut_lineage

RELATED = ("related_methods", "related_classes")
ITEM_KEY = ["project", "method_id"]
CLASS_KEY = ["project", "package", "class_identifier"]

#: Placeholders of the level templates and the columns that fill them.
_VALUE_COLUMNS = {
    "method_name": "method_identifier", "class_name": "class_identifier", "method_code": "full_text",
    "package": "package", "imports": "imports", "class_header": "header",
}


def block_rows(edges: DataFrame, key: list[str], order: list[str], text: Column, title: Column | None = None,
               language: str = LANGUAGE, name: str = "block") -> DataFrame:
    """Fenced blocks of each key's related code as rows (key, position, block), for keys with any number (A4, F8)."""
    return ordered_lines(edges, key, code_block(text, title, language), order, name)


def render_blocks(edges: DataFrame, key: list[str], order: list[str], text: Column, title: Column | None = None,
                  language: str = LANGUAGE, name: str = "blocks", *, rows_per_part: int) -> DataFrame:
    """Fenced blocks of each key's related code, in order, ``rows_per_part`` blocks a row (A4, F8).

    Gives (key, part, blocks).  Keys without related code have no row: see :func:`or_no_relations`; see
    :func:`block_rows` for a row per block.
    """
    return ordered_parts(edges, key, code_block(text, title, language), order, "", name, rows_per_part=rows_per_part)


def or_no_relations(blocks: Column) -> Column:
    return F.coalesce(blocks, F.lit(NO_RELATIONS))


def _values() -> dict[str, Column]:
    return {name: F.col(column) for name, column in _VALUE_COLUMNS.items()}


def _method_block(language: str) -> Column:
    title = member_title(F.col("method_identifier"), F.col("class_identifier"))
    return code_block(F.col("full_text"), title, language)


def _gather(edges: DataFrame, blocks: DataFrame, on: list[str], name: str) -> DataFrame:
    """Related blocks of each item as one text.

    Only called with the edges of items whose related texts are known to fit a budget,
    so a group is no longer than that budget.
    """
    texts = edges.join(blocks, on).groupBy(*ITEM_KEY).agg(
        F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("_sorted")
    )
    return texts.select(*ITEM_KEY, F.array_join(F.col("_sorted")["block"], "").alias(name))


def gather_context(tables: dict[str, DataFrame], budget: int = INPUT_BUDGET, levels: tuple[str, ...] = LEVELS,
                   counter: TokenCounter | None = None, language: str = LANGUAGE,
                   only: Column | None = None) -> DataFrame:
    """Prompt of every method at the largest level that fits.

    Gives (project, method_id, method_identifier, class_identifier, filepath, level,
    tokens, prompt); level 0 has a null prompt.  ``only`` is a condition on
    project and method_id that picks the methods to render; it reaches the scans.

    Related texts are the bulk of the data: every call brings the text of its target.
    They are therefore joined last.  First each block is measured once, edges carry only
    the measure, and its sum per method is combined before the shuffle; a method whose
    related blocks cannot fit never gathers their texts.  So no group is larger than the
    budget, even where one method has a third of all calls.
    """
    classes, methods = tables["classes"], tables["methods"]
    method_edges = tables["related_methods"].select("project", F.col("source_id").alias("method_id"), "target_id", "ord")
    class_edges = tables["related_classes"].select("project", "method_id", "package", "class_identifier", "ord")
    related = {
        "related_methods": (method_edges, ["project", "target_id"], methods.select(
            "project", F.col("method_id").alias("target_id"), _method_block(language).alias("block"))),
        "related_classes": (class_edges, ["project", "package", "class_identifier"], classes.select(
            "project", "package", "class_identifier", code_block(F.col("full_text"), None, language).alias("block"))),
    }
    if only is not None:
        methods = methods.where(only)
        related = {name: (edges.where(only), on, blocks) for name, (edges, on, blocks) in related.items()}

    parts = [token_parts(level, {**FRAMEWORKS, **_values(), **dict.fromkeys(RELATED, F.lit(""))}) for level in levels]
    additive = counter is None and all(part is not None for part in parts)
    if additive:
        plan = _levels_by_sums(methods, classes, related, parts, levels, budget)
    else:
        plan = _candidates(methods, related, budget, counter)
    plan = cut_lineage(plan, "levels")  # numbers only, read once per related table and once below

    full = methods.join(
        classes.select(*CLASS_KEY, "imports", "header", "filepath"), CLASS_KEY, "left"
    ).join(plan, ITEM_KEY)
    texts = {}
    for name, (edges, on, blocks) in related.items():
        wanted = plan.where(F.col(f"take_{name}")).select(*ITEM_KEY)
        full = full.join(_gather(edges.join(wanted, ITEM_KEY, "left_semi"), blocks, on, f"_{name}"), ITEM_KEY, "left")
        texts[name] = or_no_relations(F.col(f"_{name}"))
    prompts = render_levels({**_values(), **texts}, levels)
    kept = [*ITEM_KEY, "method_identifier", "class_identifier", "filepath"]

    if additive:
        chosen = None
        for number, prompt in enumerate(prompts, 1):
            hit = F.col("level") == number
            chosen = F.when(hit, prompt) if chosen is None else chosen.when(hit, prompt)
        return full.select(*kept, "level", "tokens", chosen.alias("prompt"))

    numbers = range(1, len(levels) + 1)
    rendered = full.select(*kept, *[
        F.when(_fits_all(placeholders(level)), prompt).alias(f"_prompt_{n}") for n, level, prompt in zip(numbers, levels, prompts)
    ])
    # a prompt that cannot fit was not rendered and counts as a misfit
    counted = rendered.withColumns({
        f"_tokens_{n}": F.coalesce(count_tokens(F.col(f"_prompt_{n}"), counter), F.lit(budget)) for n in numbers
    })
    counted = counted.withColumn("level", choose_level([F.col(f"_tokens_{n}") for n in numbers], budget))

    def at_level(stem: str) -> Column:
        return F.try_element_at(F.array(*[F.col(f"{stem}_{n}") for n in numbers]), F.nullif(F.col("level"), F.lit(0)))

    return counted.select(*kept, "level", at_level("_tokens").cast("bigint").alias("tokens"), at_level("_prompt").alias("prompt"))


def _sums(edges: DataFrame, on: list[str], blocks: DataFrame, measure: Column, name: str) -> DataFrame:
    """Sum of a measure of the related blocks, per item; texts stay where they are."""
    sizes = blocks.select(*on, measure.cast("bigint").alias("_size"))
    thin = edges.select(*ITEM_KEY, *[column for column in on if column not in ITEM_KEY])
    return thin.join(sizes, on).groupBy(*ITEM_KEY).agg(F.sum("_size").alias(name))


def _levels_by_sums(methods, classes, related, parts, levels, budget) -> DataFrame:
    """Level and tokens of every item from token counts of its parts alone.

    Counts are taken below the joins, so each text is read once and never shuffled.
    """
    def size(name: str) -> Column:
        return token_count(F.coalesce(F.col(_VALUE_COLUMNS[name]), F.lit("None"))).cast("bigint").alias(f"_{name}")

    of_method = [size(name) for name in ("method_name", "class_name", "method_code", "package")]
    of_class = [size(name) for name in ("imports", "class_header")]
    sized = methods.select(*ITEM_KEY, "package", "class_identifier", *of_method).join(
        classes.select(*CLASS_KEY, *of_class), CLASS_KEY, "left"
    )
    for name, (edges, on, blocks) in related.items():
        sized = sized.join(_sums(edges, on, blocks, token_count(F.col("block")), f"_{name}"), ITEM_KEY, "left")
    fallback = {"imports": 1, "class_header": 1, **dict.fromkeys(RELATED, len(NO_RELATIONS.split()))}
    counts = [
        sum((F.coalesce(f"_{name}", F.lit(fallback.get(name, 0))) for name in columns), F.lit(own).cast("bigint"))
        for own, columns in parts
    ]
    level = choose_level(counts, budget)
    takes = []
    for name in RELATED:
        users = [number for number, text in enumerate(levels, 1) if name in placeholders(text)]
        takes.append((level.isin(users) & F.col(f"_{name}").isNotNull()).alias(f"take_{name}"))
    tokens = F.try_element_at(F.array(*counts), F.nullif(level, F.lit(0)))
    return sized.select(*ITEM_KEY, level.alias("level"), tokens.alias("tokens"), *takes)


def _candidates(methods, related, budget, counter) -> DataFrame:
    """Which related texts of an item could fit at all, by a measure that adds up.

    White-space tokens of separate blocks add up, but for one that may fuse with the text
    before it.  A user's counter rules nothing out, unless it states how many characters a
    token stands for at most; each block is then held to that.
    """
    block, limit = F.col("block"), None
    if counter is None:
        measure, limit = token_count(block), budget + 1
    elif counter.max_chars_per_token is None:
        measure = F.lit(0)
    else:
        most = counter.max_chars_per_token
        broken = F.length(block) > counter.column(block) * most
        measure = F.when(broken, F.raise_error(F.lit(f"a text has more than {most} characters per token")).cast("int")).otherwise(F.length(block))
        limit = budget * most
    out = methods.select(*ITEM_KEY)
    for name, (edges, on, blocks) in related.items():
        out = out.join(_sums(edges, on, blocks, measure, f"_{name}"), ITEM_KEY, "left")
    columns = []
    for name in related:
        fits = F.lit(True) if limit is None else F.coalesce(f"_{name}", F.lit(0)) < limit
        columns += [fits.alias(f"fits_{name}"), (fits & F.col(f"_{name}").isNotNull()).alias(f"take_{name}")]
    return out.select(*ITEM_KEY, *columns)


def _fits_all(names: set[str]) -> Column:
    fits = F.lit(True)
    for name in RELATED:
        if name in names:
            fits = fits & F.col(f"fits_{name}")
    return fits
