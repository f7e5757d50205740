"""Node-table operators over the tags of pages."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from unitloom.operators.nodes import children, descendants, first_below
from unitloom.proofs.registry import proof, table

TAGS = r"</?[a-z][a-z0-9]*[^>]*>"


def tag_nodes(spark, folder):
    """Tags as nodes: an opening tag reaches to the next closing tag of its name.

    Ids are positions among the page's tags, times 100, so that attributes fit between.
    """
    tags = table(spark, folder, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("pos", "tag"))
    name = F.regexp_extract("tag", r"^</?([a-z0-9]+)", 1)
    closing = F.col("tag").startswith("</")
    rest = Window.partitionBy("page_id", "name").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = tags.withColumn("name", name).withColumn("end", F.last(F.when(closing, F.col("pos")), ignorenulls=True).over(rest))
    node_id = (F.col("pos") * 100).cast("int")
    return found.select(
        F.col("page_id").alias("file_id"), node_id.alias("node_id"),
        F.when(closing | F.col("end").isNull(), node_id + 99).otherwise((F.col("end") * 100).cast("int")).alias("last_desc_id"),
        F.lit(0).alias("parent_id"), F.col("pos").alias("ord"), F.when(closing, F.concat(F.lit("/"), "name")).otherwise(F.col("name")).alias("type"),
        F.lit(True).alias("is_named"), F.lit(None).cast("string").alias("field_name"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), "tag")


TAG_SQL = r"""
    with t as (select page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*[^>]*>') as ts from pages),
    tags as (select page_id, ts[i] as tag, i - 1 as pos from (select page_id, ts, unnest(range(1, len(ts) + 1)) as i from t)),
    named as (select page_id, pos, tag, regexp_extract(tag, '^</?([a-z0-9]+)', 1) as name, starts_with(tag, '</') as closing from tags),
    ended as (select *, min(case when closing then pos end) over
                (partition by page_id, name order by pos rows between current row and unbounded following) as e from named),
    nodes as (select page_id, cast(pos * 100 as integer) as node_id, tag,
                     cast(case when closing or e is null then pos * 100 + 99 else e * 100 end as integer) as last_id,
                     case when closing then '/' || name else name end as type from ended)
"""


@proof(TAG_SQL + """
    select d.page_id as file_id, a.node_id as ancestor_id, a.type as ancestor_type, d.node_id, d.type
    from nodes a join nodes d on a.page_id = d.page_id and d.node_id between a.node_id and a.last_id
    where a.type in ('nav', 'ul', 'article', 'footer') and d.type in ('a', 'p', 'li', 'h1', 'nav')
""")
def tag_descendants(spark, folder):
    nodes = tag_nodes(spark, folder)
    around = nodes.where(F.col("type").isin("nav", "ul", "article", "footer"))
    inside = nodes.where(F.col("type").isin("a", "p", "li", "h1", "nav")).select("file_id", "node_id", "type")
    found = descendants(around, inside, ids_per_bucket=512)
    kinds = around.select("file_id", F.col("node_id").alias("ancestor_id"), F.col("type").alias("ancestor_type"))
    return found.join(kinds, ["file_id", "ancestor_id"]).select("file_id", "ancestor_id", "ancestor_type", "node_id", "type")


@proof(TAG_SQL + """
    select a.page_id as file_id, a.node_id, a.type, min(d.node_id) as first_id
    from nodes a left join nodes d on a.page_id = d.page_id and d.type = 'p' and d.node_id between a.node_id and a.last_id
    where a.type in ('nav', 'ul', 'article', 'p', 'footer') group by all
""")
def first_descendant(spark, folder):
    found = first_below(tag_nodes(spark, folder), first=(F.col("type") == "p", F.struct("node_id")))
    wanted = found.where(F.col("type").isin("nav", "ul", "article", "p", "footer"))
    return wanted.select("file_id", "node_id", "type", F.col("first.node_id").alias("first_id"))


@proof(TAG_SQL + r"""
    , attrs as (select page_id, node_id, type, regexp_extract_all(tag, '([a-z]+)="[^"]*"', 1) as ns,
                       regexp_extract_all(tag, '[a-z]+="([^"]*)"', 1) as vs from nodes),
    single as (select *, unnest(range(1, len(ns) + 1)) as i from attrs)
    select page_id as file_id, node_id as tag_id, type as tag, cast(i - 1 as integer) as ord, vs[i] as value
    from single where ns[i] in ('href', 'class') and type in ('a', 'div')
""")
def tag_children(spark, folder):
    tags = tag_nodes(spark, folder)
    names = F.regexp_extract_all("tag", F.lit('([a-z]+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all("tag", F.lit('[a-z]+="([^"]*)"'), F.lit(1))
    attributes = tags.select("file_id", F.col("node_id").alias("parent_id"), F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("ord", "a")).select(
        "file_id", "parent_id", "ord", F.lit("attribute").alias("type"), F.col("a.n").alias("field_name"), F.col("a.v").alias("value"))
    parents = tags.where(F.col("type").isin("a", "div"))
    kept = {"type": "tag", "node_id": "tag_id"}
    found = children(parents, attributes, "attribute", "href", kept).unionByName(children(parents, attributes, None, "class", kept))
    return found.select("file_id", "tag_id", "tag", "ord", "value")


@proof(r"""
    with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as ls from pages)
    select page_id, cast(i - 1 as integer) as ord, ls[i] as link
    from (select page_id, ls, unnest(range(1, len(ls) + 1)) as i from l)
""")
def facts_from_text(spark, folder):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select("page_id", F.posexplode(links).alias("ord", "link"))
