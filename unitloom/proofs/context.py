"""Budgeted context over orders: an order's parts and suppliers are its related code."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.functions.templates import LEVELS
from unitloom.functions.tokens import TokenCounter
from unitloom.plans.context import gather_context
from unitloom.proofs.registry import proof, table, template_sql, tokens_sql

BUDGET = 260
ORD = 1_000_000_000


def shop_tables(spark, folder):
    """Fact tables in which orders and parts are methods, customers, brands and suppliers classes."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    parts, suppliers, lines = (table(spark, folder, name) for name in ("part", "supplier", "lineitem"))
    project, package = F.lit("shop").alias("project"), F.lit("src").alias("package")

    def classes_of(df, name, text, header, imports):
        return df.select(project, package, name.alias("class_identifier"), text.alias("full_text"), header.alias("header"),
                         imports.alias("imports"), F.concat(F.lit("shop/java/src/"), name).alias("filepath"))

    customer = F.concat(F.lit("Customer"), F.col("c_custkey"))
    supplier = F.concat(F.lit("Supplier"), F.col("s_suppkey"))
    classes = classes_of(
        customers, customer, F.col("c_name"), F.concat_ws(" ", F.lit("segment"), "c_mktsegment"),
        F.concat(F.lit("import nation"), "c_nationkey"),
    ).unionByName(classes_of(
        suppliers, supplier, F.concat_ws(" ", "s_name", F.lit("of nation"), "s_nationkey"), F.lit(""), F.lit(""),
    ))
    methods = orders.select(
        project, package, F.col("o_orderkey").alias("method_id"), F.concat(F.lit("order"), "o_orderkey").alias("method_identifier"),
        F.concat(F.lit("Customer"), "o_custkey").alias("class_identifier"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("full_text"), F.lit(0).alias("ord"),
    ).unionByName(parts.select(
        project, package, (-F.col("p_partkey") - 1).alias("method_id"), F.col("p_name").alias("method_identifier"),
        F.col("p_brand").alias("class_identifier"), F.concat_ws(" ", "p_type", "p_size").alias("full_text"), F.lit(0).alias("ord"),
    ))
    related_methods = lines.select(
        project, F.col("l_orderkey").alias("source_id"), (-F.col("l_partkey") - 1).alias("target_id"),
        (F.col("l_linenumber").cast("bigint") * ORD + F.col("l_partkey")).alias("ord"))
    related_classes = lines.select(
        project, F.col("l_orderkey").alias("method_id"), package,
        F.concat(F.lit("Supplier"), "l_suppkey").alias("class_identifier"),
        (F.col("l_linenumber").cast("bigint") * ORD + F.col("l_suppkey")).alias("ord"))
    return {"classes": classes, "methods": methods, "related_methods": related_methods, "related_classes": related_classes}


_VALUES = {
    "testing_framework": "'JUnit 5'", "mocking_framework": "'Mockito'", "method_name": "name", "class_name": "cls",
    "method_code": "code", "package": "'src'", "imports": "coalesce(imports, 'None')",
    "class_header": "coalesce(header, 'None')", "related_methods": "ms", "related_classes": "cs",
}
_PROMPTS = [template_sql(level, _VALUES) for level in LEVELS]

SHOP_SQL = f"""
    with methods as (
        select o_orderkey as id, 'order' || o_orderkey as name, 'Customer' || o_custkey as cls,
               o_orderstatus || ' ' || o_orderpriority as code, o_custkey as cust from orders
        union all
        select -p_partkey - 1, p_name, p_brand, p_type || ' ' || p_size, null from part),
    ms as (
        select l_orderkey as id, string_agg('Method: ' || name || ' of the class ' || cls || ':' || chr(10) || '```java' || chr(10)
               || code || chr(10) || '```' || chr(10), '' order by l_linenumber, l_partkey) as ms
        from lineitem join methods on id = -l_partkey - 1 group by l_orderkey),
    cs as (
        select l_orderkey as id, string_agg('```java' || chr(10) || s_name || ' of nation ' || s_nationkey || chr(10) || '```' || chr(10),
               '' order by l_linenumber, l_suppkey) as cs
        from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey),
    full_rows as (
        select id, name, cls, code, 'import nation' || c_nationkey as imports, 'segment ' || c_mktsegment as header,
               coalesce(ms, 'No relations found.') as ms, coalesce(cs, 'No relations found.') as cs
        from methods left join ms using (id) left join cs using (id) left join customer on c_custkey = cust),
    prompts as (select id, {", ".join(f"{p} as p{n}" for n, p in enumerate(_PROMPTS, 1))} from full_rows),
    sized as (select *, {", ".join(f"{tokens_sql(f'p{n}')} as t{n}" for n in range(1, 5))} from prompts),
    levels as (select *, case when t1 >= {BUDGET} then 0 when t2 >= {BUDGET} then 1 when t3 >= {BUDGET} then 2
                              when t4 >= {BUDGET} then 3 else 4 end as level from sized)
    select id as method_id, level, cast(case level when 1 then t1 when 2 then t2 when 3 then t3 when 4 then t4 end as bigint) as tokens,
           md5(case level when 1 then p1 when 2 then p2 when 3 then p3 when 4 then p4 end) as prompt
    from levels
"""


@proof(SHOP_SQL)
def budgeted_context(spark, folder):
    found = gather_context(shop_tables(spark, folder), BUDGET)
    return found.select("method_id", "level", "tokens", F.md5("prompt").alias("prompt"))


@proof(SHOP_SQL)
def budgeted_context_with_tokenizer(spark, folder):
    """The same with a tokenizer of the user's, which cannot be added up."""
    def make():
        import re
        return lambda text: len(re.findall(r"\S+", text))

    found = gather_context(shop_tables(spark, folder), BUDGET, counter=TokenCounter(make, max_chars_per_token=64))
    return found.select("method_id", "level", "tokens", F.md5("prompt").alias("prompt"))
