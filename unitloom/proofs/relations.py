"""Filters, joins, aggregates and ordered groups over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.functions.templates import member_title
from unitloom.operators import filters, joins, ordered
from unitloom.plans.context import or_no_relations, render_blocks as blocks_of
from unitloom.proofs.registry import proof, table
from unitloom.sources.files import count_by_group, missing_groups as groups_missing, path_filter as is_source


@proof("""
    with p as (select page_id, url, string_split(url, '/') as parts from pages)
    select page_id, url from p
    where ends_with(parts[len(parts)], '.html') and not contains(parts[len(parts)], '?')
      and not list_contains(parts[1 : len(parts) - 1], 'en')
""")
def path_filter(spark, folder):
    return table(spark, folder, "pages").where(is_source(F.col("url"), ".html", "?", "en")).select("page_id", "url")


@proof("select source, count(*) as n from documents group by source")
def group_counts(spark, folder):
    return count_by_group(table(spark, folder, "documents"), "source")


@proof("""
    select distinct source from documents
    where source not in (select source from documents where n_chars > 30000)
""")
def missing_groups(spark, folder):
    docs = table(spark, folder, "documents")
    return groups_missing(docs, docs.where(F.col("n_chars") > 30000), "source")


@proof("select doc_id, n_chars from documents where not contains(text, 'tion.')")
def exclude_marked(spark, folder):
    return filters.exclude_marked(table(spark, folder, "documents"), "text", "tion.").select("doc_id", "n_chars")


@proof("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def choose_groups(spark, folder):
    chosen = filters.choose_groups(table(spark, folder, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    return chosen.select("o_orderkey", "o_orderpriority")


@proof("""
    select doc_id, source from documents
    where source in (select source from documents where n_chars > 30000)
""")
def choose_groups_by_table(spark, folder):
    docs = table(spark, folder, "documents")
    return filters.choose_groups(docs, "source", docs.where(F.col("n_chars") > 30000)).select("doc_id", "source")


@proof("select p_partkey, p_size from part where p_size between 10 and 30")
def id_range(spark, folder):
    start, end = filters.parse_range("10:30")
    return filters.id_range(table(spark, folder, "part"), "p_size", start, end).select("p_partkey", "p_size")


@proof("select event_id, c_custkey, c_name, c_mktsegment from (select event_id, user_id * 20 as c_custkey from events)"
       " left join customer using (c_custkey)")
def lookup_batch(spark, folder):
    keys = table(spark, folder, "events").select("event_id", (F.col("user_id") * 20).alias("c_custkey"))
    return filters.lookup(keys, table(spark, folder, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"]).select(
        "event_id", "c_custkey", "c_name", "c_mktsegment")


@proof("select c_custkey, c_custkey in (select o_custkey from orders) as ordered from customer")
def exists_in(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    known = filters.exists_in(customers, orders, ["c_custkey"]).withColumn("ordered", F.lit(True))
    absent = filters.exists_in(customers, orders, ["c_custkey"], absent=True).withColumn("ordered", F.lit(False))
    return known.unionByName(absent)


@proof("""
    select l_orderkey, l_linenumber, l_partkey, o_orderpriority, o_orderstatus
    from lineitem join orders on l_orderkey = o_orderkey
""")
def related_bag(spark, folder):
    edges = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    units = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return joins.related_units(edges, units, {"l_orderkey": "o_orderkey"})


@proof("""
    select l_orderkey, l_linenumber, l_partkey, s_name, n_nationkey, n_name
    from lineitem join (select s_suppkey as l_suppkey, s_name, s_nationkey as n_nationkey from supplier) using (l_suppkey)
    join nation using (n_nationkey)
""")
def owner_attribute(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    owned = joins.owner_attribute(lines, suppliers, ["l_suppkey"], ["s_name", "n_nationkey"])
    named = joins.owner_attribute(owned, table(spark, folder, "nation"), ["n_nationkey"], ["n_name"])
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_nationkey", "n_name")


@proof("""
    with known as (select p_type, min(p_partkey) as first_key from part where p_retailprice > 990 group by p_type)
    select p_partkey, p_type, first_key from part join known using (p_type)
""")
def link_by_type(spark, folder):
    parts = table(spark, folder, "part")
    known = parts.where(F.col("p_retailprice") > 990)
    return joins.link_by_type(parts.select("p_partkey", "p_type"), known, {"p_type": "p_type"}, {"first_key": "p_partkey"})


@proof("""
    with first as (select p_brand, p_size, min(p_partkey) as target_id from part where p_retailprice > 940 group by all)
    select l_orderkey, l_linenumber, l_partkey, target_id
    from lineitem join part on l_partkey = p_partkey join first using (p_brand, p_size)
""")
def first_match(spark, folder):
    parts = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    refs = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey")
    targets = parts.where(F.col("p_retailprice") > 940)
    found = joins.resolve_references(refs, targets, {"p_brand": "p_brand", "p_size": "p_size"}, "p_partkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "target_id")


@proof("""
    select event_id, coalesce(case when event_type = 'click' then s_name end, c_name, 'this.' || user_id) as resolved
    from events left join supplier on s_suppkey = user_id left join customer on c_custkey = user_id and event_type <> 'view'
""")
def cascade(spark, folder):
    refs = table(spark, folder, "events").select("event_id", "event_type", F.concat(F.lit("this."), "user_id").alias("ref"))
    bare = F.replace(F.col("ref"), F.lit("this."), F.lit(""))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("value"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("value"))
    scopes = [(suppliers, [], bare, F.col("event_type") == "click"), (customers, [], bare, F.col("event_type") != "view")]
    return joins.resolve_cascade(refs, F.col("ref"), scopes, F.col("ref")).select("event_id", "resolved")


WORDS = "[x for x in string_split(replace(text, chr(10), ' '), ' ') if x <> '']"


@proof(f"""
    with v as (select w[1] as word, cast(min(doc_id) as varchar) as value from (select doc_id, {WORDS} as w from documents) group by 1),
    turns as (select conv_id, turn, {WORDS} as w from conversations),
    items as (select conv_id, turn, w, unnest(range(1, len(w) + 1)) as i from turns),
    hits as (select conv_id, turn, string_agg(value, ',' order by i) as found from items join v on w[i] = word group by 1, 2)
    select conv_id, turn, coalesce(found, '') as found from turns left join hits using (conv_id, turn)
""")
def ordered_lookup(spark, folder):
    def words(df):
        return df.withColumn("w", F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: x != ""))

    known = words(table(spark, folder, "documents")).groupBy(F.get("w", 0).alias("item")).agg(
        F.min("doc_id").cast("string").alias("value"))
    turns = words(table(spark, folder, "conversations")).select("conv_id", "turn", "w")
    found = joins.ordered_lookup(turns, ["conv_id", "turn"], "w", known)
    return found.select("conv_id", "turn", F.array_join("found", ",").alias("found"))


@proof("""
    select conv_id, turn, role, opener, md5(text) as text
    from conversations join (select conv_id, min_by(role, turn) as opener from conversations group by conv_id) using (conv_id)
""")
def attach_members(spark, folder):
    turns = table(spark, folder, "conversations")
    owners = ordered.first_wins(turns, ["conv_id"], "role", ["turn"], "opener")
    found = joins.attach_members(owners, turns, ["conv_id"])
    return found.select("conv_id", "turn", "role", "opener", F.md5("text").alias("text"))


@proof("select o_orderkey, cast(run as integer) as run from orders, (values (1), (2), (3)) as t(run)")
def cross_runs(spark, folder):
    return joins.cross_runs(table(spark, folder, "orders").select("o_orderkey"), 3)


@proof("select count(*) as n from lineitem")
def unit_count(spark, folder):
    return filters.unit_count(table(spark, folder, "lineitem"))


@proof("select event_type, count(*) as n from events group by event_type")
def unit_count_by_group(spark, folder):
    return filters.unit_count(table(spark, folder, "events"), ["event_type"])


@proof("""
    with r as (select conv_id, text, row_number() over (partition by conv_id order by turn) as i from conversations)
    select conv_id, cast((i - 1) // 4 as bigint) as part, md5(string_agg(text, chr(10) order by i)) as text
    from r group by 1, 2
""")
def ordered_join(spark, folder):
    turns = table(spark, folder, "conversations")
    parts = ordered.ordered_parts(turns, ["conv_id"], F.col("text"), ["turn"], rows_per_part=4)
    return parts.withColumn("text", F.md5("text"))


@proof("""
    with b as (select o_custkey, o_orderkey, 'Method: ' || o_orderkey || ' of the class ' || o_custkey || ':' || chr(10) || '```sql' || chr(10)
                      || o_orderstatus || ' ' || o_orderpriority || chr(10) || '```' || chr(10) as block,
                      row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
    p as (select o_custkey as c_custkey, cast((i - 1) // 10 as bigint) as part, string_agg(block, '' order by i) as blocks from b group by 1, 2)
    select c_custkey, coalesce(part, 0) as part, md5(coalesce(blocks, 'No relations found.')) as blocks
    from customer left join p using (c_custkey)
""")
def render_blocks(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    title = member_title(F.col("o_orderkey").cast("string"), F.col("c_custkey").cast("string"))
    text = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    made = blocks_of(orders, ["c_custkey"], ["o_orderkey"], text, title, "sql", rows_per_part=10)
    all_customers = table(spark, folder, "customer").select("c_custkey").join(made, "c_custkey", "left")
    return all_customers.select("c_custkey", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
                                F.md5(or_no_relations(F.col("blocks"))).alias("blocks"))


CENTS = "cast(round(value * 100) as bigint)"


@proof(f"select user_id, event_type, arg_max({CENTS}, (ts, event_id)) as value from events group by 1, 2")
def last_wins(spark, folder):
    events = table(spark, folder, "events").withColumn("cents", F.expr(CENTS))
    return ordered.last_wins(events, ["user_id", "event_type"], "cents", ["ts", "event_id"])


@proof(f"select user_id, event_type, arg_min({CENTS}, (ts, event_id)) as value from events group by 1, 2")
def first_wins(spark, folder):
    events = table(spark, folder, "events").withColumn("cents", F.expr(CENTS))
    return ordered.first_wins(events, ["user_id", "event_type"], "cents", ["ts", "event_id"])


@proof(f"""
    with l as (select user_id, event_type, arg_max({CENTS}, (ts, event_id)) as value from events group by 1, 2)
    select user_id, string_agg(event_type || '=' || value, ',' order by event_type) as entries from l group by user_id
""")
def last_wins_map(spark, folder):
    events = table(spark, folder, "events").withColumn("cents", F.expr(CENTS))
    made = ordered.last_wins_map(events, ["user_id"], "event_type", "cents", ["ts", "event_id"], "entries")
    pairs = F.transform(F.sort_array(F.map_entries("entries")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("user_id", F.array_join(pairs, ",").alias("entries"))


@proof("select doc_id, source, row_number() over (partition by source order by doc_id) as id from documents")
def assign_ids(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return ordered.assign_ids(docs, ["source"], ["doc_id"])


@proof("""
    with b as (select conv_id, turn, text, lag(role) over w as r, lag(text) over w as t from conversations
               window w as (partition by conv_id order by turn))
    select conv_id, turn, md5(case when r = 'user' then t || chr(10) || text else text end) as text from b
""")
def attach_previous(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = ordered.attach_previous(turns, ["conv_id"], ["turn"], "text", F.col("role") == "user", rows_per_slice=3)
    return made.select("conv_id", "turn", F.md5("text").alias("text"))
