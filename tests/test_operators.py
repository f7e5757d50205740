"""Joins, ordered groups and tree ranges, with hot groups."""

import random

from pyspark.sql import functions as F

from unitloom.operators import filters, joins, nodes, ordered


def hot_rows(spark):
    """One group holds most rows, and another spans a few."""
    rows = [("hot", i) for i in range(4000)] + [("b", i) for i in range(7)] + [(None, 1), ("c", 5)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, k int")


def test_positions_of_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ordered.positions(hot_rows(spark), ["g"], ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(made) == 4009
    for row in made:
        assert row.position == (1 if row.g in (None, "c") else row.k + 1)


def test_parts_keep_every_row(spark):
    parts = ordered.ordered_parts(hot_rows(spark).where("g is not null"), ["g"], F.col("k").cast("string"), ["k"], ",", rows_per_part=1000)
    rows = {(r.g, r.part): r.text.split(",") for r in parts.collect()}
    assert {key: len(v) for key, v in rows.items()} == {**{("hot", i): 1000 for i in range(4)}, ("b", 0): 7, ("c", 0): 1}
    assert sum((rows["hot", i] for i in range(4)), []) == [str(i) for i in range(4000)]


def test_previous_across_slices(spark):
    df = hot_rows(spark).where("g = 'hot'").withColumn("t", F.col("k").cast("string"))
    made = ordered.attach_previous(df, ["g"], ["k"], "t", F.col("k") % 2 == 0, rows_per_slice=10).collect()
    assert len(made) == 4000
    for row in made:
        assert row.t == (f"{row.k - 1}\n{row.k}" if row.k % 2 else str(row.k))


def test_no_text_is_range_partitioned(spark, monkeypatch):
    """Only keys are dealt by range; texts meet their numbers by hash of the whole key."""
    written, real = [], ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, label="step": written.append(df) or real(df, label))
    df = hot_rows(spark).withColumn("t", F.col("k").cast("string"))
    lines = ordered.ordered_lines(df, ["g"], F.col("t"), ["k"])
    led = ordered.attach_previous(df, ["g"], ["k"], "t", F.col("k") % 2 == 0)
    assert lines.columns == ["g", "position", "text"]
    assert {(r.g, r.position): r.text for r in lines.where("g = 'hot'").collect()} == {("hot", i + 1): str(i) for i in range(4000)}
    ranged = [frame for frame in written if "rangepartitioning" in frame._jdf.queryExecution().executedPlan().toString()]
    assert len(ranged) == 2 and all(set(frame.columns) == {"g", "k", "_slice", "_row"} for frame in ranged)
    for made in (lines, led):
        assert "rangepartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_null_keys_and_texts_are_placed(spark):
    rows = [(None, None, "a", True), (None, 1, None, True), (None, 2, "c", None), ("g", None, "d", True), ("g", 5, "e", False), ("g", 6, "f", True)]
    df = spark.createDataFrame(rows, "g string, k int, t string, take boolean")
    placed = {(r.g, r.k): (r.position, r.t) for r in ordered.positions(df, ["g"], ["k"]).collect()}
    assert placed == {(None, None): (1, "a"), (None, 1): (2, None), (None, 2): (3, "c"), ("g", None): (1, "d"), ("g", 5): (2, "e"), ("g", 6): (3, "f")}
    led = {(r.g, r.k): r.t for r in ordered.attach_previous(df, ["g"], ["k"], "t", F.col("take")).collect()}
    assert led == {(None, None): "a", (None, 1): None, (None, 2): "c", ("g", None): "d", ("g", 5): "d\ne", ("g", 6): "f"}
    empty = df.where("false")
    assert ordered.positions(empty, ["g"], ["k"]).count() == 0 and ordered.attach_previous(empty, ["g"], ["k"], "t", F.col("take")).count() == 0
    assert [r.position for r in ordered.positions(df.select("t"), [], ["t"]).orderBy("position").collect()] == [1, 2, 3, 4, 5, 6]


def test_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.value for r in ordered.last_wins(df, ["k"], "v", ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r.k: r.value for r in ordered.first_wins(df, ["k"], "v", ["o"]).collect()} == {"a": "x", "b": "z"}
    named = df.withColumn("owner", F.lit(1))
    assert ordered.last_wins_map(named, ["owner"], "k", "v", ["o"], "m").first().m == {"a": "y", "b": "z"}
    lines = ordered.ordered_join(named, ["owner"], F.col("v"), ["o", "k"]).first()
    assert lines.text == "x\nz\ny"


def test_references(spark):
    targets = spark.createDataFrame([(3, "m", "A"), (1, "m", "A"), (2, "n", "A")], "id int, name string, owner string")
    refs = spark.createDataFrame([(9, "m", "A"), (9, "m", "A"), (9, "n", "A"), (9, "x", "A")], "source int, call string, cls string")
    made = joins.resolve_references(refs, targets, {"call": "name", "cls": "owner"}, "id")
    assert sorted(tuple(r) for r in made.collect()) == [(9, "m", "A", 1), (9, "m", "A", 1), (9, "n", "A", 2)]


def test_cascade_order(spark):
    refs = spark.createDataFrame([(1, "a", "id"), (1, "b", "id"), (1, "this.c", "field_access"), (1, "c", "id"), (1, "d", "id")],
                                 "m int, n string, kind string")
    scope = lambda *pairs: spark.createDataFrame([(1, *p) for p in pairs], "m int, name string, value string")
    scopes = [(scope(("a", "L")), ["m"], None, None), (scope(("a", "P"), ("b", "P")), ["m"], None, None),
              (scope(("c", "F")), ["m"], F.replace("n", F.lit("this."), F.lit("")), F.col("kind") == "field_access")]
    made = joins.resolve_cascade(refs, F.col("n"), scopes, F.col("n"))
    assert {r.n: r.resolved for r in made.collect()} == {"a": "L", "b": "P", "this.c": "F", "c": "c", "d": "d"}
    assert made.columns == ["m", "n", "kind", "resolved"]


def test_ordered_lookup(spark):
    df = spark.createDataFrame([(1, ["x", "y", "x", "z"]), (2, []), (3, ["q"])], "k int, items array<string>")
    known = spark.createDataFrame([("x", "X"), ("z", "Z")], "item string, value string")
    assert {r.k: r.found for r in joins.ordered_lookup(df, ["k"], "items", known).collect()} == {1: ["X", "X", "Z"], 2: [], 3: []}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert [r.id for r in filters.id_range(df, "id", *filters.parse_range("2:3")).collect()] == [2, 3]
    assert [r.id for r in filters.exists_in(df, df.where("id = 1"), ["id"], absent=True).collect()] == [2, 3]
    keys = spark.createDataFrame([(3,), (9,)], "id int")
    assert sorted((r.id, r.v) for r in filters.lookup(keys, df, ["id"], ["v"]).collect()) == [(3, "c"), (9, None)]
    assert sorted(r.run for r in joins.cross_runs(df.where("id = 1"), 3).collect()) == [1, 2, 3]


def random_tree(spark, size, seed):
    pick, parents = random.Random(seed), [None]
    for node in range(1, size):
        parents.append(pick.randrange(max(0, node - 6), node))
    # renumber in preorder
    below = {}
    for node, parent in enumerate(parents):
        below.setdefault(parent, []).append(node)
    rows, stack = [], []

    def walk(node, parent, ord_):
        me = len(rows)
        rows.append(None)
        for place, child in enumerate(below.get(node, [])):
            walk(child, me, place)
        rows[me] = (1, me, len(rows) - 1, parent, ord_, pick.choice("abc"), True, None, me, me)

    walk(0, None, 0)
    return rows, spark.createDataFrame(rows, nodes.NODE_SCHEMA)


def test_ranges_against_brute_force(spark):
    rows, df = random_tree(spark, 300, 5)
    a = [r for r in rows if r[5] == "a"]
    wanted = {(x[1], y[1]) for x in a for y in rows if y[5] == "b" and x[1] <= y[1] <= x[2]}
    for ids_per_bucket in (7, 256):
        made = nodes.descendants(df.where("type = 'a'"), df.where("type = 'b'"), ids_per_bucket).collect()
        assert len(made) == len(wanted) and {(r.ancestor_id, r.node_id) for r in made} == wanted
    firsts = nodes.first_below(df, first=(F.col("type") == "b", F.struct("node_id"))).collect()
    for row in firsts:
        inside = [y[1] for y in rows if y[5] == "b" and row.node_id <= y[1] <= row.last_desc_id]
        assert (row.first.node_id if row.first else None) == (min(inside) if inside else None)
    kids = nodes.children(df.where("type = 'a'"), df, "b").collect()
    assert {r.node_id for r in kids} == {y[1] for y in rows if y[5] == "b" and y[3] is not None and rows[y[3]][5] == "a"}


def test_range_join_is_an_equi_join(spark):
    _, df = random_tree(spark, 50, 1)
    plan = nodes.descendants(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_key_is_split(spark):
    """A target with a third of all edges: the skew rule splits its rows, and all of them arrive."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        edges = spark.range(0, 60000, 1, 8).select(
            F.col("id").alias("source"), F.when(F.col("id") < 20000, 7).otherwise(F.col("id") % 5000).alias("target"),
            F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        units = spark.range(5000).select("id", F.concat(F.lit("u"), "id").alias("text"))
        made = joins.related_units(edges, units, {"target": "id"})
        assert made.groupBy("source").agg(F.count("*").alias("n")).where("n = 1").count() == 60000
        rows = made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 60000 and all(r.text == f"u{r.target}" for r in rows)
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
