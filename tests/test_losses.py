"""Nothing is lost or mixed up: cases that earlier rounds got wrong."""

import pytest
from pyspark.sql import functions as F

from unitloom.operators.filters import choose_groups, exists_in
from unitloom.operators.joins import link_by_type, resolve_cascade, resolve_references
from unitloom.plans.rounds import OTHER, column_check, infer, repair_rounds, row_check, start_items
from unitloom.sources.files import require_groups
from unitloom.sources.records import CLASS_RECORD, METHOD_RECORD, read_facts_json, write_facts_json
from unitloom.sources.tables import FACT_TABLES, read_fact_tables, write_fact_tables


def repaired(df):
    return df.withColumn("repaired", F.lit("fixed"))


def odd_check():
    return lambda text: ({"good": 0, "bad": 1, "fixed": 0}.get(text), text)


@pytest.mark.parametrize("check", [
    row_check(odd_check),
    column_check(lambda text: F.struct(F.when(text.isin("good", "fixed"), 0).when(text == "bad", 1).alias("code"), text.alias("output")))])
@pytest.mark.parametrize("gate", [None, row_check(lambda: lambda text: (None if text == "fixed" else 0, text))])
def test_items_without_a_code_stay(spark, check, gate):
    items = start_items(spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd"), (4, None)], "id int, text string"))
    out = {r.id: (r.outcome, len(r.events)) for r in repair_rounds(items, check, repaired, 2, gate=gate).collect()}
    assert sorted(out) == [1, 2, 3, 4] and out[3] == (OTHER, 1) and out[4] == (OTHER, 1)
    assert (out[2][0] == OTHER) == (gate is not None)


def test_rounds_read_their_items_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ask(i):
        calls.add(1)
        return "good"
    items = start_items(spark.range(4).withColumn("text", ask.asNondeterministic()("id")))
    assert repair_rounds(items, row_check(odd_check), repaired, 1).count() == 4 and calls.value == 4


def record(spark, path, methods):
    shape = spark.sql(f"select from_json('{{\"filepath\": \"{path}\", \"class_identifier\": \"C\", \"package\": \"p\"}}', '{CLASS_RECORD}') r")
    names = ", ".join(f"named_struct('method_identifier', '{m}')" for m in methods)
    made = f"from_json(to_json(array({names})), 'array<{METHOD_RECORD}>')"
    return shape.select(F.lit("p").alias("project"), F.col("r").alias("class_record"), F.expr(made).alias("methods"))


def test_json_keeps_classes_of_one_name_apart(spark, tmp_path):
    write_facts_json(record(spark, "a/C", ["m", "n"]).unionByName(record(spark, "b/C", ["o"])), str(tmp_path / "j"))
    found = read_facts_json(spark, str(tmp_path / "j")).collect()
    assert sorted((r.class_record.filepath, [m.method_identifier for m in r.methods]) for r in found) == [("a/C", ["m", "n"]), ("b/C", ["o"])]


def test_broken_json_is_an_error(spark, tmp_path):
    write_facts_json(record(spark, "a/C", ["m"]), str(tmp_path / "j"))
    (tmp_path / "j/classes/project=p/extra.json").write_text('{"filepath": "x", \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        read_facts_json(spark, str(tmp_path / "j")).collect()


def test_an_emptied_table_loses_its_old_rows(spark, tmp_path):
    def tables(edges):
        out = {name: spark.createDataFrame([], schema) for name, schema in FACT_TABLES.items()}
        out["projects"] = spark.createDataFrame([("p",)], "project string")
        out["related_methods"] = spark.createDataFrame(edges, FACT_TABLES["related_methods"])
        return out
    write_fact_tables(tables([("p", 1, 2, 0)]), str(tmp_path / "f"))
    assert read_fact_tables(spark, str(tmp_path / "f"))["related_methods"].count() == 1
    write_fact_tables(tables([]), str(tmp_path / "f"))
    found = read_fact_tables(spark, str(tmp_path / "f"), "p")
    assert found["related_methods"].count() == 0 and [tuple(r) for r in found["projects"].collect()] == [("p",)]


def test_lost_groups_are_counted(spark):
    with pytest.raises(ValueError, match="and 5 more"):
        require_groups(spark.range(26).withColumnRenamed("id", "g"), spark.range(1).withColumnRenamed("id", "g"), "g")


def test_hot_keys_of_grouped_lookups_are_split(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = spark.range(60_000, numPartitions=8).select("id", F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("k"))
        known = spark.range(60_000).select(F.col("id").alias("k"), F.col("id").alias("target"))
        scope = known.groupBy("k").agg(F.max("target").alias("value")).withColumn("name", F.lit("n"))
        cascade = resolve_cascade(rows, F.lit("n"), [(scope, ["k"], None, None)], F.lit(-1))
        for joined in (cascade, exists_in(rows, known, ["k"]), choose_groups(rows, "k", known), resolve_references(rows, known, {"k": "k"}, "target"),
                       link_by_type(rows, known, {"k": "k"})):
            joined.write.format("noop").mode("overwrite").save()
            seen = joined._jdf.queryExecution().executedPlan()
            joined.collect()
            assert "skew=true" in seen.toString() or "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hanging_checks_time_out_alone(spark):
    def make():
        import time
        return lambda text: time.sleep(30) if text == "hang" else (0, text)
    items = start_items(spark.createDataFrame([(1, "hang"), (2, "fine")], "id int, text string"))
    rows = {r.id: r.checked for r in row_check(make, time_limit=0.5)(items).collect()}
    assert tuple(rows[1]) == (1, "Timeout") and tuple(rows[2]) == (0, "fine")


def test_models_can_take_lists(spark):
    def make():
        def answer(prompts):
            assert len(prompts) <= 3
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]
        return answer
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "bad", "c", "d", "e"])], "id int, prompt string").coalesce(1)
    rows = {r.id: (r.answer, r.error) for r in infer(df, "prompt", make, at_once=3).collect()}
    assert rows == {0: ("A", None), 1: ("B", None), 2: (None, None), 3: (None, "no"), 4: ("C", None), 5: ("D", None), 6: ("E", None)}
