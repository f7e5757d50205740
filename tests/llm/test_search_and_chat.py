"""Top-k search and chat formatting: brute force, round trips and odd inputs."""

import json
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from unitloom.llm import chat_format, topk_search

VECTORS = "vec_id long, embedding array<float>, score string"


def brute(rows, k, divisor=50, scale=256):
    usable = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * scale).astype(int)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for n, (i, q) in enumerate(usable):
        if i % divisor == 0:
            scores = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out |= {(n, i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)}
    return sorted(x[1:] for x in out)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # ties
    rows += [(7, rows[3][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6),
             (503, [float("inf")] * 6), (None, rows[1][1]), (550, [0.5, -0.5]), (551, [0.1, 0.1]), (600, []), (601, [])]
    df = spark.createDataFrame([(*row, "x") for row in rows], VECTORS)
    found = topk_search.top_k(df, k=4, block_rows=37, chunk_queries=3).collect()
    assert sorted(map(tuple, found)) == sorted((q, r, v, s) for q, r, v, s in brute(rows, 4))


def test_search_of_an_empty_table(spark):
    assert topk_search.top_k(spark.createDataFrame([], VECTORS)).collect() == []


def test_every_finite_vector_takes_part(spark):
    """Components past a machine word, whose scores with small vectors still fit; a returned score that does not is an error."""
    rows = [(0, [0.0, 1.0, 0.0]), (50, [1.0, 0.0, -2.0]), (1, [9e5, 2.0, 9e5]), (2, [0.0, 3.0, 2.0 ** 40]), (3, [0.0, -1.0, 3e38]),
            (4, [0.0, 2.5, -3e38]), (5, [3.0 ** 30, 0.25, 0.0])]
    exact = [(i, [int(Fraction(float(np.float32(x))) * 256 // 1) for x in v]) for i, v in rows]
    score = {(i, j): sum(a * b for a, b in zip(v, w)) for i, v in exact for j, w in exact if i != j}
    df = spark.createDataFrame([(*row, "x") for row in rows], VECTORS)
    found = topk_search.top_k(df.where("vec_id <> 50"), k=9, block_rows=2).collect()
    best = sorted((j for i, j in score if i == 0 and j != 50), key=lambda j: (-score[0, j], j))
    assert sorted(map(tuple, found)) == [(0, n + 1, j, score[0, j]) for n, j in enumerate(best)]
    with pytest.raises(Exception, match="passes 64 bits"):
        topk_search.top_k(df, k=1, block_rows=2).collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=2, max_size=140), st.integers(1, 6))
def test_bit_sliced_selection(values, k):
    rows = pd.DataFrame({"vec_id": range(len(values)), "dim": 3, "q": values})
    index = topk_search.build_index(rows)
    at, vec, score = topk_search.search_block(index, np.array([0]), np.array([[-3, 0, 5]]), k)
    exact = sorted((-(-3 * v[0] + 5 * v[2]), i) for i, v in enumerate(values) if i != 0)[:k]
    assert sorted(zip(score, vec), key=lambda x: (-x[0], x[1])) == [(-s, i) for s, i in exact]


CONTROL = st.text(alphabet=st.sampled_from(list("</s>[INT] \\a\n")), max_size=40)


def test_format_reads_back(spark):
    texts = ["", "\\", "\\\\", "</s>", "<\\/s>", "<s>[INST] x [/INST]</s>", "[/INST", " [/INST]", "<", "</s", "\n", "é</s>ß", "[INST] \\[INST] "]
    rows = [(n, turn, role, text) for n, text in enumerate(texts) for turn, role in ((0, "user"), (1, "assistant"), (2, "a</s>[INST] b"))]
    rows += [(100, 0, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    out = chat_format.formatted(chat_format.records_of(df)).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"),
        chat_format.loss_text(F.col("formatted"), F.col("spans")).alias("loss")).collect()
    for row in out:
        wanted = sorted((t, r or "", x or "") for c, t, r, x in rows if c == row.conv_id)
        assert [(t.role, t.text) for t in row.back] == [(r, x) for _, r, x in wanted]
        assert row.loss == "".join(x for _, r, x in wanted if r == "assistant")
        assert row.formatted.count("</s>") == len(wanted)


@pytest.mark.parametrize("seed", range(3))
def test_escaping_is_reversible(spark, seed):
    import random
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["<", "/", "s>", "[", "INST]", "\\", "x", "</s>", "[/INST]"]) for _ in range(rng.randrange(25))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u")).collect():
        assert row.u == row.t and not any(c in row.e for c in chat_format.CONTROLS)


def test_fingerprints_select_mappings(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"completion": "c", "prompt": "p"}, {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "n", "output": "o"}, {"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"messages": []}, {"question": "q", "answer": None},
        {"something": "else"}, 3]
    wanted = [
        [("user", "p"), ("assistant", "c")], [("user", "p"), ("assistant", "c")], [("user", "i"), ("assistant", "o")],
        [("user", "i\n\nn"), ("assistant", "o")], [("user", "u"), ("assistant", "a")], [("user", "h"), ("assistant", "g")], [],
        [("user", "q"), ("assistant", "")], None, None]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "{no json"), (21, None)]
    out = {r.id: r.turns for r in chat_format.formatted(spark.createDataFrame(rows, "id int, record string")).collect()}
    assert [out[i] and [tuple(t) for t in out[i]] if out[i] else out[i] for i in range(len(records))] == wanted
    assert out[20] is None and out[21] is None


def test_formatting_stays_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.formatted(chat_format.records_of(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat_format.records_of(df.limit(0)).collect() == []


def test_long_messages_are_formatted(spark):
    df = spark.range(1).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("0123456789"), F.lit(2_000_001)).alias("text"))
    out = chat_format.formatted(chat_format.records_of(df)).select(F.size("turns"), F.length("formatted"), "fingerprint").first()
    short = chat_format.formatted(chat_format.records_of(df.withColumn("text", F.lit("x")))).select("fingerprint").first()
    assert tuple(out) == (1, 20_000_010 + 26, short[0])
    record = F.concat(F.lit('{"question": "q", "answer": "'), "text", F.lit('"}'))
    with pytest.raises(Exception, match="too long to be parsed"):
        chat_format.formatted(df.select(record.alias("record"))).select("turns").collect()
