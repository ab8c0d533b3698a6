"""SQL functions against the column builders that they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from quillmeter.functions.cost import cost_usd, one_hour_writes
from quillmeter.functions.models import candidate_keys
from quillmeter.functions.sql import FROM_COLUMNS, register
from quillmeter.schema import PRICE, TOKENS

TEXTS = ["2026-08-01T00:00:00Z", "2026-02-31", "1969-12-31 23:59:59.5-08:00", "x", "", None, "C:\\Users\\Me\\", "//Server/Share", " /a//b/ ", "a'b\\c.d", "/", "é" * 30]
MS = [0, -1, 1_785_542_400_123, 8_640_000_000_000_000, 8_640_000_000_000_001, None]
MODELS = ["gpt-5", "openai/gpt-5", "us.anthropic.claude-opus-4-6-20260115-v1:0", "a/b/claude-x-4.5-2026-01-02", "eu.x", "", "/", "claude-3-5", None]


@pytest.fixture(scope="module")
def names(spark):
    return register(spark)


def same(df, made, sql):
    rows = df.select(made.alias("a"), F.expr(sql).alias("b")).collect()
    assert rows and [r["a"] for r in rows] == [r["b"] for r in rows]


@pytest.mark.parametrize("name", sorted(FROM_COLUMNS))
def test_builders(spark, names, name):
    parameters, _, builder = FROM_COLUMNS[name]
    if "ms BIGINT" in parameters:
        df = spark.createDataFrame([(m, z) for m in MS[:3] + MS[5:] for z in ("UTC", "Asia/Kolkata")] + ([(m, "UTC") for m in MS] if "tz" not in parameters else []), "ms bigint, tz string")
        arguments = ["ms"] + ["tz"] * ("tz" in parameters)
    else:
        df, arguments = spark.createDataFrame([(t,) for t in TEXTS], "v string"), ["v"]
    same(df, builder(*[F.col(a) for a in arguments]), f"{name}({', '.join(arguments)})")


def test_candidate_keys(spark, names):
    df = spark.createDataFrame([(m,) for m in MODELS], "m string")
    same(df, candidate_keys(F.col("m")), "candidate_keys(m)")
    df.createOrReplaceTempView("models_of_test")
    ranked = spark.sql("SELECT m, k.key_rank, k.key FROM models_of_test, LATERAL ranked_keys(m) k")
    assert {(r["m"], r["key_rank"], r["key"]) for r in ranked.collect()} == {(r["m"], r["pos"], r["col"]) for r in df.select("m", F.posexplode(candidate_keys(F.col("m")))).collect()}


def test_cost(spark, names):
    r = random.Random(5)
    some = lambda x: None if r.random() < 0.2 else x

    def tier(threshold):
        return (float(threshold), r.random(), r.random(), some(r.random()), some(r.random()), some(r.random()))

    def price():
        tiers = some([tier(t) for t in r.sample([200, 100, 400], r.randrange(4))])
        return some((r.random(), r.random(), some(r.random()), some(r.random()), some(r.random()), tiers, some("whole-request") if r.random() < 0.5 else None))

    rows = [((r.randrange(300), r.randrange(300), some(r.randrange(300)), some(r.randrange(200)), some(r.randrange(-5, 300)), some(r.randrange(9))) if k else (0, 0, 0, 0, None, 0), price()) for k in range(300)]
    df = spark.createDataFrame(rows, f"tokens {TOKENS}, price {PRICE}")
    same(df, one_hour_writes(F.col("tokens")), "one_hour_writes(tokens)")
    same(df, F.round(cost_usd(F.col("tokens"), F.col("price")), 12), "round(cost_usd(tokens, price), 12)")


def test_the_example_of_the_readme(spark, names):
    spark.createDataFrame([("a/m", 0, (1_000_000, 0, 0, 0, None, 0)), ("x", 1, (1, 0, 0, 0, None, 0))], f"model string, ts_ms bigint, tokens {TOKENS}").createOrReplaceTempView("usage_of_test")
    spark.createDataFrame([("a/m", (2.0, 1.0, None, None, None, None, None))], f"key string, price {PRICE}").createOrReplaceTempView("prices_of_test")
    found = spark.sql("""SELECT day_key(ts_ms, 'Europe/Berlin') AS day, sum(cost_usd(tokens, price)) AS usd
FROM (SELECT *, candidate_keys(model) AS keys FROM usage_of_test) u JOIN prices_of_test p ON p.key = u.keys[0] GROUP BY 1""")
    assert [tuple(r) for r in found.collect()] == [("1970-01-01", 2.0)]


def test_ranked_keys_are_made_after_grouping(spark, names):
    """No keys are made of the rows that the caller's DISTINCT has yet to group."""
    spark.range(1000).select(F.concat(F.lit("openai/gpt-"), (F.col("id") % 3).cast("string")).alias("m")).createOrReplaceTempView("rows_of_models")
    keys = spark.sql("SELECT d.m, k.key_rank, k.key FROM (SELECT DISTINCT m FROM rows_of_models) d, LATERAL ranked_keys(d.m) k")
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "array_distinct" in line]
    made = spark.table("rows_of_models").distinct().select("m", F.posexplode(candidate_keys(F.col("m"))))
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, made.collect()))
