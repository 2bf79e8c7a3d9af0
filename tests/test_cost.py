"""What queries move and compute, read from their plans, and the same rows on odd tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vakanz.operators import listing, preferences, upsert
from vakanz.plans import load
from vakanz.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan_of(df).count("Exchange hashpartitioning")


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")


def test_ordered_distinct_moves_texts_not_words(spark, tmp_path):
    """no word is a row of a shuffle; an id that occurs twice is one text, as in the SQL."""
    rows = [(1, "b a  B c"), (2, None), (3, "   "), (4, "x y"), (4, "Y z X"), (None, "n n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = load().QUERIES["ordered_distinct"](spark, str(tmp_path))
    assert exchanges(df) == 1 and "posexplode" not in plan_of(df)
    assert {r.doc_id: r.n_terms for r in df.collect()} == {1: 3, 4: 3, None: 1}


def test_duplicate_members_computes_a_key_once(spark, sf_dir):
    """a key made of a whole text is computed for one exchange that both sides read."""
    df = load().QUERIES["duplicate_members"](spark, sf_dir)
    assert plan_of(df).count("sha2(") <= 2
    rows = spark.createDataFrame([("k", "s", 1), ("k", "t", 2), ("l", "s", 3), (None, "s", 4), (None, "s", 5)],
                                 "key string, source string, id long")
    found = upsert.duplicate_members(rows, "key", "source", "id").collect()
    assert sorted((r.key, r.id, r.members, r.first_member) for r in found) == [("k", 1, 2, 1), ("k", 2, 2, 1)]


def test_preference_lines_are_parsed_once_by_few_patterns(spark, sf_dir):
    """the parsers are bound once, and settings and issues come from one reading of the lines."""
    for name in ("preference_issues", "preference_compile"):
        plan = plan_of(load().QUERIES[name](spark, sf_dir))
        assert 0 < sum(plan.count(word) for word in ("translate(", "locate(", "regexp_", "RLIKE")) < 200
        assert plan.count("Generate explode") <= 2
        assert plan.count("posexplode") == 1


def test_preference_lines_of_any_owner_keep_their_issues(spark):
    """An owner without settings, a null owner, blank and null texts."""
    rows = [(1, "Maximum travel: 20 %"), (2, "hello"), (None, "hello"), (3, " \n "), (4, None)]
    fields = "employment_types contract_types languages industries company_sizes preferred_states".split()
    lists = [F.array().cast("array<string>").alias(f) for f in (*fields, "primary_role_terms", "additional_role_terms")]
    current = spark.createDataFrame([(1,), (3,), (4,)], "k long").select(
        "k", *lists, F.lit(False).alias("include_germany_remote"), F.lit(None).cast("string").alias("workplace_preference"),
        *[F.lit(1.0).alias(f"{m}_weight") for m in preferences.MODES], F.lit(70).alias("commute_penalty_minutes"),
        F.lit(60).alias("max_commute_minutes"), *[F.lit(5).cast("bigint").alias(n) for n in preferences.NUMBERS])
    values, issues = preferences.compile_preferences(current, spark.createDataFrame(rows, "k long, prompt string"), "k")
    assert {r.k: r.max_travel_percent for r in values.collect()} == {1: 20, 3: 5, 4: 5}
    assert Counter((r.k, r.line_number, r.line, r.code) for r in issues.collect()) == Counter([
        (None, 1, "hello", "unknown_instruction"), (2, 1, "hello", "unknown_instruction"),
        *[(k, 0, "", "commute_order") for k in (1, 3, 4)]])


def test_deep_pages_meet_by_row_number(spark):
    """rows are dealt by their number; dealt by section, one of two sections is half a table in one task."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 < 2, "a").when(F.col("id") < 3000, "b").alias("s"))
    page = listing.section_pages(df, "s", [F.col("id").desc()], 2000, 600)
    joins = [line for line in plan_of(page).split("\n") if "Join" in line]
    assert joins and not any("[s#" in line for line in joins)
    rows = page.orderBy("s", "position").collect()
    assert [(r.s, r.position, r.total, r.has_more) for r in rows] == [("a", p, 4000, True) for p in range(2001, 2601)]
    assert [r.id for r in rows] == [i for i in range(5999, -1, -1) if i % 3 < 2][2000:2600]
    last = listing.deep_pages(df, "s", [F.col("id").desc()], 900, 200).filter("s = 'b'").collect()
    assert len(last) == 100 and not last[0].has_more
    assert listing.deep_pages(df, "s", [F.col("id").desc()], 0, 0).count() == 0


def test_state_is_written_in_few_files(spark, tmp_path):
    """the rows of a bucket meet before they are written; else every task leaves a file in every bucket."""
    store = jobs.KeyedRows(spark, str(tmp_path / "state"), "key long, at timestamp, tie long, value string", buckets=4)
    rows = spark.range(0, 400, 1, 8).select(
        F.col("id").alias("key"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("tie"), F.lit("v").alias("value"))
    store.replace(rows)
    assert len(store.read().inputFiles()) == 4
    store.replace(rows.filter("key % 2 = 0").union(rows.filter("key % 2 = 1")))
    assert store.read().count() == 400 and store.read().select("key").distinct().count() == 400
