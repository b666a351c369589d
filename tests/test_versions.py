"""Tables in versions: only touched buckets are rewritten, versions stay readable, a dead batch changes nothing."""

import pytest
from pyspark.sql import functions as F

from canopy.operators.versions import VersionedTable
from canopy.sources.scratch import scratch_dir

SCHEMA = "namespace string, page_id long, title string, embedding array<float>, extracted_at timestamp_ntz"


def pages(spark, ids, title, at):
    return spark.createDataFrame([("ns", i, f"{title} {i}", [float(i), 0.5]) for i in ids],
                                 "namespace string, page_id long, title string, embedding array<float>") \
        .withColumn("extracted_at", F.to_timestamp_ntz(F.lit(at)))


@pytest.fixture()
def table(spark):
    return VersionedTable.create(scratch_dir(spark, "versions"), pages(spark, range(200), "old", "2025-10-01 00:00:00"),
                                 ["namespace", "page_id"], buckets=16)


def test_an_upsert_rewrites_the_touched_buckets_only(spark, table):
    before = table.manifest()
    files = {f for f in table.read().select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    touched = table.upsert(pages(spark, [3, 900], "new", "2025-11-01 00:00:00"))
    after = table.manifest()
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == touched
    now = {f for f in table.read().select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(now - files) <= 2 and len(now & files) == len(files) - len(touched)
    rows = {r.page_id: r for r in table.read().collect()}
    assert len(rows) == 201 and rows[3].title == "new 3" and rows[900].embedding == [900.0, 0.5]
    assert {str(r.extracted_at)[:7] for i, r in rows.items() if i in (3, 900)} == {"2025-11"}
    assert {str(r.extracted_at)[:7] for i, r in rows.items() if i not in (3, 900)} == {"2025-10"}
    assert {r.title for r in table.read(1).where("page_id = 3").collect()} == {"old 3"} and table.read(1).count() == 200


def test_columns_and_deletes(spark, table):
    change = spark.createDataFrame([("ns", 5, "named"), ("ns", 5000, "none")], "namespace string, page_id long, title string")
    table.merge_columns(change, ["title"])
    rows = {r.page_id: r for r in table.read().collect()}
    assert rows[5].title == "named" and rows[5].embedding == [5.0, 0.5] and 5000 not in rows
    table.merge_columns(change, ["title"], insert_missing=True)
    assert table.read().where("page_id = 5000").first().embedding is None
    table.delete(table.read().select("namespace", "page_id"))
    assert table.read().count() == 0 and set(table.manifest().values()) == {None}
    table.upsert(pages(spark, [1], "again", "2025-12-01 00:00:00"))
    assert [r.title for r in table.read().collect()] == ["again 1"]


def test_a_batch_that_fails_leaves_the_table_as_it_was(spark, table):
    with pytest.raises(Exception):
        table.change(pages(spark, [3], "x", "2025-11-01 00:00:00"),
                     lambda old, new: old.withColumn("title", F.raise_error(F.lit("stop")).cast("string")))
    assert table.versions() == [1] and table.read().where("title LIKE 'old%'").count() == 200
    assert table.change(pages(spark, [], "x", "2025-11-01 00:00:00"), lambda old, new: old) == set()


def test_last_duplicate_of_a_batch_wins(spark, table):
    batch = pages(spark, [7], "first", "2025-11-01 00:00:00").withColumn("seq", F.lit(1)) \
        .unionByName(pages(spark, [7], "second", "2025-11-01 00:00:00").withColumn("seq", F.lit(2)))
    table.upsert(batch, "seq")
    assert table.read().where("page_id = 7").first().title == "second 7"


def plans_of(table, work):
    """The plans of the rows that ``work`` writes."""
    seen, put = [], table._put
    table._put = lambda rows, batch: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), put(rows, batch))
    work()
    del table._put
    return seen


def test_whole_rows_are_shuffled_once_at_most(spark, table):
    change = spark.createDataFrame([("ns", 5, "named"), ("ns", 6, "too")], "namespace string, page_id long, title string")
    plan, = plans_of(table, lambda: table.upsert(pages(spark, [3, 900], "new", "2025-11-01 00:00:00")))
    assert plan.count("Exchange hashpartitioning") == 1
    plan, = plans_of(table, lambda: table.merge_columns(change, ["title"]))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    plan, = plans_of(table, lambda: table.delete(change))
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan  # that of the distinct keys


@pytest.mark.parametrize("budget", [0, 1500, 10**6])
def test_changes_beyond_the_broadcast_budget(spark, table, monkeypatch, budget):
    """In one round, in many, or by a shuffle: the same rows; duplicates and null keys as ever."""
    from canopy.operators import vectors as Vx
    from canopy.operators.versions import rounds
    monkeypatch.setattr(Vx, "BROADCAST_BUDGET_BYTES", budget)
    table.upsert(pages(spark, [300, 301], "new", "2025-11-01 00:00:00").withColumn(
        "namespace", F.when(F.col("page_id") == 300, F.lit("ns"))))
    ids = list(range(0, 200, 2))
    table.merge_columns(spark.createDataFrame([("ns", i, f"t{i}") for i in ids] + [("ns", 4, "t4")],
                                              "namespace string, page_id long, title string"), ["title"])
    table.delete(spark.createDataFrame([("ns", i) for i in range(0, 200, 3)] + [("ns", 3), (None, 301)],
                                       "namespace string, page_id long"))
    rows = sorted((r.page_id, r.title) for r in table.read().collect())
    want = [(i, f"old {i}" if i % 2 else f"t{i}") for i in range(200) if i % 3] + [(4, "t4"), (300, "new 300"), (301, "new 301")]
    assert rows == sorted(want)
    assert rounds({0: 5, 1: 5, 2: 9, 3: 50}, 10) == [({0, 1}, True), ({2}, True), ({3}, False)]
