"""Tables with one row for each key: against a dictionary, versions that are seen whole, and runs whose number follows the logarithm."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.sources.merged import MergedTable
from pagemill.sources.tables import read_versions, saved_versions, write_versions

SCHEMA = "k string, part int, v int, note string"


@pytest.mark.parametrize("first_stays", [False, True])
def test_by_a_dictionary(spark, tmp_path, first_stays):
    rng = random.Random(4)
    table, want = MergedTable(spark, str(tmp_path / "t"), ["k", "part"], ["v"], first_stays), {}
    for batch in range(9):
        rows = {(rng.choice(["a", "b", None]), rng.choice([1, 2, None])): (rng.choice([None, 1, 2, 3]), f"{batch}") for _ in range(rng.choice([0, 2, 6]))}
        table.append(spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA), batch)
        table.append(spark.createDataFrame([("a", 1, 99, "again")], SCHEMA), batch)
        for k, (v, note) in rows.items():
            old = want.get(k)
            number = -1 if v is None else v
            if old is None or number > old[0] or (number == old[0] and not first_stays):
                want[k] = (number, v, note)
        got = {(r.k, r.part): (r.v, r.note) for r in table.read().collect()}
        assert got == {k: x[1:] for k, x in want.items()} and table.read().count() == len(want)
    some = table.read(spark.createDataFrame([("a",)], "k string"))
    assert {(r.k, r.part) for r in some.collect()} == {k for k in want if k[0] == "a"}


def test_repeated_rows_of_a_batch_have_one_winner(spark, tmp_path):
    rows = [("a", 1, 5, "x"), ("a", 1, 5, "y"), ("a", 1, 5, "y"), ("a", 1, 4, "z")]
    notes = set()
    for k in range(3):
        table = MergedTable(spark, str(tmp_path / str(k)), ["k"], ["v"])
        table.append(spark.createDataFrame(random.Random(k).sample(rows, 4), SCHEMA).repartition(k + 1))
        (row,) = table.read().collect()
        notes.add(row.note)
    assert len(notes) == 1 and notes < {"x", "y"}


def test_runs_and_versions_are_few(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), ["k"])
    for batch in range(12):
        table.append(spark.createDataFrame([(f"k{batch}-{i}", 0, i, "n") for i in range(40)], SCHEMA).coalesce(1))
        state = table.state()
        assert len(state["runs"]) <= 5 and len(table._versions()) <= table.KEPT
    assert table.read().count() == 480
    folders = list((tmp_path / "t" / "data").iterdir())
    assert len(folders) <= 5 + 2 * table.KEPT  # what the versions kept still list


def test_readers_see_a_version_whole(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), ["k"])
    table.append(spark.createDataFrame([("a", 0, 1, "n")], SCHEMA))
    before = table.read()
    table.append(spark.createDataFrame([("a", 0, 2, "n"), ("b", 0, 2, "n")], SCHEMA))
    assert [(r.k, r.v) for r in before.collect()] == [("a", 1)] and table.read().count() == 2


def test_two_writers_of_a_version(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), ["k"])
    table.append(spark.createDataFrame([("a", 0, 1, "n")], SCHEMA))
    state = table.state()
    run = table._saved(spark.createDataFrame([("b", 0, 1, "n")], SCHEMA))
    table._commit(state, [*state["runs"], run], -1, state["schema"])
    with pytest.raises(Exception, match="[Ee]xist"):
        table._commit(state, state["runs"], -1, state["schema"])
    assert table.read().count() == 2


def test_rows_of_the_oldest_run_are_not_sorted(spark, tmp_path):
    """Only rows that a later run has too are aggregated; the others come from their files."""
    table = MergedTable(spark, str(tmp_path / "t"), ["k"])
    table.append(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("part"), F.col("id").cast("int").alias("v"), F.lit("n").alias("note")))
    table.append(spark.createDataFrame([("k7", 0, -1, "new"), ("z", 0, 0, "new")], SCHEMA))
    rows = table.read()
    assert rows.count() == 20_001 and rows.where("k = 'k7'").first().v == -1
    rows = table.read()
    rows.collect()
    metrics = str(rows._jdf.queryExecution().executedPlan())
    assert "SortMergeJoin" not in metrics.split("== Initial Plan ==")[0] and "LeftAnti" in metrics


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    write_versions(docs(("a", "1"), ("b", "1"), (None, "1")), path, at(5))
    write_versions(docs(("a", "2")), path, at(5))
    write_versions(docs(("b", "early")), path, at(4))
    write_versions(docs((None, "2"), ("c", "1")), path)
    saved_versions(spark, path, 3).append(docs(("a", "other version")).withColumn("saved_at", at(59)))
    assert {r.doc_id: r.text for r in saved_versions(spark, path).read().collect()} == {"a": "2", "b": "1", None: "2", "c": "1"}


def test_versions_of_any_table(spark):
    rows = [("a", 4, 1, "x"), ("a", 4, 2, "y"), ("a", 4, 2, "z"), ("a", 3, 9, "n"), (None, 4, 1, "o"), ("b", 4, None, "p")]
    frame = spark.createDataFrame(rows, "doc_id string, cache_version int, saved_at int, text string")
    found = [sorted(map(tuple, read_versions(frame.repartition(k)).collect()), key=repr) for k in (1, 4)]
    assert found[0] == found[1] and [(r[0], r[2]) for r in found[0]] == [("a", 2), ("b", None), (None, 1)]
    assert read_versions(frame.drop("saved_at")).count() == 5


def test_no_row_is_moved(spark, tmp_path):
    """Winners are found by keys and places of rows; what else a row has stays in its file until it is read."""
    table = MergedTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    for notes in ("old", "new", "newest"):
        table.append(spark.createDataFrame([(f"k{i}", 0, i, notes) for i in range(1000 if notes == "old" else 300)], SCHEMA).coalesce(1))
    runs = table.state()["runs"]
    rows = table._merged([*runs, table._saved(spark.createDataFrame([("k1", 0, 9, "last"), ("k2", 0, 0, "lost")], SCHEMA))], table.state()["schema"])
    assert {r.k: r.note for r in rows.where("v < 4 or k = 'k1'").collect()} == {"k0": "newest", "k1": "last", "k2": "newest", "k3": "newest"} and rows.count() == 1000
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(" in plan and not re.search(r"(max_by|collect_list)\([^\n]*note", plan)


def test_a_batch_is_tidied(spark, tmp_path):
    """A key that comes twice in a batch, in whatever file, leaves one row, many small files become one, and what was written first is gone."""
    table = MergedTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    table.append(spark.range(40_000).select((F.col("id") % 39_000).cast("string").alias("k"), F.lit(0).alias("part"), F.col("id").cast("int").alias("v"), F.lit("n").alias("note")).repartition(3))
    assert table.read().count() == 39_000 and table.read().where("v < 1000").count() == 0
    table.append(spark.range(40).selectExpr("concat('x', id) as k", "0 as part", "0 as v", "'n' as note").repartition(40))
    folders = list((tmp_path / "t" / "data").iterdir())
    assert sorted(f.name for f in folders) == sorted(r["name"] for r in table.state()["runs"]) and len(folders) == 2
    assert min(len(list(f.glob("*.parquet"))) for f in folders) == 1 and table.read().count() == 39_040
