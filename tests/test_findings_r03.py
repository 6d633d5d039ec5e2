"""Cases of the findings of round 3."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import floorplans, text
from parcelspark.plans import registry
from parcelspark.streaming import keyed

from .test_keyed import DAY, JOBS, MEMBERS, SECOND, put, source

SF = "/root/testdata/sf0.001"


def held_blocks(spark, out, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{out}/checkpoint").select("key").distinct().count()


def test_jobs_of_a_block_share_their_state_and_fail_each_at_its_time(spark, tmp_path):
    """state is read and written for a block of jobs; the block's timer goes on to the next job that is due."""
    out, us = f"file://{tmp_path}/out", DAY * SECOND
    put(spark, tmp_path / "in", [(i, "processing" if i % 2 else "pending", (i + 1) * SECOND, i) for i in range(600)], JOBS)
    put(spark, tmp_path / "in", [(5_000_000, "pending", us + 100 * SECOND, 600)], JOBS)
    put(spark, tmp_path / "in", [(3, "completed", us + 150 * SECOND, 601), (5_000_000, "pending", us + 300 * SECOND, 602)], JOBS)
    got = {r.job_id: (r.status, r.by, r.completed_us) for r in keyed.job_clock(source(spark, tmp_path / "in", JOBS), DAY, out).collect()}
    for i in range(600):
        fails = i % 2 and i + 1 <= 300
        assert got[i] == (("completed", "event", us + 150 * SECOND) if i == 3 else ("failed", "timer", us + (i + 1) * SECOND) if fails else ("processing" if i % 2 else "pending", "event", None))
    assert held_blocks(spark, out, "jobs") == 2


def test_groups_of_a_block_share_their_state_and_fire_apart(spark, tmp_path):
    """state is read and written for a block of groups."""
    out = f"file://{tmp_path}/out"
    put(spark, tmp_path / "in", [(g, 10 * g + m, "completed", 3) for g in range(100) for m in range(2 + g % 2)], MEMBERS)
    got = lambda: sorted(map(tuple, keyed.fired_once(source(spark, tmp_path / "in", MEMBERS), out).collect()))
    assert got() == [(g, 3) for g in range(100) if g % 2]
    put(spark, tmp_path / "in", [(g, 10 * g + 1, "failed", 3) for g in range(100)] + [(g, 10 * g + 2, "failed", 3) for g in range(50)], MEMBERS)
    assert got() == [(g, 3) for g in range(100) if g % 2 or g < 50]
    assert held_blocks(spark, out, "ended") == held_blocks(spark, out, "fired") == 1


@pytest.fixture
def tied(tmp_path):
    """The smallest tables, with runs of a project completed at the same time."""
    for f in os.listdir(SF):
        if f != "events.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    duckdb.sql(f"copy (select * replace (date_trunc('year', ts) as ts) from '{SF}/events.parquet' order by event_id) to '{tmp_path}/events.parquet'")
    return str(tmp_path)


def test_back_fill_takes_the_first_of_runs_of_one_time(spark, tied):
    """as max_by in the SQL."""
    c = duckdb.connect()
    for f in os.listdir(tied):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{tied}/{f}'")
    want = c.sql(registry.ORACLE_SQL["w03_back_fill"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["w03_back_fill"](spark, tied).collect()), key=str) == sorted(want, key=str)


def test_either_key_has_the_pairs_of_the_whole_join(spark):
    """jobs and runs of 700 and 400 projects and 250 packages."""
    events = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    want = sorted((j, r) for j in events if j % 3 == 0 for r in events if j % 700 == r % 400 or j == r % 250)
    assert sorted(map(tuple, registry.QUERIES["j20_either_key"](spark, SF).collect())) == want


def test_rows_of_small_files_are_dealt_out_first(spark):
    """F8, F9, F10: one scan task made the work of all rows."""
    for name in ("s08_table_function", "f03_location", "f10_text_facts"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(p_partkey" in plan and "REPARTITION_BY_NUM" in plan


def test_names_are_found_as_each_by_its_own_pattern(spark):
    """one fixed pattern for a list instead of one made for each row and name."""
    texts = ["", None, "DUBAI marina mall", "Dubai Marina Malls, Dubai Hills Estate", "Retail outlets and retail", "a park, parking; swimming  pool", "24/7 security_ Security", "Villas, Villass studio", "Dubai Islandsx The Views", "Rashid Yachts & Marina Dubai South", "Central A/C + central ac"]
    lists = {"a": (text.AMENITIES, ""), "c": (text.COMMUNITIES, ""), "p": (text.PROPERTY_TYPES, "s?"), "e": (text.EMIRATES, "")}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    found = df.select("i", "text", *(text._named(F.col("text"), *of).alias(k) for k, of in lists.items()), *(text._first_named(F.col("text"), *of).alias(f"{k}1") for k, of in lists.items()))
    for r in found.collect():
        for k, (names, suffix) in lists.items():
            want = None if r.text is None else [n for n in names if re.search(rf"(?i)\b{re.escape(n)}{suffix}\b", r.text, re.ASCII)]
            assert r[k] == want and r[k + "1"] == (want[0] if want else None)
    assert "lambda" not in registry.QUERIES["f03_location"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_values_of_a_breakdown_are_taken_once(spark):
    """each use of a part looked at the text again."""
    df = spark.createDataFrame([("2BR suite\nbalcony\ntotal\n500 sqft\n50 sqft\n600 sqft",), ("Suite area: 700 sqft total: 650 sqft",), ("Suite area: 700 sqft\nBalcony: 60 sqft\nTotal area: 1,100.25 sqft",), (None,)], "text string")
    out = df.select(floorplans.header_breakdown(F.col("text")).alias("h"), floorplans.labelled_breakdown(F.col("text")).alias("l"))
    assert [(r.h and tuple(r.h), r.l and tuple(r.l)) for r in out.collect()] == [((500.0, 50.0, 600.0), None), (None, None), (None, (700.0, 60.0, 1100.25)), (None, None)]
    plan = df.select(floorplans.labelled_breakdown(F.col("text")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:total|gross)") == 1


def test_index_stems_words_after_they_are_gathered(spark, tmp_path):
    """words of one stem meet in one block, with their places in order."""
    from parcelspark.operators import textindex
    from parcelspark.operators.search import search_words

    texts = {1: "Towers tower of towers", 8191: "tower", 8192: "hill towers hill", 20_000: "", 30_000: "the hills"}
    df = spark.createDataFrame([*texts.items(), (None, "tower")], "id long, text string")
    index = textindex.TextIndex(spark, str(tmp_path / "at"))
    index.add(df, ["text"])
    got = sorted((r.term, r.range, r.most_hits, r.ids, r.hits, r.positions) for r in index.blocks(["tower", "hill"]).collect())
    assert got == [("hill", 1, 2, [8192], [2], [[0, 2]]), ("hill", 3, 1, [30_000], [1], [[0]]), ("tower", 0, 3, [1, 8191], [3, 1], [[0, 1, 2], [0]]), ("tower", 1, 1, [8192], [1], [[1]])]
    assert [r.w for r in df.where("id = 1").select(search_words(F.col("text")).alias("w")).collect()] == [["towers", "tower", "towers"]]


def test_linked_areas_join_nothing_afterwards(spark):
    """two joins shuffled all plans and rows again."""
    plan = registry.QUERIES["j09_linked_areas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_keys_of_a_label_are_made_once():
    """and given back as they were made."""
    from parcelspark.operators import linkage

    keys = linkage.Keys()
    assert keys["2br", "a", "a", 2] is keys["2br", "a", "a", 2] and keys["2br", "a", "a", 2] == linkage._likeness("2br", "a", "a", 2)
