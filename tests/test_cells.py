"""Pairs cell by cell: every pair once, equal keys together, one cell on disk at a time."""

import os
import time

import pytest
from test_pairs import SCHEMA, expected, hot_texts

from ambilens.operators import pairs
from ambilens.plans import queries
from ambilens.session import shuffles_removed


@pytest.fixture
def small_cells(monkeypatch):
    """Sets the least pairs of a cell."""
    monkeypatch.setattr(pairs, "PAIRS_PER_TEXT", 1)
    return lambda least: monkeypatch.setattr(pairs, "LEAST_PER_CELL", least)


def documents(spark, path, n=80):
    """Texts that several sources share, two runs apart; a null text and a null source."""
    rows = [
        (i, f"text {i % 61}" * (1 + i % 3), f"src{i % 5}" if i % 37 else None, ["en", "fr", "de", "es"][i % 4], 400 + i % 2 * 2000)
        for i in range(n)
    ]
    rows.append((n, None, "src1", "en", 400))
    kind = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_cells_hold_every_pair_once(spark, small_cells, block=7):
    rows = hot_texts(300)
    df = spark.createDataFrame([*rows, (None, "x", 0, "p"), (None, "x", 0, "q")], SCHEMA)
    plan = pairs.plan_pairs(df, block)
    small_cells(plan.pairs // 4)
    cells = pairs.cells(plan)
    assert len(cells) == 6
    found, at = [], {}
    for n, cell in enumerate(cells):
        got = pairs.translation_pairs(cell.texts(df), block, plan=plan, cell=cell).collect()
        assert len(got) < 0.5 * plan.pairs
        found += [(r.source_index, r.sentence1, r.sentence2) for r in got]
        for r in got:
            assert at.setdefault((r.sentence1, r.sentence2), n) == n
    assert sorted(found) == expected(rows) and len(at) < len(found)


def test_disk_holds_one_cell(spark, small_cells, tmp_path):
    """What the earlier cells stored is gone, and no cell is more than a part of the job."""
    texts = queries.flagged_texts(spark, documents(spark, tmp_path))
    total, folders, sizes = pairs.plan_pairs(texts).pairs, [], []
    small_cells(total * 3 // 5)
    for run in queries.two_runs(texts):
        assert os.path.isdir(run.folder) and not any(map(os.path.exists, folders))
        folders.append(run.folder)
        sizes.append(run.narrow.count())
    assert len(sizes) == 3 and sum(sizes) == total and max(sizes) < 0.7 * total and not os.path.exists(folders[-1])


@pytest.mark.parametrize("name", ["scoring_totals", "scored_pairs", "refusals"])
def test_results_are_those_of_one_cell(spark, rows, small_cells, tmp_path, name):
    query = queries.QUERIES[name]
    path = documents(spark, tmp_path)
    whole = rows(query(spark, path))
    plan = pairs.plan_pairs(queries.flagged_texts(spark, path))
    small_cells(plan.pairs * 3 // 5)
    assert len(pairs.cells(plan)) == 3
    assert rows(query(spark, path)) == whole and whole


def test_shuffles_go_with_their_query(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle")}

    before = files()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    with shuffles_removed(spark):
        assert spark.range(1000).repartition(3).groupBy("id").count().count() == 1000
    assert spark.conf.get(name) == setting
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
