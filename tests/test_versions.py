"""Replacing tables: whatever step fails, the old or the new rows are there."""

import pytest

from ambilens.sinks import report, tables
from ambilens.sources.tables import read_model_tables, read_table


class Lost(BaseException):
    """The driver is gone: nothing it would still do happens."""


def losing(monkeypatch, after):
    """File operations stop after the first ``after``."""
    done = [0]
    for name in ("rename", "delete", "put"):
        real = getattr(tables, name)

        def stop(*args, real=real, **options):
            if done[0] >= after:
                raise Lost
            done[0] += 1
            return real(*args, **options)

        monkeypatch.setattr(tables, name, stop)
    return done


def count(spark, path):
    return read_table(spark, path, ["id"]).count()


@pytest.mark.parametrize("folder", ["t", "models/m.parquet"])
def test_a_driver_lost_at_any_step_leaves_old_or_new_rows(spark, tmp_path, monkeypatch, folder):
    path, seen = str(tmp_path / folder), set()
    tables.write_table(spark.range(3), path, "id long")
    for after in range(9):
        before = count(spark, path)
        with monkeypatch.context() as patch:
            done = losing(patch, after)
            try:
                tables.write_table(spark.range(before + 1), path, "id long", overwrite=True)
                ended = True
            except Lost:
                ended = False
        assert count(spark, path) in (before, before + 1)
        if "/" in folder:
            assert read_model_tables(spark, str(tmp_path / "models"), ["id"]).count() == count(spark, path)
        seen.add((ended, count(spark, path) - before))
        if ended:
            break
    assert done[0] >= 5 and seen == {(False, 0), (False, 1), (True, 1)}
    with pytest.raises(FileExistsError):
        tables.write_table(spark.range(1), path, "id long")
    tables.write_table(spark.range(50), path, "id long", overwrite=True)
    assert spark.read.parquet(path).count() == count(spark, path) == 50
    assert not tables.exists(spark, tables.pointer_path(path))


def test_a_failed_rename_leaves_the_path_readable(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path, "id long")
    real = tables.rename

    def refuses(session, source, target):
        if target == path and "-new-" in source:
            raise OSError("no")
        real(session, source, target)

    monkeypatch.setattr(tables, "rename", refuses)
    with pytest.raises(OSError):
        tables.write_table(spark.range(4), path, "id long", overwrite=True)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 3 and count(spark, path) == 4
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 4


def test_reports_have_header_and_rows_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    report.write_report(spark.range(2), {"model_id": 2}, path)
    for after in range(9):
        with monkeypatch.context() as patch:
            losing(patch, after)
            try:
                report.write_report(spark.range(5), {"model_id": 5}, path, overwrite=True)
                break
            except Lost:
                pass
        header, rows = report.read_report(spark, path)
        assert header["model_id"] == rows.count()
    assert report.read_report(spark, path)[0] == {"model_id": 5}


def test_a_new_table_appears_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as patch:
        losing(patch, 0)
        with pytest.raises(Lost):
            tables.write_table(spark.range(3), path, "id long")
    assert not tables.exists(spark, path)
    tables.write_table(spark.range(3), path, "id long")
    assert count(spark, path) == 3
