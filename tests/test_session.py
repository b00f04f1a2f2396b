"""Tables that runs write have an owner and are removed with it."""

import threading
from pathlib import Path

import pytest

from corpusloom.session import materialize, release, run_tables


def files(folder):
    return sorted(p.name.rsplit("-", 1)[0] for p in Path(folder).glob("*"))


def test_nothing_is_left_after_a_run(spark):
    with run_tables(spark) as folder:
        first = materialize(spark.range(10), "first")
        with run_tables(spark) as inner:
            assert materialize(first, "second").count() == 10 and files(inner) == ["second"]
        assert not Path(inner).exists() and files(folder) == ["first"] and first.count() == 10
    assert not Path(folder).exists()


def test_a_failed_run_leaves_nothing(spark):
    with pytest.raises(ZeroDivisionError):
        with run_tables(spark) as folder:
            materialize(spark.range(3))
            1 / 0
    assert not Path(folder).exists()


def test_released_tables_go_at_once_and_others_stay(spark):
    with run_tables(spark) as folder:
        one, other = materialize(spark.range(3), "one"), materialize(spark.range(4), "other")
        release(one, spark.range(2), one)
        assert files(folder) == ["other"] and other.count() == 4


def test_overlapping_runs_know_their_own_tables_only(spark):
    started, go_on, counts = threading.Barrier(2), threading.Event(), []

    def run(rows):
        with run_tables(spark) as folder:
            table = materialize(spark.range(rows))
            started.wait()
            if rows == 5:
                go_on.wait()
            counts.append((rows, table.count(), len(files(folder))))
        if rows != 5:
            go_on.set()

    threads = [threading.Thread(target=run, args=(rows,)) for rows in (5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(counts) == [(5, 5, 1), (6, 6, 1)]
