"""Scratch tables: scopes remove their own and nothing else."""

import os
import threading

import pytest

from tessera import registry, session


def test_scopes_remove_their_own(spark):
    with session.scratch_scope(spark) as outer:
        _, gone = session.materialize(spark.range(3), "gone")
        with session.scratch_scope(spark) as inner:
            kept_frame, kept = session.materialize(spark.range(5), "kept")
            _, dropped = session.materialize(spark.range(4), "dropped")
            inner.append(kept)
        assert os.path.isdir(kept) and not os.path.isdir(dropped) and os.path.isdir(gone)
        outer.append(kept)
    assert not os.path.isdir(gone) and kept_frame.count() == 5


def test_kept_tables_belong_to_the_scope_around(spark):
    with session.scratch_scope(spark):
        with session.scratch_scope(spark) as inner:
            _, path = session.materialize(spark.range(1), "inner")
            inner.append(path)
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_an_exception_leaves_nothing(spark):
    with pytest.raises(RuntimeError), session.scratch_scope(spark) as keep:
        _, path = session.materialize(spark.range(2), "lost")
        keep.append(path)
        raise RuntimeError
    assert not os.path.isdir(path)


def test_threads_leave_each_other_alone(spark):
    ready, done, paths = threading.Event(), threading.Event(), []

    def other():
        with session.scratch_scope(spark) as keep:
            _, path = session.materialize(spark.range(7), "theirs")
            paths.append(path)
            keep.append(path)
            ready.set()
            done.wait(60)

    with session.scratch_scope(spark):
        thread = threading.Thread(target=other)
        thread.start()
        assert ready.wait(60)
        _, mine = session.materialize(spark.range(8), "mine")
    assert not os.path.isdir(mine) and os.path.isdir(paths[0])
    done.set()
    thread.join(60)
    assert os.path.isdir(paths[0])
    session.clear_scratch(spark)
    assert not os.path.isdir(paths[0])


def test_names_are_registered_once():
    name = next(iter(registry.REGISTRY), None)
    if name is None:
        from tessera import queries  # noqa: F401

        name = next(iter(registry.REGISTRY))

    def again(spark, folder):
        return None

    again.__name__ = name
    with pytest.raises(ValueError, match="already"):
        registry.query()(again)
