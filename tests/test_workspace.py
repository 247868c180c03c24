"""Tables in the shared folder."""

import os

from cubeloom.workspace import Scratch, qualified, scope


def test_scope_drops_what_it_made(spark):
    outer = Scratch(spark, "outer")
    kept = outer.save(spark.range(5), "a")
    with scope():
        inner = Scratch(spark, "inner")
        inner.save(spark.range(3), "b")
        folder = inner.root.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert kept.count() == 5
    outer.drop("a")
    assert not os.path.exists(outer.path("a").removeprefix("file://"))


def test_scopes_of_threads_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def work(n):
        with scope():
            made = Scratch(spark, f"thread{n}")
            both.wait()
            df = made.save(spark.range(n), "a")
            if n == 1:
                both.wait()  # the other scope has ended
                return df.count()
        both.wait()
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (1, 2))) == [1, 2]


def test_qualified(spark):
    assert qualified(spark, "/shared/x/") == "file:///shared/x"
    assert qualified(spark, "file:/shared/x") == "file:///shared/x"
    assert qualified(spark, "hdfs://n/x/") == "hdfs://n/x"
