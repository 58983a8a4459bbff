"""Stored tables and when they go."""

import os
import time

from strandloom.plans import storage


def there(table):
    return os.path.isdir(table._stored_at.removeprefix("file:"))


def test_discarded(spark):
    one, two = (storage.stored(spark.range(n), "t") for n in (3, 4))
    storage.discarded(one)
    assert not there(one) and two.count() == 4


def test_within(spark):
    made = []

    @storage.within("inner")
    def inner(n):
        made.append(storage.stored(spark.range(n), "deep"))
        return made[-1].filter("id > 0")

    @storage.within("outer")
    def outer():
        """Two results, of which one was stored on the way."""
        made.append(inner(5))
        kept = storage.stored(made[-1].filter("id > 1"), "kept")
        return kept, made[-1]

    a, b = outer()
    assert (a.count(), b.count()) == (3, 4) and outer.__doc__.startswith("Two")
    assert not any(map(there, made)) and there(a) and there(b)


def test_within_fails_cleanly(spark):
    @storage.within("broken")
    def broken():
        storage.stored(spark.range(1), "t")
        raise ValueError("x")

    for _ in range(2):
        try:
            broken()
        except ValueError:
            pass
    assert storage._scopes == []


def test_released(spark):
    """What was dealt for a stored table is gone once it is written, and the session's setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dealt = lambda: {str(blocks.getAllFiles().apply(i)) for i in range(blocks.getAllFiles().size()) if "shuffle_" in str(blocks.getAllFiles().apply(i))}
    then = dealt()
    rows = storage.stored(spark.range(1000).repartition(3, "id"), "t")
    assert spark.conf.get(name) == before
    end = time.time() + 20
    while dealt() - then and time.time() < end:
        time.sleep(0.2)
    assert not any(".data" in x for x in dealt() - then)
    assert rows.count() == 1000
