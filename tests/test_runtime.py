import os

from plumbline.runtime import Scratch, close_all, shared_root, workspace


def left(spark):
    root = shared_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_workspace_leaves_nothing(spark):
    before = left(spark)
    out = Scratch(spark, "out")
    with workspace(spark, "work"):
        inner = Scratch(spark, "inner").save(spark.range(5), "t")
        saved = out.save(inner.where("id > 2"), "kept")
    assert saved.count() == 2 and len(left(spark) - before) == 1
    out.close()
    assert left(spark) == before


def test_close_all(spark):
    Scratch(spark, "one").save(spark.range(3), "t")
    close_all()
    assert not [x for x in left(spark) if x.startswith("one-")]
