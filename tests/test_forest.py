import random

import pytest

from fleetscope.operators.forest import forest, with_children_only
from fleetscope.operators.subtree import subtree_sums
from fleetscope.session import ensure_checkpoint_dir, mounted_path


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_orphans_and_cycles_have_no_row(frame):
    nodes = frame("id STRING, parent STRING", [("r", None), ("c", "r"), ("g", "c"), ("o", "gone"), ("x", "y"), ("y", "x"),
                                               ("below", "x"), ("lone", None)])
    tree = forest(nodes, "id", "parent")
    assert by_id(tree, "root", "depth", "path") == {
        "r": ("r", 0, ["r"]), "c": ("r", 1, ["r", "c"]), "g": ("r", 2, ["r", "c", "g"]), "lone": ("lone", 0, ["lone"])}
    assert set(by_id(with_children_only(tree), "root")) == {"r", "c", "g"}


def test_repeated_ids_are_refused(frame):
    nodes = frame("id STRING, parent STRING", [("r", None), ("c", "r"), ("c", "r"), ("g", "c")])
    with pytest.raises(ValueError, match="unique"):
        forest(nodes, "id", "parent")
    nameless = frame("id STRING, parent STRING", [("r", None), (None, "r"), (None, "r")])
    assert sorted((str(r.id), r.root) for r in forest(nameless, "id", "parent").collect()) == [("None", "r"), ("None", "r"), ("r", "r")]


def test_deep_chain(frame):
    nodes = frame("id INT, parent INT", [(i, i - 1 if i else None) for i in range(300)])
    tree = forest(nodes, "id", "parent", with_path=False)
    assert by_id(tree, "root", "depth") == {i: (0, i) for i in range(300)}


def estimate_digits(df):
    """Digits of the planner's estimate of the rows' bytes."""
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_do_not_grow_with_the_rounds(frame):
    nodes = frame("id INT, parent INT", [(i, i - 1 if i else None) for i in range(70)])
    assert estimate_digits(forest(nodes, "id", "parent", with_path=False)) < 20
    sums = subtree_sums(nodes.selectExpr("id", "parent", "1L AS one"), "id", "parent", "one")
    assert estimate_digits(sums) < 20
    assert by_id(sums, "depth", "entry", "exit", "subtree_sum") == {i: (i, i + 1, 140 - i, 70 - i) for i in range(70)}


def test_parents_without_a_type(frame):
    tree = forest(frame("id STRING", [("r",), ("s",)]).selectExpr("id", "NULL AS parent"), "id", "parent")
    assert by_id(tree, "parent", "root", "depth") == {"r": (None, "r", 0), "s": (None, "s", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest_against_walking(frame, seed):
    rng = random.Random(seed)
    parent = {i: rng.choice([None, rng.randrange(80), rng.randrange(80), 999]) for i in range(80)}
    expected = {}
    for node in parent:
        path, at = [node], node
        while parent[at] is not None and parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.insert(0, at)
        if parent[at] is None:
            expected[node] = (path[0], len(path) - 1, path)
    tree = forest(frame("id INT, parent INT", list(parent.items())), "id", "parent")
    assert by_id(tree, "root", "depth", "path") == expected


def test_keys_keep_forests_apart(frame):
    nodes = frame("b STRING, id INT, parent INT", [("p", 1, None), ("p", 2, 1), ("q", 1, None), ("q", 2, None), ("q", 3, 2)])
    tree = with_children_only(forest(nodes, "id", "parent", ["b"]), ["b"])
    assert sorted((r.b, r.id, r.root) for r in tree.collect()) == [("p", 1, 1), ("p", 2, 1), ("q", 2, 2), ("q", 3, 2)]


def test_checkpoint_folder_is_kept(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first


def test_mounted_paths():
    assert mounted_path("file:/tmp/a") == "/tmp/a"
    assert mounted_path("file:///tmp/a") == "/tmp/a"
    assert mounted_path("/tmp/a") == "/tmp/a"
    assert mounted_path("s3a://bucket/a") is None
