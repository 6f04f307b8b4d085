"""Trees deeper than any fixed number of levels."""

from lodestow.operators import ordered


def test_tree_levels_of_a_deep_tree(spark):
    rows = [(0, None), *[(i, i - 1) for i in range(1, 150)], (500, 0), (900, 899), (910, 911), (911, 910)]
    got = {r["k"]: r["level"] for r in ordered.tree_levels(spark.createDataFrame(rows, "k long, parent long"), "k", "parent").collect()}
    assert got == {**{i: i for i in range(150)}, 500: 1}
