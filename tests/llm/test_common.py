"""What operators keep in a Python worker goes when another one's turn comes."""

from lectern.llm import common


def test_a_turn_lets_go_what_others_keep(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "_TURN", [""])
    held = {"one": [1], "two": [2]}
    for name, own in held.items():
        common.keeps(name, own.clear)
    common.turn("one")
    assert held == {"one": [1], "two": []}
    held["two"].append(3)
    common.turn("one")  # still its turn: nothing is looked at
    assert held == {"one": [1], "two": [3]}
    common.turn("two")
    assert held == {"one": [], "two": [3]}
    common.turn("three")
    assert held == {"one": [], "two": []}


def test_sums_take_their_turn_and_one_worker_a_task(spark, monkeypatch):
    """What a former operator keeps in a worker goes where vectors are added up, and no second worker stands beside a task's own."""
    rows = spark.createDataFrame([(0, [1, 2]), (1, [5]), (0, [10, 20])], "at int, counts array<long>")
    plans = []
    plain = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df))[1])
    turns = []
    monkeypatch.setattr(common, "turn", turns.append)
    taken = []
    held = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, *a: (taken.append(f), held(df, f, *a))[1])
    got = common.added_up(rows, common.STRETCH + 1)
    assert got[[0, 1, common.STRETCH]].tolist() == [11, 22, 5] and got.sum() == 38
    assert plans[0].count("MapInArrow") == 1
    list(taken[0](iter([])))
    assert turns == ["added_up"]
