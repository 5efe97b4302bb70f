"""Texts are read once, batches of Python workers are bounded, and timers don't grow with operations."""

import pandas as pd

import __spark_entry__
from difforge.operators import postings
from difforge.plans import catalog
from difforge.session import bound_batches
from difforge.streaming import expiring

SF = "/root/testdata/sf0.001"


def operators(df):
    """The operators of the plan as first made, each once for each place."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def test_syntax_chunks_parse_each_text_once_and_shuffle_none(spark):
    plan = operators(catalog.queries()["syntax_chunks"](spark, SF))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Join") == 0


def test_syntax_table_parses_each_text_once(spark):
    assert operators(catalog.queries()["syntax_table"](spark, SF)).count("ArrowEvalPython") == 1


def test_semantic_chunks_join_texts_once(spark):
    plan = operators(catalog.queries()["semantic_chunks"](spark, SF))
    assert plan.count("Join") == 1


def test_queries_bound_what_python_workers_hold(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "100000")
        __spark_entry__.queries()["syntax_table"](spark, SF)
        assert [int(spark.conf.get(k)) for k in keys] == [2000, 16 << 20]
        spark.conf.set(keys[0], "70")
        bound_batches(spark)
        assert spark.conf.get(keys[0]) == "70"
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_first_chunks_of_an_index_are_not_joined(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("r", "1", "a.py", 1, "x y x"), ("r", "1", "a.py", 1, "y z")], "repo_id string, chunk_id string, file_path string, start_line int, content string")
    index, plans = postings.Index(spark, str(tmp_path), 4), []
    change = index.entries._change
    monkeypatch.setattr(index.entries, "_change", lambda rows, batch: plans.append(operators(rows)) or change(rows, batch))
    index.add(chunks)
    index.add(chunks.where("content = 'y z'"))
    assert [p.count("Join") > 0 for p in plans] == [False, True]
    assert sorted(r.token for r in index.entries.read().collect()) == ["y", "z"]


class Held:
    """State of one key in memory."""

    def __init__(self):
        self.value, self.rows = None, []

    def exists(self):
        return self.value is not None or bool(self.rows)

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.value, self.rows = None, []


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return Held()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_waiting_operations_share_a_timer():
    n = 1000
    rows = pd.DataFrame({"op_id": range(n), "micros": [1_000_000 * i for i in range(n)], "kind": ["put", "get"] * (n // 2), "value": "v", "seconds": 60})
    cache, handle = expiring._Cache(), Handle()
    cache.init(handle)
    list(cache.handleInputRows(("k",), iter([rows]), None))
    assert handle.timers == [1]

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 500_000

    (answers,) = cache.handleExpiredTimer(("k",), Now(), None)
    assert list(answers["op_id"]) == list(range(1, 500, 2)) and set(answers["value"]) == {"v"}
    assert handle.timers == [1, 500_001]
