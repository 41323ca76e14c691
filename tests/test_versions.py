"""Tables that change together, and tables laid out by key."""

import uuid

import pytest
from listing import listed
from pyspark.sql import functions as F

from voxtable.operators import catalog as ct
from voxtable.operators import intervals as iv
from voxtable.session import fresh_path
from voxtable.sources.versions import Conflict, Tables, lay_out


@pytest.fixture
def tables(spark, rows):
    made = Tables(spark, fresh_path(spark, "tables"))
    assert made.version() == -1 and made.names() == {}
    made.commit({
        "series": rows("series_id bigint, name string", [(1, "a"), (2, "b"), (3, "c")]),
        "episode": rows("episode_id bigint, series_id bigint, status string", [(10, 1, "QUEUED"), (11, 1, "FAILED"), (20, 2, "ASR"), (30, 3, "QUEUED")]),
        "issue": rows("issue_id bigint, episode_id bigint, code string, resolved boolean", [(1, 10, "X", False), (2, 20, "X", False), (3, 30, "Y", False), (4, None, "X", False)]),
        "segment": rows("episode_id bigint, ord bigint", [(10, 0), (11, 0), (20, 0), (30, 1)]),
        "glossary": rows("term string", [("t",)]),
    }, -1)
    return made


def test_a_cascade_is_one_commit(tables, rows):
    version, busy = ct.delete_series(tables, rows("series_id bigint", [(1,), (1,), (2,), (9,)]))
    assert version == tables.version() == 1 and listed(busy, "series_id") == [(2,)]  # a worker holds an episode of series 2
    assert listed(tables.read("series"), "series_id") == [(2,), (3,)] and listed(tables.read("episode"), "episode_id") == [(20,), (30,)]
    assert listed(tables.read("issue"), "issue_id") == [(2,), (3,), (4,)] and listed(tables.read("segment"), "episode_id") == [(20,), (30,)]
    assert tables.read("glossary").count() == 1 and tables.names(0)["glossary"] == tables.names(1)["glossary"]
    assert tables.read("issue", 0).count() == 4  # what was read before stays readable


def test_a_writer_stopped_half_way_changes_nothing(spark, tables):
    before = tables.names()
    broken = spark.range(3).select(F.raise_error(F.lit("stopped")).alias("x"))
    with pytest.raises(Exception, match="stopped"):
        tables.commit({"segment": tables.read("segment").limit(0), "issue": broken}, 0)
    assert tables.version() == 0 and tables.names() == before and tables.read("segment").count() == 4
    # An entry that is not written to its end does not count either.
    out = tables._files.create(tables._entry(1), False)
    out.write(bytearray(b'{"series": "half'))
    out.close()
    assert tables.version() == 0 and tables.names() == before


def test_the_second_writer_is_refused(spark, tables):
    first, second = Tables(spark, tables.root), Tables(spark, tables.root)
    base = second.version()
    ct.change_tables(first, {"issue": lambda issues: ct.resolve_issues(issues, first.read("episode").where("episode_id = 10"))})
    with pytest.raises(Conflict):
        second.commit({"segment": second.read("segment").limit(1)}, base)
    assert tables.version() == 1 and tables.read("segment").count() == 4
    assert listed(tables.read("issue").where("resolved"), "issue_id") == [(1,)]


def test_tables_laid_out_by_key_need_no_exchange(spark):
    name = f"words_{uuid.uuid4().hex[:8]}"
    words = spark.range(4000).selectExpr("id % 37 AS episode_id", "id * 13 % 5000 AS s", "id * 13 % 5000 + 5 AS e", "id AS pos")
    laid = lay_out(words, name, ["episode_id"], ["s"], 4)
    chunks = lay_out(spark.range(400).selectExpr("id % 37 AS episode_id", "id DIV 37 AS chunk_no", "id DIV 37 * 900 AS start_ms", "id DIV 37 * 900 + 1000 AS end_ms"), f"{name}_c", ["episode_id"], ["chunk_no"], 4)
    try:
        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        sessions = iv.silence_groups(laid, ["episode_id"], ["s", "pos"], gap_ms=20, start="s", end="e")
        plain = iv.silence_groups(words, ["episode_id"], ["s", "pos"], gap_ms=20, start="s", end="e")
        assert "Exchange" not in plan(sessions) and "Exchange" in plan(plain)
        assert listed(sessions, *sessions.columns) == listed(plain, *plain.columns)
        bounds = iv.chunk_bounds(chunks, ["episode_id"])
        assert "Exchange" not in plan(bounds)
        assert "Exchange" not in plan(bounds.join(laid.hint("merge"), "episode_id"))
    finally:
        for t in (name, f"{name}_c"):
            spark.sql(f"DROP TABLE {t}")
