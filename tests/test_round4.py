"""What the reviewer's fourth round found, each by a small case that failed before."""

import re

import duckdb
import pytest

from tidemark.plans import catalog


def sql_rows(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"create view {table} as select * from '{path}'")
    return sorted(map(str, con.execute(catalog.oracle_sql()[name]).fetchall()))


def test_nearest_events_with_nulls_equal_sql(spark, tmp_path):
    """Null users, times and ids match nothing, as in SQL; the nearest view before counts even if its id is null."""
    path = f"{tmp_path}/events.parquet"
    null = lambda c, n: f"case when event_id % {n} = 0 then null else {c} end as {c}"
    made = f"select {null('event_id', 7)}, {null('ts', 5)}, case when event_id % 3 = 0 then null else user_id % 4 end as user_id, event_type, value, props"
    duckdb.execute(f"copy ({made} from '/root/testdata/sf0.001/events.parquet') to '{path}' (format parquet)")
    found = catalog.queries()["asof_prev_next"](spark, str(tmp_path)).select("user_id", "event_id", "view_before", "view_after")
    assert sorted(str(tuple(r)) for r in found.collect()) == sql_rows("asof_prev_next", events=path)


def exchanges(frame):
    """The shuffles of a query's plan: what they deal out by."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("name", ["char_overlap_join", "block_words", "short_subtitles", "grouped_sentences", "smart_split"])
def test_words_are_shuffled_as_whole_texts_alone(spark, name):
    """Words take several times the space of their texts: windows, groups and matches must not deal them out again."""
    found = exchanges(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert found and all(re.fullmatch(r"doc_id#[0-9]+L, [0-9]+", e) for e in found), found


def test_null_documents_equal_sql(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    duckdb.execute(f"copy (select case when doc_id % 9 = 0 then null else doc_id end as doc_id, text, lang, source, n_chars from '/root/testdata/sf0.001/documents.parquet' where doc_id % 9 > 0 or doc_id = 18) to '{path}' (format parquet)")
    for name in ("char_overlap_join", "block_words"):
        found = catalog.queries()[name](spark, str(tmp_path)).toPandas()
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{path}'")
        con.execute(f"create table theirs as {catalog.oracle_sql()[name]}")
        con.register("ours", found)
        columns = ", ".join(f'"{c}"' for c in found.columns)
        a, b = f"select {columns} from ours", f"select {columns} from theirs"
        assert con.execute(f"select count(*) from (({a} except all {b}) union all ({b} except all {a}))").fetchone() == (0,), name


def test_style_sets_are_parsed_once_for_each_level(spark):
    """A set's text is parsed for its levels, not for each of its hundred fields, and a lower set is not repeated in each field."""
    plan = catalog.queries()["style_sets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and 0 < plan.count("from_json") < 100


def test_streamed_tables_leave_only_their_result(spark):
    """The segments' files and the stream's state go once all is given out."""
    import os

    from tidemark.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert catalog.queries()["streamed_alignment"](spark, "/root/testdata/sf0.001").count() > 0
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before] == ["segment-times"]
