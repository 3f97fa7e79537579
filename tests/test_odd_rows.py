"""Queries of the catalogue against their SQL over small tables of odd rows."""

import duckdb

from treeloom.plans import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


def at_odds(spark, folder, name, **tables):
    """Rows that only the query has, and rows that only its SQL has. Tables are DuckDB queries."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    theirs = con.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    theirs = sorted(theirs.fetchall(), key=repr)
    mine = sorted((tuple(r) for r in Q[name](spark, str(folder)).select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert theirs
    return [r for r in mine if r not in theirs], [r for r in theirs if r not in mine], len(mine) - len(theirs)


def test_dates_count_to_the_nearest_second(spark, tmp_path):
    times = ["2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-01-02 00:00:00.5", "2024-01-01 23:59:59.6", "1969-12-31 23:59:59.5", "1969-12-31 23:59:59.2", None]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, {f'TIMESTAMP {t!r}' if t else 'NULL::TIMESTAMP'} AS ts" for i, t in enumerate(times))
    assert at_odds(spark, tmp_path, "utc_date", events=rows) == ([], [], 0)


#: Turns that say the same line, at the beginning, at the end and in whole; one without a text, one that is missing.
TURNS = """SELECT * FROM (VALUES (1, 0, 'a'), (1, 1, 'a'), (1, 2, 'a'), (1, 3, 'a'), (1, 4, 'b'), (2, 0, E'x\\ny'), (2, 1, E'x\\nz\\ny'), (2, 2, E'z\\ny'), (2, 3, E'x\\nz\\ny'),
 (3, 0, E'p\\nq\\nr'), (3, 1, 'k'), (3, 2, 'm'), (3, 3, E'p\\nq\\nr'), (4, 0, 'a'), (4, 1, NULL), (4, 2, 'a'), (4, 3, ''), (4, 4, ''), (5, 0, 'a'), (5, 2, E'a\\n'), (5, 3, 'a'), (5, 7, 'a')) t(conv_id, turn, text)"""


def test_hunks_of_turns_that_say_the_same(spark, tmp_path):
    assert at_odds(spark, tmp_path, "blame_hunks", conversations=TURNS) == ([], [], 0)


def test_origins_of_turns_that_say_the_same(spark, tmp_path):
    assert at_odds(spark, tmp_path, "line_origins", conversations=TURNS) == ([], [], 0)


#: Rows that repeat a turn, with the same text, with other texts that share lines, and without one.
REPEATED = """SELECT * FROM (VALUES (1, 0, 'a'), (1, 0, 'a'), (1, 1, E'x\\ny'), (1, 1, 'x'), (1, 1, E'x\\n'), (1, 2, 'z'), (1, 3, E'p\\nq'), (1, 3, NULL), (1, 3, E'q\\np'), (1, 4, ''), (1, 4, ''),
 (2, 0, E'k\\nk'), (2, 2, E'k\\nk'), (2, 2, E'k\\nk\\nk'), (2, 3, 'k'), (2, 7, E'm\\tn'), (2, 7, 'm'), (3, 0, 'only'), (NULL, 0, 'n'), (4, NULL, 'n')) t(conv_id, turn, text)"""


def test_origins_of_repeated_turns(spark, tmp_path):
    assert at_odds(spark, tmp_path, "line_origins", conversations=REPEATED) == ([], [], 0)


def test_hunks_of_repeated_turns(spark, tmp_path):
    assert at_odds(spark, tmp_path, "blame_hunks", conversations=REPEATED) == ([], [], 0)


#: Texts of one id or of none, with lines that repeat, without a last line feed, empty and null.
TEXTS = """SELECT * FROM (VALUES (1, E'a\\nb\\nc\\nd\\ne\\n'), (1, E'a\\nb\\nc\\nd\\ne\\n'), (1, 'a'), (2, repeat(E'x\\n', 50)), (2, repeat(E'x\\ny\\n\\n', 30) || 'x'), (NULL, E'\\n\\n\\n'), (NULL, E'p\\r\\nq\\rr\\n'),
 (3, ''), (4, NULL), (5, E'a\\nb\\nc'), (6, E'\\n'), (7, E'ä\\nö\\n\\nü\\n€\\n😀')) t(doc_id, text)"""


def test_scripts_of_texts_with_one_id(spark, tmp_path):
    assert at_odds(spark, tmp_path, "script_counts", documents=TEXTS) == ([], [], 0)
