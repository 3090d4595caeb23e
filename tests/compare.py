"""A Spark result against the rows of a statement in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same_rows(df, con, sql: str) -> None:
    r = con.execute(sql)
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    canon = lambda rows, cols: sorted(repr([row[cols.index(c)] for c in order]) for row in rows)
    assert canon([tuple(x) for x in df.collect()], df.columns) == canon(r.fetchall(), columns)
