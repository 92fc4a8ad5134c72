"""Running a query's SQL in DuckDB and comparing rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(df, sql, sf_dir):
    names, rows = rows_of_sql(sql, sf_dir)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, rows)
