"""Rows of Spark and DuckDB in one form: by column name, sorted, floats to six digits."""

import math


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            return f"{v + 0.0:.6g}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return norm([tuple(r) for r in df.collect()], df.columns)


def duck_rows(con, sql):
    got = con.execute(sql)
    return norm(got.fetchall(), [d[0] for d in got.description])
