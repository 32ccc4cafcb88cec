"""Compare a query with its SQL on a second engine."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return f"{float(x):.9g}"
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False, name=None))


def differences(spark, con, run, sql, sf_dir):
    ours, theirs = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    for frame, other in ((ours, theirs), (theirs, ours)):
        for c in frame.columns:  # integer columns with nulls come as floats from one side
            if str(frame[c].dtype).startswith("float") and str(other[c].dtype).startswith(("int", "Int")):
                other[c] = other[c].astype("float64")
    a, b = canonical(ours), canonical(theirs)
    if a != b:
        sa, sb = set(a), set(b)
        only = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
        return f"{len(a)} rows against {len(b)}; only ours {only[0]}; only theirs {only[1]}"
    return None
