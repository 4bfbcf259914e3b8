"""What tests share: the tables and the comparison with SQL."""

import os

SF = "/root/testdata/sf0.001"


def canonical(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def same_as_sql(df, sql, sf_dir=SF):
    """Asserts that df and the SQL over the same tables give equal rows."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(canonical(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(canonical(r[i]) for i in at)) for r in rel.fetchall())
    assert ours == theirs
