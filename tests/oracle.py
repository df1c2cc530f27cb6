"""Run a query in Spark and its SQL in DuckDB and compare names, types and values."""

import glob
import math
import os

import duckdb

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
          "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _key(row):
    return tuple((v is None, "" if v is None else repr(round(v, 6)) if isinstance(v, float)
                  and not math.isnan(v) else repr(v)) for v in row)


def compare(spark, con, query, sql, sf_dir=SF):
    """Returns a list of complaints, empty when both agree, and the row count."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"], 0
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    bad = [f"type of {c}: {t} != {want_types[c]}" for c, t in df.dtypes
           if _TYPES.get(t) != want_types[c]]
    got = sorted((tuple(r) for r in df.select(*got_cols).collect()), key=_key)
    quoted = ", ".join('"%s"' % c for c in got_cols)
    want = sorted(rel.project(quoted).fetchall(), key=_key)
    if len(got) != len(want):
        bad.append(f"rows {len(got)} != {len(want)}")
    for g, w in zip(got, want):
        if _key(g) != _key(w):
            bad.append(f"first difference: {str(g)[:400]} != {str(w)[:400]}")
            break
    return bad, len(got)


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from colloquary.session import build_session

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(), entry.oracle_sql()
    wanted = sys.argv[1:]
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            bad, n = compare(spark, con, query, oracle[name])
        except Exception as e:  # report and go on with the next
            bad, n = [f"{type(e).__name__}: {str(e)[:1500]}"], 0
        print("ok " if not bad else "BAD", name, n, f"{time.time() - t:.2f}s", *bad, flush=True)
