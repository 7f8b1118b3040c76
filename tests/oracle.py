"""Runs queries beside their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

import math
import sys
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    return v


def compare(spark, sf, names=None, queries=None, sql=None):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = {}
    for name in names or sql:
        try:
            df = queries[name](spark, sf)
            cols = sorted(df.columns)
            got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
            rel = con.sql(sql[name])
            if sorted(rel.columns) != cols:
                out[name] = f"columns {cols} {sorted(rel.columns)}"
                continue
            want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
            bad = [(g, w) for g, w in zip(got, want) if g != w]
            out[name] = "" if got == want else f"{len(got)} rows, {len(want)} wanted; {cols}: {bad[:2]}"
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {str(e)[:500]}"
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from pyspark.sql import SparkSession

    from siltmark import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for name, why in compare(spark, sys.argv[1], sys.argv[2:] or None, catalog.QUERIES, catalog.ORACLE_SQL).items():
        print("ok  " if not why else "BAD ", name, why[:900])
