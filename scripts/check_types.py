"""Compare result column types of each catalogue query and its SQL twin (Spark vs DuckDB)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from canopy import tables  # noqa: E402
from canopy.plans.catalogue import oracle_sql, queries  # noqa: E402
from canopy.session import get_session  # noqa: E402


def spark_to_duck(t) -> str:
    if isinstance(t, T.ArrayType):
        return spark_to_duck(t.elementType) + "[]"
    return {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
        T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP",
        T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.ShortType: "SMALLINT", T.BinaryType: "BLOB",
    }.get(type(t), t.simpleString())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in tables.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(sqls):
        df = qs[name](spark, sf)
        st = {f.name: spark_to_duck(f.dataType) for f in df.schema.fields}
        rel = con.sql(sqls[name])
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            bad += 1
            print(f"{name:30s} {diff}")
    print("type mismatches:", bad)


if __name__ == "__main__":
    main()
