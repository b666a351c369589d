"""Helpers: run a catalogue query and its SQL twin, compare as multisets (floats to 6 places)."""

import math

import duckdb

from canopy import tables


def _norm(v, inside=False):
    """Comparable form of a value; the sign of zero counts inside arrays, as in the driver's comparison."""
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) if inside else round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, True) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), inside)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


_CONS = {}


def duck(sf_dir):
    if sf_dir not in _CONS:
        con = duckdb.connect()
        for t in tables.TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _CONS[sf_dir] = con
    return _CONS[sf_dir]


def compare(df, sql, sf_dir):
    s_cols, s_rows = df.columns, df.collect()
    res = duck(sf_dir).execute(sql)
    o_cols = [c[0] for c in res.description]
    o_rows = res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows(s_cols, s_rows) == rows(o_cols, o_rows)
    return len(s_rows)
