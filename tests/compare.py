"""Order-insensitive comparison of a query's rows with its oracle's."""

import decimal


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in expected)
    assert len(got) == len(want)
    assert got == want
