"""Rows of a query against those of its SQL, in any order, columns by name."""


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    try:
        return f"{float(v):.8g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(norm(r[i]) for i in order) for r in data)


def same(df, duck, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = duck.execute(sql)
    want = rows([c[0] for c in q.description], q.fetchall())
    assert got == want
