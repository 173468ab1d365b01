"""Compare a DataFrame with DuckDB rows, in any order."""


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(repr(tuple(round(float(x), 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in zip(*columns, strict=True))


def assert_same(df, duck, sql):
    got, wanted = df.toArrow(), duck.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(wanted.column_names)
    assert rows(got) == rows(wanted)
