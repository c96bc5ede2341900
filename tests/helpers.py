"""What several test modules use."""


def values(df, *columns):
    """Rows as tuples, sorted with nulls first."""
    rows = [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
