"""Results as plain values."""


def listed(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
