"""Rows of a table in a fixed order, for comparing."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
