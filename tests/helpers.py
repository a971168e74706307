"""Comparison of a query with its SQL twin."""

import decimal
import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return round(float(value), 9) if isinstance(value, decimal.Decimal) else value


def same_rows(frame, con, sql):
    names = sorted(frame.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    got = con.execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    order = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)
    assert ours == theirs
    return ours
