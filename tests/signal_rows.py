"""Rows and results that several test files share."""

from signalloom.spec import HEARTBEAT


def pad(samples, n=HEARTBEAT.n_samples):
    return [float(x) for x in samples] + [0.0] * (n - len(samples))


def beat_rows(rows):
    """(id, split, label, samples) with the five-class names."""
    names = HEARTBEAT.collection("mitbih").names
    return [
        (i, "mitbih", split, label, None if label is None else names[label], signal)
        for i, split, label, signal in rows
    ]


def as_dicts(df):
    return [row.asDict() for row in df.collect()]


def by_key(df, *keys):
    out = {}
    for row in as_dicts(df):
        key = tuple(row[k] for k in keys)
        out[key if len(key) > 1 else key[0]] = row
    return out
