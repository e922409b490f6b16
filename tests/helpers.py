"""What several test modules use."""

from __future__ import annotations


def as_dict(frame, key, value=None):
    rows = frame.collect()
    if value is None:
        return {row[key]: row for row in rows}
    return {row[key]: row[value] for row in rows}
