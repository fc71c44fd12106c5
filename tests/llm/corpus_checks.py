"""Helpers of the corpus tests."""


def by_id(frame, *columns):
    return {row["doc_id"]: tuple(row[c] for c in columns) for row in frame.collect()}
