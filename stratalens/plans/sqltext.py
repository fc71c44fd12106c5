"""Pieces of SQL that the comparison queries share."""

from __future__ import annotations

from collections.abc import Sequence

PEOPLE = """people AS (
  SELECT c_custkey, n_name AS country, r_name AS region, c_mktsegment AS segment, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SURVEY = """survey AS (
  SELECT o_orderkey AS respondent, country, region, segment, o_orderpriority AS priority,
         o_orderstatus AS status, o_totalprice AS price, CAST(year(o_orderdate) AS BIGINT) AS wave
  FROM orders JOIN people ON o_custkey = c_custkey)"""

LABELLED = """labelled AS (
  SELECT l.doc_id, lang, source, quality, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

STANDARD = [
    ("Country × Segment", ("country", "segment")),
    ("Region × Segment", ("region", "segment")),
    ("Country", ("country",)),
    ("Region", ("region",)),
    ("Segment", ("segment",)),
]
STANDARD_KEYS = ("country", "segment", "region")
DOCUMENT = [("Language × Source", ("lang", "source")), ("Language", ("lang",)), ("Source", ("source",))]
DOCUMENT_KEYS = ("lang", "source")


def r(expr: str, name: str) -> str:
    """A rounded double column without negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def counted(name: str, table: str, dims, keys: Sequence[str], by: Sequence[str] = ()) -> str:
    """Counts per dimension and group, one SELECT per dimension; null keys leave their dimension."""
    parts = []
    for dim, cols in dims:
        shown = ", ".join(k if k in cols else f"CAST(NULL AS VARCHAR) AS {k}" for k in keys)
        lead = "".join(f"{b}, " for b in by)
        whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        parts.append(
            f"SELECT {lead}'{dim}' AS dimension, {shown}, count(*) AS n FROM {table} WHERE {whole} "
            f"GROUP BY {lead}{', '.join(cols)}"
        )
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def shares(name: str, table: str, dims, keys: Sequence[str]) -> str:
    """Long benchmark: counts over all rows of ``table``."""
    return (
        counted(f"{name}_n", table, dims, keys)
        + f",\n{name} AS (SELECT dimension, {', '.join(keys)}, n::DOUBLE / (SELECT count(*) FROM {table}) AS q FROM {name}_n)"
    )


def lined_up(
    dims,
    keys: Sequence[str],
    survey: str = "survey",
    base: str = "people",
    by: Sequence[str] = (),
    threshold: str | None = None,
    total: str = "size",
) -> str:
    """CTEs ``counts, bench, sizes, aligned``: full outer alignment with s, q, t, n, relevant and
    the sample size under the name ``total``."""
    lead = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    bar = threshold or f"1.0 / {total}"
    on = " AND ".join(f"e.{c} IS NOT DISTINCT FROM c.{c}" for c in [*by, "dimension", *keys])
    merged = ", ".join(f"coalesce(e.{c}, c.{c}) AS {c}" for c in [*by, "dimension", *keys])
    match = "".join(f" AND sizes.{b} = counts.{b}" for b in by)
    return f"""{counted("counts", survey, dims, keys, by)},
{shares("bench", base, dims, keys)},
sizes AS (SELECT {lead}count(*) AS {total} FROM {survey} {group}),
expected AS (
  SELECT {lead}bench.*, {total}, q > {bar} AS relevant,
         sqrt(q) / sum(sqrt(q)) OVER (PARTITION BY {lead}dimension) AS t
  FROM bench, sizes),
sampled AS (SELECT counts.*, {total}, n::DOUBLE / {total} AS s FROM counts JOIN sizes ON true{match}),
aligned AS (
  SELECT {merged}, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(t, 0) AS t,
         coalesce(relevant, false) AS relevant, coalesce(e.{total}, c.{total}) AS {total}, q IS NOT NULL AS in_bench
  FROM expected e FULL OUTER JOIN sampled c ON {on})"""


def label(dims, keys: Sequence[str]) -> str:
    """Stratum name in the dimension's own column order."""
    cases = " ".join(f"WHEN dimension = '{d}' THEN concat_ws(' × ', {', '.join(c)})" for d, c in dims)
    return f"CASE {cases} END"


MATCH = "1 - 0.5 * sum(abs(s - q))"
STRATEGIC = "1 - 0.5 * sum(abs(s - t))"
COVERAGE = (
    "CASE WHEN count(*) FILTER (relevant) = 0 THEN 1.0 "
    "ELSE count(*) FILTER (relevant AND n > 0)::DOUBLE / count(*) FILTER (relevant) END"
)
SE = "CASE WHEN n > 0 THEN sqrt(s * (1 - s) / n) ELSE 1.0 END"
WEIGHTED = "CASE WHEN sum(w) > 0 THEN 1 - sum(w * abs(s - q)) / sum(w) ELSE 0.0 END"

ORDERS = PEOPLE + ",\n" + SURVEY
