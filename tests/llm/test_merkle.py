import hashlib
import random
import zlib

import duckdb
import pyspark.sql.functions as F
import pytest

from stratalens.llm.merkle import fold, manifest, proof_text
from stratalens.llm.queries import QUERIES, SQL, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, per node, the siblings on its way, level by level, by holding all levels at once."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = range(i - i % 3, min(i - i % 3 + 3, len(nodes)))
            path.append(("".join(nodes[k] for k in run if k < i), "".join(nodes[k] for k in run if k > i)))
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of all rows, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in names}
    lower = {s: climb([leaf for _, leaf in ordered[s]]) for s in names}
    root, upper = climb([lower[s][0] for s in names])
    found = []
    for s, above in zip(names, upper):
        subroot, paths = lower[s]
        found += [(i, leaf, subroot, root, path + above) for (i, leaf), path in zip(ordered[s], paths)]
    return sorted(found, key=str)


def plain(frame):
    return sorted(((r[0], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]) for r in frame.collect()), key=str)


def rows_with(counts, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, rng.choice(["de", None]), rng.randrange(99), f"text\n{i} ü") for s, n in counts.items() for i in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("every", [1, 2, 5])
@pytest.mark.parametrize(
    "counts",
    [
        {"a": 1},
        {"a": 2, "b": 1},
        {"a": 3, None: 4, "": 5, "é": 9, "z": 10, "Z": 1},
        {"hot": 260, "b": 27, "c": 28, "d": 1},
        {f"s{i}": 1 + i % 3 for i in range(30)},
    ],
)
def test_against_brute_force(spark, counts, every):
    rows = rows_with(counts)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS tree", "'x' AS digest", "3 AS level").repartition(5)
    got = manifest(frame, FIELDS, every=every)
    assert plain(got) == brute(rows)
    proof = F.col("proof")
    folded = got.select((fold(F.col("leaf"), proof) == F.col("root")).alias("same"), F.sha2(proof_text(proof), 256).alias("text")).collect()
    assert all(r["same"] for r in folded)
    assert sorted(r["text"] for r in folded) == sorted(sha("".join(a + b for a, b in p)) for *_, p in brute(rows))


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(None, None, None, None, None), (None, "a", None, 1, "x"), (3, "a", "de", 2, ""), (3, "a", "de", 2, ""), (3, "a", "de", 2, "other"), (4, "a", "de", None, long), (-5, "a", "", 0, "\n")]
    assert plain(manifest(spark.createDataFrame(rows, SCHEMA), FIELDS)) == brute(rows)
    assert plain(manifest(spark.createDataFrame(rows * 40, SCHEMA), FIELDS)) == brute(rows * 40)
    assert manifest(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0


def test_carried_columns_and_tampering(spark):
    rows = rows_with({"a": 12, "b": 5})
    frame = spark.createDataFrame(rows, SCHEMA)
    got = manifest(frame, FIELDS, carry={"leaf_of_other": F.sha2("text", 256), "mark": F.col("n_chars")})
    assert {r["doc_id"]: (r["leaf_of_other"], r["mark"]) for r in got.collect()} == {r[0]: (sha(r[4]), r[3]) for r in rows}
    wrong = got.select((fold(F.col("leaf_of_other"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert not any(r["same"] for r in wrong)


def test_query_against_brute_force_and_sql(spark, small):
    got = {r["doc_id"]: r for r in QUERIES["op13_merkle"](spark, small).collect()}
    rows = [tuple(r) for r in table(spark, small, "documents").select(*FIELDS).collect()]
    text = {r[0]: r for r in rows}
    want = brute(rows)
    assert sorted(got) == sorted(text)
    for i, leaf, subroot, root, path in want:
        row = text[i]
        changed = row[4] is not None and zlib.crc32(str(i).encode()) % 2 == 0
        node = leaf_of((*row[:4], row[4].replace("\n", ""))) if changed else leaf
        for left, right in path:
            node = sha(left + node + right)
        assert tuple(got[i])[1:] == (leaf, subroot, root, sha("".join(a + b for a, b in path)), node, node == root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    answer = con.execute(SQL["op13_merkle"])
    names = [d[0] for d in answer.description]
    assert sorted(answer.fetchall()) == sorted(tuple(r[n] for n in names) for r in got.values())
