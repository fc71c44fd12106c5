"""The corpus operators as registered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from stratalens.llm import langid, quality, toxicity, whitening
from stratalens.llm.bpe import decode_ids, encode_texts
from stratalens.llm.decontaminate import find_contamination
from stratalens.llm.exact_dedup import exact_duplicates
from stratalens.llm.licenses import scan_licenses
from stratalens.llm.line_dedup import dedup_lines
from stratalens.llm.merkle import fold, leaf_digest, manifest, proof_text
from stratalens.llm.ngram_join import near_duplicates
from stratalens.llm.packing import pack
from stratalens.llm.pii import BASE_KINDS, find_pii
from stratalens.llm.text import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each whole document states or quotes, and the closest match."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.size("matches").cast("long").alias("n_matches"),
        best["license"].alias("best_license"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("best_dice"),
    )


@query(
    "op2_line_dedup",
    f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, shared.key IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in at least 3 documents stay in the largest id only."""
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op9_exact_dedup",
    f"""WITH norm AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
grouped AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm.t) AS text_sha256
FROM norm JOIN grouped ON norm.t = grouped.t""",
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the id that stays in its group of equal texts."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, tokenised and packed into sequences of at most 1024 tokens; the ids show as their check sum."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024).drop("ids")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets per document; the base kinds are counted and hashed apart."""
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    more = [F.size(of("secret")).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of ten words of a test item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def held_out(modulus: int, fold: int) -> Column:
    """Whether the crc32 of the id leaves ``fold``; a null id is not held out."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == fold, F.lit(False)).alias("held_out")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the known ones."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=remainder(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, model).select("doc_id", held_out(3, 1), "lang_pred", "score")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, ranked by pairs of labelled ones of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=remainder(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones of three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=remainder(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90, bits_per_hash=8)


@query("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them, as digests."""
    path = tokenizer_path("word_bpe_49k.json")
    found = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection of every usable vector on the leading 32 components, one row a component."""
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, components=32)
    error = whitening.identity_error(rows, model)
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values])
    found = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return found.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _hashed(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _tree_sql(name: str, start: str) -> str:
    """Recursive levels ``(tree, level, pos, n, h)`` above ``start``, and the text beside every node that is not a root."""
    run = "PARTITION BY tree, level, pos // 3 ORDER BY pos"
    near = ["coalesce({}(h, {}) OVER ({}), '')".format(f, k, run) for f, k in (("lag", 2), ("lag", 1), ("lead", 1), ("lead", 2))]
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, h FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3, n),
{name}_near AS (SELECT tree, level, pos, {near[0]} || {near[1]} AS l, {near[2]} || {near[3]} AS r FROM {name} WHERE n > 1)"""


def _path_sql(name: str, start: str) -> str:
    """Every row of ``start`` on its way up the levels of ``name``."""
    return f"""{name}_path AS (
  SELECT id, tree, 0 AS level, pos, n, node, proof FROM {start}
  UNION ALL
  SELECT id, p.tree, p.level + 1, p.pos // 3, (n + 2) // 3, sha256(l || node || r), proof || l || r
  FROM {name}_path p JOIN {name}_near s ON p.tree = s.tree AND p.level = s.level AND p.pos = s.pos WHERE n > 1)"""


@query(
    "op13_merkle",
    f"""WITH RECURSIVE bits AS (
  SELECT *, list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: (ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) >> (k % 8)::INT) & 1) AS b FROM documents),
crc AS (SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(b, lambda x: x::BIGINT)),
  lambda c, x: xor(c >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)) & 1 = 1 AS even FROM bits),
leaves AS (SELECT doc_id, coalesce('g' || source, '') AS tree, {_hashed("text")} AS h,
  CASE WHEN even THEN {_hashed("replace(text, chr(10), '')")} END AS tampered FROM crc),
placed AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree_sql("up", "placed")},
subroots AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree_sql("top", "subroots")},
begun AS (SELECT id, tree, pos, n, coalesce(tampered, h) AS node, '' AS proof FROM placed),
{_path_sql("up", "begun")},
lifted AS (SELECT id, s.tree, s.pos, s.n, node, proof FROM up_path p JOIN subroots s ON p.tree = s.name WHERE p.n = 1),
{_path_sql("top", "lifted")}
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.node AS folded_root, p.node = t.h AS verified
FROM placed d JOIN subroots s ON d.tree = s.name JOIN top t ON t.n = 1 JOIN top_path p ON p.id = d.id AND p.n = 1""",
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a copy without line ends leads to."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = leaf_digest(*[F.col(f) for f in fields[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), changed)
    found = manifest(table(spark, sf_dir, "documents"), fields, carry={"tampered": tampered})
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
