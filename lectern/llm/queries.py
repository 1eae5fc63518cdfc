"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, byte_bpe, centroids, chat, exact_dedup, line_dedup, manifest, ngram_join, packing, sharding, token_counts, toxicity
from .common import cut, pick, read, remove, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents"), width=3, pct=90)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\\### Assistant: </turn> ok"
    own = spark.sql(rf"SELECT * FROM VALUES (-7L, 0L, 'user', '{both}'), (-7L, 1L, 'assistant', '{both}') AS t(conv_id, turn, role, text)")
    shown = chat.format_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    told = F.concat_ws("", F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    losses = F.concat_ws("", "loss_texts")
    return chat.parse(shown).select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under two vocabularies; the second's counts are estimates first, then revised, and lose copies.

    Every batch is committed twice and counts once.
    """
    rows = cut(token_counts.tokenized(read(spark, sf_dir, "documents"), [public_tokenizers.path(TOKENIZER), public_tokenizers.path("byte_bpe_50k.tiktoken")], public_tokenizers.PATTERN))
    folder = f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    rollup = token_counts.Rollup(spark, folder)
    version = token_counts.of_version
    exact, estimate = (lambda x: version(x, "byte-bpe-50k", F.col("tokens")[1])), version(rows, "byte-bpe-50k", F.ceil(F.col("chars") / 4))
    for _ in range(2):
        rollup.commit("words", token_counts.inserts(version(rows, "word-bpe-49k", F.col("tokens")[0])))
        rollup.commit("estimates", token_counts.inserts(estimate))
        rollup.compact()
        rollup.commit("revised", token_counts.revisions(estimate, exact(rows)))
        rollup.commit("copies", token_counts.deletes(exact(token_counts.copies_of(rows))))
    done = cut(rollup.totals())  # a row a group
    remove(spark, folder)
    return done


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return ann.nearest(table, table.where("vec_id % 20 = 0"), 20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = read(spark, sf_dir, "labels").where(~toxicity.held_out())
    done = toxicity.score_documents(read(spark, sf_dir, "documents"), learn)
    return done.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 4_096)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds told one after the other, over components as rows."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND NOT list_contains([x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)) FOR x IN embedding], true))",
        "v AS MATERIALIZED (SELECT row_id, vec_id, unnest(range(64)) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"firsts AS (SELECT row_id, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM firsts JOIN v USING (row_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT row_id, vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS distance FROM v JOIN c{r} m USING (i) GROUP BY row_id, vec_id, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, c) = 1)")
        if r < rounds:
            floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (row_id) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce({floored}, m.x) AS x FROM c{r} m LEFT JOIN s{r} USING (c, i))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, told.hash AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS hash FROM c{rounds} GROUP BY c) told USING (c)
"""


OP12_SQL = _op12_sql()


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    c = F.col
    tampered = F.crc32(c("doc_id").cast("string")) % 7 == 0
    later = manifest.leaf_of(c("doc_id"), c("source"), c("lang"), c("n_chars").cast("decimal(20,0)") + 1, c("text"))
    leaves = docs.select("doc_id", c("lang").alias("tree"), manifest.leaf_of(*map(c, docs.columns)).alias("leaf"), F.when(tampered, later).alias("claimed"))
    done = manifest.manifest(leaves, ("claimed",))
    done = done.withColumn("folded_root", manifest.root_from(F.coalesce("claimed", "leaf"), c("path")))
    return done.select("doc_id", "leaf", "subroot", "root", manifest.proof_of(c("path")).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))


#: The decimal digits of a doc_id, byte by byte and bit by bit.
_CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [CAST(ascii(b) AS BIGINT) FOR b IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: " + "{}" + "))"


def _op13_sql() -> str:
    step = "xor(c, b)"
    told = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(told(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce(list_concat([{}], [CAST(z AS BIGINT) FOR z IN range(8)]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)".format(step)
    crc = _CRC32.format(bits)
    return f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS claimed FROM documents
),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS rank FROM rows),
nodes AS (
  SELECT lang, 0 AS level, rank AS place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (max(width) + 1) // 2 FROM nodes WHERE width > 1 GROUP BY lang, level, place // 2
),
stored AS MATERIALIZED (SELECT * FROM nodes),
tops AS MATERIALIZED (SELECT lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank, count(*) OVER () AS width FROM stored WHERE width = 1),
over_nodes AS (
  SELECT 0 AS level, rank AS place, digest, width FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (max(width) + 1) // 2 FROM over_nodes WHERE width > 1 GROUP BY level, place // 2
),
over_stored AS MATERIALIZED (SELECT * FROM over_nodes),
steps AS MATERIALIZED (
  SELECT l.id, n.level, CASE WHEN s.place < n.place THEN s.digest ELSE '' END AS before, CASE WHEN s.place > n.place THEN s.digest ELSE '' END AS after
  FROM leaves l JOIN stored n ON n.lang IS NOT DISTINCT FROM l.lang AND n.width > 1 AND n.place = l.rank >> n.level
  LEFT JOIN stored s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.place = xor(n.place, 1)
  UNION ALL
  SELECT l.id, 1000 + n.level, CASE WHEN s.place < n.place THEN s.digest ELSE '' END, CASE WHEN s.place > n.place THEN s.digest ELSE '' END
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN over_stored n ON n.width > 1 AND n.place = t.rank >> n.level
  LEFT JOIN over_stored s ON s.level = n.level AND s.place = xor(n.place, 1)
),
paths AS MATERIALIZED (SELECT id, list(before ORDER BY level) AS befores, list(after ORDER BY level) AS afters, string_agg(before || after, '' ORDER BY level) AS proof FROM steps GROUP BY id),
folds AS (
  SELECT l.id, 0 AS done, l.claimed AS digest FROM leaves l
  UNION ALL
  SELECT f.id, done + 1, sha256(befores[done + 1] || digest || afters[done + 1]) FROM folds f JOIN paths p ON p.id = f.id WHERE done < len(befores)
),
ends AS (SELECT id, arg_max(digest, done) AS folded_root FROM folds GROUP BY id)
SELECT l.doc_id, l.leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT digest FROM over_stored WHERE width = 1) r JOIN ends e ON e.id = l.id LEFT JOIN paths p ON p.id = l.id
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_bpe, op4_sharding, op5_exact_dedup, op6_token_counts, op7_line_dedup, op8_nearest_neighbours, op9_toxicity, op10_best_fit_packing, op11_byte_bpe, op12_centroid_clustering, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op12_centroid_clustering": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
