"""The manifest against a tree built level by level in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lectern.llm import manifest, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, run=2):
    """(root, for each leaf the list of (before, after) from it upwards)."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    level = list(digests)
    while len(level) > 1:
        up, covered = [], []
        for at in range(0, len(level), run):
            part = level[at : at + run]
            for k in range(len(part)):
                for i in groups[at + k]:
                    paths[i].append(("".join(part[:k]), "".join(part[k + 1 :])))
            up.append(H(*part))
            covered.append([i for g in groups[at : at + run] for i in g])
        level, groups = up, covered
    return level[0], paths


def fold(own, path):
    for before, after in path:
        own = H(before, own, after)
    return own


def plain(rows, run=2):
    """doc_id, leaf, subroot, root, proof, folded root, verified; rows are dictionaries."""
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[c] for c in COLUMNS]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda x: x[:3])
    own = {name: tree([x[2] for x in langs[name]], run) for name in names}
    root, over = tree([own[name][0] for name in names], run) if names else ("", [])
    out = []
    for name, upper in zip(names, over):
        for (_, _, digest, r), path in zip(langs[name], own[name][1]):
            path = [*path, *upper]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            folded = fold(leaf([r[c] + 1 if c == "n_chars" else r[c] for c in COLUMNS]) if tampered else digest, path)
            out.append((r["doc_id"], digest, own[name][0], root, H(*[b + a for b, a in path]), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()], key=str)


def test_op13_equals_the_plain_tree_and_its_sql(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(queries.op13_merkle_manifest(spark, sf_dir))
    assert found == plain(rows)
    assert {r[6] for r in found} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.OP13_SQL})").fetchall(), key=str) == found


def told(spark, docs, run, band):
    """What the query derives, with trees of other shapes."""
    c = F.col
    tampered = F.crc32(c("doc_id").cast("string")) % 7 == 0
    later = manifest.leaf_of(c("doc_id"), c("source"), c("lang"), c("n_chars").cast("decimal(20,0)") + 1, c("text"))
    leaves = docs.select("doc_id", c("lang").alias("tree"), manifest.leaf_of(*map(c, COLUMNS)).alias("leaf"), F.when(tampered, later).alias("claimed"), F.lit(1).alias("lo"), F.lit("p").alias("path"))
    done = manifest.manifest(leaves, ("claimed",), run, band)
    return done.select("doc_id", "leaf", "subroot", "root", manifest.proof_of(c("path")).alias("proof_sha256"), manifest.root_from(F.coalesce("claimed", "leaf"), c("path")).alias("folded_root")).withColumn("verified", c("folded_root") == c("root"))


def test_trees_of_many_bands_runs_and_sizes(spark):
    rng = random.Random(7)
    for run, band in ((2, 1), (2, 2), (3, 1)):
        rows = []
        for lang, n in ((None, 1), ("a", 37), ("é", 8), ("z", 9), ("", 2), ("zz", 16)):
            rows += [(rng.choice([None, *range(40)]), rng.choice(["x", "y"]), rng.choice([None, "s"]), rng.choice([None, 5]), lang) for _ in range(n)]
        rows += [rows[5]] * 20  # repeated rows
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string")
        assert got(told(spark, docs, run, band)) == plain([r.asDict() for r in docs.collect()], run)


def test_odd_documents_one_row_and_none(spark, odd_docs, no_docs):
    docs = odd_docs.select(*COLUMNS)
    assert got(told(spark, docs, 2, 9)) == plain([r.asDict() for r in docs.collect()])
    one = docs.where("doc_id = 3")
    assert got(told(spark, one, 2, 9)) == plain([r.asDict() for r in one.collect()])
    assert told(spark, no_docs, 2, 9).count() == 0


def test_largest_number_of_characters_can_be_tampered_with(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0][:2]
    docs = spark.createDataFrame([(i, "t", "en", "s", (1 << 63) - 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(told(spark, docs, 2, 9)) == plain([r.asDict() for r in docs.collect()])


def test_siblings_are_the_parents_interval_without_the_nodes_own():
    nodes = [(i, i, str(i)) for i in range(5)]
    levels = manifest.levels_above(nodes, 1, True)
    assert [[x[:2] for x in level] for level in levels] == [[(i, i) for i in range(5)], [(0, 1), (2, 3), (4, 4)], [(0, 3), (4, 4)], [(0, 4)]]
    paths = manifest.siblings(levels)
    assert paths[4] == [("", ""), ("", ""), (levels[2][0][2], "")]
    assert paths[2] == [("", "3"), (levels[1][0][2], ""), ("", levels[2][1][2])]
