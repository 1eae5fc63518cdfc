"""References to images, their inventory, cached recognition results, and text per note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEX64 = "^[0-9a-f]{64}$"


def by_basename(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs (basename, ...) with status, path, sha256, candidates: one image is resolved, none missing, more ambiguous."""
    own = inventory.groupBy("basename").agg(F.count("*").alias("candidates"), F.min_by("path", "path").alias("path"), F.min_by("sha256", "path").alias("sha256"))
    found = refs.join(own, "basename", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    one = F.col("candidates") == 1
    status = F.when(one, "resolved").when(F.col("candidates") == 0, "missing").otherwise("ambiguous")
    return found.withColumns({"status": status, "path": F.when(one, F.col("path")), "sha256": F.when(one, F.col("sha256"))})


def by_path(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs (ref_id, note_dir, ref) with status, method, path, sha256, candidates.

    A local reference is tried from its note's folder and from the root.  Two
    different images are ambiguous, none is missing; if every candidate leaves
    the root, the reference is unsafe.
    """
    read = refs.withColumn("r", T.image_reference(F.col("ref"), ascii_only=False))
    read = read.select("ref_id", "note_dir", "ref", "r.path", "r.status")
    tries = F.array(
        F.struct(F.lit("note_relative").alias("method"), T.safe_path(F.concat_ws("/", F.nullif("note_dir", F.lit("")), "path")).alias("candidate")),
        F.struct(F.lit("root_relative").alias("method"), T.safe_path(F.col("path")).alias("candidate")),
    )
    local = read.where("status = 'local'").select("ref_id", F.explode(tries).alias("t")).select("ref_id", "t.method", "t.candidate")
    hits = local.join(inventory.select(F.col("path").alias("candidate"), "sha256"), "candidate", "left")
    hit = F.col("sha256").isNotNull()
    found = hits.groupBy("ref_id").agg(
        F.count("candidate").alias("safe"),
        F.count_distinct(F.when(hit, F.col("candidate"))).alias("candidates"),
        F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("method")))), "+").alias("method"),
        F.min(F.when(hit, F.struct("candidate", "sha256"))).alias("image"),
    )
    out = read.drop("path").join(found, "ref_id", "left")
    one = (F.col("status") == "local") & (F.col("candidates") == 1)
    status = F.when(F.col("status") != "local", F.col("status")).when(F.col("safe") == 0, "unsafe").when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return out.select(
        "ref_id", "note_dir", "ref", status.alias("status"), F.when(one, F.col("method")).otherwise(F.lit("")).alias("method"),
        F.when(one, F.col("image.candidate")).alias("path"), F.when(one, F.col("image.sha256")).alias("sha256"), F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"),
    )


LEGACY = {"image_name": "string", "exists_in_root": "string"}


def provenance(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """ref_id, path, sha256, violation: references (status, path, sha256) as the inventory bears them out.

    Only those of status resolved, or blank as old exports have it, are looked
    at.  A resolved one needs a path and a hash; a hash, where there is one,
    must be one and be the image's.  An old export's row without a path is
    found by its image_name, if exists_in_root is 1 and one image alone has the
    name; else it is no image and no violation.  path and sha256 are the
    image's, null unless it is found.
    """
    for name, kind in LEGACY.items():
        if name not in refs.columns:
            refs = refs.withColumn(name, F.lit(None).cast(kind))
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = refs.select("ref_id", clean("status").alias("status"), clean("path").alias("told"), F.lower(clean("sha256")).alias("hash"), F.lower(F.element_at(F.split(clean("image_name"), r"[/\\]"), -1)).alias("base"), clean("exists_in_root").alias("exists"))
    rows = rows.where(F.col("status").isin("", "resolved"))
    named = inventory.groupBy(F.col("basename").alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1")
    rows = rows.join(named, "base", "left")
    old = (F.col("told") == "") & (F.col("exists") == "1") & (F.col("base") != "")
    rows = rows.withColumn("at", F.when(F.col("told") != "", T.safe_path(F.col("told"))).when(old, F.col("only")))
    rows = rows.join(inventory.select(F.col("path").alias("at"), F.lower("sha256").alias("current")), "at", "left")
    resolved = F.col("status") == "resolved"
    violation = (
        F.when(resolved & (F.col("told") == ""), "resolved_without_path")
        .when(resolved & (F.col("hash") == ""), "resolved_without_hash")
        .when((F.col("hash") != "") & ~F.col("hash").rlike(HEX64), "bad_hash")
        .when((F.col("told") != "") & F.col("current").isNull(), "image_not_in_inventory")
        .when((F.col("hash") != "") & (F.col("current") != F.col("hash")), "hash_changed")
    )
    found = F.col("current").isNotNull()
    return rows.select("ref_id", F.when(found, F.col("at")).alias("path"), "current", violation.alias("violation")).withColumnRenamed("current", "sha256")


def provenance_violations(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """ref_id, violation: the references that ``provenance`` finds fault with."""
    if "basename" not in inventory.columns:
        inventory = inventory.withColumn("basename", F.lower(F.element_at(F.split("path", "/"), -1)))
    return provenance(refs, inventory).select("ref_id", "violation").where("violation IS NOT NULL")


def usable_rows(cache: DataFrame) -> DataFrame:
    """Rows with hashes of 64 hex digits, status ok or empty, and the key of image and configuration."""
    return cache.where(
        F.col("image_sha256").rlike(HEX64) & F.col("ocr_config_sha256").rlike(HEX64) & F.col("ocr_status").isin("ok", "empty")
        & (F.col("ocr_cache_key") == T.cache_key(F.col("image_sha256"), F.col("ocr_config_sha256")))
    )


def usable_cache(cache: DataFrame) -> DataFrame:
    """The last usable row of each key."""
    last = usable_rows(cache).groupBy("ocr_cache_key").agg(F.max_by(F.struct("ocr_status", "ocr_text"), "ordinal").alias("c"))
    return last.select("ocr_cache_key", "c.ocr_status", "c.ocr_text")


def reuse(images: DataFrame, cache: DataFrame, config_sha: Column) -> DataFrame:
    """images (path, sha256) with ocr_status, ocr_text and cache_reused."""
    keyed = images.withColumn("ocr_cache_key", T.cache_key(F.col("sha256"), config_sha))
    found = keyed.join(usable_cache(cache), "ocr_cache_key", "left")
    return found.withColumn("cache_reused", F.col("ocr_status").isNotNull().cast("int"))


def missing_from_cache(images: DataFrame, cache: DataFrame, config_sha: Column) -> DataFrame:
    """Images for which a run without recognition finds no cached result."""
    keyed = images.withColumn("ocr_cache_key", T.cache_key(F.col("sha256"), config_sha))
    return keyed.join(usable_cache(cache), "ocr_cache_key", "left_anti").select("path", "sha256")


def configurations(cache: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many configurations a cache names, or each of its groups; rows that name none don't count."""
    named = F.nullif(F.trim("ocr_config_sha256"), F.lit(""))
    return cache.groupBy(*(by or [])).agg(F.count_distinct(named).alias("configurations"))


def one_configuration(cache: DataFrame) -> DataFrame:
    """A violation row where a cache names other than one configuration."""
    return configurations(cache).where("configurations <> 1")


def attach_text(refs: DataFrame, recognised: DataFrame) -> DataFrame:
    """References with the recognised text of their image, or the status of one that was not processed."""
    found = refs.join(recognised.select("path", "ocr_status", "ocr_text"), "path", "left")
    return found.withColumns({"ocr_status": F.coalesce("ocr_status", F.lit("not_local_or_not_processed")), "ocr_text": F.coalesce("ocr_text", F.lit(""))})


def note_text(corpus: DataFrame, note_ocr: DataFrame) -> DataFrame:
    """Notes with their recognised text, found by id or else by the legacy id.

    Ids alone are looked up; the notes' own texts are joined once.
    """
    keys = F.array(F.struct(F.lit(0).alias("place"), F.col("note_id").alias("key")), F.struct(F.lit(1).alias("place"), F.col("legacy_note_id").alias("key")))
    ids = corpus.select("note_id", F.explode(keys).alias("k")).select("note_id", "k.place", "k.key")
    found = ids.join(note_ocr.select(F.col("note_id").alias("key"), "ocr_text"), "key").groupBy("note_id").agg(F.min_by("ocr_text", "place").alias("ocr_text"))
    return corpus.join(found, "note_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def text_of_notes(joined: DataFrame) -> DataFrame:
    """Counts and recognised text of each note that has references.

    joined: note_id, ref_index, path, sha256, ocr_status, ocr_word_count,
    ocr_char_count, ocr_text.  Equal contents (hash, else path) of a note count
    once in words, characters and text; text blocks stand in order of
    reference.
    """
    content = F.coalesce(F.nullif(F.col("sha256"), F.lit("")), F.col("path"))
    # the first reference of each content, by ok before others; partial minima, no sort over a note
    ok = F.col("ocr_status") == "ok"
    per = joined.withColumn("content", F.coalesce(content, F.lit(""))).groupBy("note_id", "content").agg(
        F.count("*").alias("refs"), F.count_if(ok).alias("oks"), F.count_if(content.isNull()).alias("blank"),
        F.min(F.when(ok, F.struct("ref_index", "ocr_word_count", "ocr_char_count", "ocr_text"))).alias("first"),
    )
    unique = F.col("content") != ""
    out = per.groupBy("note_id").agg(
        F.sum("refs").alias("ocr_ref_count"), F.sum("oks").alias("ocr_ok_count"),
        F.count_if(unique).alias("unique_image_count"), F.count_if(unique & F.col("first").isNotNull()).alias("unique_ok_count"),
        (F.sum(F.when(unique, F.col("refs")).otherwise(0)) - F.count_if(unique)).alias("duplicate_ref_count"),
        F.coalesce(F.sum(F.when(unique, F.col("first.ocr_word_count"))), F.lit(0)).alias("ocr_word_count"),
        F.coalesce(F.sum(F.when(unique, F.col("first.ocr_char_count"))), F.lit(0)).alias("ocr_char_count"),
        F.array_sort(F.collect_list(F.when(unique & T.filled(F.col("first.ocr_text")), F.struct(F.col("first.ref_index").alias("i"), F.col("first.ocr_text").alias("t"))))).alias("blocks"),
    )
    return out.withColumn("ocr_text", F.array_join(F.transform("blocks", lambda b: b["t"]), "\n\n")).drop("blocks")


def text_per_note(corpus: DataFrame, joined: DataFrame) -> DataFrame:
    """One row a note of the corpus, those without references too: see ``text_of_notes``."""
    out = text_of_notes(joined)
    notes = corpus.select("note_id", "source").join(out, "note_id", "left")
    return notes.fillna(0, [c for c in out.columns if c.endswith("count")]).fillna("", ["ocr_text"])


def coverage_by_source(joined: DataFrame, statuses: list[str]) -> DataFrame:
    """References, one count a status, and words (of each reference, not of each image) by source."""
    counts = [F.count_if(F.col("ocr_status") == s).alias(f"{s}_count") for s in statuses]
    return joined.groupBy(T.source_or_none(F.col("source")).alias("source")).agg(F.count("*").alias("ref_count"), *counts, F.sum("ocr_word_count").alias("ocr_word_count"))


def status_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("status").agg(F.count("*").alias("ref_count"), F.count_distinct("path").alias("distinct_images"))


def in_order(table: DataFrame, keys: list[str]) -> DataFrame:
    """The table in the order its files show; only for what is written out."""
    return table.orderBy(*keys)


def numbered_refs(refs: DataFrame) -> DataFrame:
    return refs.withColumn("ref_index", F.row_number().over(Window.partitionBy("note_id").orderBy("ref_index", "ref")))
