"""Document fingerprints: a canonical exact digest, in DataFrame functions alone.

Canonical text: compatibility composition (NFKC), case folding, composition again, white space
runs to one space, trimmed. The digest is 128 bits of xxhash64, two hashes with different
seeds. Documents are grouped by digest and, inside a digest that several documents share, the
canonical bytes are compared: texts that differ get digests told apart by a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm._tables import by_ids, kept

#: Neighbours are looked for within 2**12 ids, then among such groups.
_GROUP_BITS = 12


def canonical(text: Column) -> Column:
    """The canonical text; null is empty."""
    x = F.coalesce(text, F.lit(""))
    x = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    x = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    x = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.trim(F.regexp_replace(x, r"(?U)[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits of a canonical text."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(1), canon)))))


def compared(rows: DataFrame, canon: str, fingerprint: str) -> DataFrame:
    """fingerprint, canonical text, number: the second and later texts of fingerprints that different texts share.

    Only texts whose fingerprint is shared are shuffled, and each task sends the least and the
    greatest of each; where the two are equal, so are all bytes.
    """
    shared = kept(rows.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(fingerprint), "shared")
    several = by_ids(rows.select(fingerprint, canon), shared, [fingerprint], "left_semi")
    mixed = several.groupBy(fingerprint).agg(F.min(canon).alias("x"), F.max(canon).alias("y")).where("x <> y").select(fingerprint)
    texts = by_ids(several, kept(mixed, "mixed"), [fingerprint], "left_semi").distinct()
    number = F.row_number().over(Window.partitionBy(fingerprint).orderBy(canon))
    return texts.withColumn("number", number).where("number > 1")


def fingerprints(docs: DataFrame, fingerprint_of=digest) -> DataFrame:
    """The rows with a column fingerprint: equal exactly where canonical texts are.

    Null and empty texts share the fingerprint of the empty text; repeated rows share theirs.
    A column of that name is replaced; others stay, whatever their names. ``fingerprint_of`` may
    be a weaker digest.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "fingerprint")).alias("own")
    rows = docs.select(own, canonical(F.col("text")).alias("canon")).withColumn("fingerprint", fingerprint_of(F.col("canon")))
    rows = _told_apart(rows, kept(compared(rows, "canon", "fingerprint"), "told"), "canon", "fingerprint")
    return rows.select("own.*", "fingerprint")


def _told_apart(rows: DataFrame, told: DataFrame, canon: str, fingerprint: str) -> DataFrame:
    """The rows, their fingerprints followed by the numbers that ``told`` (fingerprint, canon, number) has for their texts."""
    if not told.limit(1).count():
        return rows
    named = told.select(F.col("fingerprint").alias(fingerprint), F.col("canon").alias(canon), F.col("number").alias("told_number"))
    return rows.join(named, [fingerprint, canon], "left").withColumn(fingerprint, F.concat_ws("-", fingerprint, F.col("told_number").cast("string"))).drop("told_number")


def _next_smaller(keys: DataFrame) -> DataFrame:
    """key, next: the next smaller key of each of the distinct keys (null for the least).

    Keys are ranged over tasks and written with the number of their range; each looks inside its
    range, and the least of a range looks at the ranges, of which there are as many as tasks.
    """
    ranged = kept(keys.select("key").repartitionByRange(F.desc("key")).withColumn("part", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    tops = ranged.groupBy("part").agg(F.max("key").alias("top"))
    below = tops.withColumn("below", F.lead("top").over(Window.orderBy(F.desc("top")))).select("part", "below")  # a row for each task
    return inside.join(F.broadcast(below), "part").select("key", F.coalesce("next", "below").alias("next"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in the order doc_id descending, text ascending; the last row's is the first's.

    Null texts count as empty. Rows with a null doc_id stand outside the order: their next text is empty.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    alone = docs.where("doc_id IS NULL").withColumn("next_text", F.lit(""))
    grouped = docs.where("doc_id IS NOT NULL").withColumn("g", F.shiftright("doc_id", _GROUP_BITS))
    tops = kept(grouped.groupBy("g").agg(F.max("doc_id").alias("doc_id")), "tops")
    heads = by_ids(grouped, tops.select("doc_id"), ["doc_id"], "left_semi").groupBy("g").agg(F.min("text").alias("head"))
    order = _next_smaller(tops.select(F.col("g").alias("key")))
    first = tops.agg(F.max("g").alias("first"))
    order = order.crossJoin(F.broadcast(first)).select(F.col("key"), F.coalesce("next", "first").alias("g"))  # one row
    after = order.join(heads, "g").select(F.col("key").alias("g"), "head")
    inside = grouped.withColumn("next_text", F.lead("text").over(Window.partitionBy("g").orderBy(F.desc("doc_id"), "text")))
    found = inside.join(after, "g").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))
    return found.unionByName(alone)


def edited_fingerprints(docs: DataFrame, fingerprint_of=digest) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's. An exact digest knows two degrees of likeness: 1 where the
    canonical texts are the same, byte by byte, else 0. Null doc_ids stand outside the order:
    their texts are edited with an empty next text. Other columns are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next_text(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(canonical(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    like = lambda c: F.when(F.col("text") == F.col(c), 1.0).otherwise(0.0)
    rows = rows.withColumns({"fingerprint": fingerprint_of(F.col("text")), "edited_fingerprint": fingerprint_of(F.col("edited")), "near_edited": like("edited"), "near_next": like("next_text")})
    own = docs.select(canonical(F.col("text")).alias("canon")).withColumn("fingerprint", fingerprint_of(F.col("canon")))
    told = kept(compared(own, "canon", "fingerprint"), "told")
    rows = _told_apart(_told_apart(rows, told, "text", "fingerprint"), told, "edited", "edited_fingerprint")
    copies = kept(rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "fingerprints")
    several = kept(copies.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1"), "several")
    found = by_ids(copies, several, ["fingerprint"], "left")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"))
