"""Document fingerprints: a canonical exact digest, with Spark expressions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space as one
blank, trimmed.  Digest: two 64-bit xxhash values of that form with different
seeds, as 32 hex digits.  Where a digest occurs more than once, the texts that have
it are compared (``fingerprinted``: by their bytes; ``neighbours``: by SHA-256, and by
bytes where those differ); different ones are told apart, and all but the least of
them carry a suffix.  Edited texts take part in that like others.

Defined results: a null text counts as empty; repeated rows and equal texts get
equal fingerprints; an empty table gives an empty result; other columns are
neither read nor returned by ``neighbours`` and kept by ``fingerprinted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Tables

#: Cells that digests are dealt to; those of repeated digests are sent to every task.
CELLS = 1 << 18
#: Collisions up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Ranges of doc_id that neighbours are found in, at least.
RANGES = 200
BLANKS = r"(?U)\s+"


def canonical(text: Column) -> Column:
    def composed(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), BLANKS, " "))


def digest(canon: Column) -> Column:
    def wide(*x: Column) -> Column:
        return F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")

    return F.concat(wide(canon), wide(F.lit("second seed"), canon))


def collisions(canon: DataFrame) -> DataFrame:
    """(digest, canon, nth): canonical texts that share a digest with another, numbered by their bytes.

    ``canon`` has the columns digest and canon.  Equal texts meet in the partial
    aggregate of each task, so a group of copies sends one row per task.
    """
    distinct = canon.groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    shared = distinct.groupBy("digest").count().filter("count > 1")
    return distinct.join(shared, "digest", "left_semi").select("digest", "canon", (F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1).alias("nth"))


def resolved(df: DataFrame, found: DataFrame, rows: int, digest_column: str, canon_column: str) -> DataFrame:
    """``df`` with the digest of colliding texts completed by the text's number."""
    if not rows:
        return df
    found = found.select(F.col("digest").alias(digest_column), F.col("canon").alias(canon_column), "nth")
    found = F.broadcast(found) if rows <= BROADCAST_ROWS else found
    suffix = F.when(F.col("nth") > 0, F.concat(F.lit(":"), F.col("nth").cast("string"))).otherwise("")
    return df.join(found, [digest_column, canon_column], "left").withColumn(digest_column, F.concat(digest_column, suffix)).drop("nth")


def cell(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(CELLS)).cast("int")


def repeated(canon: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``canon`` (digest, canon) that may share a digest with another of ``digests`` (digest): a text alone with
    its digest needs no comparison, so most texts are spared the shuffle.  At most ``CELLS`` cells are broadcast."""
    return sharing(canon, digests.groupBy("digest").count().filter("count > 1"))


def sharing(canon: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``canon`` whose digest shares a cell with one of ``digests``."""
    cells = digests.select(cell("digest").alias("cell")).distinct()
    return canon.join(F.broadcast(cells), cell("digest") == F.col("cell"), "left_semi")


def fingerprinted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column ``fingerprint``; a column of that name is replaced."""
    canon = df.select(canonical(F.col(text)).alias("canon")).select(digest(F.col("canon")).alias("digest"), "canon")
    found = collisions(repeated(canon, canon.select("digest")))
    out = df.withColumn("_canon", canonical(F.col(text))).withColumn("fingerprint", digest(F.col("_canon")))
    return resolved(out, found, found.count(), "fingerprint", "_canon").select(*[c for c in df.columns if c != "fingerprint"], "fingerprint")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(fingerprint, first, copies): each class of equal texts with its least key and its number of rows."""
    return fingerprinted(df, text).groupBy("fingerprint").agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def with_next(df: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(key, *columns, next_*): each row with the values of the row after it in descending key; the last meets the first.

    Rows go to ranges of the key, split at quantiles that occur in the data.  The
    row at a split is also sent to the range above, where it ends the order, so
    no range needs to see another.  Null keys come last; equal keys are ordered
    by the columns.
    """
    spark = df.sparkSession
    number = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("key"), *columns)
    wanted = [i / number for i in range(1, number + 1)]
    found = rows.agg(F.percentile_approx("key", wanted, 10 * number).alias("splits"), F.max("key").alias("last"), F.count(F.when(F.isnull("key"), 1)).alias("nulls")).first()
    splits = sorted({*(found["splits"] or []), *([found["last"]] if found["last"] is not None else [])})
    if not splits:
        bucket, also = F.lit(0), F.lit(True)
        also_in = F.lit(0)
    else:
        array = F.array(*[F.lit(x) for x in splits])
        bucket = F.coalesce(F.size(F.filter(array, lambda s: s < F.col("key"))), F.lit(0))
        also = F.coalesce(F.array_contains(array, F.col("key")), F.lit(False))
        also_in = F.when(bucket == len(splits) - 1, 0).otherwise(bucket + 1)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))
    placed = rows.select("*", F.explode(F.when(also, F.array(own, F.struct(also_in.alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))).alias("at"))
    order = Window.partitionBy("at.bucket").orderBy(F.col("at.extra"), F.col("key").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns])
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("at.extra = 0").select(F.col("key").alias(key), *columns, *[f"next_{c}" for c in columns])


def edited_rows(df: DataFrame) -> DataFrame:
    """(doc_id, text, edited, next_text): each text, its edited form, and the next document's."""
    out = with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    return out.select("doc_id", "text", edited.alias("edited"), "next_text")


def neighbours(df: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Likeness of two exact fingerprints is 1 where the canonical texts are equal
    byte for byte, else 0.  The digests are one written table, with a SHA-256 of each
    canonical text.  Where a digest occurs with two of those, the texts that have it
    are read again and compared by their bytes; else no text is moved a second time.
    """
    tables = Tables(df.sparkSession)
    rows = edited_rows(df)
    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(f"{c}_canon") for c in ("text", "edited", "next_text")])
    own, edited, after = (F.col(f"{c}_canon") for c in ("text", "edited", "next_text"))

    def finished(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    out = out.select("*", digest(own).alias("fingerprint"), digest(edited).alias("edited_fingerprint"), (own == edited).cast("double").alias("near_edited"), (own == after).cast("double").alias("near_next"))
    # 32 bytes of each canonical text, so that only digests of different texts need the texts again.
    proofs = [F.unhex(F.sha2(c, 256)).alias(n) for c, n in ((own, "own_proof"), (edited, "edited_proof"))]
    whole = tables.write(out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *proofs), "fingerprints")
    known = finished(whole)
    each = F.array(F.struct(F.col("fingerprint").alias("digest"), F.col("own_proof").alias("proof")), F.struct(F.col("edited_fingerprint").alias("digest"), F.col("edited_proof").alias("proof")))
    proofs_of = whole.select(F.inline(each)).groupBy("digest").agg(F.min("proof").alias("low"), F.max("proof").alias("high"))
    clashes, seen = tables.counted(proofs_of.filter("low != high").select("digest"), "clashes")
    if not seen["n"]:
        return known
    canon = rows.select(F.explode(F.array(canonical(F.col("text")), canonical(F.col("edited")))).alias("canon")).select(digest(F.col("canon")).alias("digest"), "canon")
    found, seen = tables.counted(collisions(sharing(canon, clashes)), "collisions")
    for c in ("text", "edited"):
        out = resolved(out, found, seen["n"], "fingerprint" if c == "text" else "edited_fingerprint", f"{c}_canon")
    return finished(out)
