"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Lengths are counted first. Prefixes are hashed only in rows whose length
repeats, and whole texts only in rows whose (length, prefix) repeats. What
survives a level reaches the next scan as a bitmap with ``SLOTS`` bits and more
for every survivor, so no text is shuffled to find copies. A bitmap is broadcast
and never larger than ``MOST_BITS`` (256 MB, enough for 10^8 survivors); beyond
that it fills up, and a false positive costs one more hash of a text that the
scan has read already, which is less than shuffling texts to the survivors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import ascii_lower, fresh, stored

#: Bits of a filter between two scans: SLOTS for every key, rounded up to a power of two, in rows of 4 KB.
SLOTS, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 31
PREFIX_CHARS = 64
#: A text with more than a share of 1/HOT of all rows is hot; there are fewer than HOT of them.
HOT = 1000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def full_hash(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (SLOTS * keys - 1).bit_length() if keys else 0))


@dataclass(frozen=True)
class Bitmap:
    """rows (bucket, bitmap) of a filter of so many bits over the columns ``key``."""

    rows: DataFrame
    bits: int
    key: tuple[str, ...]

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.bits))

    def flag(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with a flag: whether the filter has the slot of their key."""
        bucket, bit, bitmap = fresh(rows, "bucket", "bit", "bitmap")
        place = rows.withColumns({bucket: F.bitmap_bucket_number(self.slot()), bit: F.bitmap_bit_position(self.slot())})
        byte = F.conv(F.hex(F.substring(bitmap, (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.col(bitmap).isNotNull() & (byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{bit}` % 8 as int))")) != 0)
        found = place.join(F.broadcast(self.rows.toDF(bucket, bitmap)), bucket, "left")
        return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(bucket, bit, bitmap)


def bitmap_of(keys: DataFrame) -> Bitmap:
    """The filter of the rows of keys, sized by their number."""
    made = Bitmap(keys, filter_bits(keys.count()), tuple(keys.columns))
    slots = keys.select(F.bitmap_bucket_number(made.slot()).alias("bucket"), F.bitmap_bit_position(made.slot()).alias("bit"))
    return replace(made, rows=slots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")))


@dataclass(frozen=True)
class Levels:
    """The filters of repeated lengths and of repeated (length, prefix) of a table's texts."""

    lengths: Bitmap
    pairs: Bitmap

    def flag(self, scan: DataFrame) -> DataFrame:
        """scan (n_bytes, content, ..) with prefix (null where the length is unique) and again (length and prefix repeat)."""
        return self.pairs.flag(_with_prefix(scan, self.lengths), "in_pair").withColumn("again", F.col("same_length") & F.col("in_pair")).drop("same_length", "in_pair")


def _with_prefix(scan: DataFrame, lengths: Bitmap) -> DataFrame:
    start = F.xxhash64(normalised(F.substring("content", 1, PREFIX_CHARS)))
    return lengths.flag(scan, "same_length").withColumn("prefix", F.when(F.col("same_length"), start))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).alias("n_bytes"), text.alias("content"))


def levels(scan: DataFrame) -> Levels:
    """Two passes over a scan: lengths that repeat, then prefixes that repeat among these. Keys are counted and stored, texts are not."""
    lengths = bitmap_of(stored(scan.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes"), "lengths"))
    pairs = _with_prefix(scan, lengths).filter("same_length").groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    return Levels(lengths, bitmap_of(stored(pairs.select("n_bytes", "prefix"), "pairs")))


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, known: Levels | None = None) -> DataFrame:
    """doc_id, row, n_bytes, prefix (null where the length is unique), again (length and prefix repeat), digest (null unless again or digest_all).

    Rows are small and are stored once, so that every later step sees the same
    row numbers.
    """
    scan = _scan(docs, id_col, text_col)
    rows = (known or levels(scan)).flag(scan.withColumn("row", F.monotonically_increasing_id()))
    digest = F.sha2(ascii_lower(F.col("content")).cast("binary"), 256)
    return stored(rows.select("doc_id", "row", "n_bytes", "prefix", "again", (digest if digest_all else F.when(F.col("again"), digest)).alias("digest")), "digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays; a null id is smaller than any other. Rows
    repeated with the same id and text are copies of one another: one of them
    stays. text_sha256 is null for texts never hashed in full, unless digest_all.
    An empty table gives no rows; other columns of docs are ignored.
    """
    return verdicts(refined(docs, id_col, text_col, digest_all)).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """The rows of ``refined`` with n and top (doc_id, row) of their group, null for texts without a copy, and kept."""
    # one shuffle of small rows by the full key; hot groups are combined before it
    groups = (
        rows.filter("again")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top"))
        .filter("n > 1")
    )
    groups = stored(groups, "groups")
    # rows of a hot text get their group by broadcast and are dealt out by their own number after that
    most = F.lit(max(1, rows.count() // HOT))
    hot = groups.filter(F.col("n") > most).select("digest", F.col("n").alias("hot_n"), F.col("top").alias("hot_top"))
    rows = rows.withColumn("digest_", F.when(F.col("again"), F.col("digest"))).join(F.broadcast(hot.withColumnRenamed("digest", "digest_")), "digest_", "left")
    key = F.when(F.col("again") & F.col("hot_n").isNull(), F.col("digest")).otherwise(F.col("row").cast("string"))
    cold = groups.filter(F.col("n") <= most).select(F.col("digest").alias("key"), "n", "top")
    out = rows.withColumn("key", key).join(cold, "key", "left").withColumns({"n": F.coalesce("hot_n", "n"), "top": F.coalesce("hot_top", "top")})
    return out.withColumn("kept", F.col("n").isNull() | (F.col("top.row") == F.col("row")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns.

    A row is found again by its id and its key: the digest where length and
    prefix repeat, else length and prefix, which no other row has. So a text is
    hashed in full only where it may have a copy. Text is shuffled once, by keys
    that no two kept rows share.
    """
    known = levels(_scan(docs, id_col, text_col))
    key = F.when(F.col("again"), F.col("digest")).otherwise(F.concat_ws(":", "n_bytes", "prefix"))
    kept = verdicts(refined(docs, id_col, text_col, known=known)).filter("kept")
    kept = kept.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), key.alias("key"))

    id_of = F.col("doc").getField(id_col)
    scan = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit(""))
    rows = known.flag(scan.select("doc", F.octet_length(text).alias("n_bytes"), text.alias("content")))
    rows = rows.withColumn("digest", F.when(F.col("again"), F.sha2(ascii_lower(F.col("content")).cast("binary"), 256)))
    rows = rows.select("doc", id_of.isNull().alias("no_id"), F.coalesce(id_of.cast("string"), F.lit("")).alias("id"), key.alias("key"))
    found = rows.join(kept, ["no_id", "id", "key"], "left_semi").dropDuplicates(["no_id", "id", "key"])
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
