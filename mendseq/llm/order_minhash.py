"""Order MinHash fingerprints with DataFrame functions only.

A text is a row of pieces: runs of up to eight characters that are not white space.
Its k-mers are pieces next to each other; a k-mer that repeats is numbered by its
occurrence, so that repeats count (Marcais et al., 2019). One hash deals the numbered
k-mers to buckets. The least of each bucket is selected, it is paired with the next
bucket's, the pair is put in the order it has in the text, and that tuple is hashed.
Two texts agree in a bucket if they share both k-mers in the same order, so the share
of equal buckets falls with edits, moves included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendseq.session import materialize

K, BUCKET_BITS = 2, 7
PIECE = r"\S{1,8}"
# A numbered k-mer is one bigint: bucket and hash above, place in the text below.
HASH_BITS, PLACE_BITS, CODE_BITS = 32, 24, 24

_KEY = ["unknown", "id", "digest"]


def _at(array: Column, i: Column) -> Column:
    """An element known to be there, as a column that can't be null."""
    return F.coalesce(F.get(array, i), F.lit(0).cast("long"))


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _numbered(kmer: Column, occurrence: Column, place: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(kmer, occurrence), 64 - BUCKET_BITS - HASH_BITS)
    return F.shiftleft(high, PLACE_BITS).bitwiseOR(place)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the codes of ``text`` (not null) as array<int> ``name``, one per bucket that isn't empty."""
    words, kmers, by_kmer, starts, by_hash, least = (f"__{name}_{i}" for i in range(6))
    c, mask = F.col, F.lit((1 << PLACE_BITS) - 1).cast("long")

    df = df.withColumn(words, F.transform(F.regexp_extract_all(c(text), F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))
    n = F.size(words)
    windows = F.transform(_upto(n - (K - 1)), lambda i: F.xxhash64(*[_at(c(words), i + j) for j in range(K)]))
    # A text of fewer pieces is one k-mer.
    df = df.withColumn(kmers, F.when(n >= K, windows).otherwise(F.transform(c(words), lambda x: F.xxhash64(x))))

    # Equal k-mers side by side, in the order of the text. Places of enormous texts are made coarser to fit.
    coarse = F.greatest(F.lit(1), F.size(kmers) / F.lit(1 << PLACE_BITS)).cast("long")
    df = df.withColumn("__coarse", coarse).withColumn(by_kmer, F.sort_array(F.transform(
        c(kmers), lambda x, i: F.shiftleft(F.shiftrightunsigned(x, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(
            F.coalesce(F.least((i / c("__coarse")).cast("long"), mask), F.lit(0).cast("long"))))))
    same = lambda i: F.shiftright(_at(c(by_kmer), i), PLACE_BITS)
    df = df.withColumn(starts, F.filter(_upto(F.size(by_kmer)), lambda i: (i == 0) | (same(i) != same(i - 1))))

    def occurrences(first: Column, run: Column) -> Column:
        end = F.coalesce(F.get(c(starts), run + 1), F.size(by_kmer))
        return F.transform(F.sequence(first, end - 1), lambda q: _numbered(
            same(first), q - first, _at(c(by_kmer), q).bitwiseAND(mask)))

    df = df.withColumn(by_hash, F.sort_array(F.flatten(F.transform(c(starts), occurrences))))
    bucket = lambda x: F.shiftright(x, PLACE_BITS + HASH_BITS)
    df = df.withColumn(least, F.filter(c(by_hash), lambda x, i: (i == 0) | (bucket(x) != bucket(_at(c(by_hash), i - 1)))))

    def code(x: Column, i: Column) -> Column:
        other = F.coalesce(F.get(c(least), i + 1), _at(c(least), F.lit(0)))
        a, b = F.shiftright(x, PLACE_BITS), F.shiftright(other, PLACE_BITS)
        ordered = F.when(x.bitwiseAND(mask) <= other.bitwiseAND(mask), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        low = ordered.bitwiseAND(F.lit((1 << CODE_BITS) - 1).cast("long"))
        return F.shiftleft(bucket(x), CODE_BITS).bitwiseOR(low).cast("int")

    return df.withColumn(name, F.transform(c(least), code)).drop(
        words, kmers, by_kmer, starts, by_hash, least, "__coarse")


def likeness(a: Column, b: Column) -> Column:
    """Share of the buckets either has in which both have the same code; 1 if both have none."""
    used = lambda x: F.transform(x, lambda v: F.shiftright(v, CODE_BITS))
    either = F.size(F.array_union(used(a), used(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def successors(keys: DataFrame) -> DataFrame:
    """Each key with the one after it (``next_...``), doc_id falling; after the last comes the first.

    The keys are dealt to ranges; only the first key of each range is looked at by a
    single task.
    """
    order = [F.col("unknown").asc(), F.col("id").desc(), F.col("digest").asc()]
    ranged = materialize(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    key = F.struct(*_KEY)
    # ~id falls as id rises and can't overflow.
    first = ranged.groupBy("range").agg(F.min_by(key, F.struct("unknown", F.bitwise_not("id"), "digest")).alias("first"))
    ranges = Window.orderBy("range")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each range.
    first = first.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(whole)).alias("beyond"))
    after = F.lead(key).over(Window.partitionBy("range").orderBy(*order))
    found = ranged.withColumn("after", after).join(F.broadcast(first), "range") \
        .withColumn("next", F.coalesce("after", "beyond"))
    return found.select(*_KEY, "n_chars", *[F.col(f"next.{k}").alias(f"next_{k}") for k in _KEY])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last third (rounded down) of its code points replaced by
    as many from the beginning of the next document, or all it has. Documents follow
    each other by falling doc_id, then by a hash of the text; rows that repeat both are
    one document and each get its result. A null text is an empty one, which has an
    empty fingerprint; so has a text of white space. A null doc_id comes last. A single
    document follows itself. Other columns are left out; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.col("doc_id").isNull().cast("int").alias("unknown"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("digest"), "text")
    chain = materialize(successors(given.select(*_KEY, F.char_length("text").cast("long").alias("n_chars")).distinct()),
                        "successors")
    # Both uses of this table share one exchange.
    marked = with_fingerprint(given, "text", "codes").repartition(*_KEY)
    wanted = chain.select(*[F.col(f"next_{k}").alias(k) for k in _KEY], *[F.col(k).alias(f"for_{k}") for k in _KEY],
                          F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"))
    heads = marked.join(wanted, _KEY).select(
        *[F.col(f"for_{k}").alias(k) for k in _KEY], "wanted",
        F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("head"), F.col("codes").alias("next_codes"))
    edited = marked.join(heads.dropDuplicates(_KEY), _KEY).withColumn("n_chars", F.char_length("text").cast("long")) \
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("wanted")).cast("int")), "head")) \
        .withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "head")
    return with_fingerprint(edited, "edited", "edited_codes").select(
        F.when(F.col("unknown") == 0, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("codes")).alias("fingerprint"), as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
