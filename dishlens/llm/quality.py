"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio of trusted texts to all texts.

The n-grams of a text are, for each word, the word, its last `TAIL` characters, and the word with the next one, hashed
into `BUCKETS` buckets. Two multinomials over the buckets are counted: the trusted one
from at most `TRUSTED` documents labelled good, the raw one from every document. Both are smoothed by `PRIOR` n-grams
a bucket, the raw one scaled to the trusted one's size, so a bucket of which neither has shown much says little. A
document's score is the mean of log(p_trusted / p_raw) over its n-grams, in whole millionths, so that no order of
adding changes it; a document that doesn't fail the plain rules is kept if its score is at least `CUT`. Everything is
DataFrame functions: one pass counts, one pass scores; bucket counts and one row per document are shuffled, no texts.

Rows: a null text is the empty text; texts without a word have counts of 0, fail and score 0; a null id is kept as it
is and is never trusted; of contradicting labels of one id the lower counts; without trusted documents all scores
are 0. Equal texts get equal counts and scores, repeated rows stay. Very long texts are read whole: their words are one
array and their windows of five words one array of 64-bit hashes (windows are equal if these are), so a task needs
some hundred bytes a word of its longest text. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import texts, written
from dishlens.operators.spread import let

#: Bound of the labelled documents that make the trusted multinomial, chosen by hash of the id.
TRUSTED = 20_000
BUCKETS, PRIOR, CUT, WINDOW, TAIL, GRAMS = 1 << 16, 5.0, -0.3, 5, 3, 3
_SPACE, _ENDS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
_UNIT = 1_000_000


def words(text: Column) -> Column:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    trimmed = F.btrim(text, F.lit(_ENDS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _after(values: Column, n: int = 1) -> Column:
    """The array without its first n elements."""
    return F.slice(values, n + 1, F.size(values))


def _windows(hashes: Column) -> Column:
    """Hashes of all windows of WINDOW words, in order, from the words' hashes."""

    def joined(a: Column, b: Column, n: int) -> Column:
        return F.zip_with(a, _after(b, n), lambda x, y: F.xxhash64(x, y))

    four = let(let(hashes, lambda h: joined(h, h, 1)), lambda two: joined(two, two, 2))
    whole = F.zip_with(four, _after(hashes, WINDOW - 1), lambda x, y: F.xxhash64(x, y))
    return F.slice(whole, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    same = let(placed, lambda all_: F.zip_with(all_, _after(all_), lambda a, b: F.when(
        a["hash"] == b["hash"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>"))))
    found = F.sort_array(F.array_distinct(F.flatten(same)))
    # a window covers its words up to the start of the next repeated one; least() passes over the null of the last
    covered = let(found, lambda at: F.zip_with(at, _after(at), lambda p, q: F.least(F.lit(WINDOW), q - p)))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n)


def repeated_words(windows: Column) -> Column:
    """Words within windows whose hash occurs twice or more, from the hashes of all windows in order."""
    alone = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(alone, F.lit(0).cast("long")).otherwise(_covered(windows))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every document."""
    rows = texts(docs).withColumn("words", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_ENDS)) != "")
    rows = rows.withColumns({"_lines": lines, "_hashes": F.transform("words", lambda w: F.xxhash64(w))})
    rows = rows.withColumn("_windows", _windows(F.col("_hashes")))
    rows = rows.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _grams(rows: DataFrame, *columns: str, keep_empty: bool = False) -> DataFrame:
    """One row per word of `words` with the buckets of its n-grams; the last word has no pair (null)."""
    pairs = F.arrays_zip(F.col("words").alias("one"), _after(F.col("words")).alias("two"))
    rows = rows.select(*columns, (F.explode_outer if keep_empty else F.explode)(pairs).alias("g"))
    one, two = F.col("g")["one"], F.col("g")["two"]
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    return rows.select(
        *columns,
        F.when(one.isNotNull(), bucket(one)).alias("word"),
        F.when(one.isNotNull(), bucket(F.substring(one, -TAIL, TAIL), F.lit(TAIL))).alias("tail"),
        F.when(two.isNotNull(), bucket(one, two)).alias("pair"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most TRUSTED ids of documents labelled good."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min("quality").alias("good")).filter("good = 1")
    return good.orderBy(F.xxhash64("doc_id", F.lit("trusted")), "doc_id").limit(TRUSTED).select(
        "doc_id", F.lit(True).alias("trusted")
    )


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all documents and of the trusted ones; at most BUCKETS rows."""
    rows = texts(docs).join(F.broadcast(trusted_ids(labels)), "doc_id", "left")
    grams = _grams(rows.select("trusted", words(F.col("text")).alias("words")), "trusted")
    return grams.select("trusted", F.explode(F.array("word", "tail", "pair")).alias("bucket")).filter(
        "bucket IS NOT NULL"
    ).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted"))


def weights(counts: DataFrame) -> DataFrame:
    """One row with the log ratios of all buckets in order, in millionths; 0 where nothing is known."""
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    share = (totals["trusted"] or 0) / max(totals["raw"] or 0, 1)
    ratio = F.ln((F.col("trusted") + PRIOR) / (F.col("raw") * F.lit(share) + PRIOR)) if share else F.lit(0.0)
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce(F.round(ratio * _UNIT).cast("long"), F.lit(0).cast("long")).alias("weight")
    )
    return dense.agg(F.sort_array(F.collect_list(F.struct("bucket", "weight")))["weight"].alias("weights"))


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Every document with its counts, `score` (mean log ratio of its n-grams) and `kept`."""
    weight = weights(written(bucket_counts(docs, labels), "buckets")).select("weights").scalar()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = counted(docs).withColumn("_row", F.monotonically_increasing_id())
    grams = _grams(rows, "_row", *columns, keep_empty=True).select(
        "_row", *columns, *[F.coalesce(F.get(weight, F.col(x)), F.lit(0)).alias(x) for x in ("word", "tail", "pair")]
    )
    # a document's n-grams lie side by side, so they are added up before the shuffle
    sums = grams.groupBy("_row").agg(
        F.sum(F.col("word") + F.col("tail") + F.col("pair")).alias("_sum"), *[F.max(c).alias(c) for c in columns]
    )
    score = F.when(F.col("n_words") > 0, F.col("_sum") / ((GRAMS * F.col("n_words") - 1) * _UNIT)).otherwise(0.0)
    return sums.withColumn("score", score).select(
        *columns, (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept"), "score"
    )
