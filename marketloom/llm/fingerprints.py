"""Document fingerprints by consistent weighted sampling, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.shared import materialise

#: Samples of a fingerprint: the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32
#: White space between terms (space, tab, line feed, vertical tab, form feed, carriage return).
WHITE = "\t\n\x0b\x0c\r"
#: Bits of each uniform number; five of them come from two 64-bit hashes.
BITS = 25


def terms(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; between two white spaces stands an empty word."""
    for white in WHITE:
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.split(text, " ")


def _uniform(bits: Column) -> Column:
    """A number strictly between 0 and 1 from the lowest bits of a hash."""
    return (bits.bitwiseAND(F.lit((1 << BITS) - 1)).cast("double") + 0.5) * 2.0**-BITS


def sample(term: Column, log_weights: list[Column], k: int) -> list[Column]:
    """ln a of the k-th sample of a term, given by its 64-bit hash, for each of several weights.

    Everything random depends on the term and k alone: r and c are Gamma(2, 1), beta is uniform.
    A weight w lies on the grid y = exp(r * (t - beta)) with the whole number t = floor(ln w / r + beta),
    and a = c / (y * exp(r)) is exponential with rate w; the least a of a document marks its sample.
    As a follows from the term and t, two documents have the same least a where they have the same
    sample (term, t), which happens with the chance of their generalised Jaccard similarity.
    """
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    shift = F.shiftrightunsigned
    r = -F.log(_uniform(one) * _uniform(shift(one, BITS)))
    c = F.log(-F.log(_uniform(two) * _uniform(shift(two, BITS))))
    rest = 64 - 2 * BITS
    beta = shift(one, 2 * BITS).cast("double") * 2.0**-rest + (shift(two, 2 * BITS).cast("double") + 0.5) * 2.0 ** (-2 * rest)
    return [c - r * (F.floor(w / r + beta) - beta) - r for w in log_weights]


def signatures(texts: DataFrame, key: str, columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key, a column <name>_fp: array<int> for each of the text columns); rows of one key must have equal texts.

    A text's terms are counted where its row is (no exchange if the rows are dealt by key), and
    each sample is the least of a group by key: nothing of a text is gathered, however long it is.
    A text without terms gets zeros for all samples.
    """
    each = [F.struct(F.col(c).alias("text"), *(F.lit(int(c == d)).alias(f"in_{d}") for d in columns)) for c in columns]
    word = texts.select(key, F.explode(F.array(*each)).alias("t")).select(key, *(f"t.in_{c}" for c in columns), F.explode_outer(terms(F.col("t.text"))).alias("word"))
    counted = word.groupBy(key, "word").agg(*(F.sum(f"in_{c}").alias(c) for c in columns))
    # an empty word stands for no term: it keeps the key, but has no weight
    weight = [F.log(F.when((F.col("word") != "") & (F.col(c) > 0), F.col(c)).cast("double")).alias(c) for c in columns]
    hashed = counted.select(key, F.xxhash64("word").alias("term"), *weight)
    least = [F.min(a).alias(f"{c}_{k}") for k in range(samples) for c, a in zip(columns, sample(F.col("term"), [F.col(c) for c in columns], k), strict=True)]
    found = hashed.groupBy(key).agg(*least)
    number = lambda name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.hash(name))
    return found.select(key, *(F.array(*(number(f"{c}_{k}") for k in range(samples))).alias(f"{c}_fp") for c in columns))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def printed(fingerprint: Column) -> Column:
    """Eight lowercase hex digits for each sample."""
    eight = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(fingerprint, eight), "")


def followers(keys: DataFrame) -> DataFrame:
    """(key, next): the key that follows in descending (id, key); after the last one comes the first. keys: id, key, distinct.

    The keys are cut in ranges by sampled bounds and each range is ordered by itself; only one row a
    range meets in a window over all of them.
    """
    order = [F.col("id").desc_nulls_last(), F.col("key")]
    ranged = materialise(keys.select("id", "key").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    within = F.lead("key").over(Window.partitionBy("range").orderBy(*order))
    # the first key of each range: its place is the least of (null id, -id, key)
    place = F.struct(F.col("id").isNull(), -F.col("id").cast("decimal(20,0)"), F.col("key").alias("key"))
    heads = ranged.groupBy("range").agg(F.min(place)["key"].alias("first"))
    every = Window.orderBy("range")
    top = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(top)).alias("first"))
    followed = ranged.withColumn("next", within).join(F.broadcast(after), "range")
    return followed.select("key", F.coalesce("next", "first").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, text_sha256, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) for every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the text that follows in descending id; after the last comes the first. Fingerprints are
    array<int>, one number a sample; likeness() compares them. Whole texts are read, however long;
    texts are dealt out once by a key of their own, and the parts that replace others once more.
    A null text is an empty one; a text without words has zeros and is wholly like its own kind
    alone. Rows with equal id and text are one document in the order and each get its result;
    different texts of one id follow by their MD5; null ids come last. One document alone follows itself. An empty table gives
    none. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), text.alias("text"), F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), text)).alias("key"))
    sizes = rows.select("id", "key", F.length("text").alias("n"))
    keys = materialise(sizes.groupBy("id", "key").agg(F.min("n").alias("n"), F.count("*").alias("copies")))
    order = followers(keys).join(keys.select("key", F.floor(F.col("n") / 3).cast("int").alias("m")), "key")
    order = materialise(order)
    wanted = order.where("m > 0").select(F.col("next").alias("key"), F.col("key").alias("of"), "m")
    # only a table that repeats rows needs to look for them
    once = rows.dropDuplicates(["key"]) if keys.where("copies > 1").limit(1).count() else rows
    ends = once.join(wanted, "key").select(F.col("of").alias("key"), "m", F.substring("text", F.lit(1), F.col("m")).alias("end"))
    both = once.join(ends, "key", "left")
    cut = F.substring("text", F.lit(1), F.length("text") - F.coalesce("m", F.lit(0)))
    both = both.select("key", "text", F.concat(cut, F.coalesce("end", F.lit(""))).alias("edited"))
    prints = signatures(both, "key", ["text", "edited"], samples)
    shas = both.select("key", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.sha2("edited", 256).alias("edited_sha256"))
    made = materialise(prints.join(shas, "key"))
    next_ = order.select("key", "next").join(made.select(F.col("key").alias("next"), F.col("text_fp").alias("next_fingerprint")), "next").drop("next")
    found = keys.select("id", "key", "copies").join(made, "key").join(next_, "key")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) if once is not rows else found
    return found.select("id", "n_chars", "text_sha256", "edited_sha256", F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "next_fingerprint")
