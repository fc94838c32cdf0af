"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

Each distinct word of a text is a term of weight (occurrences x length in code points). For each term and sample,
gamma-distributed numbers derived from hashes of the two alone give the term's value (Ioffe's scheme); the least value
over all terms is the sample's signature, and two texts agree in a sample with a probability that is their generalised
Jaccard similarity (sum of the lesser weights over sum of the greater). The standard error of a likeness is at most
0.5 / sqrt(SAMPLES).

Words are counted inside their row, by sorting their hashes, so only distinct terms become rows; a term that a text
shares with its edited text is one row, whose hashes and logarithms serve both weights. Samples are taken GROUP at a
time. Rows are dealt out by ranges of doc_id of about SECTION_CHARS characters.

Rows are ordered by (doc_id, text), nulls first; repeated rows follow one another and are each other's next. Null
texts count as empty. Texts without words have fingerprints of zeros; two of those are alike (1.0), one of those and
any other are not (0.0). Very long texts are read whole; a word's length counts up to 2^20 code points. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritgraph.llm.common import let, shuffle_partitions, table, words

SAMPLES, GROUP = 48, 12
LEAST = -(2**63)
EMPTY = "00000000"
SECTION_CHARS = 1 << 26
#: The driver holds a bound and a key for each section.
MAX_SECTIONS = 10_000
LENGTH_BITS = 20


def sample_values(term: Column, log_weights: list[Column], sample: Column) -> list[Column]:
    """For each weight the logarithm of the term's value a = c / (y e^r): it is equal for equal terms whose weights
    round alike. r and c are gamma-distributed with shape 2; all numbers follow from the term and the sample."""
    first, second = F.xxhash64(term, sample), F.xxhash64(term, -1 - sample)
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)
    r, beta = -F.ln(part(first, 43, 21) * part(first, 22, 21)), part(first, 0, 22)
    c = F.ln(-F.ln(part(second, 32, 32) * part(second, 0, 32)))
    return [c - r * (F.floor(w / r + beta) - beta) - r for w in log_weights]


def terms(a: Column, b: Column) -> Column:
    """The distinct words of two texts: t (a hash with the word's length in its last bits) and the weights a and b (null
    where the text doesn't have the word)."""

    def keys(text: Column, which: int) -> Column:
        low = lambda w: F.shiftleft(F.least(F.length(w), F.lit((1 << LENGTH_BITS) - 1)), 1).bitwiseOR(F.lit(which)).cast("long")
        return F.transform(words(text), lambda w: F.shiftleft(F.xxhash64(w), LENGTH_BITS + 1).bitwiseOR(low(w)))

    def runs(s: Column) -> Column:
        """(key, count), by key."""
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("key"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("n"))))

    def paired(found: Column) -> Column:
        """A text's key ends in 0, the other's equal word follows with a 1."""
        t = lambda x: F.shiftright(x["key"], 1)
        length = lambda x: t(x).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
        own = lambda x, which: F.when(x["key"].bitwiseAND(F.lit(1)) == which, x["n"] * length(x))

        def joined(x: Column, j: Column) -> Column:
            after = F.get(found, j + 1)
            return F.struct(t(x).alias("t"), own(x, 0).alias("a"), F.coalesce(own(x, 1), F.when(t(after) == t(x), after["n"] * length(x))).alias("b"))

        alone = lambda x, j: (j == 0) | (t(F.get(found, j - 1)) != t(x))
        return F.filter(F.transform(found, lambda x, j: F.when(alone(x, j), joined(x, j))), lambda x: x.isNotNull())

    return let(let(F.sort_array(F.concat(keys(a, 0), keys(b, 1))), runs), paired)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are alike, and unlike all others."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != EMPTY)), lambda x: x))
    empty = lambda x: F.get(x, F.lit(0)) == EMPTY
    return F.when(empty(a) & empty(b), 1.0).otherwise(equal / SAMPLES)


def section_count(docs: DataFrame) -> int:
    """Sections of about SECTION_CHARS characters, as many as the session has shuffle partitions at least."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return min(MAX_SECTIONS, max(shuffle_partitions(docs.sparkSession), -(-chars // SECTION_CHARS)))


def _sections(docs: DataFrame, n: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with ``section`` (up to ``n`` ranges of doc_id, from an approximate quantile sketch), and for each
    section's least key the section before it in the ring: what the driver gets is bounded by ``n``."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), k.alias("k"))
    shares = [i / n for i in range(1, n)]
    bounds = keyed.agg(F.percentile_approx("k", shares, 10 * n)).first()[0] if n > 1 else []
    bounds = F.array(*map(F.lit, sorted(set(bounds or [])))).cast("array<bigint>")
    keyed = keyed.withColumn("section", F.size(F.filter(bounds, lambda b: b < F.col("k"))))
    least = sorted(keyed.groupBy("section").agg(F.min("k").alias("k")).collect())
    return keyed, {row.k: least[i - 1].section for i, row in enumerate(least)}


def with_next(docs: DataFrame, sections: int) -> DataFrame:
    """Rows of ``docs`` with the following row's text, in ascending doc_id, after the last the first. Each section's
    first row is copied behind the section before it (``ghost``), so no window crosses a section."""
    keyed, before = _sections(docs, sections)
    ring = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0), F.lit(0))
    ghosts = keyed.where(F.col("k").isin(list(before))).groupBy("k").agg(F.min("text").alias("text"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", "k", ring[F.col("k")].cast("int").alias("section"), F.lit(1).alias("ghost"))
    order = Window.partitionBy("section").orderBy("ghost", "k", "text")
    rows = keyed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return rows.select("section", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, sections: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    rows = with_next(docs, section_count(docs) if sections is None else sections)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("ghost") == 0, F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half)))
    # all later grouping is by (section, ...), which the window's exchange already deals out
    own = ["section", "rn", "ghost", "doc_id", "n_chars", "sha"]
    rows = rows.withColumn("edited", edited).select("section", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), terms(F.col("text"), F.coalesce("edited", F.lit(""))).alias("terms"))
    flat = rows.select(*own, F.inline_outer("terms")).select(*own, "t", F.ln(F.col("a").cast("double")).alias("a"), F.ln(F.col("b").cast("double")).alias("b"))
    flat = flat.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - GROUP), F.lit(GROUP))))
    values = [sample_values(F.col("t"), [F.col("a"), F.col("b")], F.col("g") + i) for i in range(GROUP)]
    least = flat.groupBy(*own, "g").agg(*(F.min(v).alias(f"{x}{i}") for i, pair in enumerate(values) for x, v in zip("ab", pair, strict=True)))
    # in single precision, which the last bit of a logarithm hardly ever reaches
    sign = lambda a: F.when(a.isNull(), EMPTY).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(a.cast("float")).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    signs = least.select(*own, F.struct("g", *(F.array(*(sign(F.col(f"{x}{i}")) for i in range(GROUP))).alias(x) for x in "ab")).alias("s"))
    joined = signs.groupBy(*own).agg(F.sort_array(F.collect_list("s")).alias("s"))
    joined = joined.select(*own, F.flatten(F.transform("s", lambda x: x["a"])).alias("f"), F.flatten(F.transform("s", lambda x: x["b"])).alias("e"))
    follow = Window.partitionBy("section").orderBy("rn")
    signed = joined.withColumn("next_f", F.lead("f").over(follow)).where(F.col("ghost") == 0)
    return signed.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.array_join("f", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
