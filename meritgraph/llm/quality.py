"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Shares of rare things (symbols, repeated lines and windows, echoes) are mostly zero, and quartiles of zeros say nothing.
So a share of k in n is taken by its variance-stabilised angle, asin(sqrt((k + 3/8) / (n + 3/4))), which is never zero and
whose standard error is 1 / (2 sqrt(n)) whatever the share; windows of words overlap, so they count by whole windows.
Word length is a mean as it is.

Each metric's values go into mergeable quantile sketches (KLL, rank error about 0.2% at ``SKETCH``, exact for up to
``SKETCH`` values), one for each language and source; sketches of a language, and of all documents, are merged from
those. Quartiles of the sketches give fences, SPREAD interquartile ranges beyond them: they follow the group's own
values, and the lengths of its documents, which say how large a share of nothing may look. A document is rejected when it
is beyond a fence by more than its own error, ERROR standard errors of its angle, or MEAN_ERROR / sqrt(n) for a mean of n
words, so short documents have more room. Statistics are computed once and written with the columns that the caller keeps.

Null or empty texts count as texts without words (they fail the base rule). Null languages and sources are groups of
their own. Groups of under ``MIN_DOCS`` documents that pass the base rule take the fences of their language, and those
of all documents where that has too few as well. Values on a fence are inside. Repeated rows are judged alike; an empty
table gives no rows; columns of any other name pass through untouched. Beyond ``SKETCH`` documents a group's sketch
keeps a random choice of ranks, so another run may move a fence by its rank error; within a run all documents meet the
same fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import SPACE_CHARS, checkpointed, let, quoted, table, words, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 30
SPREAD = 3
#: Thresholds are broadcast up to this many rows; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 32
SKETCH = 2_048
#: Standard errors of a share's angle, and the error of a mean of n words times sqrt(n).
ERROR, MEAN_ERROR = 1.0, 1.5
#: metric: (what is counted, out of what, how many of those are one observation); means of words have no share
SHARES = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", WINDOW), "echoes": ("n_echoes", "n_words", 1)}
MEANS = {"word_length": ("word_chars", "n_words")}
METRICS = [*SHARES, *MEANS]


def _repeat_words(keys: Column) -> Column:
    """Words under windows that occur twice or more, given each window's key: each word once."""

    def covered(pos: Column) -> Column:
        gaps = F.transform(pos, lambda p, j: F.when(j + 1 < F.size(pos), F.least(F.lit(WINDOW), F.get(pos, j + 1) - p)).otherwise(WINDOW))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def again(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(let(ordered, again), covered))


def base_statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_echoes, n_lines (long) of a text."""
    text = F.coalesce(text, F.lit(""))

    def doubled(a: Column, k: int) -> Column:
        return F.zip_with(a, F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:  # of 2, 4 and 8 words; what reaches beyond the end goes
        eight = let(let(doubled(h, 1), lambda a: doubled(a, 2)), lambda a: doubled(a, 4))
        return F.slice(eight, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    def stats(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(hashes, lambda h: let(windows(h), _repeat_words)).cast("long").alias("n_repeat_words"),
            let(hashes, lambda h: F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1))))).cast("long").alias("n_echoes"),
            let(lines, F.size).cast("long").alias("n_lines"),
        )

    return let(words(text), stats)


def _base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _values(s: Column) -> dict[str, Column]:
    """Angles of shares, and means."""
    angle = lambda k, n, u: F.asin(F.sqrt((s[k].cast("double") / u + 0.375) / (s[n].cast("double") / u + 0.75)))
    return {m: angle(*x) for m, x in SHARES.items()} | {m: s[k].cast("double") / F.greatest(s[n], F.lit(1)) for m, (k, n) in MEANS.items()}


def _errors(s: Column) -> dict[str, Column]:
    return {m: ERROR * 0.5 / F.sqrt(s[n].cast("double") / u + 0.5) for m, (_, n, u) in SHARES.items()} | {m: MEAN_ERROR / F.sqrt(F.greatest(s[n], F.lit(1)).cast("double")) for m, (_, n) in MEANS.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source): n documents that pass the base rule, and a quantile sketch of each metric over those."""
    passes = ~_base_failed(F.col("s"))
    own = [F.kll_sketch_agg_double(F.when(passes, v), SKETCH).alias(m) for m, v in _values(F.col("s")).items()]
    return measured.groupBy("lang", "source").agg(F.count_if(passes).alias("n"), *own).where("n > 0")


def merged(found: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return found.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in METRICS))


def fences() -> Column:
    """For each metric the highest and the lowest value that is inside (lowest: null where none is too low), from the
    sketch in the column of its name."""
    shares = F.array(F.lit(0.25), F.lit(0.75))

    def limits(metric: str, low: bool) -> Column:
        reach = lambda q: SPREAD * (q[1] - q[0])
        lowest = (lambda q: q[0] - reach(q)) if low else (lambda q: F.lit(None).cast("double"))
        return let(F.kll_sketch_get_quantile_double(F.col(metric), shares), lambda q: F.struct((q[1] + reach(q)).alias(f"{metric}_hi"), lowest(q).alias(f"{metric}_lo")))

    return F.struct(*(limits(m, m in MEANS).alias(m) for m in METRICS))


def judge(docs: DataFrame, keep: list[str] | None = None, stats: str = "stats", quality: str = "quality") -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` (text, and lang and source if it has them), with ``stats`` and ``quality``
    (struct base_failed, kept)."""
    keep = docs.columns if keep is None else keep
    if clash := {stats.lower(), quality.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    of = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    # the caller's columns travel in one, where no name of theirs can meet one of ours
    measured = written(docs.select(F.struct(*quoted(keep)).alias("row"), of("lang").alias("lang"), of("source").alias("source"), base_statistics(F.col("text")).alias("s")))
    found = written(sketches(measured))
    enough = F.col("n") >= MIN_DOCS
    own = found.where(enough).select("lang", "source", fences().alias("own"))
    wider = merged(found, ["lang"]).where(enough)
    wider = wider.select(F.col("lang").alias("wl"), fences().alias("wider"))
    everywhere = merged(found, [])
    everywhere = everywhere.where("n > 0").select(fences().alias("everywhere"))
    groups = found.select("lang", "source").join(own.withColumnsRenamed({"lang": "ol", "source": "os"}), F.col("lang").eqNullSafe(F.col("ol")) & F.col("source").eqNullSafe(F.col("os")), "left")
    groups = groups.join(wider, F.col("lang").eqNullSafe(F.col("wl")), "left").join(F.broadcast(everywhere), F.lit(True), "left")  # one row
    limits = checkpointed(groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.coalesce("own", "wider", "everywhere").alias("limit")))
    same = F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs"))
    if limits.count() <= BROADCAST_ROWS:
        met = measured.join(F.broadcast(limits), same, "left")
    else:  # so many groups, of which one may hold a third of all rows
        salted = limits.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = measured.withColumn("own_salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int"))
        met = met.join(salted, same & (F.col("own_salt") == F.col("salt")), "left")
    inside, failed, errors = F.lit(True), _base_failed(F.col("s")), _errors(F.col("s"))
    for m, v in _values(F.col("s")).items():
        error = errors[m]
        low, high = F.col("limit")[m][f"{m}_lo"], F.col("limit")[m][f"{m}_hi"]
        inside &= F.coalesce(v <= high + error, F.lit(True)) & F.coalesce(v >= low - error, F.lit(True))
    return met.select("row.*", F.col("s").alias(stats), F.struct(failed.alias("base_failed"), (~failed & inside).alias("kept")).alias(quality))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    s = F.col("stats")
    return judge(docs, ["doc_id"]).select("doc_id", *(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("quality.base_failed").alias("base_failed"), F.col("quality.kept").alias("kept"))


_QUARTILES = ", ".join(f"quantile_disc({m}, 0.25) AS {m}_1, quantile_disc({m}, 0.75) AS {m}_3" for m in METRICS)
_VALUES = ", ".join([f"asin(sqrt(({k}::DOUBLE / {u} + 0.375) / ({n}::DOUBLE / {u} + 0.75))) AS {m}" for m, (k, n, u) in SHARES.items()] + [f"{k}::DOUBLE / greatest({n}, 1) AS {m}" for m, (k, n) in MEANS.items()])
_INSIDE = " AND ".join(
    [f"{m} <= {m}_3 + {SPREAD} * ({m}_3 - {m}_1) + {ERROR * 0.5} / sqrt({n}::DOUBLE / {u} + 0.5)" for m, (_, n, u) in SHARES.items()]
    + [f"{m} {op} {m}_{q} {sign} {SPREAD} * ({m}_3 - {m}_1) {sign} {MEAN_ERROR} / sqrt(greatest({n}, 1)::DOUBLE)" for m, (_, n) in MEANS.items() for op, q, sign in (("<=", 3, "+"), (">=", 1, "-"))]
)
OP4_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
k AS (SELECT *, [array_to_string(w[i : i + 7], ' ') FOR i IN range(1, len(w) - 6)] AS k FROM w),
s AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
       len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echoes FROM k),
e AS (SELECT doc_id, unnest(k) AS key, unnest(range(len(k))) AS i FROM k),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM e),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r WHERE c > 1),
n AS (SELECT doc_id, sum(coalesce(least(8, j - i), 8))::BIGINT AS n_repeat_words FROM p GROUP BY doc_id),
a AS (SELECT s.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {_VALUES} FROM a),
g AS (SELECT lang, source, count(*) AS n, {_QUARTILES} FROM f WHERE NOT base_failed GROUP BY lang, source),
h AS (SELECT lang, count(*) AS n, {_QUARTILES} FROM f WHERE NOT base_failed GROUP BY lang),
o AS (SELECT {_QUARTILES} FROM f WHERE NOT base_failed),
l AS (SELECT f.*, {", ".join(f"CASE WHEN g.n IS NOT NULL THEN g.{m}_{x} WHEN h.n IS NOT NULL THEN h.{m}_{x} ELSE o.{m}_{x} END AS {m}_{x}" for m in METRICS for x in (1, 3))} FROM f
       LEFT JOIN g ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source AND g.n >= {MIN_DOCS} LEFT JOIN h ON f.lang IS NOT DISTINCT FROM h.lang AND h.n >= {MIN_DOCS} LEFT JOIN o ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_INSIDE}, true) AS kept FROM l
"""
