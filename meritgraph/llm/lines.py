"""Line deduplication over a suffix array of line numbers.

Each text is the sequence of its lines that hold a word, told apart by 64-bit hashes. Prefix doubling ranks all
suffixes by their first 1, 2, 4, ... lines: a level's rank orders the pairs of the level before, and its groups are the
intervals of the suffix array whose longest common prefix reaches the level's length. Suffixes that no other shares
drop out, so later levels hold only what is repeated that far, and the rounds end at the longest repeated run. An
interval's first member by (doc_id, text hash, place) is the original; all others are later copies, and the lines that
their prefix covers are deleted. A run's power-of-two prefixes cover the run, so this deletes exactly the lines of
maximal repeated runs from their second occurrence on, and the longest common prefixes themselves are not needed. A run counts from ``MIN_LINES`` lines on, a single line from
``MIN_CHARS`` code points on.

Null texts stay null, and empty and blank ones as they are; blank lines are never deleted and don't break a run.
Repeated rows are one text, which is not a copy of itself. Rows without an id come first in the order. Very long texts
take as many rounds as their longest copied run doubles, and their work grows with their lines. An empty table gives no
rows. ``deduplicate``
keeps all other columns and refuses a frame that has one of its own names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritgraph.llm.common import SPACE_CHARS, checkpointed, join_counted, let, quoted, table, written

MIN_LINES = 2
MIN_CHARS = 50
LEAST = -(2**63)
KEY = ["d", "th", "at"]


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)), F.xxhash64(docs["text"])


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, th, at (place among the lines with words), length: the longest prefix of a power of two that is a later copy."""
    d, th = _key(docs)
    solid = F.transform(F.filter(F.split("text", "\n"), _solid), lambda x: F.struct(F.xxhash64(x).alias("r"), (F.length(x) >= min_chars).alias("long")))
    lines = written(docs.where("text IS NOT NULL").select(d.alias("d"), th.alias("th"), F.posexplode(solid).alias("at", "x")).select(*KEY, "x.r", "x.long"))
    copy = (F.col("first") != F.struct(*KEY)).alias("copy")

    def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
        """The intervals of suffixes that agree in ``by``: their size and first member. Only those of two or more."""
        return checkpointed(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY)).alias("first")).where("n > 1"))

    def followed(rows: DataFrame, by: int) -> DataFrame:
        """Suffixes with their rank and that of the suffix ``by`` lines on, where that one is repeated as well."""
        ahead = Window.partitionBy("d", "th").orderBy("at").rangeBetween(by, by)
        return checkpointed(rows.select(*KEY, F.col("r").alias("r1"), F.max("r").over(ahead).alias("r2")).where("r2 IS NOT NULL"))

    level = join_counted(lines, repeated(lines, ["r"]), ["r"], lines.count())
    level = checkpointed(level.select(*KEY, "r", "long", copy).dropDuplicates(KEY))
    length, found = 1, []
    while True:
        if length >= min_lines or length == 1:
            enough = F.col("copy") & (F.col("long") if length == 1 and min_lines > 1 else F.lit(True))
            found.append(level.where(enough).select(*KEY, F.lit(length).alias("length")))
        if length < min_lines < 2 * length:  # runs of min_lines exactly: two overlapping prefixes
            exact = followed(level, min_lines - length)
            same = join_counted(exact, repeated(exact, ["r1", "r2"]), ["r1", "r2"], exact.count())
            found.append(checkpointed(same.where(copy).select(*KEY, F.lit(min_lines).alias("length"))))
        pairs = followed(level, length)
        groups = repeated(pairs, ["r1", "r2"])
        if groups.isEmpty():
            break
        # ids rise with the order of the pairs: the ranks of the next level
        ranked = checkpointed(groups.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").withColumn("r", F.monotonically_increasing_id()))
        level = join_counted(pairs, ranked, ["r1", "r2"], pairs.count())
        level = checkpointed(level.select(*KEY, "r", F.lit(True).alias("long"), copy))
        length *= 2
    return reduce(DataFrame.union, found).groupBy(*KEY).agg(F.max("length").alias("length"))


def deduplicate(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` without later copies of repeated runs in ``text``, and with n_lines (with words) and n_removed."""
    if clash := {n_lines.lower(), n_removed.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    runs = repeated_runs(docs.select("doc_id", "text"), min_lines, min_chars)
    # a text's runs without what earlier ones cover: disjoint, so a text has no more of them than lines
    end = F.col("at") + F.col("length")
    before = F.coalesce(F.max(end).over(Window.partitionBy("d", "th").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.greatest(F.col("at"), before)
    runs = runs.select("d", "th", begin.alias("at"), (end - begin).alias("length")).where("length > 0")
    runs = checkpointed(runs.groupBy("d", "th").agg(F.collect_list(F.struct("at", "length")).alias("runs")).select(F.col("d").alias("rd"), F.col("th").alias("rth"), "runs"))
    d, th = _key(docs)
    # the caller's columns travel in one, where no name of theirs can meet one of ours
    met = docs.select(F.struct(*quoted(docs.columns)).alias("row"), d.alias("d"), th.alias("th")).join(runs, (F.col("d") == F.col("rd")) & (F.col("th") == F.col("rth")), "left")
    none, text = F.array().cast("array<int>"), F.col("row.text")

    def without(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        solid = F.filter(places, lambda i: _solid(F.get(lines, i)))

        def removed(s: Column) -> Column:
            gone = F.when(F.col("runs").isNull(), none).otherwise(F.flatten(F.transform("runs", lambda r: F.slice(s, r["at"] + 1, r["length"]))))
            return F.struct(F.size(s).alias("n"), gone.alias("gone"))

        def rewritten(x: Column) -> Column:
            kept = F.transform(F.array_except(places, x["gone"]), lambda i: F.get(lines, i))
            new = F.when(F.size(x["gone"]) == 0, text).otherwise(F.array_join(kept, "\n"))
            return F.struct(new.alias("text"), x["n"].alias("n"), F.size(x["gone"]).alias("gone"))

        return let(let(solid, removed), rewritten)

    met = met.select("row", F.when(text.isNotNull(), let(F.split(text, "\n"), without)).alias("new"))
    columns = [F.col("new.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return met.select(*columns, F.coalesce("new.n", F.lit(0)).alias(n_lines), F.coalesce("new.gone", F.lit(0)).alias(n_removed))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: n_lines, n_removed and the text that is left."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP6_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM s),
c AS (SELECT doc_id, i, seq, length(line) >= {MIN_CHARS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS one,
       nxt IS NOT NULL AND row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, seq) > 1 AS two FROM p),
g AS (SELECT doc_id, i, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY seq), false) AS gone FROM c),
k AS (SELECT l.doc_id, count(g.i)::INTEGER AS n_lines, count(*) FILTER (WHERE gone)::INTEGER AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(gone, false)), '') AS text FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, k.text FROM documents LEFT JOIN k USING (doc_id)
"""
