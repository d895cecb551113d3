"""Audit of how filters interact, over all orders in which they can be applied.

Per document, the failed conditions are one mask of bits. All that an order of
filters does to a part follows from how many documents of the part have which
mask, so documents are folded to cells (part, mask) of counts first: at most
32 a part.

A recursive query then enumerates the orders. Its seed is the empty prefix of
each part, which holds the part's cells; each level appends a filter that the
prefix has not used, carries the bits applied so far, and emits that step's
counts from the cells. Prefixes are shared by the orders that begin with them:
325 rows a part instead of 600. Whole orders are looked up in them at the end.

Conditions (words are maximal runs without ASCII blanks, case kept):

* A: under 200 words;
* B: 100 * different words < 50 * words;
* C: 100 * ``[A-Z]`` characters > 3 * code points;
* D: holds any of ``#$%&*|``;
* E: the text is identical to that of any smaller doc_id in the table.

Texts are compared by SHA-256. The least id of a text is an aggregate with a
map-side combine; it is joined back by dealing the rows of a text to
``common.SALTS`` parts, so a text that a third of the table copies never meets
in one task.

Cases: a null text is the empty text; a null ``lang`` is the part ``""``; a
null doc_id is no smaller than any and has no smaller one, and has no labels;
rows of one doc_id do not fail E through one another; of several label rows
for an id, one with 1 is enough; repeated rows count each; an empty table
gives no rows. The number of parts is the number of languages: 325 recursion
rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import spread_lookup, stored, table

#: Filters in the order of their bits, lowest first.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
_BLANKS = r"[\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, bits, key): the bits of A to D, and the text's hash."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # a generator of one row: Catalyst does not copy the costly split into each use of it
    split = F.struct(F.array_remove(F.split("text", _BLANKS), "").alias("words"))
    words = rows.select("*", F.inline(F.array(split)))
    counted = words.select(
        "doc_id",
        "part",
        "text",
        F.inline(F.array(F.struct(F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")))),
    )
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    bits = (
        _bit(F.col("n_words") < MIN_WORDS, "A")
        + _bit(100 * F.col("n_distinct").cast("long") < MIN_DISTINCT_PERCENT * F.col("n_words").cast("long"), "B")
        + _bit(100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length("text").cast("long"), "C")
        + _bit(F.col("text").rlike("[#$%&*|]"), "D")
    )
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return counted.select("doc_id", "part", bits.alias("bits"), key.alias("key"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the conditions of ``mask``."""
    rows = stored(features(docs), "audit-features")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    least = least.filter("copies > 1 AND first IS NOT NULL").select("key", "first")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    known = spread_lookup(rows, least, ["key"], [F.col("doc_id")])
    known = known.select("doc_id", "part", (F.col("bits") + _bit(F.col("doc_id") > F.col("first"), "E")).alias("mask"), "key")
    known = spread_lookup(known, marks, ["doc_id"], [F.col("key"), F.col("mask")])
    return known.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def _cell_sum(condition: str, count: str) -> str:
    """SQL: the sum of a count over the cells of a row for which a condition on the cell ``c`` holds."""
    return f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + c.{count})"


def audit(found: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``cells``."""
    spark = found.sparkSession
    # a row a part: bounded by the number of languages, held as one array of at most 32 cells each
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    fails, before = "(c.mask & f.bit) <> 0", "(c.mask & p.applied) <> 0"
    # the row limit guards against runaway recursion; this one ends after five levels, at 325 rows a part
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    prefixes = spark.sql(
        f"""
        WITH RECURSIVE prefix(part, cells, letters, applied, step, letter,
                              kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, cells, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{parts}}
            UNION ALL
            SELECT p.part, p.cells, concat(p.letters, f.letter), p.applied | f.bit, p.step + 1, f.letter,
                {_cell_sum("(c.mask & (p.applied | f.bit)) = 0", "n")},
                {_cell_sum(f"{fails} AND NOT {before}", "n")},
                {_cell_sum(f"{fails} AND {before}", "n")},
                {_cell_sum("c.mask = f.bit", "n")},
                {_cell_sum(f"{fails} AND NOT {before}", "good")},
                {_cell_sum(f"{fails} AND NOT {before}", "toxic")}
            FROM prefix p JOIN (VALUES {letters}) AS f(letter, bit) ON (p.applied & f.bit) = 0
        )
        SELECT part, letters, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
        FROM prefix WHERE step > 0
        """,
        parts=parts,
    )
    steps = stored(prefixes, "audit-prefixes")
    orders = steps.filter(F.col("step") == len(FILTERS)).select("part", F.col("letters").alias("filter_order"))
    orders = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    orders = orders.withColumn("letters", F.expr("left(filter_order, step)"))
    rows = orders.join(steps, ["part", "letters", "step"])
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH RECURSIVE
words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
    FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
masks AS (
    SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
        CASE WHEN len(w.w) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w.w)) < 50 * len(w.w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 3 * length(w.text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > f.first_id THEN 16 ELSE 0 END AS mask
    FROM words w JOIN firsts f ON f.text = w.text LEFT JOIN marks m ON m.doc_id = w.doc_id
),
cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
),
filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
prefix(letters, before, applied, step, bit) AS (
    SELECT '', 0, 0, 0, 0
    UNION ALL
    SELECT p.letters || f.letter, p.applied, p.applied | f.bit, p.step + 1, f.bit
    FROM prefix p JOIN filters f ON (p.applied & f.bit) = 0
),
steps AS (
    SELECT c.part, p.letters, p.step, p.bit,
        sum(CASE WHEN (c.mask & p.applied) = 0 THEN c.n ELSE 0 END) AS kept,
        sum(CASE WHEN (c.mask & p.bit) <> 0 AND (c.mask & p.before) = 0 THEN c.n ELSE 0 END) AS removed,
        sum(CASE WHEN (c.mask & p.bit) <> 0 AND (c.mask & p.before) <> 0 THEN c.n ELSE 0 END) AS redundant,
        sum(CASE WHEN c.mask = p.bit THEN c.n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (c.mask & p.bit) <> 0 AND (c.mask & p.before) = 0 THEN c.good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (c.mask & p.bit) <> 0 AND (c.mask & p.before) = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
    FROM cells c JOIN prefix p ON p.step > 0
    GROUP BY c.part, p.letters, p.step, p.bit
),
whole AS (
    SELECT s.part, o.letters AS filter_order, s.step, s.bit,
        s.kept, s.removed, s.redundant, s.unique_fails, s.good_lost, s.toxic_lost
    FROM prefix o JOIN steps s ON o.step = 5 AND left(o.letters, s.step) = s.letters
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM whole
"""
