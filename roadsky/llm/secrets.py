"""Secrets in text: patterns with exact spans, and strings that a battery of randomness tests takes for keys.

Everything here is a DataFrame expression. A pattern's spans come from
splitting the text by it: the pieces between and the matches alternate, so the
running sum of their lengths gives every start and end in code points.

Strings of 20 and more letters, digits and ``+ / - _`` get an encoding by the
characters they hold: hex, base 32 or 36 in one case, lower case with ``- _``,
base 64 in both forms, or all of these characters together. Every such string
with digits and letters is tested. Under the hypothesis of
independent uniform symbols three tests are taken: chi-squared over the
alphabet, runs about its middle, and serial correlation of neighbours. Fisher
joins their two-sided p-values. A small value means ordered text. Within a
stratum of encoding and length (powers of two), the Benjamini-Hochberg step
rejects the strings that are not random, so that at most ``FALSE_SHARE`` of
those put aside are keys; short strings, where the tests see little, are not
judged by the level of long ones. What is not rejected is a secret.

The step needs ranks over all strings of a stratum. p-values are rounded to
``BINS`` parts of a power of ten, counted per stratum and value by an
aggregate, and the level per stratum, one small row each, is the only thing
brought to the driver.

Cases: null texts are empty; repeated rows get one result each; a text of
many matches is one row and stays one; columns beside id and text are not
looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadsky.llm.common import fresh, table

# The base kinds, in the order in which they are listed, with what a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Strings that are tested for randomness.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_SHARE = 0.05
BINS = 64
_HIGHEST = 20 * BINS
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base38": _DIGITS + _LOWER + "-_",
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "all": _UPPER + _LOWER + _DIGITS + "+/-_",
}


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost matches that ``keep`` (a condition on the match) lets stand."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(match, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    empty = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["m"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["m"].alias("found"))
        return F.struct(
            end.alias("at"),
            F.when(keep(s["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"),
        )

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, by start, then kind.

    A run of hex digits or of an access key is found whole or not at all, so a
    least length in the pattern finds what dropping short matches would leave.
    """
    always = lambda m: F.lit(True)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN
    access = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
    return F.array_sort(
        F.concat(
            spans(text, ASSIGN, 0, value),
            spans(text, access, 1, always),
            spans(text, f"[0-9a-f]{{{LEAST_HEX},}}", 2, always),
        )
    )


def encoding(core: Column) -> Column:
    """The name of the smallest alphabet that holds the string, null where it is only letters or only digits."""
    return (
        F.when(~core.rlike("[0-9]") | ~core.rlike("[A-Za-z]"), F.lit(None))
        .when(core.rlike("^[0-9a-f]+$"), "hex")
        .when(core.rlike("^[0-9A-F]+$"), "HEX")
        .when(core.rlike("^[A-Z2-7]+$"), "base32")
        .when(core.rlike("^[a-z0-9]+$"), "base36")
        .when(core.rlike("^[A-Z0-9]+$"), "BASE36")
        .when(core.rlike("^[a-z0-9_-]+$"), "base38")
        .when(core.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(core.rlike("^[A-Za-z0-9_-]+$"), "base64url")
        .otherwise("all")
    )


def _log_tail(z: Column) -> Column:
    """Natural logarithm of the two-sided normal tail beyond z, by the usual rational approximation."""
    x = F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.log(poly) - x * x, F.lit(0.0))


def _with(array: Column, **fields) -> Column:
    """Add fields to the structs of an array; each takes what stands in the struct so far."""

    def adding(name: str, make):
        return lambda s: s.withField(name, make(s))

    for name, make in fields.items():
        array = F.transform(array, adding(name, make))
    return array


def _squares(s: Column) -> Column:
    """Sum of the squared counts of the alphabet's symbols."""
    core, alphabet = s["core"], s["alphabet"]
    symbols = F.sequence(F.lit(1), F.length(alphabet))
    count = lambda i: s["n"] - F.length(F.call_function("replace", core, F.substring(alphabet, i, F.lit(1)), F.lit("")))
    return F.aggregate(symbols, F.lit(0.0), lambda acc, i: acc + F.pow(count(i), F.lit(2.0)))


def _walk(s: Column) -> Column:
    """Runs on one side of the alphabet's middle, and the sum of products of neighbours, as a struct."""
    codes = F.transform(F.split(s["core"], ""), lambda c: F.call_function("instr", s["alphabet"], c) - 1)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("cross"))

    def step(acc: Column, code: Column) -> Column:
        now = code.cast("double") - (s["size"] - 1) / 2
        turned = acc["last"].isNull() | ((acc["last"] > 0) != (now > 0))
        return F.struct(
            now.alias("last"),
            (acc["runs"] + F.when(turned, 1.0).otherwise(0.0)).alias("runs"),
            (acc["cross"] + F.coalesce(acc["last"] * now, F.lit(0.0))).alias("cross"),
        )

    # an empty piece at the end of a split has no place in the alphabet
    return F.aggregate(F.filter(codes, lambda c: c >= 0), start, step)


def _half_fisher(s: Column) -> Column:
    """Half of Fisher's statistic over the three two-sided p-values."""
    n, size = s["n"], s["size"]
    chi = size / n * s["squares"] - n
    z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    z_runs = (s["walked"]["runs"] - (1 + (n - 1) / 2)) / F.sqrt((n - 1) / 4)
    z_serial = s["walked"]["cross"] / ((size * size - 1) / 12) / F.sqrt(n - 1)
    return -(_log_tail(z_chi) + _log_tail(z_runs) + _log_tail(z_serial))


def _bin(s: Column) -> Column:
    """-log10 of the joint p-value (chi-squared of six degrees) in whole parts of ``BINS``."""
    half = s["half"]
    joint = -half + F.log(1 + half + half * half / 2)
    return F.least(F.floor(-joint / math.log(10) * BINS), F.lit(_HIGHEST)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start, end, stratum, bin>> of the strings that have an encoding."""
    found = spans(text, RUN, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    named = _with(found, core=lambda s: F.regexp_replace(s["found"], "=+$", ""), name=lambda s: encoding(s["core"]))
    named = F.filter(named, lambda s: s["name"].isNotNull())
    tested = _with(
        named,
        alphabet=lambda s: alphabets[s["name"]],
        n=lambda s: F.length(s["core"]).cast("double"),
        size=lambda s: F.length(s["alphabet"]).cast("double"),
        squares=_squares,
        walked=_walk,
        half=_half_fisher,
    )
    band = lambda s: F.floor(F.log2(s["n"])).cast("string")
    return F.transform(
        tested,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.concat(s["name"], F.lit("/"), band(s)).alias("stratum"),
            _bin(s).alias("bin"),
        ),
    )


def levels(docs: DataFrame, share: float = FALSE_SHARE) -> dict[str, int]:
    """Per stratum the bin from which on strings are rejected as not random; at most encodings x length bands entries."""
    strings = docs.select(F.explode(candidates(_whole(F.col("text")))).alias("s")).select("s.stratum", "s.bin")
    counts = strings.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    beyond = Window.partitionBy("stratum").orderBy(F.desc("bin"))  # at most _HIGHEST rows a stratum
    ranked = counts.withColumn("rank", F.sum("n").over(beyond)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    p = F.pow(F.lit(10.0), -F.col("bin") / BINS)
    rejected = ranked.filter(p <= share * F.col("rank") / F.col("all"))
    rows = rejected.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()
    return {r["stratum"]: r["bin"] for r in rows}


def random_spans(text: Column, base: Column, level: dict[str, int]) -> Column:
    """Spans of strings that pass as random and lie in none of the ``base`` spans."""
    kept = candidates(text)
    if level:
        limits = F.create_map(*[x for k, v in level.items() for x in (F.lit(k), F.lit(v))])
        kept = F.filter(kept, lambda s: s["bin"] < F.coalesce(limits[s["stratum"]], F.lit(_HIGHEST + 1)))
    fresh = F.filter(kept, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return F.transform(
        fresh,
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), F.lit("").alias("found")),
    )


def with_spans(docs: DataFrame, level: dict[str, int], base: str = "_base", spans: str = "_spans") -> DataFrame:
    """Documents with the spans of the patterns in ``base`` and all spans in ``spans``, each sorted by start and kind."""
    text = _whole(F.col("text"))
    found = docs.withColumn(base, base_spans(text))
    return found.withColumn(spans, F.array_sort(F.concat(base, random_spans(text, F.col(base), level))))


def _told(spans_of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret in ``text`` replaced; spans that overlap become one mark. Other rows stay as they are."""
    names = [fresh(docs.columns, n) for n in ("_base", "_spans")]
    found = with_spans(docs, levels(docs), *names)
    text, every = F.col("text"), F.col(names[1])
    hit = F.size(every) > 0
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    cut = F.aggregate(
        every, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    )
    done = found.withColumn("text", F.when(hit, cut).otherwise(text))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(hit, length).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, levels(docs))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told(F.col("_base")), 256).alias("base_sha256"),
        _told(F.col("_spans")).alias("spans"),
    )
