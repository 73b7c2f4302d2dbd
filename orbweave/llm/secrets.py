"""Secret scans: fixed patterns, and tokens that pass a battery of randomness tests.

Candidates of the battery are runs of 20 or more characters of base64 alphabets. The encoding is inferred from the characters: digits, hexadecimal in one case, base32,
capitals and digits, letters and digits, or base64 in its two alphabets. Under uniform random codes three statistics are standard normal: the chi-squared statistic of the
alphabet's counts, the number of runs above and below the middle, and the serial correlation of neighbours. The sum of their squares is small for random tokens, whatever their encoding and length,
and large for structured ones, the more the longer they are.

What is reported is tested against structure. The corpus' own words, joined as identifiers are (plainly, in camel case, by underscores, by digits), give structured strings: every text is cut into runs of words, one
after the other, that just give the least length of each class of length in turn, in the four forms by turns. So each word of each document is in one structured string (but the last ones of a text, if too few for one more); what is in a candidate itself is no word. A token's p-value is the share of them that look as random as it does or more. In each class the
Benjamini-Hochberg rule rejects structure for distinct tokens such that an expected share of at most `rate` of those rejected are structured after all; these are reported as kind `random`, unless a
fixed pattern's span overlaps them. Sums of squares count by steps (an eighth of a power of two of their tail), so the rule needs one count per class and step, whatever the size of the corpus.
Too few words give no small p-values: a class needs at least 1 / rate structured strings before anything is reported.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows are scanned each, but a token counts as one test; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import settled, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so the least length can be in the pattern: shorter runs hold no longer match either.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pattern and alphabet, in the order of codes; the first that fits is the encoding.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"^.*$", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Least lengths of the classes of length.
CLASSES = (20, 32, 64, 128)
STEPS, LAST = 8, 8 * 60
#: A sum of squares from which on any token is in the last step: its tail is less than 2 ** -60.
SURE = 90.0
#: Hits that are placed in one go, letters of a word of a structured string, and the shortest runs of whole words with as many letters as each class has, one after the other; a text may end after any.
PLACED, LETTERS = 64, r"[A-Za-z]{2,}"
RUNS = "".join(r"((?: ?[A-Za-z]){%d,}?(?![A-Za-z]))%s" % (least, "?" if k else "") for k, least in enumerate(CLASSES))


def found(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, as array<struct<s, e, m>>: what lies between them gives their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<s:int,e:int,m:string>>"
    none = F.from_json(F.lit("[]"), kind)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m")))).alias("out"))

    # Hits are placed PLACED at a time, so that long texts don't copy all that came before for each of them.
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def placed(all_: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(all_, k * PLACED + 1, F.lit(PLACED)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PLACED).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), f"array<{kind}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    places = F.element_at(F.transform(F.array(pairs), placed), 1)  # a variable of the lambda is computed once, whatever uses it
    return F.when(text.rlike(pattern), places).otherwise(none)


def _spans(hits: Column, kind: int) -> Column:
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once: a variable of a lambda is."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _coded(token: Column, alphabet: str, enough: float | None) -> Column:
    """Sum of the squares of the three statistics of one token; without the last one, which takes longest, where the others alone reach enough."""
    k, n = len(alphabet), F.length(token).cast("double")
    letters = F.array_distinct(F.split(token, ""))
    squares = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.call_function("replace", token, c, F.lit(""))), F.lit(2.0)))
    uneven = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    half = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    turns = (2 * n - F.length(F.call_function("replace", half, F.lit("01"), F.lit(""))) - F.length(F.call_function("replace", half, F.lit("10"), F.lit("")))) / 2
    upper = (k - k // 2) / k
    both = 2 * upper * (1 - upper)
    # Turns between independent neighbours: those at distance one share a character, which adds to the variance if the halves differ.
    spread = (n - 1) * both * (1 - both) + 2 * (n - 2) * (upper * (1 - upper) - both * both)
    runs = (turns - (n - 1) * both) / F.sqrt(spread)
    codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(alphabet), c) - 1 - F.lit((k - 1) / 2))
    step = lambda acc, x: F.struct(x.alias("x"), (acc["sum"] + acc["x"] * x).alias("sum"))
    moved = F.aggregate(codes, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    serial = moved / ((k * k - 1) / 12) / F.sqrt(n - 1)
    two, three = F.pow(uneven, F.lit(2.0)) + F.pow(runs, F.lit(2.0)), lambda q: q + F.pow(serial, F.lit(2.0))
    return three(two) if enough is None else _let(two, lambda q: F.when(q >= enough, q).otherwise(three(q)))


def battery(token: Column, enough: float | None = None) -> Column:
    """The p-value of a token under uniform random codes; one whose sum reaches enough may get the larger one of two statistics alone."""
    total = None
    for pattern, alphabet in ENCODINGS:
        own = _coded(token, alphabet, enough)
        total = F.when(token.rlike(pattern), own) if total is None else total.when(token.rlike(pattern), own)
    return _let(total, tail)


def tail(q: Column) -> Column:
    """P(chi-squared of three degrees > q); the complementary error function by a rational approximation within 2e-7."""
    x = F.sqrt(q / 2)
    t = 1 / (1 + x * 0.3275911)
    erfc = t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592) * F.exp(-x * x)
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), erfc + F.sqrt(q * (2 / math.pi)) * F.exp(-q / 2)))


def _step(token: Column) -> Column:
    return F.least(F.lit(LAST), F.floor(-F.log2(battery(token, SURE)) * STEPS)).cast("int")


def structured(docs: DataFrame) -> DataFrame:
    """of and step: class of length and step of every structured string that the words of the texts give."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), CANDIDATE, " ")
    words = F.array_join(F.filter(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), lambda x: F.length(x) <= 32), " ")
    rows = docs.select(words.alias("words"), F.pmod(F.xxhash64(text), F.lit(4)).cast("int").alias("turn"))
    # One pass writes the runs of each class on lines in turn; what follows the last line is left over.
    lines = F.split(F.regexp_replace("words", F.lit(RUNS), F.lit("".join(f"${k + 1}\n" for k in range(len(CLASSES))))), "\n")
    of, at = F.col("i") % len(CLASSES), F.floor(F.col("i") / len(CLASSES))
    runs = rows.select("turn", F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("i", "x")).filter("x <> ''").select(of.alias("of"), ((F.col("turn") + at + of) % 4).alias("form"), F.ltrim("x").alias("t"))
    joined = lambda x, by: F.call_function("replace", x, F.lit(" "), F.lit(by))
    forms = F.when(F.col("form") == 0, F.lower(joined("t", ""))).when(F.col("form") == 1, joined(F.initcap("t"), "")).when(F.col("form") == 2, joined("t", "_")).otherwise(joined("t", "2"))
    strings = runs.select("of", F.substr(forms, F.lit(1), F.element_at(F.array(*map(F.lit, CLASSES)), F.col("of") + 1)).alias("t"))
    return strings.select("of", _step(F.col("t")).alias("step"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of s, kind, e), candidates (array of s, e, length class, step and a hash of the token)."""
    text = F.col("text")
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    length = lambda x: x["e"] - x["s"]
    kind = lambda x: sum(F.when(length(x) >= least, 1).otherwise(0) for least in CLASSES[1:])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.concat(_spans(assign, 0), _spans(found(text, ACCESS), 1), _spans(found(text, HEX), 2)).alias("base"), found(text, CANDIDATE).alias("tokens")
    )
    tested = F.transform("tokens", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), kind(x).alias("of"), _step(x["m"]).alias("step"), F.xxhash64(x["m"]).alias("h")))
    return rows.select("doc_id", "base", tested.alias("candidates"))


def rejected_upto(scans: DataFrame, strings: DataFrame, rate: float) -> dict[int, int]:
    """Class of length: the step up to which structure is rejected for its tokens. At most a row per class leaves the executors."""
    tokens = scans.select(F.inline("candidates")).groupBy("of", "step", "h").agg(F.lit(1).alias("n")).groupBy("of", "step").agg(F.sum("n").alias("t"), F.lit(0).cast("long").alias("d"))
    strings = strings.groupBy("of", "step").agg(F.lit(0).cast("long").alias("t"), F.count(F.lit(1)).alias("d"))
    counts = tokens.unionByName(strings).groupBy("of", "step").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    w = Window.partitionBy("of")
    upto = w.orderBy("step")
    ranked = counts.select("of", "step", F.sum("t").over(upto).alias("rank"), F.sum("t").over(w).alias("all"), ((1 + F.sum("d").over(upto)) / (1 + F.sum("d").over(w))).alias("p"))
    passing = ranked.filter((F.col("rank") > 0) & (F.col("p") <= rate * F.col("rank") / F.col("all")))
    return {r["of"]: r["step"] for r in passing.groupBy("of").agg(F.max("step").alias("step")).collect()}


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    scans = settled(scanned(docs))
    limits = rejected_upto(scans, structured(docs), rate)

    def random_only(x: Column) -> Column:
        of = F.element_at(F.array(*[F.lit(limits.get(k, -1)) for k in range(len(CLASSES))]), x["of"] + 1)
        return (x["step"] <= of) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    more = F.transform(F.filter("candidates", random_only), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("kind"), x["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda spans, k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return scans.withColumn("more", more).select(
        "doc_id", *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.size("more").cast("long").alias("n_random"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.concat("base", "more")).alias("spans"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
