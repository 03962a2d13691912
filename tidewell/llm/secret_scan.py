"""Secret scan with a battery of randomness tests (native: DataFrame functions only).

Base kinds (assign, access, hex) are found exactly, with code point spans: the pieces that ``split`` leaves
between the matches and the matches themselves, laid end to end, give every start and end.

The method adds spans of kind ``random``: runs of 20 or more key-like characters, with a letter and a digit, that no base span
touches. An encoding is inferred for each (hex, base32, base64), and three tests ask whether its symbols look
uniform and independent: chi-squared over parts of the alphabet (frequent and rare letters by case, digits, signs;
Wilson-Hilferty), runs about the middle of the alphabet, and lag-one serial correlation. Fisher's method combines them to a score
of randomness.

What is reported as a secret is what is controlled: the null hypothesis of a run is that it is ordinary text (an identifier, a path,
a date, a name with a version). ``ordinary`` makes ``NULLS`` such strings by rule and puts them through the same battery; a run's
p-value is the share of them, in its length class, that look at least as random. The Benjamini-Hochberg rule, within each length class
because longer runs give the tests more power, reports the runs for which at most a share of ``FDR`` is expected to be
ordinary. It needs only histograms of scores (at most ``BINS`` rows a class), so that nothing is sorted globally.

Defined results: null text counts as empty; an empty table gives an empty result; repeated rows give
equal rows; a null ``doc_id`` is carried along; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import durable, table, text_of

# Patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: runs are maximal either way
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more, likewise
RUN = r"[A-Za-z0-9+/_.=-]{20,}"
KEY = r"[A-Za-z0-9+/_=-]{20,}"
FDR = 0.02
NULLS = 40_000
BINS, BINS_PER_DECADE = 400, 20

SPAN = "array<struct<kind:int,start:long,end:long,token:string>>"


CHUNK = 64


def _fold(pieces: Column, start: Column, kind: int) -> Column:
    """Spans of matches (m) and what stands before each, from a start on."""
    return F.aggregate(
        pieces,
        F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["before"] + F.length(x["m"])).cast("long").alias("at"),
            F.concat(
                a["out"],
                F.array(F.struct(F.lit(kind).alias("kind"), (a["at"] + x["before"]).cast("long").alias("start"), (a["at"] + x["before"] + F.length(x["m"])).cast("long").alias("end"), x["m"].alias("token"))).cast(SPAN),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )


def _spans(kind: int, text: Column, pattern: str, keep) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping, for which keep(match) holds.

    Many matches are folded in chunks, whose starts are summed first, so that no long array is copied for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    every = F.arrays_zip(found.alias("m"), F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda x: F.length(x)).alias("before"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda c: F.slice(every, c * CHUNK + 1, F.lit(CHUNK)))
    widths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["before"] + F.length(x["m"])))
    starts = F.aggregate(
        widths,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")),
        lambda a, w: F.struct((a["at"] + w).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
        lambda a: a["out"],
    )
    many = F.flatten(F.zip_with(chunks, starts, lambda c, at: _fold(c, at, kind)))
    return F.filter(F.when(F.size(found) <= CHUNK, _fold(every, F.lit(0).cast("long"), kind)).otherwise(many), lambda s: keep(s["token"]))


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.col("_text")
    none = F.array().cast(SPAN)
    every = lambda t: F.lit(True)
    return (
        docs.select("doc_id", text_of().alias("_text"))
        .withColumn("_run", text.rlike(RUN))
        .select(
            "doc_id",
            F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _spans(0, text, ASSIGN, lambda t: F.length(F.regexp_extract(t, ASSIGN, 2)) >= 6)).otherwise(none).alias("assign"),
            F.when(F.col("_run") & F.contains(text, F.lit("AKIA")), _spans(1, text, ACCESS, every)).otherwise(none).alias("access"),
            F.when(F.col("_run"), _spans(2, text, HEX, every)).otherwise(none).alias("hex"),
            F.when(F.col("_run"), _spans(3, text, KEY, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))).otherwise(none).alias("_keys"),
        )
        .withColumn("_base", F.concat("assign", "access", "hex"))
        .select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.size("assign").cast("long").alias("n_assign"),
            F.size("access").cast("long").alias("n_access"),
            F.size("hex").cast("long").alias("n_hex"),
            F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("_base"),
            F.filter("_keys", lambda k: ~F.exists("_base", lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"]))).alias("_keys"),
        )
    )


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal (Abramowitz-Stegun 7.1.26 by halves, error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


# Parts of the alphabets whose shares are tested; letters frequent in European languages first.
HEX_PARTS = ["01234", "56789", "abc", "def"]
BASE32_PARTS = ["ETAOINSHRDLU", "BCFGJKMPQVWXYZ", "234567"]
BASE64_PARTS = ["etaoinshrdlu", "bcfgjkmpqvwxyz", "ETAOINSHRDLU", "BCFGJKMPQVWXYZ", "0123456789", "+/"]


def _chi(parts: list[str]) -> Column:
    """Chi-squared of the parts' counts in ``plain`` against equal shares of the alphabet's symbols."""
    total = F.lit(0.0)
    for part in parts:
        count = (F.length("plain") - F.length(F.translate("plain", part, ""))).cast("double")
        total = total + count * count * F.col("a") / len(part)
    return total / F.col("n") - F.col("n")


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, length class and the combined p-value of randomness to rows with a ``token``."""
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.when(body.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z"), "hex").when(body.rlike(r"^[A-Z2-7]+\z"), "base32").otherwise("base64")
    order = (
        F.when(F.col("encoding") == "hex", "0123456789abcdef")
        .when(F.col("encoding") == "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    )
    plain = F.when(F.col("encoding") == "hex", F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    symbols = F.transform(F.filter(F.split("plain", ""), lambda c: c != ""), lambda c: F.instr(F.col("order"), c) - 1)
    t = tokens.withColumn("encoding", encoding).withColumn("order", order).withColumn("plain", plain).withColumn("x", symbols).withColumn("n", F.size("x").cast("double")).withColumn("a", F.length("order").cast("double"))
    t = t.withColumn("chi", F.when(F.col("encoding") == "hex", _chi(HEX_PARTS)).when(F.col("encoding") == "base32", _chi(BASE32_PARTS)).otherwise(_chi(BASE64_PARTS)))
    k = F.when(F.col("encoding") == "hex", float(len(HEX_PARTS) - 1)).when(F.col("encoding") == "base32", float(len(BASE32_PARTS) - 1)).otherwise(float(len(BASE64_PARTS) - 1))
    wilson = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / k, 1 / 3) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    high = F.transform("x", lambda v: (v >= F.col("a") / 2).cast("int"))
    t = t.withColumn("high", high).withColumn("n1", F.aggregate("high", F.lit(0), lambda s, v: s + v).cast("double"))
    pairs = F.arrays_zip(F.slice("high", F.lit(1), F.size("high") - 1).alias("p"), F.slice("high", F.lit(2), F.size("high") - 1).alias("q"))
    t = t.withColumn("runs", 1.0 + F.size(F.filter(pairs, lambda z: z["p"] != z["q"])))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    mean = 1 + 2 * n0 * n1 / n
    var = 2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1))
    runs_z = F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)).otherwise(F.sqrt(n))
    centre = (F.col("a") - 1) / 2
    steps = F.arrays_zip(F.slice("x", F.lit(1), F.size("x") - 1).alias("p"), F.slice("x", F.lit(2), F.size("x") - 1).alias("q"))
    lagged = F.aggregate(steps, F.lit(0.0), lambda s, z: s + (z["p"] - centre) * (z["q"] - centre))
    serial_z = lagged / ((F.col("a") * F.col("a") - 1) / 12) / F.sqrt(n - 1)
    ps = [_normal_tail(wilson), 2 * _normal_tail(F.abs(runs_z)), 2 * _normal_tail(F.abs(serial_z))]
    half = -sum(F.log(F.least(F.lit(1.0), F.greatest(p, F.lit(1e-15)))) for p in ps)
    fisher = F.exp(-half) * (1 + half + half * half / 2)
    length_class = F.when(n < 32, 0).when(n < 48, 1).otherwise(2)
    return t.withColumn("p", fisher).withColumn("length_class", length_class).drop("order", "plain", "x", "a", "chi", "high", "n1", "runs")


# Common words of names and paths.
WORDS = "access account active backup balance base build cache client config count create current data default delete detail document error event export feature field file filter format handler header image import index input item label layer limit list local manager message method model module name network number object option order output page parse path point process product profile project property query record release report request resource response result route schema search section server service session setting source state status storage stream string style system table target task template test text time total type update user value version view window worker".split()


def ordinary(spark: SparkSession, count: int = NULLS) -> DataFrame:
    """Key-like strings that are no secrets, by rule: ``token``. Names in camel, snake and kebab case, paths, dates with names, versions."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    words = F.transform(F.sequence(F.lit(0), draw(0, 7) + 2), lambda i: F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))).cast("int")))
    number = draw(1, 10_000).cast("string")
    day = F.format_string("%d-%02d-%02d", draw(2, 40) + 1990, draw(3, 12) + 1, draw(4, 28) + 1)
    camel = F.array_join(F.transform("w", lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")
    snake = F.array_join("w", "_")
    forms = [
        F.concat(camel, number),
        F.concat(snake, F.lit("_"), number),
        F.concat(F.array_join("w", "-"), F.lit("-"), number),
        F.concat(F.array_join("w", "/"), F.lit("/"), number),
        F.concat(day, F.lit("-"), F.array_join("w", "-")),
        F.concat(F.upper(snake), F.lit("_"), number),
        F.concat(F.initcap(F.element_at("w", 1)), camel, F.lit("V"), draw(5, 20).cast("string"), F.lit("_"), day),
        F.concat(day, F.lit("T"), F.format_string("%02d-%02d-%02d", draw(6, 24), draw(7, 60), draw(8, 60)), F.lit("-"), snake),
    ]
    return spark.range(count).withColumn("w", words).select(F.element_at(F.array(*forms), draw(9, len(forms)) + 1).alias("token")).filter(F.length("token") >= 20)


def reported(tested: DataFrame, null: DataFrame) -> DataFrame:
    """Per length class the last bin of scores that is reported: Benjamini-Hochberg over histograms of runs and of ordinary strings."""
    of = lambda d, a, b: d.groupBy("length_class", _bin()).agg(F.sum(F.lit(a)).alias("runs"), F.sum(F.lit(b)).alias("nulls"))
    binned = of(tested, 1, 0).unionByName(of(null, 0, 1)).groupBy("length_class", "bin").agg(F.sum("runs").alias("runs"), F.sum("nulls").alias("nulls"))
    by_class = Window.partitionBy("length_class")
    down_to = by_class.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = (1 + F.sum("nulls").over(down_to)) / (1 + F.sum("nulls").over(by_class))
    ranked = binned.withColumn("p", p).withColumn("rank", F.sum("runs").over(down_to)).withColumn("m", F.sum("runs").over(by_class))
    return ranked.filter((F.col("rank") > 0) & (F.col("p") * F.col("m") <= FDR * F.col("rank"))).groupBy("length_class").agg(F.max("bin").alias("report_to"))


def _bin() -> Column:
    """0 for the most random."""
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-30))) * BINS_PER_DECADE)).cast("int").alias("bin")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scanned = durable(_scanned(docs))
    tested = durable(battery(scanned.select("_row", F.explode("_keys").alias("k")).select("_row", "k.start", "k.end", "k.token")).select("_row", "start", "end", "length_class", "p"))
    null = battery(ordinary(docs.sparkSession)).select("length_class", "p")
    cut = reported(tested, null)  # at most one row for each of the three length classes
    random = (
        tested.withColumn("bin", _bin())
        .join(F.broadcast(cut), "length_class")
        .filter(F.col("bin") <= F.col("report_to"))
        .groupBy(F.col("_row").alias("_r"))
        .agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("_random"))
    )
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
    line = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return scanned.join(random, F.col("_row") == F.col("_r"), "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(line(F.col("_base")), 256).alias("base_sha256"),
        line(F.concat("_base", F.coalesce("_random", empty))).alias("spans"),
        F.size(F.coalesce("_random", empty)).cast("long").alias("n_random"),
    )


def op3_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
