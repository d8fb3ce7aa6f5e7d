"""Secret scans: known patterns, and a battery of randomness tests for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.words import let
from kindred.session import written

#: Patterns of the known kinds, in the order in which kinds are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide: the first that holds all characters of a token is taken.
ENCODINGS = (
    (r"\A[0-9A-F]+\z", DIGITS + UPPER[:6]),
    (r"\A[0-9a-f]+\z", DIGITS + LOWER[:6]),
    (r"\A[A-Z2-7]+=*\z", UPPER + "234567"),
    (r"\A[0-9a-z]+\z", DIGITS + LOWER),
    (r"\A[0-9A-Za-z]+\z", UPPER + LOWER + DIGITS),
    (r"\A[0-9A-Za-z+/]+=*\z", UPPER + LOWER + DIGITS + "+/"),
    (r"\A[0-9A-Za-z_-]+=*\z", UPPER + LOWER + DIGITS + "-_"),
)
#: Chance that two, and that three letters of ordinary text agree; share of a-f among its characters.
TEXT_PAIR, TEXT_TRIPLE, TEXT_HEX = 0.065, 0.0055, 0.4
FALSE_DISCOVERIES = 0.05
LEAST_UNIFORM = 0.001
P_STEPS, P_LEAST = 256, 1e-300  # steps of the grid to each halving of p, and where it ends


def running(values: Column, join) -> Column:  # noqa: ANN001
    """Inclusive running total of an array under ``join``, in log(n) passes."""
    def add(total: Column, k: Column) -> Column:
        return F.transform(total, lambda x, i: F.when(i >= k, join(x, F.get(total, (i - k).cast("int")))).otherwise(x))

    powers = let(F.size(values), lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda k: k < n))
    return F.aggregate(powers, values, add)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches as (start, end, group): code points, end exclusive.

    Matches and the gaps between them alternate, so running totals of their
    lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    gaps = F.split(text, pattern, -1)
    steps = let(gaps, lambda g: F.transform(found, lambda x, i: F.length(x) + F.length(F.get(g, i))))
    ends = running(steps, lambda a, b: a + b)
    return F.arrays_zip(found.alias("found"), inner.alias("inner"), ends.alias("end"))


def spans(text: Column, kind: str, quick: str, pattern: str, least: int, groups: int = 0) -> Column:
    """Matches of one kind whose group has ``least`` characters; texts that ``quick`` misses cost no more."""
    placed = let(matches(text, pattern, groups), lambda m: F.transform(
        F.filter(m, lambda x: F.length(x["inner"]) >= least),
        lambda x: F.struct((x["end"] - F.length(x["found"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["found"].alias("found")),
    ))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(text.rlike(quick), placed).otherwise(none)


def normal_below(z: Column) -> Column:
    """Standard normal distribution function, by a logistic curve (error below 0.0002)."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def two_sided(z: Column) -> Column:
    return 2 * normal_below(-F.abs(z))


def normal_tail(z: Column) -> Column:
    """Standard normal distribution function whose relative error stays below 2e-7 however far out ``z`` lies."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    powers = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    series = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        series = c + t * series
    half = t * F.exp(series - x * x) / 2
    return F.when(z < 0, half).otherwise(1 - half)


def battery(token: Column) -> Column:
    """Test results of a token: alphabet size ``a``, ``uniform`` and ``text``.

    ``uniform`` is the least of three p-values under "symbols are drawn evenly
    from the inferred alphabet", times three: the chi-squared test of the
    alphabet, the runs test about its middle, the serial correlation of
    neighbours. ``text`` is the p-value of the same chi-squared statistic under
    "symbols agree as often as those of ordinary text"; longer tokens reach
    lower ones.
    """
    alphabet = F.lit(None).cast("string")
    for pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    alphabet = F.coalesce(alphabet, F.lit(UPPER + LOWER + DIGITS + "+/-_"))
    body = F.regexp_replace(token, r"=+\z", "")

    def tests(v: Column) -> Column:
        s, a, x = v["s"], v["a"].cast("double"), v["x"]
        n = F.size(x).cast("double")
        squares = F.aggregate(
            F.transform(F.array_distinct(F.split(s, "")), lambda d: F.pow((F.length(s) - F.length(F.replace(s, d))).cast("double"), 2.0)),
            F.lit(0.0), lambda t, y: t + y,
        )
        chi = F.greatest(a / n * squares - n, F.lit(0.0))
        df = a - 1
        z_chi = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.transform(x, lambda y: (y > (a - 1) / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda t, y: t + y).cast("double")
        n2 = n - n1
        changes = let(high, lambda h: F.aggregate(F.transform(h, lambda y, i: (y != F.coalesce(F.get(h, i - 1), y)).cast("int")), F.lit(0), lambda t, y: t + y))
        expected = 2 * n1 * n2 / n + 1
        spread = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
        z_runs = F.when(spread > 0, (changes + 1 - expected) / spread).otherwise(F.lit(9.0))
        mean = F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / n
        var = F.aggregate(x, F.lit(0.0), lambda t, y: t + y * y) / n - mean * mean
        lagged = F.aggregate(F.transform(x, lambda y, i: y * F.coalesce(F.get(x, i - 1), F.lit(0.0))), F.lit(0.0), lambda t, y: t + y) / n
        z_serial = F.when(var > 0, (lagged - mean * mean) / var * F.sqrt(n)).otherwise(F.lit(9.0))
        pair = (squares - n) / (n * (n - 1))
        pair_var = (2 * TEXT_PAIR * (1 - TEXT_PAIR) + 4 * (n - 2) * (TEXT_TRIPLE - TEXT_PAIR**2)) / (n * (n - 1))
        as_text = F.when(a == 16, F.pow(F.lit(TEXT_HEX), n)).otherwise(let((pair - TEXT_PAIR) / F.sqrt(pair_var), normal_tail))
        uniform = F.least(F.lit(1.0), 3 * F.least(two_sided(z_chi), two_sided(z_runs), two_sided(z_serial)))
        return F.struct(a.cast("int").alias("a"), uniform.alias("uniform"), as_text.alias("text"))

    values = let(alphabet, lambda al: F.struct(body.alias("s"), F.length(al).alias("a"), F.transform(F.split(body, ""), lambda c: (F.instr(al, c) - 1).cast("double")).alias("x")))
    return let(values, tests)


def scan(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Secrets in whole texts: ``key`` columns, ``base`` and ``spans``.

    ``base`` holds the known kinds, ``spans`` these and random-looking tokens
    that touch none of them; both are arrays of (start, kind, end), start by
    start. A token of 20 or more characters with letters and digits is random if
    the battery does not rule out even symbols, and if "ordinary text" is ruled
    out at a false-discovery rate of 5 % among all tokens of about its length:
    p-values are counted on a logarithmic grid for each length class, which bounds
    the table from which the cut is read and tells the smallest of them apart.

    Null text: empty. One row per input row; texts are read once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        spans(t, "assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, 6, 2),
        spans(t, "access", "AKIA", ACCESS, 20),
        spans(t, "hex", "[0-9a-f]{24}", HEX, 24),
    )
    other = spans(t, "random", CANDIDATE, CANDIDATE, 20)
    found = docs.select(*key, F.struct(base.alias("b"), other.alias("o")).alias("f"))
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    free = let(F.col("f.b"), lambda b: F.filter("f.o", lambda x: mixed(x["found"]) & ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))
    tested = F.transform(free, lambda x: F.struct(x["start"], x["kind"], x["end"], battery(x["found"]).alias("t")))
    plain = lambda x: F.struct(x["start"], x["kind"], x["end"])
    found = written(found.select(*key, F.sort_array(F.transform("f.b", plain)).alias("base"), tested.alias("tested")), "secrets")

    each = found.select(F.explode("tested").alias("x")).select("x.*")
    size = F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))).cast("int")
    step = F.floor(-P_STEPS * F.log2(F.greatest("t.text", F.lit(P_LEAST)))).cast("int")
    counts = each.groupBy(size.alias("size"), step.alias("step")).agg(F.count("*").alias("n"), F.max("t.text").alias("p"))
    rank = F.sum("n").over(Window.partitionBy("size").orderBy(F.desc("step")))
    total = F.sum("n").over(Window.partitionBy("size"))
    good = F.col("p") <= FALSE_DISCOVERIES * rank / total
    cuts = counts.withColumn("good", good).filter("good").groupBy("size").agg(F.max("p").alias("cut"))
    # One number for each length class, of which there are at most 31.
    known = F.create_map(*(F.lit(x) for r in cuts.collect() for x in (r["size"], r["cut"]))).cast("map<int,double>")
    cut = lambda x: F.coalesce(F.try_element_at(known, F.floor(F.log2((x["end"] - x["start"]).cast("double"))).cast("int")), F.lit(-1.0))
    random = F.filter("tested", lambda x: (x["t"]["uniform"] >= LEAST_UNIFORM) & (x["t"]["text"] <= cut(x)))
    every = F.sort_array(F.concat("base", F.transform(random, plain)))
    return found.select(*key, "base", every.alias("spans"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span replaced by ``mark``; spans that overlap become one mark."""
    def rewrite(v: Column) -> Column:
        t, s, reach = v["t"], v["s"], v["reach"]
        pieces = F.transform(s, lambda x, i: let(F.coalesce(F.get(reach, i - 1), F.lit(0)), lambda e: F.when(
            (x["start"] > e) | (i == 0), F.concat(F.substr(t, e + 1, x["start"] - e), F.lit(mark))
        ).otherwise("")))
        return F.concat(F.array_join(pieces, ""), F.substr(t, F.element_at(reach, -1) + 1))

    reach = running(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    whole = F.struct(text.alias("t"), found.alias("s"), reach.alias("reach"))
    return F.when(F.size(found) > 0, let(whole, rewrite)).otherwise(text)
