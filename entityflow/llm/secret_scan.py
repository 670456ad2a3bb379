"""Secret scans by patterns and a battery of randomness tests (operator 8). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # equals AKIA[A-Z0-9]+ of 20 or more: a run that begins later is shorter
HEX = r"[0-9a-f]{24,}"  # equals [0-9a-f]+ of 24 or more: runs are maximal
#: What the tests judge: 20 or more characters of the usual encodings, the whole run.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Inferred encodings in the order they are tried: name, what the whole token matches, symbols in order,
#: collision probability of ordinary text in them, chance that ordinary neighbours differ in class, and
#: the chance that random ones do (0: one class only, the runs test says nothing).
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.10, 0.10, 0.47),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.10, 0.10, 0.47),
    ("lower", r"^[a-z]+$", _LOW, 0.065, 0.0, 0.0),
    ("upper", r"^[A-Z]+$", _UP, 0.065, 0.0, 0.0),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOW, 0.065, 0.10, 0.40),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UP, 0.065, 0.10, 0.40),
    ("base62", r"^[0-9A-Za-z]+$", _UP + _LOW + _DIGITS, 0.065, 0.12, 0.62),
    ("base64url", r"^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_", 0.065, 0.20, 0.64),
    ("base64", "", _UP + _LOW + _DIGITS + "+/", 0.065, 0.20, 0.64),
)
#: Ordinary text as a chain, for the likelihood ratio: letters whatever their case (per mille, common to
#: English, German, French and Spanish; mixed with equal ones by SPREAD), digits, separators.
_LETTERS = (85, 16, 31, 44, 140, 17, 20, 37, 72, 4, 8, 45, 28, 76, 62, 25, 7, 67, 70, 70, 45, 13, 12, 3, 10, 6)
_SEPARATORS = "-_/+"
SPREAD = 0.3
ORDINARY = [(1 - SPREAD) * n / sum(_LETTERS) + SPREAD / 26 for n in _LETTERS] + [0.1] * 10 + [0.3, 0.3, 0.3, 0.1]
#: Chance of the next class (lower, upper, digit, separator) after each of these, and of a symbol said again.
CLASSES = (0.86, 0.05, 0.04, 0.05, 0.50, 0.42, 0.04, 0.04, 0.06, 0.06, 0.80, 0.08, 0.50, 0.20, 0.25, 0.05)
AGAIN = 0.15
#: Lengths from which a stratum of the false-discovery control begins, and its rate.
STRATA = (20, 32, 64)
FALSE_DISCOVERIES = 0.001
_BINS, _TOP = 20, 30  # bins per power of ten of the p-value, powers of ten
_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def places(text: Column, pattern: str) -> Column:
    """array<struct(start, end, text)> of the leftmost non-overlapping matches, in code points, end
    exclusive: the pieces between matches and the matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.aggregate(
        F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.coalesce(F.length(p), F.lit(0)).cast("long").alias("gap"), m.alias("text"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(_SPANS).alias("got")),
        lambda a, x: F.struct((a["at"] + x["gap"] + F.coalesce(F.length(x["text"]), F.lit(0))).alias("at"), F.when(x["text"].isNull(), a["got"]).otherwise(F.concat(F.coalesce(a["got"], F.array().cast(_SPANS)), F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["text"])).alias("end"), x["text"].alias("text"))))).alias("got")),
        lambda a: F.coalesce(a["got"], F.array().cast(_SPANS)),
    )
    return F.when(F.size(found) > 0, walk).otherwise(F.array().cast(_SPANS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: it stands as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by Abramowitz and Stegun 26.2.17 (error under 1e-7), not under 1e-30."""

    def of(x: Column) -> Column:
        t = x["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        tail = 0.3989422804014327 * F.exp(-x["a"] * x["a"] / 2) * poly
        return F.greatest(F.when(x["z"] >= 0, tail).otherwise(1 - tail), F.lit(1e-30))

    small = lambda x: F.struct(x.alias("z"), F.least(F.abs(x), F.lit(11.0)).alias("a"))
    return _let(z, lambda x: _let(small(x), lambda y: _let(F.struct(y["z"].alias("z"), y["a"].alias("a"), (1 / (1 + 0.2316419 * y["a"])).alias("t")), of)))


def p_ordinary(token: Column) -> Column:
    """The chance that ordinary text looks as random as the token, by its inferred encoding.

    Three tests, each of a statistic that is known for ordinary text and for uniform symbols:
    chi-squared of the symbol counts (ordinary text is far from uniform), runs of character classes
    (random symbols change class far more often) and the serial correlation of neighbouring symbols
    (in ordinary text upper, lower and digits keep together). The p-values of the two tests of order are
    put together by Fisher's method; a token must look random in its counts and in its order, so the
    larger of the two counts (camel case, say, is in order only). Longer tokens separate the two better.

    In small alphabets and short tokens the counts alone can hardly tell the two apart. So a likelihood
    ratio stands beside the battery: uniform symbols of the encoding against a chain of ordinary text
    (letters, digits and separators keep together, case changes as in camel case, symbols repeat). Under the
    chain a ratio of r or more has chance 1 / r at most; it is paid for the choice among the encodings, and
    the smaller of the two p-values for the choice between them. One-class tokens stay in doubt.
    """
    body = F.regexp_replace(token, "=+$", "")
    kind = F.lit(None).cast("struct<symbols:string,collision:double,change:double,chance:double>")
    for _, whole, symbols, collision, change, chance in reversed(ENCODINGS):
        this = F.struct(F.lit(symbols).alias("symbols"), F.lit(collision).alias("collision"), F.lit(change).alias("change"), F.lit(chance).alias("chance"))
        kind = F.when(body.rlike(whole), this).otherwise(kind) if whole else this

    def counted(x: Column) -> Column:
        symbols = F.split(x["body"], "")
        squares = F.aggregate(F.regexp_extract_all(F.array_join(F.array_sort(symbols), ""), F.lit(r"(.)\1*"), F.lit(0)), F.lit(0.0), lambda s, r: s + F.length(r).cast("double") * F.length(r))
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["body"], "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "p")
        return F.struct(
            F.length(x["body"]).cast("double").alias("n"), F.length(x["kind"]["symbols"]).cast("double").alias("k"), squares.alias("squares"), (F.length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double") - 1).alias("changes"),
            x["kind"]["change"].alias("change"), (x["kind"]["chance"] > 0).alias("mixed"), (F.length(x["kind"]["symbols"]) * x["kind"]["collision"] - 1).alias("excess"), F.transform(symbols, lambda y: F.instr(x["kind"]["symbols"], y).cast("double")).alias("index"),
            ordinary(x["body"]).alias("ordinary"),
        )

    def ordinary(body: Column) -> Column:
        """The log-likelihood of the token as ordinary text. Without lower case, upper case stands for it."""
        same_case = F.when(body.rlike("[a-z]"), body).otherwise(F.lower(body))
        classes = F.split(F.translate(same_case, _LOW + _UP + _DIGITS + _SEPARATORS, "l" * 26 + "u" * 26 + "d" * 10 + "p" * 4), "")
        chance = lambda y: F.element_at(F.lit(ORDINARY), F.instr(F.lit(_LOW + _DIGITS + _SEPARATORS), F.lower(y)))
        one = F.zip_with(F.split(body, ""), classes, lambda y, c: F.struct(y.alias("y"), F.instr(F.lit("ludp"), c).alias("c"), chance(y).alias("p")))
        step = lambda u, v: F.log((1 - AGAIN) * F.element_at(F.lit(list(CLASSES)), (u["c"] - 1) * 4 + v["c"]) * v["p"] + F.when(u["y"] == v["y"], AGAIN).otherwise(0.0))
        return _let(one, lambda z: F.log(F.element_at(z, 1)["p"]) + _total(F.zip_with(F.slice(z, F.lit(1), F.size(z) - 1), F.slice(z, F.lit(2), F.size(z) - 1), step)))

    def correlated(x: Column) -> Column:
        """Fisher's z of the correlation of neighbouring symbols."""

        def of(y: Column) -> Column:
            head, tail = (F.slice(y["d"], F.lit(i), F.size(y["d"]) - 1) for i in (1, 2))
            r = _total(F.zip_with(head, tail, lambda u, v: u * v)) / (_total(F.transform(y["d"], lambda u: u * u)) + 1e-9)
            return _let(F.least(F.greatest(r, F.lit(-0.99)), F.lit(0.99)), lambda q: 0.5 * F.log((1 + q) / (1 - q)))

        return _let(_total(x["index"]) / x["n"], lambda m: _let(F.struct(F.transform(x["index"], lambda u: u - m).alias("d")), of))

    def tests(x: Column) -> Column:
        df, c = x["k"] - 1, x["change"]
        uniform = _upper_tail((df + x["n"] * x["excess"] - (x["k"] / x["n"] * x["squares"] - x["n"])) / F.sqrt(2 * df + 4 * x["n"] * x["excess"]))
        runs = _upper_tail((x["changes"] - (x["n"] - 1) * c) / F.sqrt((x["n"] - 1) * c * (1 - c) + 1e-9))
        serial = _upper_tail((0.5493 - correlated(x)) * F.sqrt(x["n"] - 3))
        order = _let(-(F.log(runs) + F.log(serial)), lambda h: F.exp(-h) * (1 + h))  # chi-squared, 4 degrees
        battery = F.when(x["mixed"], F.greatest(uniform, order)).otherwise(uniform)
        ratio = len(ENCODINGS) * F.exp(F.least(x["ordinary"] + x["n"] * F.log(x["k"]), F.lit(0.0)))
        return F.least(2 * F.least(battery, ratio), F.lit(1.0))

    return _let(F.struct(body.alias("body"), kind.alias("kind")), lambda x: _let(counted(x), tests))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, y: s + y)


def _stratum(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA):
        out = F.when(length >= least, i).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * _BINS), F.lit(_BINS * _TOP - 1)).cast("int")


def thresholds(tokens: DataFrame) -> list[int]:
    """tokens (stratum, bin) of all candidates -> for each stratum the least bin that is a discovery.

    Benjamini and Hochberg within each stratum of length, on p-values rounded up to bins: one grouped
    count of at most len(STRATA) * _BINS * _TOP rows comes to the driver, whatever the corpus."""
    counts = {(r["stratum"], r["bin"]): r["count"] for r in tokens.groupBy("stratum", "bin").count().collect()}
    out = []
    for s in range(len(STRATA)):
        total = sum(n for (t, _), n in counts.items() if t == s)
        found, least = 0, _BINS * _TOP
        for b in range(_BINS * _TOP - 1, -1, -1):
            found += counts.get((s, b), 0)
            if found and total * 10 ** (-b / _BINS) <= FALSE_DISCOVERIES * found:
                least = b
        out.append(least)
    return out


def _tokens(text: Column) -> Column:
    """array<struct(start, end, text, stratum, bin)> of all candidate tokens."""
    judged = F.transform(places(text, TOKEN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), _stratum(F.length(x["text"])).alias("stratum"), _bin(p_ordinary(x["text"])).alias("bin")))
    return judged


def _strip(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def with_spans(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """docs, all columns, with the columns {name}_base and {name}_random: arrays of struct(start, kind
    (place in KINDS), end) in order of start, then kind; code points, end exclusive.

    The first holds matches of the three patterns; an assignment counts if its value has 6 or more
    characters. The second holds tokens that pass the battery under the false-discovery control and touch no
    base span. Null and empty texts have no spans; repeated rows are judged alike (each counts among the
    candidates); no rows give no rows. Columns that are already called so are replaced.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    least = thresholds(docs.select(F.explode(_tokens(t)).alias("x")).select("x.stratum", "x.bin"))
    wanted = F.lit(False)
    assign = F.filter(places(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(_strip(assign, "assign"), _strip(places(t, ACCESS), "access"), _strip(places(t, HEX), "hex")))

    def discovered(x: Column) -> Column:
        hit = wanted
        for s, b in enumerate(least):
            hit = hit | ((x["stratum"] == s) & (x["bin"] >= b))
        return hit

    base_name, random_name = f"{name}_base", f"{name}_random"
    found = docs.withColumns({base_name: base, random_name: F.filter(_tokens(t), discovered)})
    clear = F.filter(F.col(random_name), lambda x: ~F.exists(F.col(base_name), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return found.withColumn(random_name, _strip(clear, "random"))


def spelled(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kind = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", name: str = "_secrets") -> DataFrame:
    """docs, all columns, with every secret span (overlapping ones as one) replaced by mark."""
    found = with_spans(docs, text, name)
    spans = F.array_sort(F.concat(F.col(f"{name}_base"), F.col(f"{name}_random")))
    acc = "array<string>"
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(acc).alias("parts")),
        lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["parts"], F.array(F.substring(F.col(text), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)))).otherwise(a["parts"]).alias("parts")),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text))).drop(f"{name}_base", f"{name}_random")
