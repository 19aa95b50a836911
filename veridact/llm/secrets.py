"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three base patterns and the least lengths of what they must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE_CHARS = 6
KINDS = ("assign", "access", "hex", "random")

#: Stretches that the battery tests: 20 characters or more of an encoding's alphabet. A stretch of more than 491 characters is
#: tested in windows of 472, the last of them 20 to 491 long, so that the work is linear in the stretch. A window begins where
#: the stretch or the window before it does, so that no other place is tried.
CANDIDATE = r"(?:(?<![A-Za-z0-9+/_-])|\G)(?:[A-Za-z0-9+/_-]{20,491}+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{472})"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Inferred encoding: pattern of the whole window, alphabet in digit order, and how often, in an ordinary stretch of that
#: look (words, names, numbers), a symbol is of another class (lower case, upper case, digit, sign) than the one before.
#: Of letters in one case it is vowels and other letters that alternate; how often is learned.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.25),
    "base32": (r"^(?=.*[2-7])[A-Z2-7]+$", _UPPER + "234567", 0.1),
    "base36": (r"^(?=.*[0-9])(?:[A-Z0-9]+|[a-z0-9]+)$", _DIGITS + _LOWER, 0.1),
    "upper": (r"^[A-Z]+$", _UPPER, None),
    "lower": (r"^[a-z]+$", _LOWER, None),
    "letters": (r"^[A-Za-z]+$", _UPPER + _LOWER, 0.3),
    "base62": (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.3),
    "base64": (r"", _UPPER + _LOWER + _DIGITS + "+/", 0.3),
}
_FOLDED = ("hex", "base36")
_SYMBOLS = _LOWER + _UPPER + _DIGITS + "+/"
_CLASSES = "a" * 26 + "A" * 26 + "0" * 10 + "-" * 2
_VOWELS = "aeiouy"
#: Lower ends of the length classes within which false discoveries are controlled.
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128)
BINS_PER_DECADE, MAX_BIN = 10, 400
#: Share of the pair in an ordinary letter's chance after another; the rest is the letter's own: words may be from elsewhere.
PAIR_SHARE = 0.7
#: Share of English in what is ordinary, whatever the corpus: names in code are English.
ENGLISH_SHARE = 0.3
# Letters of English in thousandths, and its commonest letter pairs in ten thousandths of all pairs.
_ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7)
_ENGLISH_PAIRS = {
    "th": 356, "he": 307, "in": 243, "er": 205, "an": 199, "re": 185, "on": 176, "at": 149, "en": 145, "nd": 135,
    "ti": 134, "es": 134, "or": 128, "te": 120, "of": 117, "ed": 117, "is": 113, "it": 112, "al": 109, "ar": 107,
    "st": 105, "to": 105, "nt": 104, "ng": 95, "se": 93, "ha": 93, "as": 87, "ou": 87, "io": 83, "le": 83,
    "ve": 83, "co": 79, "me": 79, "de": 76, "hi": 76, "ri": 73, "ro": 73, "ic": 70, "ne": 69, "ea": 69,
    "ra": 69, "ce": 65, "li": 62, "ch": 60, "ll": 58, "be": 58, "ma": 57, "si": 55, "om": 55, "ur": 54,
}
#: Correlation that the combination of the three tests allows for between any two of them.
TEST_CORRELATION = 0.5
FALSE_DISCOVERY_RATE = 0.01
#: 99.9% point of chi-squared with three degrees of freedom: the battery's joint statistic stays below it on random text.
BATTERY_LIMIT = 16.266
MARK = "[REDACTED]"


@dataclass(frozen=True)
class Ordinary:
    """What ordinary text is like: shares of letters, how neighbours attract each other, and how often vowels alternate."""

    letters: tuple[float, ...]
    pull: tuple[float, ...]  # 26 * 26, by first letter: logarithm of how much likelier the second is after it
    pull_mean: float
    pull_var: float
    turn: float  # chance that of two neighbours one is a vowel and one isn't

    @classmethod
    def of(cls, pairs: dict[str, int]) -> Ordinary:
        """From counts of letter pairs inside words."""
        english = [v / sum(_ENGLISH) for v in _ENGLISH]
        rest = 1 - sum(_ENGLISH_PAIRS.values()) / 1e4
        of = [sum(pairs.get(a + c, 0) for a in _LOWER) for c in _LOWER]
        own = [(v + w) / (sum(of) + 1) for v, w in zip(of, english)]
        q = [(1 - ENGLISH_SHARE) * v + ENGLISH_SHARE * w for v, w in zip(own, english)]
        after = [sum(pairs.get(a + c, 0) for c in _LOWER) for a in _LOWER]
        chance = [[(pairs.get(a + c, 0) + 26 * q[j]) / (after[i] + 26) for j, c in enumerate(_LOWER)] for i, a in enumerate(_LOWER)]
        other = [[_ENGLISH_PAIRS.get(a + c, 0) / 1e4 / english[i] + rest * english[j] for j, c in enumerate(_LOWER)] for i, a in enumerate(_LOWER)]
        both = [[(1 - ENGLISH_SHARE) * v + ENGLISH_SHARE * w for v, w in zip(*rows)] for rows in zip(chance, other)]
        pull = [[math.log(PAIR_SHARE * p / q[j] + 1 - PAIR_SHARE) for j, p in enumerate(row)] for row in both]
        weights = [(own[i] * chance[i][j], pull[i][j], (_LOWER[i] in _VOWELS) != (_LOWER[j] in _VOWELS)) for i in range(26) for j in range(26)]
        mean = sum(w * s for w, s, _ in weights)
        var = sum(w * (s - mean) ** 2 for w, s, _ in weights)
        return cls(tuple(q), tuple(s for row in pull for s in row), mean, max(var, 0.05), sum(w for w, _, t in weights if t))

    def powers(self) -> tuple[float, float]:
        """Sums of the second and third powers of the letters' shares."""
        return sum(q**2 for q in self.letters), sum(q**3 for q in self.letters)


def _located(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start,end,text[,group]>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Splitting by the pattern gives the stretches between matches, so the lengths of both add up to the positions. Matches are
    added up in groups of 128, whose arrays alone are copied as they grow.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    names = ["text", *[f"group{g}" for g in groups]]
    item = "struct<start:int,end:int," + ",".join(f"{n}:string" for n in names) + ">"
    none = F.array().cast(f"array<{item}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["text"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), *[x[n].alias(n) for n in names]).cast(item)
        return F.struct(end.alias("at"), F.when(x["text"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def located(parts: Column) -> Column:
        def group(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(parts, k * 128 + 1, F.lit(128)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 128).cast("int")), begin, group, lambda a: F.flatten(a["out"]))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *[f.alias(n) for f, n in zip(found, names)])
    return F.when(text.rlike(pattern), _let(parts, located)).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is taken once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def prose(docs: DataFrame, text_col: str = "text") -> Ordinary:
    """Ordinary letters, learned from all words of 2 to 19 letters of all texts, so that candidates teach nothing.

    Words are counted before the shuffle and once more after it; letter pairs are taken of different words only. The driver
    gets at most 26 * 26 counts.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z0-9+/_-]+")).alias("word")).filter(F.col("word").rlike("^[a-z]{2,19}$"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    found = counts.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Ordinary.of({r["pair"]: r["n"] for r in found})


def _differ(values: Column) -> Column:
    """How many pairs of neighbours differ."""
    last = F.size(values) - 1
    pairs = F.zip_with(F.slice(values, F.lit(1), last), F.slice(values, F.lit(2), last), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v).cast("double")


def _symbols(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _inferred(x: Column) -> Column:
    """A window's encoding, and its symbols with one pair of signs."""
    encoding = F.coalesce(*[F.when(x["text"].rlike(p), F.lit(name)) for name, (p, *_) in ENCODINGS.items()])
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), encoding.alias("encoding"), F.translate(x["text"], "-_", "+/").alias("plain"))


def _read(x: Column) -> Column:
    """A window's symbols as digits, classes, vowels and letters."""
    folded = F.when(x["encoding"].isin(*_FOLDED), F.lower(x["plain"])).otherwise(x["plain"])
    vowelled = F.translate(F.lower(x["plain"]), _LOWER, "".join("v" if c in _VOWELS else "c" for c in _LOWER))
    alphabet = F.coalesce(*[F.when(x["encoding"] == name, F.lit(a)) for name, (_, a, _) in ENCODINGS.items()])
    letters = F.transform(_symbols(F.lower(x["plain"])), lambda c: F.position(c, F.lit(_LOWER)) - 1)
    return F.struct(
        *[x[c].alias(c) for c in ("start", "end", "encoding", "plain")], F.length(x["plain"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
        _let(alphabet, lambda a: F.transform(_symbols(folded), lambda c: F.position(c, a) - 1)).alias("digits"),
        F.translate(x["plain"], _SYMBOLS, _CLASSES).alias("classed"), vowelled.alias("vowelled"), letters.alias("letters"),
    )


def _counts(x: Column, ordinary: Ordinary) -> Column:
    """What the tests of one window need: its digits, equal pairs, symbols by class, changes of class and pull of neighbours."""
    of = {name: F.regexp_count(x["classed"], F.lit(c)) for name, c in (("lower", "a"), ("upper", "A"), ("digit", "0"), ("sign", "-"))}
    times = F.transform(F.array(*[F.lit(c) for c in _SYMBOLS]), lambda c: x["n"] - F.length(F.replace(x["plain"], c, F.lit(""))))
    last = F.size(x["letters"]) - 1
    pulls = F.zip_with(
        F.slice(x["letters"], F.lit(1), last), F.slice(x["letters"], F.lit(2), last),
        lambda a, b: F.when((a >= 0) & (b >= 0), F.get(F.array(*[F.lit(v) for v in ordinary.pull]), a * 26 + b)),
    )
    return F.struct(
        *[x[c].alias(c) for c in ("start", "end", "encoding", "n", "k", "digits")],
        F.aggregate(times, F.lit(0.0), lambda a, v: a + v * v).alias("same"), *[v.cast("double").alias(name) for name, v in of.items()],
        _let(_symbols(x["classed"]), _differ).alias("turns"), _let(_symbols(x["vowelled"]), _differ).alias("swings"),
        _let(F.filter(pulls, lambda v: v.isNotNull()), lambda p: F.struct(F.size(p).cast("double").alias("n"), F.aggregate(p, F.lit(0.0), lambda a, v: a + v).alias("sum"))).alias("pull"),
    )


def _plain_battery(x: Column) -> Column:
    """The three tests against true randomness, joined: chi-squared with three degrees of freedom if every symbol is drawn alike."""
    n, k, digits = x["n"], x["k"], x["digits"]
    # chi-squared uniformity over the alphabet, made normal by the cube root
    df = k - 1
    chi = k * x["same"] / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # runs of symbols in the upper and lower half of the alphabet
    halves = F.transform(digits, lambda v: (v * 2 >= k).cast("int"))
    n1 = F.aggregate(halves, F.lit(0), lambda a, v: a + v).cast("double")
    mean = 1 + 2 * n1 * (n - n1) / n
    spread_runs = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    z_runs = F.when((n1 == 0) | (n1 == n), F.lit(10.0)).otherwise((1 + _differ(halves) - mean) / spread_runs)
    # serial correlation of neighbours
    z_serial = _let(F.aggregate(digits, F.lit(0), lambda a, v: a + v) / n, lambda centre: _serial(digits, centre, n))
    upper = F.greatest(z_chi, F.lit(0.0))
    return upper * upper + z_runs * z_runs + z_serial * z_serial


def _serial(digits: Column, centre: Column, n: Column) -> Column:
    spread = F.aggregate(digits, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre))
    last = F.size(digits) - 1
    lagged = F.zip_with(F.slice(digits, F.lit(1), last), F.slice(digits, F.lit(2), last), lambda a, b: (a - centre) * (b - centre))
    return F.when(spread == 0, F.lit(10.0)).otherwise(F.aggregate(lagged, F.lit(0.0), lambda a, v: a + v) / spread * F.sqrt(n))


def _scores(x: Column, ordinary: Ordinary) -> Column:
    """The three tests against ordinary text, as normal scores: the lower, the less like it and the more like randomness.

    Uniformity: the chi-squared statistic of a window goes by its equal pairs of symbols, of which ordinary text of the same
    classes has more; of hex, how unlikely it is that ordinary letters stay within its six. Runs: of classes (of vowels, if
    all letters are of one case), against the ordinary rate. Serial correlation: of neighbouring letters, measured by how
    the corpus's neighbours attract each other; hex has too few letters for it, and is judged by the other two.
    """

    def moments(m: Column, second: float, third: float) -> tuple[Column, Column]:
        pairs = m * (m - 1)
        return m + pairs * second, 2 * pairs * second + 4 * pairs * (m - 2) * third - 2 * pairs * (2 * m - 3) * second * second

    is_hex, hex_share = x["encoding"] == "hex", sum(ordinary.letters[:6])
    parts = [moments(x["lower"], *ordinary.powers()), moments(x["upper"], *ordinary.powers()), moments(x["digit"], 0.1, 0.01), moments(x["sign"], 0.5, 0.25)]
    mean, var = (sum(p[i] for p in parts[1:]) + parts[0][i] for i in range(2))
    outside = F.greatest((x["lower"] + x["upper"]) * -math.log(hex_share) - math.log(2), F.lit(0.0))
    z_chi = F.when(is_hex, -F.sqrt(2 * outside)).when(var > 1e-6, (x["same"] - mean) / F.sqrt(var)).otherwise(F.lit(0.0))
    rate = F.coalesce(*[F.when(x["encoding"] == name, F.lit(c)) for name, (_, _, c) in ENCODINGS.items() if c])
    gaps = x["n"] - 1
    turns = (gaps * rate - x["turns"]) / F.sqrt(gaps * rate * (1 - rate))
    swings = (x["swings"] - gaps * ordinary.turn) / F.sqrt(gaps * (ordinary.turn * (1 - ordinary.turn)))
    z_runs = F.coalesce(turns, swings)
    pairs = x["pull"]["n"]
    z_serial = F.when(~is_hex & (pairs > 0), (x["pull"]["sum"] - pairs * ordinary.pull_mean) / F.sqrt(pairs * ordinary.pull_var)).otherwise(F.lit(0.0))
    return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"))


def _judged(x: Column, ordinary: Ordinary) -> Column:
    """A window with its stratum and the bin of its p-value, which combines the three tests.

    Stouffer's rule for scores of pairwise correlation ``TEST_CORRELATION``; half the exponential of minus half the
    square is no less than a normal tail. A window that the plain battery tells from true randomness has the p-value 1.
    """
    spread = F.when(x["encoding"] == "hex", F.lit(math.sqrt(2 + 2 * TEST_CORRELATION))).otherwise(F.lit(math.sqrt(3 + 6 * TEST_CORRELATION)))
    z = (x["z"]["chi"] + x["z"]["runs"] + x["z"]["serial"]) / spread
    decades = F.when((z < 0) & (x["joint"] <= BATTERY_LIMIT), (z * z / 2 + math.log(2)) / math.log(10)).otherwise(F.lit(0.0))
    length_class = F.coalesce(*[F.when(x["n"] >= c, F.lit(c)) for c in reversed(LENGTH_CLASSES)])
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.concat_ws(":", x["encoding"], length_class.cast("string")).alias("stratum"),
        F.least(F.lit(MAX_BIN), F.floor(decades * BINS_PER_DECADE).cast("int")).alias("bin"), (x["joint"] <= BATTERY_LIMIT).alias("random"),
    )


def battery(found: Column, ordinary: Ordinary) -> Column:
    """Windows with their place, length class and encoding, the three scores, and the joint statistic of the plain battery."""
    counted = F.transform(F.transform(F.transform(found, _inferred), _read), lambda x: _counts(x, ordinary))
    return F.transform(counted, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), x["n"].alias("n"),
        _scores(x, ordinary).alias("z"), _plain_battery(x).alias("joint"),
    ))


def scan(docs: DataFrame, text_col: str = "text", ordinary: Ordinary | None = None) -> DataFrame:
    """``docs`` with ``secret_base``, the sorted spans of the fixed patterns, and ``secret_candidates``, judged windows.

    Row by row, no shuffle, once ``ordinary`` is learned by :func:`prose`, here if not given. Null texts count as empty;
    positions are code points of the whole text. Time is linear in the text: long stretches are tested in windows.
    """
    ordinary = ordinary or prose(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_located(text, ASSIGN, 2), lambda x: F.length(x["group2"]) >= ASSIGN_VALUE_CHARS)
    base = F.array_sort(F.concat(_spans(assign, "assign"), _spans(_located(text, ACCESS), "access"), _spans(_located(text, HEX), "hex")))
    apart = F.filter(
        F.col("secret_found"),
        lambda x: ~F.exists(F.col("secret_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    out = docs.withColumn("secret_base", base).withColumn("secret_found", _located(text, CANDIDATE))
    judged = F.transform(battery(apart, ordinary), lambda x: _judged(x, ordinary))
    return out.withColumn("secret_candidates", judged).drop("secret_found")


def discovery_thresholds(scanned: DataFrame) -> dict[str, int]:
    """Least p-value bin per stratum that the Benjamini-Hochberg rule admits, over all windows of all rows.

    Windows are counted per stratum and bin before the shuffle: at most ``8 * 6 * (MAX_BIN + 1)`` rows, whatever the
    input; the driver gets one row per stratum.
    """
    one = scanned.select(F.explode("secret_candidates").alias("c"))
    counts = one.groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("stratum")
    found = counts.select("stratum", "bin", F.sum("n").over(down).alias("above"), F.sum("n").over(whole).alias("all"))
    passed = found.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= FALSE_DISCOVERY_RATE * F.col("above") / F.col("all"))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def spans(thresholds: dict[str, int]) -> Column:
    """All spans of a scanned row, by start and then kind: the base ones and the random windows that the thresholds admit.

    Windows of one long stretch that follow each other make one span.
    """
    if not thresholds:
        return F.col("secret_base")
    limits = F.create_map(*[F.lit(v) for pair in sorted(thresholds.items()) for v in pair])
    found = F.filter("secret_candidates", lambda x: x["bin"] >= F.coalesce(limits[x["stratum"]], F.lit(MAX_BIN + 1)))
    starts, ends = F.transform(found, lambda x: x["start"]), F.transform(found, lambda x: x["end"])
    # a window that begins where one ends opens no span, one that ends where one begins closes none
    opens, closes = F.array_sort(F.array_except(starts, ends)), F.array_sort(F.array_except(ends, starts))
    joined_up = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.array_sort(F.concat(F.col("secret_base"), _spans(joined_up, "random")))


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda k: (k == kind).cast("int")


def find(scanned: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """A scanned table with the counts per base kind, the digest of the base spans, and all spans."""
    base = F.col("secret_base")
    of = F.transform(base, lambda s: s["kind"])
    count = {k: F.size(F.array_remove(F.transform(of, _is(i)), 0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])}
    return scanned.select(
        *[F.col(f"`{c}`") for c in scanned.columns], *count.values(),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans(thresholds)).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``MARK``; overlapping spans are replaced together. Keeps rows and columns.

    Three passes over the texts: one counts words for the ordinary letters, one counts windows for the false-discovery
    control, one replaces. A column ``n_chars`` follows the new text.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    ordinary = prose(texts)
    limits = discovery_thresholds(scan(texts, ordinary=ordinary))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    redacted = F.aggregate(F.col("spans"), begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    marked = scan(whole, ordinary=ordinary).withColumn("spans", spans(limits)).withColumn("clean", F.when(F.size("spans") > 0, redacted).otherwise(text))
    columns = []
    for field in docs.schema:
        old = F.col("row")[field.name]
        new = F.col("clean") if field.name == text_col else F.length("clean").cast(field.dataType) if field.name == "n_chars" else None
        columns.append((F.when(F.size("spans") > 0, new).otherwise(old) if new is not None else old).alias(field.name))
    return marked.select(*columns)
