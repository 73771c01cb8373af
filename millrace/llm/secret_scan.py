"""Secret scan (operator 1), DataFrame functions only: keyword, access-key and hex findings, and beside them tokens that a battery of randomness tests calls random.

Battery, for each run of 20 or more token characters, with the alphabet of its inferred encoding (hex, base32, letters, base62, base64): chi-squared uniformity of the alphabet, runs, serial
correlation. Both hypotheses are tested. Against randomness, all three: a token passes if none rejects it (Bonferroni, level ALPHA). Against text, as the null hypothesis of the
false-discovery control, those that tell the two apart: the chi-squared statistic where letters repeat as in text (its linear form, the chance that two letters are equal), and the
number of runs of lower case, upper case and digits; the lesser p value counts (Bonferroni). Benjamini-Hochberg within classes of length and over all rows sets the p value needed, so which
random tokens are reported follows from the whole table; the base spans of a text follow from the text alone. The classes' histograms (4 x 301 rows at most) are all that reaches the driver.

Spans are in code points, their end exclusive. A random span is what base spans leave of a token. Work grows as n to the power 1.5 at most with the findings of one text (prefix()).
Null and empty texts have no findings; repeated rows give repeated results; an empty table gives no rows; of docs only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

# The base patterns and the least lengths of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

TOKEN, MIN_TOKEN = r"[A-Za-z0-9+/_=-]{20,}", 20
ALPHA, FDR, BINS = 0.003, 0.01, 300
#: Of text, as the null hypothesis: chance that two letters are equal, that three are, and that the class of character changes from one to the next.
REPEAT2, REPEAT3, CHANGES = 0.066, 0.0066, 0.05
CLASSES = [32, 64, 128]
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def prefix(values: Column) -> Column:
    """Sums of the elements before each one. In two levels, blocks of about the square root, as an array that grows by one is copied each time."""
    grow = lambda first: F.struct(first.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    run = lambda xs, first: F.aggregate(xs, grow(first), add, lambda acc: acc["out"])
    size = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))), F.lit(1)).cast("int")
    cut = lambda v: F.when(F.size(v) > 0, let(size(v), lambda n: F.transform(F.sequence(F.lit(1), F.size(v), n), lambda k: F.slice(v, k, n)))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    return let(values, lambda v: let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, run(F.transform(blocks, total), F.lit(0)), run))))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches: the lengths of what stands between them and of themselves, added up."""
    p = F.lit(pattern)
    sized = lambda hits: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len")))
    start = lambda m: m["before"] + m["x"]["gap"]
    parts = lambda x, hits: F.arrays_zip(x.alias("x"), prefix(F.transform(x, lambda y: y["gap"] + y["len"])).alias("before"), (hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))).alias("value"))
    found = lambda x, hits: F.transform(parts(x, hits), lambda m: F.struct(start(m).alias("start"), (start(m) + m["x"]["len"]).alias("end"), m["value"].alias("value")))
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda hits: let(sized(hits), lambda x: found(x, hits)))


def found(text: Column, kind: str, pattern: str, group: int, least: int, has: str) -> Column:
    """Spans of one kind; texts without the pattern `has` are passed over."""
    hits = F.filter(located(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(has), spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    return F.concat(found(text, "assign", ASSIGN, 1, 6, r"(?i)(?:passw|secret|token|api_?key)"), found(text, "access", ACCESS, 0, 20, "AKIA"), found(text, "hex", HEX, 0, 24, HEX))


def normal_cdf(z: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -1.5976 * z - 0.07056 * z * z * z))))


def two_sided(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))


def battery(tokens: Column) -> Column:
    """From located tokens to array<struct<start, end, n, random, p_text>>, in steps so that each value is computed once."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def letters(t: Column) -> Column:
        v = t["value"]
        k = (F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(v.rlike("^[A-Z2-7]+=*$"), 32).when(v.rlike("^(?:[a-z]+|[A-Z]+)$"), 26).when(v.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64))
        places = F.when(k == 16, F.lit("0123456789abcdef")).when(k == 32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=")).when(k == 26, F.lit("abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(BASE64))
        body = F.when(k.isin(16, 26), F.lower(v)).otherwise(v)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), body.alias("v"), v.alias("raw"), k.cast("double").alias("k"), F.length(v).cast("double").alias("n"), places.alias("places"),
                        F.filter(F.split(body, ""), lambda c: c != "").alias("chars"))

    def numbers(t: Column) -> Column:
        x = F.transform(t["chars"], lambda c: F.instr(t["places"], c).cast("double"))
        counts = F.transform(F.array_distinct(t["chars"]), lambda c: F.pow(t["n"] - F.length(F.replace(t["v"], c, F.lit(""))), F.lit(2.0)))
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t["raw"], "[^A-Za-z0-9]", ""), "[a-z]", "~"), "[A-Z]", "^"), "[0-9]", "#")
        same = F.length(kinds) - F.length(F.regexp_replace(kinds, r"(.)(?=\1)", ""))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["k"].alias("k"), t["n"].alias("n"), x.alias("x"), total(counts).alias("ss"),
                        F.greatest(F.length(kinds) - 1, F.lit(1)).cast("double").alias("pairs"), F.greatest(F.length(kinds) - 1 - same, F.lit(0)).cast("double").alias("changes"))

    def centred(t: Column) -> Column:
        mean = total(t["x"]) / t["n"]
        return F.struct(*(t[c].alias(c) for c in ("start", "end", "k", "n", "ss", "pairs", "changes")), F.transform(t["x"], lambda x: x > t["k"] / 2).alias("high"), t["x"].alias("x"), mean.alias("mean"))

    def tests(t: Column) -> Column:
        n, k = t["n"], t["k"]
        df = k - 1
        chi = k * t["ss"] / n - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        m = (n - 1).cast("int")
        pairs = lambda a, f: total(F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(2), m), f))
        runs = 1 + pairs(t["high"], lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        up = total(F.transform(t["high"], lambda h: F.when(h, 1.0).otherwise(0.0)))
        want = 2 * up * (n - up) / n + 1
        z_runs = (runs - want) / F.sqrt(F.greatest((want - 1) * (want - 2) / (n - 1), F.lit(0.01)))
        square = total(F.transform(t["x"], lambda x: F.pow(x - t["mean"], F.lit(2.0))))
        z_serial = pairs(t["x"], lambda a, b: (a - t["mean"]) * (b - t["mean"])) / F.greatest(square, F.lit(1e-9)) * F.sqrt(n)
        same = (t["ss"] - n) / (n * (n - 1))
        sd = F.sqrt(2 / (n * (n - 1)) * REPEAT2 * (1 - REPEAT2) + 4 * (n - 2) / (n * (n - 1)) * (REPEAT3 - REPEAT2**2))
        z_change = (t["changes"] - 0.5 - CHANGES * t["pairs"]) / F.sqrt(t["pairs"] * CHANGES * (1 - CHANGES))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), n.cast("int").alias("n"),
                        (F.least(normal_cdf(-z_chi), two_sided(z_runs), two_sided(z_serial)) * 3 >= ALPHA).alias("random"),
                        F.least(F.lit(1.0), 2 * F.least(normal_cdf((same - REPEAT2) / sd), normal_cdf(-z_change))).alias("p_text"))

    for step in (letters, numbers, centred, tests):
        tokens = F.transform(tokens, step)
    return tokens


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for c in CLASSES:
        out = out + F.when(n >= c, 1).otherwise(0)
    return out


def thresholds(histogram: list[tuple[int, int, int]], q: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg from counts by (length class, tenths of -log10 p): the least bin of each class that is kept; none if no bin will do."""
    out: dict[int, int] = {}
    for c in {h[0] for h in histogram}:
        bins = sorted(((b, n) for k, b, n in histogram if k == c), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if 10 ** (-b / 10) * total / above <= q:
                out[c] = b
    return out


def pieces(tokens: Column, base: Column, kind: int = 3) -> Column:
    """What base spans leave of tokens (both arrays of structs with start and end), as spans of a kind. Between any two neighbouring ends of tokens and spans all is the same,
    so it is enough to count how many of each are open there."""
    ends = lambda xs, t, b: F.flatten(F.transform(xs, lambda x: F.array(F.struct(x["start"].alias("at"), F.lit(t).alias("t"), F.lit(b).alias("b")), F.struct(x["end"].alias("at"), F.lit(-t).alias("t"), F.lit(-b).alias("b")))))
    opened = lambda marks: F.arrays_zip(marks.alias("m"), prefix(F.transform(marks, lambda m: m["t"])).alias("t"), prefix(F.transform(marks, lambda m: m["b"])).alias("b"))
    # prefix() stops before the mark itself: what is open after mark k is what is open before mark k + 1
    pair = lambda x, y: F.struct(x["m"]["at"].alias("start"), y["m"]["at"].alias("end"), (y["t"] > 0).alias("t"), (y["b"] == 0).alias("free"))
    pairs = lambda o: F.when(F.size(o) > 1, F.zip_with(F.slice(o, F.lit(1), F.size(o) - 1), F.slice(o, F.lit(2), F.size(o) - 1), pair))
    left = F.filter(let(let(F.array_sort(F.concat(ends(tokens, 1, 0), ends(base, 0, 1))), opened), pairs), lambda x: x["t"] & x["free"] & (x["start"] < x["end"]))
    spans = F.transform(left, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.coalesce(F.when(F.size(tokens) > 0, spans), F.array()).cast(f"array<{SPAN}>")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and the arrays base and spans of (start, kind, end), sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.when(text.rlike(TOKEN), located(text, TOKEN)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))
    marked = F.transform(battery(tokens), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["random"].alias("random"), length_class(t["n"]).alias("class"),
        F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(t["p_text"], F.lit(1e-30))))).cast("int").alias("bin")))
    rows = stage(docs.select("doc_id", base_spans(text).alias("base"), marked.alias("tokens")), "secret-scan")
    bins = rows.select(F.explode("tokens").alias("t")).groupBy(F.col("t.class").alias("c"), F.col("t.bin").alias("b")).count().collect()
    needed = thresholds([tuple(r) for r in bins])
    enough = lambda t: F.coalesce(*[F.when(t["class"] == c, t["bin"] >= b) for c, b in sorted(needed.items())], F.lit(False))
    extra = pieces(F.filter("tokens", lambda t: t["random"] & enough(t)), F.col("base"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.array_sort("base").alias("base"),
                       F.array_sort(F.concat("base", extra.cast(f"array<{SPAN}>"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


#: Code points in a piece of a text: a place in a piece is found from the piece's start.
PIECE = 1024


def redact(text: Column, spans: Column) -> Column:
    """The text with each of the (sorted) spans replaced by [SECRET:kind]; of overlapping ones the first counts, and what sticks out of it goes too. Spans that meet without overlap stay two."""
    names = F.array(*map(F.lit, KINDS))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text."""
        of = lambda k: F.substring(F.get(chunks, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), of), "")).otherwise("")

    # a span is new if no span before it is open at its start; groups of overlapping spans have the first one's kind
    ends = F.flatten(F.transform(spans, lambda x: F.array(F.struct(x["start"].alias("at"), F.lit(1).alias("d"), x["kind"].alias("kind")), F.struct(x["end"].alias("at"), F.lit(-1).alias("d"), F.lit(9).alias("kind")))))
    opened = lambda marks: F.arrays_zip(marks.alias("m"), prefix(F.transform(marks, lambda m: m["d"])).alias("open"))
    borders = F.filter(let(F.array_sort(ends), opened), lambda x: F.when(x["m"]["d"] > 0, x["open"] == 0).otherwise(x["open"] == 1))  # starts and ends of the groups by turns; ends come first at one place

    def write(bs: Column, chunks: Column) -> Column:
        n = F.size(bs)
        at = lambda k: F.get(bs, k)["m"]["at"]
        mark = lambda k: F.concat(between(chunks, F.when(k > 0, at(k - 1)).otherwise(0), at(k)), F.lit("[SECRET:"), F.element_at(names, F.get(bs, k)["m"]["kind"] + 1), F.lit("]"))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), mark), ""), between(chunks, at(n - 1), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(borders, lambda bs: let(cut, lambda chunks: write(bs, chunks)))).otherwise(text)
