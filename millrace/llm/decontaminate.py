"""Benchmark decontamination (operator 8), DataFrame functions only: a distributed positional inverted index over the training texts.

The texts are read and cut into words once. Of every benchmark term the index stores its postings (row, place), and of every row its number of words. Terms are then known by how
often they occur. Items are looked for by their rarest terms: the postings of these, less the term's place in the item, are intersected on cells of neighbouring diagonals; what
at least two different places share is looked up in full, with the postings of all terms of the item in that row and cell.

A run of WINDOW consecutive item words on one diagonal (of all words of a shorter item) is an exact phrase. An exact window shares its two rarest terms with the text, so its cell is found.
A proximity match of an item: NEAR_PERCENT of SPAN consecutive item words (of all words of a shorter item) are in the text, each within the same SLOP neighbouring diagonals, wherever these
begin. If so, at least two of the span's rarest terms are there, when so many are looked for as may be missing, and two more; so every such match is found, too.

Items are cut into segments of SEGMENT words that overlap by a window, so no row holds a long item. Dictionary, probes and positions are broadcast while they are few (common.bounded)
and dealt by a shuffle beyond that; there is one pass over the texts however large the benchmark is.
Null and empty texts have no words; each input row is judged on its own, repeated ids too; items without words match nothing; empty tables give no rows. Columns of docs other than doc_id and
text aren't read, so their names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, bounded, stage, unstage

WINDOW, SLOP, SPAN, NEAR_PERCENT, SEGMENT = 10, 8, 20, 80, 256
#: What stands between words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(ascii_lower(t))
    return F.array_remove(F.split(low, SEPARATOR), "")


def segments(benchmark: DataFrame, window: int) -> DataFrame:
    """seg, item_key, item_id, words, need (the length of an exact window), span and near (words of a span, and how many of them make a match). Each window and span is inside a segment."""
    over = max(window, SPAN) - 1
    size = F.size("item")
    items = benchmark.select(F.monotonically_increasing_id().alias("item_key"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item")).where(size > 0)
    cut = items.select("item_key", "item_id", "item", F.explode(F.sequence(F.lit(0), F.greatest(size - over - 1, F.lit(0)), F.lit(max(SEGMENT, 2 * over) - over))).alias("from"))
    span = F.least(size, F.lit(SPAN))
    return cut.select(F.monotonically_increasing_id().alias("seg"), "item_key", "item_id", F.slice("item", F.col("from") + 1, F.lit(max(SEGMENT, 2 * over))).alias("words"),
                      F.least(size, F.lit(window)).alias("need"), span.alias("span"), F.ceil(span * NEAR_PERCENT / 100).cast("int").alias("near"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row, at, tid, doc_id: the postings of the terms. One more row for each text, with tid -1, has its doc_id, and its number of words as at."""
    end = docs.sparkSession.createDataFrame([("", -1)], "term string, tid bigint")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("words"))  # numbered before the words are dealt out
    each = rows.select("row", "doc_id", F.posexplode("words").alias("at", "term"))
    hit = each.join(bounded(terms.unionByName(end)), "term")
    return hit.select("row", "at", "tid", F.when(F.col("tid") < 0, F.col("doc_id")).alias("doc_id"))


def probes(places: DataFrame) -> DataFrame:
    """seg, p, tid, least: the places whose postings are intersected, and how many different ones of a segment must meet. places: seg, p, tid, n, size, need, span, near.

    Of each exact window the two rarest; of each span as many of the rarest as may be missing, and two more. Terms that no text has can't be met; a window with one, or a span with too many, is passed over.
    """
    ahead = lambda k: Window.partitionBy("seg").orderBy("p").rowsBetween(0, k - 1)
    size = F.col("size")
    starts = lambda k: (F.col("p") + k <= size) | ((F.col("p") == 0) & (size < k))
    rank = F.struct("n", "p", "tid")
    keep = ("seg", "p", "size", "need", "span", "near")
    longest = places.agg(F.max("need")).first()[0] or 1
    window = places.select(*keep, F.array_sort(F.collect_list(rank).over(ahead(longest))).alias("all")).where(starts(longest) & (F.element_at("all", 1)["n"] > 0)).select("seg", "size", F.explode(F.slice("all", 1, 2)).alias("best"))
    missing = F.col("span") - F.col("near")
    spans = places.select(*keep, F.array_sort(F.collect_list(rank).over(ahead(SPAN))).alias("all")).where(starts(SPAN))
    absent = F.size(F.filter("all", lambda x: x["n"] == 0))
    near = spans.where(absent <= missing).select("seg", "size", F.explode(F.slice("all", F.lit(1), missing + 2)).alias("best")).where("best.n > 0")
    return window.unionByName(near).select("seg", F.col("best.p").alias("p"), F.col("best.tid").alias("tid"), F.least(size, F.lit(2)).alias("least")).distinct()


def cells(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, seg, cell: where enough places of the probes meet. Cell c is the diagonals (place in the text less place in the segment) from c * SLOP on, 2 * SLOP of them, so any SLOP neighbouring ones are inside one."""
    d = F.col("at") - F.col("p")
    hits = index.join(bounded(wanted), "tid").select("row", "seg", "p", "least", F.floor(d / SLOP).cast("int").alias("c"))
    both = hits.select("row", "seg", "p", "least", F.explode(F.array(F.col("c"), F.col("c") - 1)).alias("cell"))
    return both.groupBy("row", "seg", "cell").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.min("least").alias("least")).where((F.col("least") == 1) | (F.col("lo") < F.col("hi"))).select("row", "seg", "cell")


def matched(index: DataFrame, found: DataFrame, places: DataFrame) -> DataFrame:
    """row, seg, cell, p, d: all words of the segments that are in the text on a cell's diagonals."""
    d = F.col("at") - F.col("p")
    there = index.where("tid >= 0").select("row", "at", "tid").join(bounded(found), "row").join(bounded(places.select("seg", "p", "tid")), ["seg", "tid"])
    return there.where((d >= F.col("cell") * SLOP) & (d < (F.col("cell") + 2) * SLOP)).select("row", "seg", "cell", "p", d.alias("d"))


def phrases(words_there: DataFrame, segs: DataFrame) -> DataFrame:
    """row, item_id, start, end (exclusive): runs of item words at least as long as a window. Of a diagonal's two cells the first counts."""
    one = words_there.where(F.floor(F.col("d") / SLOP) == F.col("cell"))
    run = F.col("p") - F.row_number().over(Window.partitionBy("row", "seg", "d").orderBy("p"))
    runs = one.withColumn("run", run).groupBy("row", "seg", "d", "run").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return runs.join(bounded(segs.select("seg", "item_id", "need")), "seg").where(F.col("n") >= F.col("need")).select("row", "item_id", (F.col("d") + F.col("p")).alias("start"), (F.col("d") + F.col("p") + F.col("n")).alias("end"))


def proximity(words_there: DataFrame, segs: DataFrame) -> DataFrame:
    """row, item_key of each proximity match."""
    about = bounded(segs.select("seg", "item_key", "span", "near"))
    enough = words_there.groupBy("row", "seg", "cell").agg(F.countDistinct("p").alias("n")).join(about, "seg").where(F.col("n") >= F.col("near")).select("row", "seg", "cell", "item_key", "span", "near")
    first, last = F.greatest(F.col("cell") * SLOP, F.col("d") - SLOP + 1), F.least((F.col("cell") + 1) * SLOP - 1, F.col("d"))
    bands = words_there.join(enough, ["row", "seg", "cell"]).where(first <= last).select("row", "item_key", "seg", "span", "near", "p", F.explode(F.sequence(first, last)).alias("low"))
    by_band = bands.groupBy("row", "item_key", "seg", "span", "near", "low").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") >= F.col("near"))
    dense = F.exists(F.sequence(F.lit(0), F.size("ps") - F.col("near")), lambda k: F.get("ps", k + F.col("near") - 1) - F.get("ps", k) < F.col("span"))
    return by_band.where(dense).select("row", "item_key").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), n_near (items with a proximity match) of each row of docs."""
    segs = stage(segments(benchmark, window), "decontaminate-segments")
    each = segs.select("seg", F.size("words").alias("size"), "need", "span", "near", F.posexplode("words").alias("p", "term"))
    terms = stage(each.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "decontaminate-terms")
    index = stage(build_index(docs.select("doc_id", "text"), terms), "decontaminate-index")
    counts = index.where("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(counts, "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0)).alias("n"))
    places = stage(each.join(known, "term").drop("term"), "decontaminate-places")
    found = stage(cells(index, stage(probes(places), "decontaminate-probes")), "decontaminate-cells")
    there = stage(matched(index, found, places), "decontaminate-matched")
    exact = stage(phrases(there, segs), "decontaminate-phrases")
    close = stage(proximity(there, segs), "decontaminate-near")
    unstage(terms, places, found, there, segs)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = exact.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"), F.collect_set("item_id").alias("items"))
    near = close.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    texts = index.where("tid < 0").select("row", "doc_id", F.col("at").cast("bigint").alias("n_words"))
    return texts.join(hits, "row", "left").join(near, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
