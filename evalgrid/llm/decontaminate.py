"""Benchmark decontamination by a prefix-filtered set join. Only DataFrame functions are used.

An item's windows (WINDOW consecutive words; a shorter item is one window) are sets of shingles of up
to SHINGLE words. A window occurs in a text only if each of its shingles does, so one shingle is
prefix enough to find it: the rarest in the corpus. The join on it meets the fewest places of all.
Bounds on place and length then say where the window would have to lie, and there its words are
compared one by one: nothing is lost, and no hash decides.

1. One pass over the texts marks the places whose shingle may be one of the benchmark's, by a Bloom
   filter of about 32 bits a shingle and at most 2^MOST_BITS bits (a fuller filter passes more, never
   less), and writes them with the words around them.
2. Their counts order the shingles by rarity; a window with an unseen shingle occurs nowhere.
3. The places of the rarest shingles are joined with their windows. Shingles with more than one
   HOT-th of all places, at most HOT of them, are dealt over SALTS parts.
4. Words hit are the joined lengths of overlapping occurrences, per document by its start order.

Defined results: a null or empty text has no words, an item without words no window; items are named
by item_id, so repeated rows of benchmark count once, and a null id counts as one item with an empty
name; equal rows of documents each get a row; only A-Z is lower-cased.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.session import cut_lineage

# Fixed value: what is no letter, digit or character beyond ASCII separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
MOST_BITS = 22
HOT = 1000
SALTS = 32


def words(text: Column) -> Column:
    """Array of a text's words, A-Z in lower case."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BETWEEN), "")


def _pairs(left: Column, right: Column, by: int) -> Column:
    """Hash of each element of `left` with the element of `right` that is `by` places on."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """Adds _s<w>, the hashes of all stretches of w words of `_w`, for each width asked for. A width
    is a doubling of half of it, or its largest power of two and the same one `w - power` places on."""
    need = set(widths)
    for w in range(max(widths), 1, -1):
        if w in need:
            need.add(1 << (w - 1).bit_length() - 1)
    kept = df.columns
    out = df.select(*kept, F.transform("_w", lambda x: F.xxhash64(x)).alias("_s1")) if need else df
    for w in sorted(need - {1}):
        half = 1 << (w - 1).bit_length() - 1
        by, before = w - half, out.columns
        out = out.select(*before, _pairs(F.col(f"_s{half}"), F.col(f"_s{half}"), by).alias(f"_s{w}"))
    return out.select(*kept, *[f"_s{w}" for w in widths])


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Windows once each (win, words, size, and their shingles as array of offset, width, h) and which
    item has which (win, item). `win` is the window's words joined by spaces."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i, window))).alias("words"))
    named = cut_lineage(cut.select("item", "words", F.array_join("words", " ").alias("win")).distinct())
    once = named.select("win", F.col("words").alias("_w")).distinct()
    hashed = _shingles(once, list(range(1, shingle + 1)))
    size = F.size("_w")

    def listed(w: int) -> Column:
        return F.transform(f"_s{w}", lambda h, i: F.struct(i.alias("offset"), F.lit(w).alias("width"), h.alias("h")))

    own = [listed(w) for w in range(1, shingle + 1)]
    fit = reduce(lambda rest, w: F.when(F.least(size, F.lit(shingle)) == w, own[w - 1]).otherwise(rest), range(1, shingle), own[shingle - 1])
    return hashed.select("win", F.col("_w").alias("words"), size.alias("size"), fit.alias("shingles")), named.select("win", "item")


def _bits(h: Column, bits: int) -> list[Column]:
    """Two places of a hash in a filter of 2^bits bits."""
    low = F.lit((1 << bits) - 1)
    return [h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low)]


def shingle_filter(shingles: DataFrame, most: int = MOST_BITS) -> tuple[int, Column]:
    """Bloom filter over column h: its bits as a power of two, and as a literal of 64-bit cells. It is
    all that the driver sees of the benchmark: 512 KB at most."""
    bits = min(most, max(12, (32 * shingles.select("h").distinct().count()).bit_length()))
    at = F.explode(F.array(*_bits(F.col("h"), bits))).alias("at")
    cells = shingles.select(at).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = [0] * (1 << bits - 6)
    for r in cells.collect():
        table[r["cell"]] = r["bits"]
    return bits, F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # one literal: folded by the planner


def _marked(docs: DataFrame, keep: list[Column], shingles: DataFrame, window: int, shingle: int) -> DataFrame:
    """`keep` columns, _row, n_words and places (array of place, width, h and the words around) of each
    document; null where it has none. Written."""
    widths = [r["width"] for r in shingles.select("width").distinct().orderBy("width").collect()]
    rows = docs.select(*keep, words(F.col("text")).alias("_w"))
    kept = rows.columns[:-1]
    if not widths:
        nothing = F.lit(None).cast("array<struct<place:int,width:int,h:bigint,around:array<string>>>")
        return cut_lineage(rows.select(*kept, F.monotonically_increasing_id().alias("_row"), F.size("_w").cast("long").alias("n_words"), nothing.alias("places")))
    bits, table = shingle_filter(shingles)
    cell = lambda at: F.element_at(table, (F.shiftright(at, 6) + 1).cast("int"))
    bit = lambda at: F.getbit(cell(at), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    seen = lambda h: reduce(lambda a, b: a & b, [bit(at) for at in _bits(h, bits)])
    rows = _shingles(rows, widths)
    rows = rows.select("*", reduce(lambda a, b: a | b, [F.exists(f"_s{w}", seen) for w in widths]).alias("_some"))
    from_ = lambda i: F.greatest(i - (window - 1), F.lit(0))

    def places(w: int) -> Column:
        around = lambda i: F.slice(F.col("_w"), from_(i) + 1, F.lit(2 * window))
        numbered = F.filter(F.transform(f"_s{w}", lambda h, i: F.struct(i.alias("place"), F.lit(w).alias("width"), h.alias("h"))), lambda x: seen(x["h"]))
        return F.transform(numbered, lambda x: F.struct(x["place"], x["width"], x["h"], around(x["place"]).alias("around")))

    found = F.when(F.col("_some"), F.concat(*[places(w) for w in widths]))
    return cut_lineage(rows.select(*kept, F.monotonically_increasing_id().alias("_row"), F.size("_w").cast("long").alias("n_words"), found.alias("places")))


def _salted(counts: DataFrame) -> dict[int, int]:
    """The shingles with more than one HOT-th of all places."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["h"] for r in counts.where(F.col("n") * HOT > total).collect()}


def occurrences(marked: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_row, win, start, size) of each occurrence of a window, words numbered from 0."""
    places = marked.where(F.col("places").isNotNull()).select("_row", "n_words", F.explode("places").alias("p")).select("_row", "n_words", "p.*")
    counts = cut_lineage(places.groupBy("h", "width").agg(F.count(F.lit(1)).alias("n")))
    hot = F.array(*[F.lit(h) for h in sorted(_salted(counts))]).cast("array<bigint>")
    each = windows.select("win", "words", "size", F.explode("shingles").alias("s")).select("win", "words", "size", "s.*")
    rated = each.join(counts, ["h", "width"], "left")
    rarest = F.min(F.struct("n", "h", "offset", "width", "words", "size"))
    prefix = rated.groupBy("win").agg(rarest.alias("r"), F.count("n").alias("seen"), F.count(F.lit(1)).alias("all"))
    prefix = prefix.where("seen = all").select("win", "r.h", "r.width", "r.offset", "r.words", "r.size")
    salts = F.when(F.array_contains(hot, F.col("h")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    prefix = cut_lineage(prefix.withColumn("salt", F.explode(salts)))
    salt = F.when(F.array_contains(hot, F.col("h")), F.pmod(F.xxhash64("_row", "place"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    met = places.withColumn("salt", salt).join(prefix, ["h", "width", "salt"])
    start = F.col("place") - F.col("offset")
    met = met.withColumn("start", start).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    first = F.greatest(F.col("place") - (window - 1), F.lit(0))
    same = F.slice("around", F.col("start") - first + 1, F.col("size")) == F.col("words")
    return met.where(same).select("_row", "win", "start", "size")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[Column], window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """`keep` columns, n_words, n_hit (words inside occurrences of windows), items (sorted array of the
    ids, as strings, of items with occurring windows) and spans (array of start and end, in words, of
    the joined occurrences) of each document."""
    windows, members = item_windows(benchmark, window, shingle)
    windows = cut_lineage(windows)
    marked = _marked(docs, keep, windows.select(F.explode("shingles").alias("s")).select("s.h", "s.width"), window, shingle)
    found = cut_lineage(occurrences(marked, windows, window))
    by = Window.partitionBy("_row").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.select("_row", "start", end.alias("end"), (before.isNull() | (before < F.col("start"))).cast("int").alias("new"))
    spans = opened.withColumn("span", F.sum("new").over(Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_row", "span").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    hits = spans.groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = found.select("_row", "win").distinct().join(members, "win").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    kept = [c for c in marked.columns if c not in ("_row", "places", "n_words")]
    out = marked.drop("places").join(hits.join(items, "_row"), "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
