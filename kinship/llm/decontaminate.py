"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

#: What stands between words, in text whose A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text whose A-Z alone are lower-cased; null has none."""
    return _split(F.translate(text, UPPER, LOWER))


def loose_words(text: Column) -> Column:
    """As words(), with all letters lower-cased, which is faster. Each word here is a fold of the word at the same place there: equal
    words stay equal, so this can propose matches but not prove them."""
    return _split(folded(text))


def folded(text: Column) -> Column:
    """Lower case that does not depend on what stands beside a letter, as that of a final sigma does."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _shingles(w: Column, k: int) -> Column:
    """Hashes of the k consecutive words that begin at each position; none where fewer are left."""
    tails = [F.slice(w, i + 1, F.greatest(F.size(w) - (k - 1), F.lit(0))) for i in range(k)]
    if k == 1:
        return F.transform(w, lambda x: F.xxhash64(x))
    if k == 2:
        return F.zip_with(tails[0], tails[1], lambda a, b: F.xxhash64(a, b))
    pairs = F.zip_with(tails[0], tails[1], lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, tails[2], lambda a, b: F.xxhash64(a, b))


def windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window, k): each run of size words of an item, the whole item where it has fewer, and the shingle length k, 3 or
    the window's length if that is less. Items without words give none; equal windows of an item count once."""
    w = F.col("w")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.slice(w, i, size))
    return (
        items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.explode(runs).alias("window"))
        .distinct()
        .withColumn("k", F.least(F.lit(3), F.size("window")))
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 13,
    min_share: tuple[int, int] = (1, 20),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """For each row of docs: doc_id, key, n_words, n_hit, n_items, item_ids, contaminated.

    A window of an item (size consecutive words; the whole item if shorter) is contained in a document if its words occur there in
    a row. Containment needs every shingle of the window, so one necessary token is enough as the prefix: the window's rarest
    shingle in the corpus. Documents meet the index of these by an equi-join on the shingle's hash; the position of the shingle in
    the window gives where the window would have to begin and end, which must lie in the document; then all words of that
    item-sized window are compared. n_hit counts the document's words in any window found; a document is contaminated if n_hit > 0
    and n_hit / n_words is min_share at least.

    Null or empty texts have no words, and hit nothing. Each row is judged by itself, also if ids repeat or are null; an item_id
    that repeats joins its rows' windows, a null item_id counts for n_hit but is no item of item_ids. An empty items table
    leaves every document clean. Other columns of docs are not read. key is a hash of id and text.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("key", row_key("doc_id", "text"))
    index = stored(windows(items, size, item_id, item_text), "windows")
    lengths = sorted(r[0] for r in index.select("k").distinct().collect())  # three at most

    # All shingles of the benchmark, by hash of the folded words.
    low = F.transform("window", folded)
    shingled = None
    for k in lengths:
        part = index.where(F.col("k") == k).select("item_id", "window", F.posexplode(_shingles(low, k)).alias("at", "h"))
        shingled = part if shingled is None else shingled.unionByName(part)
    if shingled is None:
        hits = None
    else:
        shingled = stored(shingled, "shingles")
        wanted = stored(shingled.select("h").distinct(), "wanted")
        # One pass over the corpus: where do shingles of the benchmark occur at all?
        w = docs.select("key", loose_words(F.col("text")).alias("w"))
        found = None
        for k in lengths:
            part = w.select("key", F.posexplode(_shingles(F.col("w"), k)).alias("pos", "h"))
            found = part if found is None else found.unionByName(part)
        hits = stored(found.join(wanted, "h", "left_semi"), "hits")
    if hits is None:
        found = docs.limit(0).select("key", F.lit(None).cast("array<struct<at:int, item_id:string, window:array<string>>>").alias("starts"))
    else:
        # The rarest shingle of each window; its frequency is counted over all documents.
        often = hits.groupBy("h").agg(F.count("*").alias("n"))
        rare = (
            shingled.join(often, "h", "left")
            .groupBy("item_id", "window")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("r"))
            .where("r.n > 0")
            .select("item_id", "window", "r.h", F.col("r.at").alias("off"))
        )
        rare = stored(rare, "prefix")
        # Few windows share a rarest shingle; they go along as one array, so that a hit stays one row.
        by_shingle = stored(rare.groupBy("h").agg(F.collect_list(F.struct("off", "item_id", "window")).alias("wins")), "index")
        found = (
            hits.join(by_shingle, "h")
            .select("key", F.explode(F.transform("wins", lambda x: F.struct((F.col("pos") - x.off).alias("at"), x.item_id.alias("item_id"), x.window.alias("window")))).alias("c"))
            .where("c.at >= 0")
            .groupBy("key")
            .agg(F.collect_set("c").alias("starts"))
        )
    both = docs.join(stored(found, "candidates"), "key", "left")
    exact = F.when(F.col("starts").isNotNull(), words(F.col("text"))).otherwise(loose_words(F.col("text")))
    both = both.select("doc_id", "key", "starts", exact.alias("w"))
    # Length bound, then the words themselves.
    kept = F.filter(
        F.coalesce("starts", F.array()),
        lambda c: (c["at"] + F.size(c["window"]) <= F.size("w")) & (F.slice("w", c["at"] + 1, F.size(c["window"])) == c["window"]),
    )
    both = both.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), kept.alias("ok"))
    spans = F.array_sort(F.array_distinct(F.transform("ok", lambda c: F.struct(c["at"].alias("a"), (c["at"] + F.size(c["window"])).alias("b")))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).cast("long").alias("n"),
            F.greatest(s["to"], x["b"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("ok", lambda c: c["item_id"]), lambda i: i.isNotNull())))
    out = both.select("doc_id", "key", "n_words", covered.alias("n_hit"), ids.alias("item_ids"))
    up, down = min_share
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * down >= F.col("n_words") * up)
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", dirty)


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; docs must have doc_id and text."""
    bad = decontaminate(docs, items, size, min_share).where("contaminated").select("key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"))
    return keyed.join(stored(bad, "contaminated"), "key", "left_anti").select("row.*")
