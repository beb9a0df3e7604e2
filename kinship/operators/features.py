"""Features of candidate pairs: string similarities and structure (A), exact and IDF overlap (B), competition within an entity (C).

Records carry the columns of functions.text.normalize and record_columns. Pairs carry the candidate union's columns. Columns of a
pair's records come as s_* and t_*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import similarities

GROUP_A = [
    "name_token_set", "name_token_sort", "name_ratio", "name_jaro", "name_cos", "addr_token_set", "addr_token_sort", "addr_ratio", "addr_jaro", "addr_cos",
    "nums_token_set", "nums_exact", "nums_both_present", "name_len_ratio", "addr_len_ratio", "name_tok_diff", "addr_tok_diff", "tgt_is_s3", "tgt_name_non_ascii", "tgt_addr_non_ascii",
]
GROUP_B = [
    "exact_name_norm", "exact_addr_norm", "exact_both_norm", "exact_name_block", "exact_addr_block", "name_jaccard", "addr_jaccard", "name_idf_jaccard", "addr_idf_jaccard",
    "name_idf_coverage", "addr_idf_coverage", "name_max_shared_idf", "addr_max_shared_idf",
]
GROUP_C = ["rank_name", "rank_addr", "rank_comb", "marg_name", "marg_addr", "marg_comb", "rel_name", "rel_addr", "n_cands", "share_comb"]
FEATURES = GROUP_A + GROUP_B + GROUP_C
TEXT = ["name_norm", "addr_norm", "name_block", "addr_block", "addr_nums"]
RECORD = [*TEXT, "name_len", "addr_len", "name_tokens", "addr_tokens", "is_s3", "name_non_ascii", "addr_non_ascii"]


def with_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with s_* and t_* of the given record columns."""
    for df, name, p in ((s1, "s1_id", "s"), (targets, "tgt_id", "t")):
        side = df.select(F.col("entity_id").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in columns))
        pairs = pairs.join(side, name)
    return pairs


def token_idf(targets: DataFrame, field: str) -> DataFrame:
    """(country, token, df, idf): ln(N / (1 + df)) + 1 over the distinct tokens of the target records of a country, N all of them."""
    tokens = targets.select("country", F.explode(F.array_distinct(F.filter(F.split(field, " "), lambda t: t != ""))).alias("token"))
    n = targets.groupBy("country").agg(F.count("*").alias("n"))
    df = tokens.groupBy("country", "token").agg(F.count("*").alias("df")).join(n, "country")
    return df.select("country", "token", "df", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))


def idf_arrays(records: DataFrame, idf: DataFrame, field: str, name: str) -> DataFrame:
    """records with an array of (token, idf) of the field's distinct tokens, sorted by token; 1 for tokens that the targets lack."""
    tokens = records.select("country", "entity_id", F.explode(F.array_distinct(F.filter(F.split(field, " "), lambda t: t != ""))).alias("token"))
    tokens = tokens.join(idf.select("country", "token", "idf"), ["country", "token"], "left")
    arrays = tokens.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("idf")))).alias(name))
    return records.join(arrays, "entity_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<token:string,idf:double>>")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["idf"])


def overlap(pairs: DataFrame, *fields: str) -> DataFrame:
    """pairs with the token-overlap features of fields (name, addr), from arrays of distinct (token, idf) in s_*_idf and t_*_idf. The
    common tokens are worked out once; what both sides have together follows from them."""
    for p in fields:
        s, t = F.col(f"s_{p}_idf"), F.col(f"t_{p}_idf")
        pairs = pairs.withColumn("_both", F.array_intersect(s, t)).withColumns({"_shared": _total(F.col("_both")), "_mine": _total(s), "_n": F.size(s) + F.size(t) - F.size("_both")})
        union = F.col("_mine") + _total(t) - F.col("_shared")
        pairs = pairs.withColumns(
            {
                f"{p}_jaccard": F.when(F.col("_n") > 0, F.size("_both") / F.col("_n")).otherwise(0.0),
                f"{p}_idf_jaccard": F.when(union > 0, F.col("_shared") / union).otherwise(0.0),
                f"{p}_idf_coverage": F.when(F.col("_mine") > 0, F.col("_shared") / F.col("_mine")).otherwise(0.0),
                f"{p}_max_shared_idf": F.coalesce(F.array_max(F.transform("_both", lambda x: x["idf"])), F.lit(0.0)),
            }
        ).drop("_both", "_shared", "_mine", "_n")
    return pairs


def _same(c: str) -> Column:
    return ((F.col(f"s_{c}") == F.col(f"t_{c}")) & (F.col(f"s_{c}") != "")).cast("double")


def exact_flags() -> dict[str, Column]:
    out = {f"exact_{f}_{k}": _same(f"{f}_{k}") for k in ("norm", "block") for f in ("name", "addr")}
    return out | {"exact_both_norm": _same("name_norm") * _same("addr_norm")}


def jaccard(field: str) -> Column:
    """Jaccard of distinct tokens, 0 if there are none."""
    side = lambda p: F.filter(F.split(f"{p}_{field}", " "), lambda t: t != "")
    n = F.size(F.array_union(side("s"), side("t")))
    return F.when(n > 0, F.size(F.array_intersect(side("s"), side("t"))) / n).otherwise(0.0)


def word_ids(text: Column) -> Column:
    """64 bits of each distinct word."""
    return F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: F.xxhash64(t)))


def jaccards_of_ids(pairs: DataFrame, *fields: str) -> DataFrame:
    """pairs with jaccard(f"{p}_norm") as *_jaccard, from word_ids in s_*_words and t_*_words."""
    for p in fields:
        pairs = pairs.withColumn("_both", F.size(F.array_intersect(f"s_{p}_words", f"t_{p}_words"))).withColumn("_n", F.size(f"s_{p}_words") + F.size(f"t_{p}_words") - F.col("_both"))
        pairs = pairs.withColumn(f"{p}_jaccard", F.when(F.col("_n") > 0, F.col("_both") / F.col("_n")).otherwise(0.0)).drop("_both", "_n")
    return pairs


def _ratio(c: str) -> Column:
    high = F.greatest(f"s_{c}", f"t_{c}")
    return F.when(high > 0, F.least(f"s_{c}", f"t_{c}") / high).otherwise(0.0)


def structure() -> dict[str, Column]:
    present = ((F.col("s_addr_nums") != "") & (F.col("t_addr_nums") != "")).cast("double")
    return {
        "nums_exact": _same("addr_nums"),
        "nums_both_present": present,
        "name_len_ratio": _ratio("name_len"),
        "addr_len_ratio": _ratio("addr_len"),
        "name_tok_diff": F.abs(F.col("s_name_tokens") - F.col("t_name_tokens")).cast("double"),
        "addr_tok_diff": F.abs(F.col("s_addr_tokens") - F.col("t_addr_tokens")).cast("double"),
        "tgt_is_s3": F.col("t_is_s3"),
        "tgt_name_non_ascii": F.col("t_name_non_ascii").cast("double"),
        "tgt_addr_non_ascii": F.col("t_addr_non_ascii").cast("double"),
    }


def string_scores(pairs: DataFrame) -> DataFrame:
    """pairs with the similarities of names, addresses and numbers; each distinct pair of strings of a batch is compared once."""
    pairs = pairs.withColumns({"_n": similarities(F.col("s_name_norm"), F.col("t_name_norm")), "_a": similarities(F.col("s_addr_norm"), F.col("t_addr_norm")), "_d": similarities(F.col("s_addr_nums"), F.col("t_addr_nums"), ("token_set",))})
    out = {f"{p}_{k}": F.col(f"_{p[0]}.{k}") for p in ("name", "addr") for k in ("token_set", "token_sort", "ratio", "jaro")}
    return pairs.withColumns(out | {"nums_token_set": F.col("_d.token_set")}).drop("_n", "_a", "_d")


def competition(pairs: DataFrame) -> DataFrame:
    """pairs with group C. Ranks start at 0, ties by target id; a best cosine counts as 0 at least."""
    w = Window.partitionBy("country", "s1_id")
    comb = F.col("name_cos") + F.col("addr_cos")
    x = {"name": F.col("name_cos"), "addr": F.col("addr_cos"), "comb": comb}
    rank = lambda c: F.row_number().over(w.orderBy(F.round(c, 6).desc(), "tgt_id")) - 1
    best = {k: F.greatest(F.max(c).over(w), F.lit(0.0)) for k, c in x.items()}
    out = {f"rank_{k}": rank(c).cast("double") for k, c in x.items()}
    out |= {f"marg_{k}": c - best[k] for k, c in x.items()}
    out |= {f"rel_{k}": x[k] / F.greatest(best[k], F.lit(1e-6)) for k in ("name", "addr")}
    out |= {"n_cands": F.count("*").over(w).cast("double"), "share_comb": comb / F.greatest(F.sum(comb).over(w), F.lit(1e-6))}
    return pairs.withColumns(out)


def pair_features(cands: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(country, s1_id, tgt_id, the 43 FEATURES) of each candidate; records are normalised and have record_columns."""
    pairs = competition(cands)
    records = []
    for df in (s1, targets):
        for f in ("name", "addr"):
            df = idf_arrays(df, token_idf(targets, f"{f}_norm"), f"{f}_norm", f"{f}_idf")
        records.append(df)
    pairs = with_records(pairs, *records, [*RECORD, "name_idf", "addr_idf"])
    pairs = overlap(pairs.withColumns(exact_flags() | structure()), "name", "addr")
    return string_scores(pairs).select("country", "s1_id", "tgt_id", *FEATURES)


def idf_overlap(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs (country, s1_id, tgt_id) with the eight token-overlap features."""
    records = []
    for df in (s1, targets):
        for f in ("name", "addr"):
            df = idf_arrays(df, token_idf(targets, f"{f}_norm"), f"{f}_norm", f"{f}_idf")
        records.append(df)
    return overlap(with_records(pairs, *records, ["name_idf", "addr_idf"]), "name", "addr")
