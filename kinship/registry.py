"""The library's named queries over the supplied tables, and the SQL that each must agree with."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DecideConfig, LinkConfig
from .functions.strings import similarities
from .operators import blocking, decide, diagnostics, features, metric, model, validate
from .oracles import ORACLES
from .plans import view
from .sources import sinks, tsv
from .storage import stored

CFG = LinkConfig()
WHOLE = replace(CFG, max_group=None)
THRESHOLD, GATE = 0.5, 0.9


def _six(*names: str) -> list[Column]:
    """To six places, no negative zeros. Rounding a double is slow, and many are 0."""
    return [F.when(F.col(n) == 0, 0.0).otherwise(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


#: What the query that runs has stored so far, by name.
_run: ContextVar[dict | None] = ContextVar("run", default=None)


def _once(name: str, make: Callable):
    made = _run.get()
    if made is None:
        return make()
    if name not in made:
        made[name] = make()
    return made[name]


def _records(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, targets), normalised and stored: most queries read them several times."""

    def make():
        r = stored(view.all_records(spark, d), "records")
        mine = F.col("entity_id").startswith("S1-")
        return r.where(mine), r.where(~mine)

    return _once("records", make)


def _keys(spark, d: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, targets) with the column key alone, stored: a query that reads no other need not have the rest normalised."""

    def make():
        r = stored(view.all_records(spark, d).select("country", "entity_id", key), "keys")
        mine = F.col("entity_id").startswith("S1-")
        return r.where(mine), r.where(~mine)

    return _once(f"records {key}", make)


def _union(spark, d: str) -> DataFrame:
    """Candidates, not stored: each query reads them once, and often few of their columns."""
    return blocking.candidate_union(*_records(spark, d), CFG)


def _exact(spark, d: str) -> DataFrame:
    """Pairs of equal name or address key."""
    s1, t = _records(spark, d)
    return blocking.exact_pairs(s1, t, "name_block", CFG).unionByName(blocking.exact_pairs(s1, t, "addr_block", CFG)).distinct()


def _scored(spark, d: str) -> DataFrame:
    """(country, s1_id, tgt_id, p): pairs of equal key, p half the sum of both Jaccards to six places."""
    s1, t = _records(spark, d)
    pairs = features.with_records(_exact(spark, d), s1, t, ["name_norm", "addr_norm"])
    return pairs.select("country", "s1_id", "tgt_id", F.round((features.jaccard("name_norm") + features.jaccard("addr_norm")) / 2, 6).alias("p"))


def _selected(spark, d: str) -> DataFrame:
    return decide.select(_scored(spark, d), DecideConfig(THRESHOLD))


def _with(spark, d: str, columns: list[str]) -> DataFrame:
    return features.with_records(_exact(spark, d), *_records(spark, d), columns)


def er_source_view(spark, d):
    return view.source_view(spark, d)


def er_discover_countries(spark, d):
    return tsv.discover_countries(view.source_view(spark, d))


def er_partition_counts(spark, d):
    return view.source_view(spark, d).groupBy("country", F.substring("entity_id", 1, 2).alias("source")).agg(F.count("*").alias("n"))


def _records_all(spark, d):
    s1, t = view.records(spark, d)
    return s1.unionByName(t)


def norm_name(spark, d):
    return _records_all(spark, d).select("entity_id", "name_norm")


def norm_address(spark, d):
    return _records_all(spark, d).select("entity_id", "addr_norm")


def block_key_name(spark, d):
    return _records_all(spark, d).select("entity_id", "name_block")


def block_key_address(spark, d):
    return _records_all(spark, d).select("entity_id", "addr_block")


def addr_numeric_tokens(spark, d):
    return _records_all(spark, d).select("entity_id", "addr_nums")


def non_ascii_flags(spark, d):
    return _records_all(spark, d).select("entity_id", "name_non_ascii", "addr_non_ascii")


def record_lengths(spark, d):
    return _records_all(spark, d).select("entity_id", "name_len", "addr_len", "name_tokens", "addr_tokens", "is_s3")


def exact_key_candidates_name(spark, d):
    return blocking.exact_pairs(*_records(spark, d), "name_block", CFG)


def exact_key_candidates_addr(spark, d):
    return blocking.exact_pairs(*_records(spark, d), "addr_block", CFG)


def token_idf_name(spark, d):
    return features.token_idf(_records(spark, d)[1], "name_norm").select("country", "token", "df", *_six("idf"))


def token_idf_addr(spark, d):
    return features.token_idf(_records(spark, d)[1], "addr_norm").select("country", "token", "df", *_six("idf"))


def trigram_df(spark, d):
    t = _records(spark, d)[1]
    return blocking.vocabulary(blocking.term_counts(t, blocking.char_grams(F.col("name_block"), 3)), t, CFG.min_df, CFG.max_df).select("country", "gram", "df", *_six("idf"))


def _pairs_cos(df):
    return df.select("country", "s1_id", "tgt_id", F.col("six").alias("cos"))


def tfidf_cosine_topk_name(spark, d):
    return _pairs_cos(blocking.name_blocker(*_keys(spark, d, "name_block"), CFG))


def tfidf_cosine_topk_addr(spark, d):
    return _pairs_cos(blocking.addr_blocker(*_keys(spark, d, "addr_block"), CFG))


def tfidf_cosine_topk_nums(spark, d):
    return _pairs_cos(blocking.num_blocker(*_keys(spark, d, "addr_nums"), CFG))


def reverse_topk(spark, d):
    s1, t = _keys(spark, d, "name_block")
    r = blocking.name_blocker(t, s1, CFG)
    return r.select("country", F.col("s1_id").alias("target_id"), F.col("tgt_id").alias("source_id"), F.col("six").alias("cos"))


def candidate_union(spark, d):
    return _union(spark, d).select("country", "s1_id", "tgt_id", *_six("name_cos", "addr_cos", "num_cos"))


def blocking_stats(spark, d):
    return blocking.blocking_stats(_union(spark, d), *_records(spark, d)).select("country", "n_s1", "n_targets", "n_cands", "empty_rows", *_six("mean_per_entity", "reduction_ratio"))


def recall_ceiling(spark, d):
    return blocking.recall_ceiling(_union(spark, d), view.truth(spark, d)).select("n_truth", "n_found", *_six("recall"))


def blocker_attribution(spark, d):
    return blocking.attribution(_union(spark, d), view.truth(spark, d))


def candidate_percentiles(spark, d):
    return blocking.candidate_percentiles(_union(spark, d), _records(spark, d)[0]).select("country", *_six("p50", "p95", "p99"), "most")


def prune_stage(spark, d):
    return blocking.pruned(_union(spark, d), 10).select("country", "s1_id", "tgt_id")


def labelled_candidates(spark, d):
    return blocking.labelled(_exact(spark, d), view.truth(spark, d)).select("s1_id", "tgt_id", "label")


def pair_jaccard(spark, d):
    return _with(spark, d, ["name_norm", "addr_norm"]).select("s1_id", "tgt_id", F.round(features.jaccard("name_norm"), 6).alias("name_jaccard"), F.round(features.jaccard("addr_norm"), 6).alias("addr_jaccard"))


def pair_exact_flags(spark, d):
    return _with(spark, d, ["name_norm", "addr_norm", "name_block", "addr_block"]).select("s1_id", "tgt_id", *(c.alias(k) for k, c in features.exact_flags().items()))


def pair_structural(spark, d):
    return _with(spark, d, features.RECORD).select("s1_id", "tgt_id", *(F.round(c, 6).alias(k) for k, c in features.structure().items()))


def pair_idf_overlap(spark, d):
    names = [f"{p}_{k}" for p in ("name", "addr") for k in ("jaccard", "idf_jaccard", "idf_coverage", "max_shared_idf")]
    return features.idf_overlap(_exact(spark, d), *_records(spark, d)).select("s1_id", "tgt_id", *_six(*names))


def pair_jaro_winkler(spark, d):
    p = _with(spark, d, ["addr_norm"]).where("s_addr_norm <> '' and t_addr_norm <> ''")
    return p.select("s1_id", "tgt_id", F.round(similarities(F.col("s_addr_norm"), F.col("t_addr_norm"), ("jaro",))["jaro"], 6).alias("addr_jaro"))


def pair_string_scores(spark, d):
    p = features.string_scores(_with(spark, d, features.TEXT))
    return p.select("s1_id", "tgt_id", *_six("name_ratio", "name_token_sort", "name_token_set", "addr_ratio", "addr_token_sort", "addr_token_set", "nums_token_set"))


def pair_features(spark, d):
    s1, t = _records(spark, d)
    return features.pair_features(_union(spark, d), s1, t).select("country", "s1_id", "tgt_id", *_six(*features.FEATURES))


def competition_features(spark, d):
    return features.competition(_union(spark, d)).select("s1_id", "tgt_id", *_six(*features.GROUP_C))


def share_sums_to_one(spark, d):
    c = features.competition(_union(spark, d))
    return c.groupBy("s1_id").agg(F.round(F.sum("share_comb"), 6).alias("total"), F.max((F.col("name_cos") + F.col("addr_cos") > 0).cast("int")).alias("any_cos"))


def rule_score_select(spark, d):
    return _selected(spark, d).select("country", "s1_id", "tgt_id", "p")


def exclusivity_winners(spark, d):
    return decide.exclusive(_scored(spark, d)).select("s1_id", "tgt_id", "p")


def singleton_gate(spark, d):
    return decide.select(_scored(spark, d), DecideConfig(THRESHOLD, GATE)).select("s1_id", "tgt_id", "p")


def threshold_sweep(spark, d):
    return decide.sweep(_scored(spark, d), view.truth(spark, d), _records(spark, d)[0]).select("threshold", *_six("macro_f05"))


def best_threshold(spark, d):
    return decide.best_threshold(decide.sweep(_scored(spark, d), view.truth(spark, d), _records(spark, d)[0])).select("threshold", *_six("macro_f05"))


def threshold_report(spark, d):
    return decide.threshold_report(_scored(spark, d), _records(spark, d)[0]).select("threshold", *_six("empty_share", "mean_size"), "total")


def set_sizes(spark, d):
    return decide.set_sizes(_selected(spark, d), _records(spark, d)[0]).select("entities", "empty", "total", *_six("mean_size"))


def _judged(f):
    return lambda spark, d: f(_selected(spark, d), view.truth(spark, d), _records(spark, d)[0])


def entity_f05(spark, d):
    return _judged(metric.entity_scores)(spark, d).select("s1_id", "n_pred", "n_true", "n_hit", *_six("f"))


def macro_f05(spark, d):
    return _judged(metric.macro_f_beta)(spark, d).select(*_six("macro_f"))


def score_breakdown(spark, d):
    return _judged(metric.breakdown)(spark, d).select("singleton_n", "non_singleton_n", *_six("macro_f", "singleton_mean", "non_singleton_mean", "singleton_part", "non_singleton_part", "singleton_share"))


def f05_by_cardinality(spark, d):
    return _judged(metric.by_cardinality)(spark, d).select("bucket", "n", *_six("mean_f"))


def _lines(pairs, s1):
    return sinks.id_lists(pairs, s1).select(F.concat_ws("\t", "s1_id", F.array_join("ids", ",")).alias("line"))


def matching_results_lists(spark, d):
    return _lines(_selected(spark, d), _records(spark, d)[0])


def candidate_lists(spark, d):
    return _lines(_exact(spark, d), _records(spark, d)[0])


def _dirty(spark, d):
    """Id lists with what writers must clean: for each source-1 document a list made of its neighbours' numbers."""
    i = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    ids = F.array(F.concat(F.lit("S3-"), (i + 1).cast("string")), F.concat(F.lit(" S2-"), i.cast("string"), F.lit(" ")), F.concat(F.lit("S2-"), (i - i % 2).cast("string")), F.when(i % 3 == 0, F.concat(F.lit("S1-"), i.cast("string"))).otherwise(""), F.when(i % 5 == 0, F.lit("X-1")).otherwise("S3-1"))
    return _records(spark, d)[0].select(F.col("entity_id").alias("s1_id"), ids.alias("ids"))


def clean_id_list(spark, d):
    return sinks.cleaned(_dirty(spark, d)).select("s1_id", F.array_join("ids", ",").alias("ids"), "duplicate_in_list", "self_match", "bad_prefix")


def validator_findings(spark, d):
    s1, t = _records(spark, d)
    i = F.regexp_extract("s1_id", r"(\d+)$", 1).cast("long")
    lines = _dirty(spark, d).where(i % 7 != 0).select(F.when(i % 11 == 0, F.col("s1_id")).otherwise(F.concat_ws("\t", "s1_id", F.array_join("ids", ","))).alias("value"))
    return validate.findings(lines, s1, t)


def subset_violations(spark, d):
    s1, t = _records(spark, d)
    return sinks.subset_violations(_exact(spark, d), blocking.exact_pairs(s1, t, "addr_block", CFG))


def merge_coverage(spark, d):
    lists = sinks.id_lists(_exact(spark, d), _records(spark, d)[0])
    i = F.regexp_extract("s1_id", r"(\d+)$", 1).cast("long")
    parts = lists.where(i % 4 != 0).unionByName(lists.where(i % 6 == 1)).unionByName(lists.where(i % 9 == 0).withColumn("s1_id", F.concat("s1_id", F.lit("x"))))
    return sinks.coverage(parts, _records(spark, d)[0])


def entity_group_split(spark, d):
    return model.group_split(_records(spark, d)[0], 0.25, 42)


def _train_pairs(spark, d, cfg=CFG):
    s1, t = _records(spark, d)
    cands = blocking.labelled(blocking.candidate_union(s1, t, cfg), view.truth(spark, d))
    w = features.with_records(features.competition(cands), s1, t, features.RECORD)
    w = w.withColumns(features.exact_flags() | features.structure() | {"name_jaccard": features.jaccard("name_norm"), "addr_jaccard": features.jaccard("addr_norm")})
    return stored(w.select("s1_id", "tgt_id", "label", *_COLUMNS), "training")  # training reads its rows many times


def _all_train_pairs(spark, d):
    """The rows of _train_pairs without a bound on exact keys, whose pairs may be many more than all others: these get what depends on
    texts where their records meet, and pairs are shuffled once, without texts."""
    ids = view.text_ids(spark, d)
    key = lambda c: F.when(F.col(c) != "", F.xxhash64(c))
    s1, t = (r.join(ids, "entity_id", "left").withColumns({"name_key": key("name_block"), "addr_key": key("addr_block")}) for r in _records(spark, d))
    fixed = ["name_len", "addr_len", "name_key", "addr_key", "text_id"]
    same = lambda c: F.coalesce(F.col(f"s_{c}") == F.col(f"t_{c}"), F.lit(False))
    told = {f"{p}_len_ratio": features.structure()[f"{p}_len_ratio"] for p in ("name", "addr")} | {f"exact_{p}_block": same(f"{p}_key").cast("double") for p in ("name", "addr")} | {"label": same("text_id").cast("int")}

    def cosines(df, name):
        cos = {f"{p}_cos": F.col("cos") if p == name else F.lit(None).cast("double") for p in ("name", "addr")}
        return df.select("country", "s1_id", "tgt_id", *(c.alias(k) for k, c in cos.items()))

    near = cosines(blocking.name_blocker(s1, t, WHOLE), "name").unionByName(cosines(blocking.addr_blocker(s1, t, WHOLE), "addr"))
    near = features.with_records(near, s1, t, ["name_norm", "addr_norm", *fixed]).withColumns(told | {f"{p}_jaccard": features.jaccard(f"{p}_norm") for p in ("name", "addr")})
    own = ["name_jaccard", "addr_jaccard", *told]
    rows = near.select("country", "s1_id", "tgt_id", "name_cos", "addr_cos", *own)
    words = {f"{p}_words": features.word_ids(F.col(f"{p}_norm")) for p in ("name", "addr")}
    for k in ("name_block", "addr_block"):
        met = blocking.exact_meetings(s1.withColumns(words), t.withColumns(words), k, [*words, *fixed], WHOLE)
        met = features.jaccards_of_ids(met, "name", "addr").withColumns(told)
        rows = rows.unionByName(met.select("country", "s1_id", "tgt_id", *own), allowMissingColumns=True)
    cos = [F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("name_cos", "addr_cos")]
    pairs = rows.repartition("country", "s1_id").groupBy("country", "s1_id", "tgt_id").agg(*cos, *(F.max(c).alias(c) for c in own))
    return stored(features.competition(pairs).select("s1_id", "tgt_id", "label", *_COLUMNS), "training")


_COLUMNS = ["name_cos", "addr_cos", "name_jaccard", "addr_jaccard", "name_len_ratio", "addr_len_ratio", "exact_name_block", "exact_addr_block", "rank_comb", "marg_comb", "share_comb"]


def gbt_scores(spark, d):
    data = _train_pairs(spark, d)
    fitted = model.train(data, model.group_split(_records(spark, d)[0]), _COLUMNS, iterations=8, depth=4)
    return model.predict(fitted, data).select("s1_id", "tgt_id", "label", *_six("p"))


def feature_importance(spark, d):
    data = _all_train_pairs(spark, d)
    return model.importances(spark, model.train(data, None, _COLUMNS, iterations=8, depth=4), _COLUMNS).select("feature", *_six("gain_percent"))


def calibration_table(spark, d):
    return model.calibration(blocking.labelled(_scored(spark, d), view.truth(spark, d))).select("bin", "n", *_six("mean_p", "positive_rate"))


def prefix_policies(spark, d):
    return diagnostics.prefix_policies(_scored(spark, d), THRESHOLD)


def fn_decomposition(spark, d):
    return diagnostics.lost_pairs(view.truth(spark, d), _exact(spark, d), _selected(spark, d))


def mined_rewrites(spark, d):
    p = _with(spark, d, ["addr_norm"])
    tokens = lambda s: F.array_distinct(F.filter(F.split(f"{s}_addr_norm", " "), lambda x: x != "")).alias(f"{s}_tokens")
    return diagnostics.mined_rewrites(p.select(tokens("s"), tokens("t")), 1, 0.3).select("t_token", "s_token", "n", *_six("confidence"))


def reject_by_quintile(spark, d):
    s1, t = _records(spark, d)
    p = features.with_records(_scored(spark, d), s1, t, ["name_len"]).withColumn("x", F.col("t_name_len").cast("double"))
    return diagnostics.reject_rate_by_quantile(p, "x", THRESHOLD).select("part", "n", *_six("reject_rate"))


QUERIES = [
    er_source_view, er_discover_countries, er_partition_counts, norm_name, norm_address, block_key_name, block_key_address, addr_numeric_tokens, non_ascii_flags, record_lengths,
    exact_key_candidates_name, exact_key_candidates_addr, token_idf_name, token_idf_addr, trigram_df, tfidf_cosine_topk_name, tfidf_cosine_topk_addr, tfidf_cosine_topk_nums, reverse_topk,
    candidate_union, blocking_stats, recall_ceiling, blocker_attribution, candidate_percentiles, prune_stage, labelled_candidates, pair_jaccard, pair_exact_flags, pair_structural, pair_idf_overlap,
    pair_jaro_winkler, pair_string_scores, pair_features, competition_features, share_sums_to_one, rule_score_select, exclusivity_winners, singleton_gate, threshold_sweep, best_threshold,
    threshold_report, set_sizes, entity_f05, macro_f05, score_breakdown, f05_by_cardinality, matching_results_lists, candidate_lists, clean_id_list, validator_findings, subset_violations,
    merge_coverage, entity_group_split, gbt_scores, feature_importance, calibration_table, prefix_policies, fn_decomposition, mined_rewrites, reject_by_quintile,
]


def _alone(f: Callable) -> Callable:
    """f with tables of its own, each stored once."""

    @functools.wraps(f)
    def run(spark, d):
        token = _run.set({})
        try:
            return f(spark, d)
        finally:
            _run.reset(token)

    return run


def queries() -> dict:
    return {f.__name__: _alone(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
