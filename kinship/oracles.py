"""DuckDB SQL for the library's queries, put together from common table expressions."""

from __future__ import annotations

from .config import LinkConfig
from .functions.text import ABBREVIATIONS, ACCENTS, LEGAL_SUFFIXES
from .operators.decide import GRID, REPORT

CFG = LinkConfig()


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _folded(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    single = {k: v for k, v in ACCENTS.items() if len(v) == 1}
    out = f"translate({out}, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in ACCENTS.items():
        if len(v) > 1:
            out = f"replace({out}, '{k}', '{v}')"
    out = f"replace({out}, '&', ' and ')"
    out = f"translate({out}, '''’ʼ`', '')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s]+|_', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _parts(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


_SUFFIXES = "[" + ", ".join(f"'{t}'" for t in LEGAL_SUFFIXES) + "]"
_SIZE = "CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END"

#: Table expressions by name, each with those that it needs.
PARTS: dict[str, tuple[list[str], str]] = {}


def _part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


_part("src", [], r"""
  SELECT lang AS country, 'S' || n || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS business_name, array_to_string(w[7:26], ' ') AS business_address
  FROM (SELECT doc_id, lang, CAST(substr(source, 4) AS INTEGER) % 3 + 1 AS n, regexp_split_to_array(trim(coalesce(text, '')), '[ \t\n\r\f]+') AS w FROM documents)""")
_part("rec0", ["src"], f"SELECT *, {_folded('business_name')} AS name_norm, {_folded('business_address')} AS addr_raw FROM src")
_part("rec1", ["rec0"], f"""
  SELECT *, array_to_string(list_transform(string_split(addr_raw, ' '), lambda t: coalesce({_map(ABBREVIATIONS)}[t], t)), ' ') AS addr_norm,
         list_filter(string_split(name_norm, ' '), lambda t: t <> '' AND NOT list_contains({_SUFFIXES}, t)) AS kept FROM rec0""")
_part("rec", ["rec1"], rf"""
  SELECT country, entity_id, business_name, business_address, name_norm, addr_norm,
         CASE WHEN len(kept) = 0 THEN name_norm ELSE array_to_string(list_sort(kept), ' ') END AS name_block,
         coalesce(array_to_string(list_sort({_parts('addr_norm')}), ' '), '') AS addr_block,
         coalesce(array_to_string(list_sort(regexp_extract_all(business_address, '\d+')), ' '), '') AS addr_nums,
         regexp_matches(business_name, '[^\x00-\x7F]') AS name_non_ascii, regexp_matches(business_address, '[^\x00-\x7F]') AS addr_non_ascii FROM rec1""")
_part("full_rec", ["rec"], f"""
  SELECT *, length(name_norm) AS name_len, length(addr_norm) AS addr_len, {_SIZE.format(c='name_norm')} AS name_tokens, {_SIZE.format(c='addr_norm')} AS addr_tokens,
         CASE WHEN entity_id LIKE 'S3-%' THEN 1.0 ELSE 0.0 END AS is_s3 FROM rec""")
_part("s1", ["full_rec"], "SELECT * FROM full_rec WHERE entity_id LIKE 'S1-%'")
_part("tg", ["full_rec"], "SELECT * FROM full_rec WHERE entity_id NOT LIKE 'S1-%'")
_part("truth", [], """
  SELECT DISTINCT 'S1-' || a.doc_id AS s1_id, 'S' || b.n || '-' || b.doc_id AS tgt_id
  FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) % 3 + 1 AS n FROM documents) a JOIN (SELECT *, CAST(substr(source, 4) AS INTEGER) % 3 + 1 AS n FROM documents) b
    ON a.lang = b.lang AND a.text = b.text WHERE a.n = 1 AND b.n <> 1""")


def _exact(name: str, key: str) -> None:
    _part(name, ["s1", "tg"], f"""
  SELECT s.country, s.entity_id AS s1_id, t.entity_id AS tgt_id
  FROM s1 s JOIN (SELECT country, {key} AS key, entity_id, row_number() OVER (PARTITION BY country, {key} ORDER BY entity_id) AS place FROM tg WHERE length({key}) >= {CFG.min_key}) t
    ON s.country = t.country AND s.{key} = t.key WHERE place <= {CFG.max_group}""")


_exact("ex_name", "name_block")
_exact("ex_addr", "addr_block")
_part("ex", ["ex_name", "ex_addr"], "SELECT * FROM ex_name UNION SELECT * FROM ex_addr")


def _grams(column: str, kind: str) -> str:
    if kind == "word":
        return _parts(column)
    padded = f"list_transform({_parts(column)}, lambda w: ' ' || w || ' ')"
    return f"flatten(list_transform({padded}, lambda w: list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substr(w, i, 3))))"


def _cosine(name: str, column: str, kind: str, k: int, least: float, min_df: int, src: str = "s1", tgt: str = "tg") -> None:
    g = _grams(column, kind)
    for side, of in (("s", src), ("t", tgt)):
        _part(f"{name}_{side}tf", [of], f"SELECT country, entity_id AS id, gram, count(*) AS tf FROM (SELECT country, entity_id, unnest({g}) AS gram FROM {of}) GROUP BY ALL")
    _part(f"{name}_voc", [f"{name}_ttf", tgt], f"""
  SELECT d.country, gram, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT country, gram, count(*) AS df FROM {name}_ttf GROUP BY ALL) d JOIN (SELECT country, count(*) AS n FROM {tgt} GROUP BY ALL) c ON d.country = c.country
  WHERE df >= {min_df} AND df <= {CFG.max_df} * n""")
    for side in "st":
        _part(f"{name}_{side}w", [f"{name}_{side}tf", f"{name}_voc"], f"""
  SELECT country, id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY country, id)) AS w
  FROM (SELECT f.country, id, f.gram, tf * idf AS x FROM {name}_{side}tf f JOIN {name}_voc v ON f.country = v.country AND f.gram = v.gram)""")
    _part(name, [f"{name}_sw", f"{name}_tw"], f"""
  SELECT country, s1_id, tgt_id, cos FROM (
    SELECT *, row_number() OVER (PARTITION BY country, s1_id ORDER BY round(cos, 6) DESC, tgt_id) AS place FROM (
      SELECT s.country, s.id AS s1_id, t.id AS tgt_id, sum(s.w * t.w) AS cos FROM {name}_sw s JOIN {name}_tw t ON s.country = t.country AND s.gram = t.gram GROUP BY ALL)
    WHERE round(cos, 6) > {least}) WHERE place <= {k}""")


_cosine("cn", "name_block", "char", CFG.name_top, CFG.name_min, CFG.min_df)
_cosine("ca", "addr_block", "char", CFG.addr_top, CFG.addr_min, CFG.min_df)
_cosine("cd", "addr_nums", "word", CFG.num_top, CFG.num_min, 1)
_cosine("cr", "name_block", "char", CFG.name_top, CFG.name_min, CFG.min_df, "tg", "s1")
_part("cand", ["cn", "ca", "ex_name", "ex_addr"], """
  SELECT country, s1_id, tgt_id, coalesce(max(n), 0.0) AS name_cos, coalesce(max(a), 0.0) AS addr_cos, 0.0::DOUBLE AS num_cos,
         bool_or(b = 'name') AS by_name, bool_or(b = 'addr') AS by_addr, bool_or(b = 'en') AS by_exact_name, bool_or(b = 'ea') AS by_exact_addr
  FROM (SELECT country, s1_id, tgt_id, cos AS n, NULL::DOUBLE AS a, 'name' AS b FROM cn UNION ALL SELECT country, s1_id, tgt_id, NULL, cos, 'addr' FROM ca
        UNION ALL SELECT country, s1_id, tgt_id, NULL, NULL, 'en' FROM ex_name UNION ALL SELECT country, s1_id, tgt_id, NULL, NULL, 'ea' FROM ex_addr) GROUP BY ALL""")


def _join(pairs: str) -> str:
    return f"{pairs} p JOIN s1 s ON p.s1_id = s.entity_id JOIN tg t ON p.tgt_id = t.entity_id"


def _jaccard(c: str) -> str:
    a, b = f"list_distinct({_parts(f's.{c}')})", f"list_distinct({_parts(f't.{c}')})"
    n = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {n} > 0 THEN len(list_intersect({a}, {b})) / {n} ELSE 0.0 END"


_part("scored", ["ex", "s1", "tg"], f"SELECT p.country, s1_id, tgt_id, round(({_jaccard('name_norm')} + {_jaccard('addr_norm')}) / 2, 6) AS p FROM {_join('ex')}")
_part("won", ["scored"], "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) = 1")
_part("sel", ["won"], "SELECT * FROM won WHERE p >= 0.5")


def _f(hit: str, pred: str, true: str) -> str:
    return f"CASE WHEN {pred} = 0 AND {true} = 0 THEN 1.0 WHEN {hit} = 0 THEN 0.0 ELSE 1.25 * ({hit} / {pred}) * ({hit} / {true}) / (0.25 * ({hit} / {pred}) + {hit} / {true}) END"


_part("ent", ["s1", "sel", "truth"], f"""
  SELECT *, {_f('n_hit', 'n_pred', 'n_true')} AS f FROM (
    SELECT entity_id AS s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(n_hit, 0) AS n_hit FROM s1
      LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM sel GROUP BY ALL) a ON a.s1_id = entity_id LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY ALL) b ON b.s1_id = entity_id
      LEFT JOIN (SELECT s1_id, count(*) AS n_hit FROM sel SEMI JOIN truth USING (s1_id, tgt_id) GROUP BY ALL) c ON c.s1_id = entity_id)""")
_part("sweep", ["won", "truth", "s1"], f"""
  SELECT threshold, avg({_f('n_hit', 'n_pred', 'n_true')}) AS macro_f05 FROM (
    SELECT threshold, entity_id, count(w.tgt_id) AS n_pred, count(t.tgt_id) AS n_hit, any_value(coalesce(n_true, 0)) AS n_true
    FROM (SELECT unnest({GRID}::DOUBLE[]) AS threshold) CROSS JOIN s1 LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY ALL) n ON n.s1_id = entity_id
      LEFT JOIN won w ON w.s1_id = entity_id AND w.p >= threshold LEFT JOIN truth t ON t.s1_id = w.s1_id AND t.tgt_id = w.tgt_id GROUP BY threshold, entity_id) GROUP BY threshold""")
_part("comp", ["cand"], """
  SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(name_cos, 6) DESC, tgt_id) - 1 AS DOUBLE) AS rank_name,
    CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(addr_cos, 6) DESC, tgt_id) - 1 AS DOUBLE) AS rank_addr,
    CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(name_cos + addr_cos, 6) DESC, tgt_id) - 1 AS DOUBLE) AS rank_comb,
    name_cos - max(name_cos) OVER w AS marg_name, addr_cos - max(addr_cos) OVER w AS marg_addr, name_cos + addr_cos - max(name_cos + addr_cos) OVER w AS marg_comb,
    name_cos / greatest(max(name_cos) OVER w, 1e-6) AS rel_name, addr_cos / greatest(max(addr_cos) OVER w, 1e-6) AS rel_addr,
    CAST(count(*) OVER w AS DOUBLE) AS n_cands, (name_cos + addr_cos) / greatest(sum(name_cos + addr_cos) OVER w, 1e-6) AS share_comb
  FROM cand WINDOW w AS (PARTITION BY s1_id)""")
for _c in ("name", "addr"):
    _part(f"idf_{_c}", ["tg"], f"""
  SELECT d.country, token, df, ln(n / (1 + df)) + 1 AS idf FROM (SELECT country, token, count(*) AS df FROM (SELECT country, unnest(list_distinct({_parts(_c + '_norm')})) AS token FROM tg) GROUP BY ALL) d
  JOIN (SELECT country, count(*) AS n FROM tg GROUP BY ALL) c ON d.country = c.country""")
    _part(f"tok_{_c}", ["full_rec", f"idf_{_c}"], f"""
  SELECT e.entity_id, e.token, coalesce(i.idf, 1.0) AS idf FROM (SELECT country, entity_id, unnest(list_distinct({_parts(_c + '_norm')})) AS token FROM full_rec) e
  LEFT JOIN idf_{_c} i ON e.country = i.country AND e.token = i.token""")
    _part(f"ov_{_c}", ["ex", f"tok_{_c}"], f"""
  SELECT p.s1_id, p.tgt_id, coalesce(both_n, 0) / greatest(coalesce(s_n, 0) + coalesce(t_n, 0) - coalesce(both_n, 0), 1) AS jaccard,
    CASE WHEN coalesce(s_sum, 0) + coalesce(t_sum, 0) - coalesce(both_sum, 0) > 0 THEN coalesce(both_sum, 0) / (coalesce(s_sum, 0) + coalesce(t_sum, 0) - coalesce(both_sum, 0)) ELSE 0.0 END AS idf_jaccard,
    CASE WHEN coalesce(s_sum, 0) > 0 THEN coalesce(both_sum, 0) / s_sum ELSE 0.0 END AS idf_coverage, coalesce(top, 0.0) AS max_shared_idf
  FROM ex p LEFT JOIN (SELECT entity_id, count(*) AS s_n, sum(idf) AS s_sum FROM tok_{_c} GROUP BY ALL) s ON s.entity_id = p.s1_id
    LEFT JOIN (SELECT entity_id, count(*) AS t_n, sum(idf) AS t_sum FROM tok_{_c} GROUP BY ALL) t ON t.entity_id = p.tgt_id
    LEFT JOIN (SELECT e.s1_id, e.tgt_id, count(*) AS both_n, sum(a.idf) AS both_sum, max(a.idf) AS top FROM ex e JOIN tok_{_c} a ON a.entity_id = e.s1_id
               JOIN tok_{_c} b ON b.entity_id = e.tgt_id AND a.token = b.token GROUP BY ALL) b ON b.s1_id = p.s1_id AND b.tgt_id = p.tgt_id""")


_I = r"CAST(regexp_extract(entity_id, '(\d+)$', 1) AS BIGINT)"
_part("dirty", ["s1"], f"""
  SELECT entity_id AS s1_id, i, ['S3-' || (i + 1), ' S2-' || i || ' ', 'S2-' || (i - i % 2), CASE WHEN i % 3 = 0 THEN 'S1-' || i ELSE '' END, CASE WHEN i % 5 = 0 THEN 'X-1' ELSE 'S3-1' END] AS ids
  FROM (SELECT entity_id, {_I} AS i FROM s1)""")
_part("lists", ["s1", "ex"], """
  SELECT s.entity_id AS s1_id, coalesce(string_agg(tgt_id, ',' ORDER BY tgt_id), '') AS ids FROM s1 s LEFT JOIN ex ON ex.s1_id = s.entity_id GROUP BY ALL""")
_part("merged", ["lists"], rf"""
  SELECT s1_id FROM (SELECT *, CAST(regexp_extract(s1_id, '(\d+)$', 1) AS BIGINT) AS i FROM lists) WHERE i % 4 <> 0 UNION ALL
  SELECT s1_id FROM (SELECT *, CAST(regexp_extract(s1_id, '(\d+)$', 1) AS BIGINT) AS i FROM lists) WHERE i % 6 = 1 UNION ALL
  SELECT s1_id || 'x' FROM (SELECT *, CAST(regexp_extract(s1_id, '(\d+)$', 1) AS BIGINT) AS i FROM lists) WHERE i % 9 = 0""")
_part("vlines", ["dirty"], r"""
  SELECT CASE WHEN i % 11 = 0 THEN s1_id ELSE s1_id || chr(9) || array_to_string(ids, ',') END AS value FROM dirty WHERE i % 7 <> 0""")
_part("vlists", ["vlines"], r"""
  SELECT split_part(value, chr(9), 1) AS s1_id, list_filter(string_split(split_part(value, chr(9), 2), ','), lambda x: x <> '') AS ids FROM vlines WHERE contains(value, chr(9))""")
_part("ranked", ["scored"], """
  SELECT *, row_number() OVER w AS place, first_value(p) OVER w AS first, lag(p) OVER w AS before FROM scored WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, tgt_id)""")


def _query(needs: list[str], sql: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + sql if order else sql


def _six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _flag(c: str) -> str:
    return f"CASE WHEN s.{c} = t.{c} AND s.{c} <> '' THEN 1.0 ELSE 0.0 END"


def _ratio(c: str) -> str:
    return f"CASE WHEN greatest(s.{c}, t.{c}) > 0 THEN least(s.{c}, t.{c}) / greatest(s.{c}, t.{c}) ELSE 0.0 END"


_GROUP_C = ["rank_name", "rank_addr", "rank_comb", "marg_name", "marg_addr", "marg_comb", "rel_name", "rel_addr", "n_cands", "share_comb"]
_UNION = " UNION ALL "
ORACLES = {
    "er_source_view": _query(["src"], "SELECT * FROM src"),
    "er_discover_countries": _query(["src"], "SELECT DISTINCT country FROM src WHERE country <> ''"),
    "er_partition_counts": _query(["src"], "SELECT country, substr(entity_id, 1, 2) AS source, count(*) AS n FROM src GROUP BY ALL"),
    "norm_name": _query(["rec"], "SELECT entity_id, name_norm FROM rec"),
    "norm_address": _query(["rec"], "SELECT entity_id, addr_norm FROM rec"),
    "block_key_name": _query(["rec"], "SELECT entity_id, name_block FROM rec"),
    "block_key_address": _query(["rec"], "SELECT entity_id, addr_block FROM rec"),
    "addr_numeric_tokens": _query(["rec"], "SELECT entity_id, addr_nums FROM rec"),
    "non_ascii_flags": _query(["rec"], "SELECT entity_id, name_non_ascii, addr_non_ascii FROM rec"),
    "record_lengths": _query(["full_rec"], "SELECT entity_id, CAST(name_len AS INTEGER) AS name_len, CAST(addr_len AS INTEGER) AS addr_len, CAST(name_tokens AS INTEGER) AS name_tokens, CAST(addr_tokens AS INTEGER) AS addr_tokens, CAST(is_s3 AS DOUBLE) AS is_s3 FROM full_rec"),
    "exact_key_candidates_name": _query(["ex_name"], "SELECT * FROM ex_name"),
    "exact_key_candidates_addr": _query(["ex_addr"], "SELECT * FROM ex_addr"),
    "token_idf_name": _query(["idf_name"], f"SELECT country, token, df, {_six('idf')} FROM idf_name"),
    "token_idf_addr": _query(["idf_addr"], f"SELECT country, token, df, {_six('idf')} FROM idf_addr"),
    "trigram_df": _query(["cn_voc"], f"SELECT country, gram, df, {_six('idf')} FROM cn_voc"),
    "tfidf_cosine_topk_name": _query(["cn"], f"SELECT country, s1_id, tgt_id, {_six('cos')} FROM cn"),
    "tfidf_cosine_topk_addr": _query(["ca"], f"SELECT country, s1_id, tgt_id, {_six('cos')} FROM ca"),
    "tfidf_cosine_topk_nums": _query(["cd"], f"SELECT country, s1_id, tgt_id, {_six('cos')} FROM cd"),
    "reverse_topk": _query(["cr"], f"SELECT country, s1_id AS target_id, tgt_id AS source_id, {_six('cos')} FROM cr"),
    "candidate_union": _query(["cand"], f"SELECT country, s1_id, tgt_id, {_six('name_cos', 'addr_cos', 'num_cos')} FROM cand"),
    "blocking_stats": _query(["cand", "s1", "tg"], """
SELECT a.country, n_s1, n_targets, n_cands, n_s1 - with_any AS empty_rows, round(n_cands / n_s1, 6) AS mean_per_entity, round(1 - n_cands / (n_s1 * n_targets), 6) AS reduction_ratio
FROM (SELECT country, count(*) AS n_s1 FROM s1 GROUP BY ALL) a JOIN (SELECT country, count(*) AS n_targets FROM tg GROUP BY ALL) b USING (country)
JOIN (SELECT country, count(*) AS n_cands, count(DISTINCT s1_id) AS with_any FROM cand GROUP BY ALL) c USING (country)"""),
    "recall_ceiling": _query(["cand", "truth"], "SELECT count(*) AS n_truth, count(c.s1_id) AS n_found, round(count(c.s1_id) / count(*), 6) AS recall FROM truth LEFT JOIN cand c USING (s1_id, tgt_id)"),
    "blocker_attribution": _query(["cand", "truth"], _UNION.join(
        f"SELECT '{b}' AS blocker, count(*) FILTER (by_{b}) AS found, count(*) FILTER (by_{b} AND CAST(by_name AS INT) + CAST(by_addr AS INT) + CAST(by_exact_name AS INT) + CAST(by_exact_addr AS INT) = 1) AS only FROM cand SEMI JOIN truth USING (s1_id, tgt_id)" for b in ("name", "addr", "exact_name", "exact_addr")) + " UNION ALL SELECT 'num', 0, 0"),
    "candidate_percentiles": _query(["cand", "s1"], """
SELECT country, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most
FROM (SELECT s1.country, entity_id, count(c.tgt_id) AS n FROM s1 LEFT JOIN cand c ON c.s1_id = entity_id GROUP BY ALL) GROUP BY country"""),
    "prune_stage": _query(["cand"], """
SELECT country, s1_id, tgt_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY (by_exact_name OR by_exact_addr) DESC, round(name_cos + addr_cos, 6) DESC, tgt_id) AS place,
  sum(CAST(by_exact_name OR by_exact_addr AS INT)) OVER (PARTITION BY s1_id) AS hits FROM cand) WHERE place <= hits + 10"""),
    "labelled_candidates": _query(["ex", "truth"], "SELECT s1_id, tgt_id, CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM ex LEFT JOIN truth t USING (s1_id, tgt_id)".replace("t.s1_id IS NOT NULL", "t.tgt_id IS NOT NULL")),
    "pair_jaccard": _query(["ex", "s1", "tg"], f"SELECT s1_id, tgt_id, round({_jaccard('name_norm')}, 6) AS name_jaccard, round({_jaccard('addr_norm')}, 6) AS addr_jaccard FROM {_join('ex')}"),
    "pair_exact_flags": _query(["ex", "s1", "tg"], f"SELECT s1_id, tgt_id, " + ", ".join(f"CAST({_flag(f'{f}_{k}')} AS DOUBLE) AS exact_{f}_{k}" for k in ("norm", "block") for f in ("name", "addr")) + f", CAST({_flag('name_norm')} * {_flag('addr_norm')} AS DOUBLE) AS exact_both_norm FROM {_join('ex')}"),
    "pair_structural": _query(["ex", "s1", "tg"], f"""
SELECT s1_id, tgt_id, CAST({_flag('addr_nums')} AS DOUBLE) AS nums_exact, CAST(s.addr_nums <> '' AND t.addr_nums <> '' AS INT)::DOUBLE AS nums_both_present, round(CAST({_ratio('name_len')} AS DOUBLE), 6) AS name_len_ratio,
  round(CAST({_ratio('addr_len')} AS DOUBLE), 6) AS addr_len_ratio, CAST(abs(s.name_tokens - t.name_tokens) AS DOUBLE) AS name_tok_diff, CAST(abs(s.addr_tokens - t.addr_tokens) AS DOUBLE) AS addr_tok_diff,
  CAST(t.is_s3 AS DOUBLE) AS tgt_is_s3, CAST(t.name_non_ascii AS INT)::DOUBLE AS tgt_name_non_ascii, CAST(t.addr_non_ascii AS INT)::DOUBLE AS tgt_addr_non_ascii FROM {_join('ex')}"""),
    "pair_idf_overlap": _query(["ov_name", "ov_addr"], "SELECT s1_id, tgt_id, " + ", ".join(f"round({x}.{k}, 6) AS {p}_{k}" for x, p in (("n", "name"), ("a", "addr")) for k in ("jaccard", "idf_jaccard", "idf_coverage", "max_shared_idf")) + " FROM ov_name n JOIN ov_addr a USING (s1_id, tgt_id)"),
    "pair_jaro_winkler": _query(["ex", "s1", "tg"], f"SELECT s1_id, tgt_id, round(jaro_winkler_similarity(s.addr_norm, t.addr_norm), 6) AS addr_jaro FROM {_join('ex')} WHERE s.addr_norm <> '' AND t.addr_norm <> ''"),
    "competition_features": _query(["comp"], f"SELECT s1_id, tgt_id, {_six(*_GROUP_C)} FROM comp"),
    "share_sums_to_one": _query(["comp"], "SELECT s1_id, round(sum(share_comb), 6) AS total, max(CAST(name_cos + addr_cos > 0 AS INTEGER)) AS any_cos FROM comp GROUP BY s1_id"),
    "rule_score_select": _query(["sel"], "SELECT country, s1_id, tgt_id, p FROM sel"),
    "exclusivity_winners": _query(["won"], "SELECT s1_id, tgt_id, p FROM won"),
    "singleton_gate": _query(["scored"], "SELECT s1_id, tgt_id, p FROM (SELECT *, max(p) OVER (PARTITION BY s1_id) AS best FROM scored) WHERE best >= 0.9 AND p >= 0.5 QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) = 1"),
    "threshold_sweep": _query(["sweep"], f"SELECT threshold, {_six('macro_f05')} FROM sweep"),
    "best_threshold": _query(["sweep"], f"SELECT threshold, {_six('macro_f05')} FROM sweep ORDER BY round(macro_f05, 9) DESC, threshold LIMIT 1"),
    "threshold_report": _query(["won", "s1"], f"""
SELECT threshold, round(1 - n_some / (SELECT count(*) FROM s1), 6) AS empty_share, round(CASE WHEN n_some > 0 THEN total / n_some ELSE 0 END, 6) AS mean_size, total FROM (
  SELECT threshold, count(DISTINCT s1_id) AS n_some, count(s1_id) AS total FROM (SELECT unnest({REPORT}::DOUBLE[]) AS threshold) LEFT JOIN won ON p >= threshold GROUP BY threshold)"""),
    "set_sizes": _query(["ent"], "SELECT count(*) AS entities, count(*) FILTER (n_pred = 0) AS empty, CAST(sum(n_pred) AS BIGINT) AS total, round(avg(n_pred) FILTER (n_pred > 0), 6) AS mean_size FROM ent"),
    "entity_f05": _query(["ent"], f"SELECT s1_id, n_pred, n_true, n_hit, {_six('f')} FROM ent"),
    "macro_f05": _query(["ent"], "SELECT round(avg(f), 6) AS macro_f FROM ent"),
    "score_breakdown": _query(["ent"], """
SELECT count(*) FILTER (n_true = 0) AS singleton_n, count(*) FILTER (n_true > 0) AS non_singleton_n, round(avg(f), 6) AS macro_f, round(avg(f) FILTER (n_true = 0), 6) AS singleton_mean, round(avg(f) FILTER (n_true > 0), 6) AS non_singleton_mean,
  round(sum(f) FILTER (n_true = 0) / count(*), 6) AS singleton_part, round(sum(f) FILTER (n_true > 0) / count(*), 6) AS non_singleton_part, round(count(*) FILTER (n_true = 0) / count(*), 6) AS singleton_share FROM ent"""),
    "f05_by_cardinality": _query(["ent"], "SELECT least(n_true, 4) AS bucket, count(*) AS n, round(avg(f), 6) AS mean_f FROM ent GROUP BY ALL"),
    "matching_results_lists": _query(["s1", "sel"], "SELECT entity_id || chr(9) || coalesce(string_agg(tgt_id, ',' ORDER BY tgt_id), '') AS line FROM s1 LEFT JOIN sel ON sel.s1_id = entity_id GROUP BY entity_id"),
    "candidate_lists": _query(["lists"], "SELECT s1_id || chr(9) || ids AS line FROM lists"),
    "clean_id_list": _query(["dirty"], """
SELECT s1_id, coalesce(array_to_string(list_sort(list_filter(o, lambda x: regexp_matches(x, '^S[23]-'))), ','), '') AS ids, CAST(len(a) - len(o) AS INTEGER) AS duplicate_in_list,
  CAST(len(list_filter(o, lambda x: x LIKE 'S1-%')) AS INTEGER) AS self_match, CAST(len(list_filter(o, lambda x: NOT regexp_matches(x, '^S[123]-'))) AS INTEGER) AS bad_prefix
FROM (SELECT s1_id, a, list_distinct(a) AS o FROM (SELECT s1_id, list_filter(list_transform(ids, lambda x: trim(x)), lambda x: x <> '') AS a FROM dirty))"""),
    "validator_findings": _query(["vlines", "vlists", "s1", "tg"], """
SELECT 'malformed' AS rule, value AS s1_id FROM vlines WHERE NOT contains(value, chr(9))
UNION ALL SELECT 'duplicate_row', s1_id FROM vlists GROUP BY s1_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_in_list', s1_id FROM vlists WHERE len(ids) <> len(list_distinct(ids))
UNION ALL SELECT 'self_match', s1_id FROM vlists WHERE len(list_filter(ids, lambda x: x LIKE 'S1-%')) > 0
UNION ALL SELECT 'bad_prefix', s1_id FROM vlists WHERE len(list_filter(ids, lambda x: NOT regexp_matches(x, '^S[123]-'))) > 0
UNION ALL SELECT DISTINCT 'unknown_id', s1_id FROM (SELECT s1_id, unnest(ids) AS id FROM vlists) WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM tg)
UNION ALL SELECT 'missing_entity', entity_id FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM vlists)
UNION ALL SELECT DISTINCT 'unexpected_entity', s1_id FROM vlists WHERE s1_id NOT IN (SELECT entity_id FROM s1)"""),
    "subset_violations": _query(["ex", "ex_addr"], "SELECT DISTINCT s1_id FROM ex ANTI JOIN ex_addr USING (s1_id, tgt_id)"),
    "merge_coverage": _query(["merged", "s1"], """
SELECT entity_id AS s1_id, 'missing' AS problem FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM merged)
UNION ALL SELECT DISTINCT s1_id, 'extra' FROM merged WHERE s1_id NOT IN (SELECT entity_id FROM s1) UNION ALL SELECT s1_id, 'repeated' FROM merged GROUP BY s1_id HAVING count(*) > 1"""),
    "entity_group_split": _query(["s1"], "SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) <= greatest(1, floor(count(*) OVER () * 0.25)) AS held_out FROM s1"),
    "calibration_table": _query(["scored", "truth"], """
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(t.n IS NOT NULL AS INT)), 6) AS positive_rate FROM scored LEFT JOIN (SELECT *, 1 AS n FROM truth) t USING (s1_id, tgt_id) GROUP BY ALL"""),
    "prefix_policies": _query(["ranked"], """
SELECT 'global' AS policy, s1_id, tgt_id FROM ranked WHERE p >= 0.5 UNION ALL SELECT 'topk_floor', s1_id, tgt_id FROM ranked WHERE place <= 3 AND p >= 0.5
UNION ALL SELECT 'capped', s1_id, tgt_id FROM ranked WHERE place <= 3 AND p >= 0.5 UNION ALL SELECT 'leading', s1_id, tgt_id FROM ranked WHERE first >= 0.5 AND p >= 0.8 * first
UNION ALL SELECT 'successive', s1_id, tgt_id FROM (SELECT *, min(CAST(before IS NULL OR p >= 0.8 * before AS INT)) OVER (PARTITION BY s1_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS ok FROM ranked) WHERE first >= 0.5 AND ok = 1
UNION ALL SELECT 'gap', s1_id, tgt_id FROM (SELECT *, min(CAST(before IS NULL OR before - p <= 0.2 AS INT)) OVER (PARTITION BY s1_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS ok FROM ranked) WHERE first >= 0.5 AND ok = 1"""),
    "fn_decomposition": _query(["truth", "ex", "sel"], """
SELECT count(*) AS total, count(s) AS tp, count(*) FILTER (c IS NULL AND s IS NULL) AS fn_blocked, count(*) FILTER (c IS NOT NULL AND s IS NULL) AS fn_model
FROM truth LEFT JOIN (SELECT s1_id, tgt_id, 1 AS c FROM ex) USING (s1_id, tgt_id) LEFT JOIN (SELECT s1_id, tgt_id, 1 AS s FROM sel) USING (s1_id, tgt_id)"""),
    "mined_rewrites": _query(["ex", "s1", "tg"], f"""
SELECT t_token, s_token, n, round(n / total, 6) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY t_token) AS total FROM (
  SELECT b[1] AS t_token, a[1] AS s_token, count(*) AS n FROM (SELECT list_filter(x, lambda v: NOT list_contains(y, v)) AS a, list_filter(y, lambda v: NOT list_contains(x, v)) AS b
    FROM (SELECT list_distinct({_parts('s.addr_norm')}) AS x, list_distinct({_parts('t.addr_norm')}) AS y FROM {_join('ex')})) WHERE len(a) = 1 AND len(b) = 1 GROUP BY ALL)) WHERE n / total >= 0.3"""),
    "reject_by_quintile": _query(["scored", "tg"], """
SELECT CAST(x > q[1] AS INT) + CAST(x > q[2] AS INT) + CAST(x > q[3] AS INT) + CAST(x > q[4] AS INT) AS part, count(*) AS n, round(avg(CAST(p < 0.5 AS INT)), 6) AS reject_rate
FROM (SELECT CAST(name_len AS DOUBLE) AS x, p FROM scored JOIN tg ON tgt_id = entity_id), (SELECT quantile_cont(CAST(name_len AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM scored JOIN tg ON tgt_id = entity_id) GROUP BY ALL"""),
}
