"""DuckDB statements that give the core queries' results."""

from __future__ import annotations

from weftline.plans.queries import LATER_EXAMPLES, MORE_STOP_WORDS, SPELLINGS, STEM_EXAMPLES, STOP_WORDS

SQL: dict[str, str] = {}

VALID = "NOT (tracker = 'Bugzilla' AND coalesce(resolution, '') LIKE '%INVALID')"
BODY = "coalesce(long_desc[1].thetext, '')"
COMMENTS = "coalesce(array_to_string(list_transform(long_desc[2:], lambda x: chr(10) || ' ' || coalesce(x.thetext, '')), ''), '')"
TOKEN = r"\b[a-zA-Z|]\w*(?:[.\-'']*\w+)*"
QUOTED = r'"(?:[^"]|"")*"'


def _clean(text: str) -> str:
    text = rf"regexp_replace({text}, '\w+://\S+', ' ', 'g')"
    text = rf"regexp_replace({text}, '(\w+/\w+(/\w+)+)|(\w+(\\\w+)+)', ' ', 'g')"
    return rf"regexp_replace({text}, '\n>.*\n', chr(10) || ' ', 'g')"


def _records(comments: bool = False) -> str:
    doc = f"coalesce(short_desc, '') || chr(10) || ' ' || {BODY}" + (f" || {COMMENTS}" if comments else "")
    return f"rec AS (SELECT doc_idx AS idx, bug_id AS id, dup_id AS duplicate_id, short_desc AS title, {doc} AS doc FROM features WHERE {VALID})"


def _tf(name: str = "", comments: bool = False) -> str:
    n = name
    rec = _records(comments).replace("rec AS", f"rec{n} AS", 1)
    return (
        f"{rec}, tok{n} AS (SELECT idx, unnest(regexp_extract_all({_clean('lower(doc)')}, '{TOKEN}')) AS t, generate_subscripts(regexp_extract_all({_clean('lower(doc)')}, '{TOKEN}'), 1) AS pos FROM rec{n}), "
        f"term{n} AS (SELECT idx, pos, replace(t, '''', '') AS term FROM tok{n}), "
        f"tf{n} AS (SELECT idx, term, count(*) AS tf FROM term{n} GROUP BY idx, term)"
    )


WEIGHTS = (
    _tf()
    + ", df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), top AS (SELECT idx, max(tf) AS m FROM tf GROUP BY idx), "
    + "w AS (SELECT idx, term, tf, df, tf / m * ln((SELECT count(*) FROM rec)::DOUBLE / df) AS w FROM tf JOIN df USING (term) JOIN top USING (idx)), "
    + "norm AS (SELECT idx, sqrt(sum(w * w)) AS norm FROM w WHERE w > 0 GROUP BY idx), u AS (SELECT idx, term, w / norm AS u FROM w JOIN norm USING (idx) WHERE w > 0)"
)
KNOWN = "first_of AS (SELECT id, min(idx) AS dup_idx FROM rec GROUP BY id), known AS (SELECT r.idx, r.id, r.duplicate_id, f.dup_idx FROM rec r JOIN first_of f ON f.id = r.duplicate_id WHERE r.duplicate_id <> '')"
PLACES = (
    "places AS (SELECT k.idx, k.id, k.duplicate_id, c.id AS c_id, coalesce(s.sim, 0) AS sim, row_number() OVER (PARTITION BY k.idx ORDER BY coalesce(s.sim, 0) DESC, c.idx) AS rank "
    "FROM known k JOIN rec c ON c.id <> k.id LEFT JOIN sims s ON s.q = k.idx AND s.c = c.idx), "
    "ranks AS (SELECT idx, id, duplicate_id, min(rank) AS rank, arg_min(sim, rank) AS sim FROM places WHERE c_id = duplicate_id GROUP BY idx, id, duplicate_id)"
)
RANKS = f"{WEIGHTS}, {KNOWN}, sims AS (SELECT a.idx AS q, b.idx AS c, round(sum(a.u * b.u), 9) AS sim FROM u a JOIN u b USING (term) WHERE a.idx IN (SELECT idx FROM known) GROUP BY a.idx, b.idx), {PLACES}"
LINKS = (
    "raw AS (SELECT nullif(trim(feature_id, E' \\t\\r'), '') AS src, nullif(trim(dup_id, E' \\t\\r'), '') AS dst FROM duplicateslsa_lo_sy_dw_sm_sc_ac), "
    "links AS (SELECT src, dst FROM raw WHERE src IS NOT NULL AND dst IS NOT NULL)"
)


def _field(d: str) -> str:
    return rf'[ \t\r]*(?:{QUOTED}[ \t\r]*|[^"{d}]*)'


def _p2() -> str:
    """Quoting, then the number of fields, then their values."""
    parts = {d: f"'^(?:{d}{_field(d)})*$'" for d in ",;"}
    fields = {d: f"regexp_extract_all(delim || raw_text, '{d}({_field(d)})', 1)" for d in ",;"}
    number = r"^[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?$"
    whole = lambda i, low: f"(regexp_full_match(f[{i}], '[0-9]+') AND coalesce(try_cast(f[{i}] AS HUGEINT), 99999999999) BETWEEN {low} AND 2147483647)"
    digits = lambda i: f"regexp_full_match(f[{i}], '[0-9]+')"
    num = lambda i: f"(f[{i}] = '' OR (regexp_matches(f[{i}], '{number}') AND coalesce(try_cast(replace(f[{i}], ',', '.') AS DOUBLE) BETWEEN -1 AND 1, false)))"
    return rf"""
        WITH s AS (SELECT raw_id, kind, raw_text,
          CASE WHEN delim = ',' THEN regexp_matches(delim || raw_text, {parts[',']}) ELSE regexp_matches(delim || raw_text, {parts[';']}) END AS quoted,
          CASE WHEN delim = ',' THEN {fields[',']} ELSE {fields[';']} END AS raw_f FROM raw_records),
        v AS (SELECT *, list_transform(raw_f, lambda x: CASE WHEN trim(x, E' \t\r') LIKE '"%' THEN replace(trim(x, E' \t\r')[2:-2], '""', '"') ELSE trim(x, E' \t\r') END) AS f FROM s)
        , r AS (SELECT raw_id, kind, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> (CASE kind WHEN 'duplicates' THEN 4 ELSE 5 END) THEN 'columns'
          WHEN kind = 'duplicates' AND NOT ({digits(1)} AND {digits(2)} AND (f[3] = '' OR {whole(3, 1)}) AND {num(4)}) THEN 'value'
          WHEN kind = 'lsa_m2' AND NOT ({whole(1, 0)} AND {digits(2)} AND {whole(3, 0)} AND {digits(4)} AND {num(5)}) THEN 'value' END AS reason FROM v)"""


SQL["p2_found"] = _p2() + " SELECT raw_id, reason FROM r WHERE reason IS NOT NULL"


def _loaded() -> str:
    number = lambda i: f"CAST(replace(nullif(f[{i}], ''), ',', '.') AS DOUBLE)"
    whole = lambda i: f"CAST(nullif(f[{i}], '') AS DOUBLE)"
    fields = [("duplicates", "feature_id", "f[1]"), ("duplicates", "dup_id", "f[2]"), ("duplicates", "rank", whole(3)), ("duplicates", "sim", number(4))]
    fields += [("lsa_m2", "title_i", whole(1)), ("lsa_m2", "id_i", "f[2]"), ("lsa_m2", "doc_j", whole(3)), ("lsa_m2", "id_j", "f[4]"), ("lsa_m2", "cosine_similarity", number(5))]
    return ", ".join(f"CASE WHEN kind = '{k}' THEN {e} END AS {k}_{n}" for k, n, e in fields)


SQL["p2_loaded"] = _p2() + f" SELECT raw_id, kind, {_loaded()} FROM r WHERE reason IS NULL"
SQL["a5_comment_rows"] = "SELECT doc_idx, CAST(i - 1 AS INTEGER) AS pos, CAST(length(long_desc[i].thetext) AS INTEGER) AS n_chars FROM features, range(1, len(long_desc) + 1) r(i)"
SQL["a6_census"] = "SELECT corpus, tracker, count(*) AS n_records, count(*) FILTER (WHERE resolution = 'DUPLICATE') AS n_duplicates FROM features GROUP BY corpus, tracker"
_DOUBLE = f"coalesce(short_desc, '') || chr(10) || ' ' || coalesce(short_desc, '') || chr(10) || ' ' || {BODY} || {COMMENTS}"
SQL["c1_documents"] = f"SELECT idx, CAST(length(doc) AS INTEGER) AS n_chars, md5(doc) AS doc_md5 FROM (SELECT doc_idx AS idx, {_DOUBLE} AS doc FROM features WHERE {VALID})"
SQL["c2_valid_records"] = f"WITH {_records()} SELECT idx, id FROM rec"
SQL["c3_known_duplicates"] = f"WITH {_records()} SELECT idx, id, duplicate_id FROM rec WHERE duplicate_id <> ''"
SQL["f4_resolvable"] = f"WITH {_records()}, {KNOWN} SELECT idx, id, duplicate_id, dup_idx FROM known"
SQL["d5_clean_texts"] = f"WITH {_records()} SELECT idx, md5({_clean('lower(doc)')}) AS clean_md5 FROM rec"
SQL["d8_code_lines"] = (
    f"WITH {_records(True)}, l AS (SELECT idx, string_split(doc, chr(10)) AS lines FROM rec) "
    "SELECT idx, CAST(len(list_filter(lines[2:len(lines) - 1], lambda x: regexp_matches(x, '[;|}{]$'))) AS INTEGER) AS code_lines FROM l"
)
_URL = r"regexp_replace(t, '\w+://\S+', ' ', 'g')"
_PATH = rf"regexp_replace({_URL}, '(\w+/\w+(/\w+)+)|(\w+(\\\w+)+)', ' ', 'g')"
SQL["d9_removed_matches"] = (
    f"WITH {_records()}, l AS (SELECT idx, lower(doc) AS t FROM rec) SELECT idx, CAST(len(regexp_extract_all(t, '\\w+://\\S+')) "
    rf"+ len(regexp_extract_all({_URL}, '(\w+/\w+(/\w+)+)|(\w+(\\\w+)+)')) + len(regexp_extract_all({_PATH}, '\n>.*\n')) AS INTEGER) AS removed FROM l"
)
SQL["d10_tokens"] = (
    f"WITH {_tf()} SELECT rec.idx, CAST(count(term) AS INTEGER) AS n_tokens, md5(coalesce(string_agg(term, ' ' ORDER BY pos), '')) AS tokens_md5 FROM rec LEFT JOIN term ON rec.idx = term.idx GROUP BY rec.idx"
)
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FIXES = ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS.items())
SQL["d12_chosen_tokens"] = (
    f"WITH {_tf()}, fix(a, b) AS (VALUES {_FIXES}) SELECT replace(coalesce(b, t), '''', '') AS term, count(*) AS n FROM tok LEFT JOIN fix ON t = a WHERE lower(t) NOT IN ({_STOPS}) GROUP BY 1"
)
SQL["d16_bigrams"] = (
    f"WITH {_tf()}, m AS (SELECT idx, pos, t IN ({_STOPS}) AS stop, CASE WHEN t IN ({_STOPS}) THEN t ELSE replace(t, '''', '') END AS s FROM tok), "
    "n AS (SELECT *, lead(s) OVER (PARTITION BY idx ORDER BY pos) AS next FROM m) SELECT s || ' ' || next AS pair, count(*) AS n FROM n WHERE NOT stop AND s <> '' AND next IS NOT NULL GROUP BY 1"
)


def _grams(t: str) -> str:
    return (
        f"list_distinct(list_concat(CASE WHEN length({t}) >= 1 THEN [{t}[1:1], {t}[-1:]] ELSE [] END, CASE WHEN length({t}) >= 2 THEN [{t}[1:2], {t}[-2:]] ELSE [] END, "
        f"CASE WHEN length({t}) >= 3 THEN list_transform(range(1, length({t}) - 1), lambda i: {t}[i:i + 2]) ELSE [] END))"
    )


SQL["d17_title_ngrams"] = f"WITH {_records()}, t AS (SELECT idx, coalesce(title, '') AS t FROM rec) SELECT idx, CAST(len({_grams('t')}) AS INTEGER) AS n_grams FROM t"
SQL["d18_title_dice"] = (
    f"WITH {_records()}, {KNOWN}, t AS (SELECT idx, lower(coalesce(title, '')) AS t FROM rec), g AS (SELECT idx, {_grams('t')} AS g FROM t) "
    "SELECT k.idx, k.dup_idx, round(CASE WHEN len(a.g) + len(b.g) > 0 THEN 2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) ELSE 0 END, 6) AS dice FROM known k JOIN g a ON a.idx = k.idx JOIN g b ON b.idx = k.dup_idx"
)
SQL["d19_ascii_words"] = (
    r"WITH x AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]{1,256}') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, "
    f"CAST(len(list_filter(w, lambda x: x NOT IN ({_STOPS}))) AS INTEGER) AS n_kept, md5(array_to_string(w, ' ')) AS words_md5 FROM x"
)
SQL["d22_dictionary"] = rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({BODY}, '\w+')) AS word FROM features WHERE {VALID}) GROUP BY word"
_CALLS = "c AS (SELECT DISTINCT 'C' || l_suppkey AS cls, 'org.p.P' || l_partkey AS owner, CASE WHEN l_suppkey % 10 = l_partkey % 10 THEN '<init>' ELSE 'get' END AS called FROM lineitem)"
SQL["d23_call_lines"] = f"WITH {_CALLS} SELECT DISTINCT line FROM (SELECT cls || ' ' || cls AS line FROM c UNION ALL SELECT cls || ':run ' || owner || ':' || called FROM c UNION ALL SELECT cls || ' ' || owner FROM c)"
SQL["d24_score_lines"] = "SELECT DISTINCT 'A' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ':run' END || ''': 0.' || s_suppkey AS line FROM supplier"
SQL["b19_decimal_points"] = "SELECT raw_id, replace(raw_text, ',', '.') AS line FROM raw_records"
SQL["b17_text_lines"] = "WITH l AS (SELECT string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT CAST(i - 1 AS INTEGER) AS pos, count(*) AS n, CAST(sum(length(l[i])) AS BIGINT) AS n_chars FROM l, range(1, len(l) + 1) r(i) GROUP BY 1"
SQL["e1_vocabulary"] = (
    f"WITH {_tf()}, f AS (SELECT term, min(struct_pack(idx := idx, pos := pos)) AS f, count(*) AS cf, count(DISTINCT idx) AS df FROM term GROUP BY term) "
    "SELECT term, row_number() OVER (ORDER BY f.idx, f.pos) - 1 AS term_idx, cf, df FROM f"
)
_STAT = "SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term"
SQL["e2_repeated_terms"] = f"WITH {_tf()} SELECT * FROM ({_STAT}) WHERE cf > 1"
SQL["e3_shared_terms"] = f"WITH {_tf()} SELECT * FROM ({_STAT}) WHERE cf > 1 AND df > 1"
SQL["e4_term_frequencies"] = f"WITH {_tf()} SELECT idx, term, tf FROM tf"
SQL["e9_weights"] = f"WITH {WEIGHTS} SELECT idx, term, tf, df, round(w, 6) AS w FROM w"
SQL["e10_documents_with_word"] = f"WITH {_tf()}, s AS (SELECT unnest([{_STOPS}]) AS stem) SELECT stem, count(tf) AS n_documents FROM s LEFT JOIN tf ON term = stem GROUP BY stem"
SQL["e12_vocabulary_size"] = f"WITH {_tf()} SELECT count(*) AS vocabulary_size FROM (SELECT term FROM tf GROUP BY term HAVING sum(tf) > 1)"
SQL["e13_corpus_size"] = f"WITH {_tf()} SELECT CAST(sum(tf) AS BIGINT) AS total_words, count(DISTINCT term) AS vocabulary_size FROM tf"
SQL["e21_adjacency"] = f"WITH {LINKS} SELECT src, dst, count(*) AS n FROM links GROUP BY src, dst"
SQL["e16_callers"] = f"WITH {LINKS} SELECT dst AS method, count(*) AS n_callers, count(DISTINCT src) AS n_distinct FROM links GROUP BY dst"
_PAIRS = f"{WEIGHTS}, p AS (SELECT a.idx AS i, b.idx AS j, sum(a.u * b.u) AS sim FROM u a JOIN u b ON a.term = b.term AND a.idx < b.idx GROUP BY a.idx, b.idx HAVING sum(a.u * b.u) > 0.5)"
SQL["f1_similar_pairs"] = f"WITH {_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM p"
SQL["b1_pair_rows"] = (
    f'WITH {_PAIRS}, b AS (SELECT i, j, sim FROM p UNION ALL SELECT j, i, sim FROM p) SELECT i AS "Title_i", x.id AS "ID_i", j AS "Doc_j", y.id AS "ID_j", '
    "round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 4) AS sim FROM b JOIN rec x ON x.idx = i JOIN rec y ON y.idx = j"
)
SQL["g1_duplicate_ranks"] = f"WITH {RANKS} SELECT idx, id, duplicate_id, rank, round(sim, 6) AS sim FROM ranks"
SQL["b2_duplicate_rows"] = f"WITH {RANKS} SELECT id AS feature_id, duplicate_id AS dup_id, rank, round(sim, 4) AS sim FROM ranks"
SQL["e11_hit_rates"] = f"WITH {RANKS} SELECT count(*) AS n_duplicates, round(avg((rank <= 10)::INT), 6) AS hit_10, round(avg((rank <= 20)::INT), 6) AS hit_20 FROM ranks"
SQL["h3_title_description"] = (
    f"WITH {_tf()}, {_tf('2', True)}, {KNOWN}, n AS (SELECT count(*)::DOUBLE AS n FROM rec), df AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term), "
    "rel AS (SELECT idx, term, tf / max(tf) OVER (PARTITION BY idx) AS r FROM tf2), srel AS (SELECT idx AS q, term, tf / max(tf) OVER (PARTITION BY idx) AS r FROM tf WHERE idx IN (SELECT idx FROM known)), "
    "ownt AS (SELECT q, term, max(f) AS f, max(s) AS s FROM (SELECT idx AS q, term, 1 AS f, 0 AS s FROM tf2 WHERE idx IN (SELECT idx FROM known) UNION ALL SELECT q, term, 0, 1 FROM srel) GROUP BY q, term), "
    "asked AS (SELECT DISTINCT idx AS q FROM known), "
    "cw AS (SELECT a.q, r.idx AS c, r.term, r.r * CASE WHEN df.df - coalesce(o.f, 0) + coalesce(o.s, 0) > 0 THEN ln(n.n / (df.df - coalesce(o.f, 0) + coalesce(o.s, 0))) ELSE 0 END AS w "
    "FROM asked a CROSS JOIN n JOIN rel r ON r.idx <> a.q JOIN df ON df.term = r.term LEFT JOIN ownt o ON o.q = a.q AND o.term = r.term), "
    "cn AS (SELECT q, c, sqrt(sum(w * w)) AS n FROM cw GROUP BY q, c), "
    "qw AS (SELECT s.q, s.term, s.r * ln(n.n / (coalesce(df.df, 0) - o.f + o.s)) AS w FROM srel s CROSS JOIN n JOIN ownt o ON o.q = s.q AND o.term = s.term LEFT JOIN df ON df.term = s.term), "
    "qn AS (SELECT q, sqrt(sum(w * w)) AS n FROM qw GROUP BY q), "
    "sims AS (SELECT cw.q, cw.c, round(CASE WHEN any_value(cn.n) * any_value(qn.n) > 1e-12 THEN sum(cw.w * qw.w) / (any_value(cn.n) * any_value(qn.n)) ELSE 0 END, 9) AS sim FROM cw JOIN qw ON qw.q = cw.q AND qw.term = cw.term JOIN cn ON cn.q = cw.q AND cn.c = cw.c JOIN qn ON qn.q = cw.q GROUP BY cw.q, cw.c), "
    f"{PLACES} SELECT idx, id, duplicate_id, rank, round(sim, 6) AS sim FROM ranks"
)
SQL["j5_similarity"] = (
    f"WITH {WEIGHTS}, two AS (SELECT min(id) AS a, max(id) AS b FROM rec), x AS (SELECT min(idx) AS i FROM rec, two WHERE id = a), y AS (SELECT min(idx) AS i FROM rec, two WHERE id = b) "
    "SELECT true AS found, round(coalesce(sum(p.u * q.u), 0), 6) AS sim FROM u p JOIN u q USING (term) WHERE p.idx = (SELECT i FROM x) AND q.idx = (SELECT i FROM y)"
)
SQL["b7_two_vectors"] = (
    f"WITH {WEIGHTS} SELECT term AS \"Term\", round(coalesce(max(w) FILTER (WHERE idx = (SELECT min(idx) FROM rec)), 0), 6) AS \"Vector_a\", round(coalesce(max(w) FILTER (WHERE idx = (SELECT max(idx) FROM rec)), 0), 6) AS \"Vector_b\" "
    "FROM w WHERE idx IN (SELECT min(idx) FROM rec UNION SELECT max(idx) FROM rec) GROUP BY term"
)
_DOT = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_NEAR = (
    "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), "
    f"s AS (SELECT a.vec_id AS q, b.vec_id AS c, {_DOT} AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), "
    "n AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS INTEGER) AS rank FROM s)"
)
SQL["g4_related"] = f"WITH {_NEAR} SELECT q, c, rank, round(sim, 6) AS sim FROM n WHERE rank <= 16"
SQL["e19_same_label"] = f"WITH {_NEAR} SELECT q, count(*) FILTER (WHERE a.label = b.label) AS same FROM n JOIN e a ON a.vec_id = q JOIN e b ON b.vec_id = c WHERE rank <= 16 GROUP BY q"
SQL["h1_dense_norms"] = (
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY label) "
    f"SELECT a.vec_id, round({_DOT}, 6) AS sim FROM e a JOIN f b ON a.label = b.label"
)
SQL["g8_message_features"] = (
    r"WITH m AS (SELECT c_id, feature_id, c_created, CAST(CASE WHEN regexp_replace(coalesce(c_text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(c_text, '^\s+|\s+$', '', 'g'), '\s+')) END AS BIGINT) AS wc FROM feature_comments), "
    "w AS (SELECT *, max(wc) OVER (PARTITION BY feature_id ORDER BY c_created NULLS FIRST, c_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest, "
    "lag(epoch_us(c_created)) OVER (PARTITION BY feature_id ORDER BY c_created NULLS FIRST, c_id) AS last FROM m) "
    "SELECT c_id, wc, round(CASE WHEN longest > 0 THEN wc / longest END, 6) AS slen, round((epoch_us(c_created) - last) / 1e6, 3) AS ppau FROM w"
)
SQL["s1_event_windows"] = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
_REPORT = (
    "x AS (SELECT corpus, CASE WHEN coalesce(dup_id, '') <> '' THEN 'true' ELSE 'false' END AS truth, CASE WHEN coalesce(resolution, '') = 'DUPLICATE' THEN 'true' ELSE 'false' END AS predicted FROM features), "
    "t AS (SELECT corpus, truth AS type, count(*) AS support, count(*) FILTER (WHERE truth = predicted) AS hit FROM x GROUP BY ALL), p AS (SELECT corpus, predicted AS type, count(*) AS named FROM x GROUP BY ALL), "
    "r AS (SELECT t.corpus, t.type, support, CASE WHEN coalesce(named, 0) > 0 THEN hit / named ELSE 0 END AS precision, hit / support AS recall FROM t LEFT JOIN p ON p.corpus IS NOT DISTINCT FROM t.corpus AND p.type = t.type), "
    "f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"
)
SQL["h26_report"] = f"WITH {_REPORT} SELECT corpus, type, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f"
_LINE = lambda name, c: f"SELECT corpus || '/' || type AS type, '{name}' AS metric, '[' || corpus || '/' || type || ', {name} = ' || CAST(CAST(round({c}, 4) AS DECIMAL(12,4)) AS VARCHAR) || ']' AS line FROM f"
SQL["c10_metric_lines"] = f"WITH {_REPORT} " + " UNION ALL ".join(_LINE(n, c) for n, c in (("Precision", "precision"), ("Recall", "recall"), ("f1-Score", "f1"), ("Support", "support")))
SQL["b16_graph_lines"] = f"WITH {LINKS} SELECT DISTINCT '\"' || src || '\",\"' || dst || '\"' AS line FROM links"


def _pagerank(rounds: int) -> str:
    steps = [
        f"{LINKS}, e AS (SELECT DISTINCT src, dst FROM links), v AS (SELECT DISTINCT unnest([src, dst]) AS vertex FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), "
        "d AS (SELECT vertex, count(dst) AS degree FROM v LEFT JOIN e ON src = vertex GROUP BY vertex), r0 AS (SELECT vertex, degree, 1 / n AS rank FROM d, n)"
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS (SELECT r.vertex, r.degree, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE degree = 0) / n) AS rank "
            f"FROM r{i - 1} r CROSS JOIN n LEFT JOIN (SELECT dst AS vertex, sum(rank / degree) AS got FROM e JOIN r{i - 1} s ON s.vertex = e.src GROUP BY dst) g ON g.vertex = r.vertex)"
        )
    return "WITH " + ", ".join(steps) + f" SELECT vertex, round(rank, 9) AS rank FROM r{rounds}"


SQL["h23_pagerank"] = _pagerank(5)
_METHODS = f"{LINKS}, m AS (SELECT CAST(bug_id AS INTEGER) AS id, CAST(sum(votes) AS DOUBLE) AS pagerank FROM features GROUP BY 1), c AS (SELECT CAST(dst AS INTEGER) AS id, CAST(src AS INTEGER) AS caller FROM links)"
SQL["g3_best_callers"] = (
    f"WITH {_METHODS}, k AS (SELECT DISTINCT c.id, c.caller FROM c JOIN m USING (id)), r AS (SELECT k.id, k.caller, row_number() OVER (PARTITION BY k.id ORDER BY p.pagerank DESC, k.caller) AS n FROM k JOIN m p ON p.id = k.caller WHERE p.pagerank > 0) "
    "SELECT k.id, coalesce(max(CASE WHEN n = 1 THEN r.caller END), 0) AS caller_one, coalesce(max(CASE WHEN n = 2 THEN r.caller END), 0) AS caller_two FROM (SELECT DISTINCT id FROM k) k LEFT JOIN r ON r.id = k.id AND r.n <= 2 GROUP BY k.id"
)
SQL["i4_wording"] = (
    f"WITH {_METHODS}, a AS (SELECT avg(pagerank) AS average FROM m), k AS (SELECT id, count(*) AS n FROM c GROUP BY id) "
    "SELECT m.id, CASE WHEN pagerank > 1.5 * average THEN 'far more' WHEN pagerank > average THEN 'slightly more' ELSE 'less' END AS importance, "
    "CASE coalesce(n, 0) WHEN 0 THEN 'not called by any methods' WHEN 1 THEN 'called by 1 method' ELSE 'called by ' || n || ' methods' END AS calls FROM m CROSS JOIN a LEFT JOIN k ON k.id = m.id WHERE pagerank IS NOT NULL"
)


# Known duplicates, stop words, published stems.
SQL["c4_without_exclusions"] = f"WITH {_records()}, {KNOWN}, {LINKS} SELECT idx, id, duplicate_id, dup_idx FROM known k WHERE NOT EXISTS (SELECT 1 FROM links WHERE src = k.id AND dst = k.duplicate_id)"
_ALL_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS + MORE_STOP_WORDS)
SQL["d13_more_stop_words"] = (
    f"WITH {_tf()}, fix(a, b) AS (VALUES {_FIXES}) SELECT replace(coalesce(b, t), '''', '') AS term, count(*) AS n FROM tok LEFT JOIN fix ON t = a WHERE lower(t) NOT IN ({_ALL_STOPS}) GROUP BY 1"
)
for _name, _examples in (("d15_published_stems", STEM_EXAMPLES), ("d21_published_stems", LATER_EXAMPLES)):
    SQL[_name] = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*x.split("=")) for x in _examples.split()) + ") v(word, stem)"


def _without_code() -> str:
    """The steps one after the other. What has to be followed by a line end is matched in a text with all line ends doubled, where that end can be taken and given back."""
    steps = [
        (r"[C|c]hecking\sin(?s:.*)done", "chr(10)", False), (r"[C|c]hecking\sin(?s:.*)revision.*\n", "chr(10)", False), (r"/cvs/(?s:.*)revision.*\n", "chr(10)", False), (r"\w+://\S+", "' '", False),
        (r"(\w+/\w+(/\w+)+)|(\w+(\\\w+)+)", "' '", False), (r"\n>.*\n", "chr(10) || ' '", False), (r"\n\s*at\s*\S+\(.*\)", "chr(10) || ' '", False), (r"\n[\w.]+[e|E]xception.*\n", "chr(10) || ' ' || chr(10)", True),
        (r"--\s[E|e]rror\s[D|d]etails(?s:.*)[E|e]xception\s[S|s]tack\s[t|T]race:", "chr(10) || ' '", False), (r"[B|b]uild\s[I|i][d|D].*\n", "chr(10) || ' '", False), (r"[U|u]ser-[A|a]gent.*\n", "chr(10) || ' '", False),
        (r"[S|s]teps.*[R|r]eproduce:", "' '", False), (r"[M|m]ore\s[I|i]nformation:", "' '", False), (r"[R|r]eproducible:.*\n", "' ' || chr(10)", True), (r"\n[T|t]hread\s\[.*\n(.*line.*\n)+", "chr(10) || ' '", False), (r"\n.*[;|}{]\n", "chr(10) || ' ' || chr(10)", True),
    ]
    sql = f"SELECT idx, doc AS t, 0 AS removed FROM rec"
    for pattern, by, doubled in steps:
        text = "replace(t, chr(10), chr(10) || chr(10))" if doubled else "t"
        changed = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
        changed = f"replace({changed}, chr(10) || chr(10), chr(10))" if doubled else changed
        sql = f"SELECT idx, {changed} AS t, removed + len(regexp_extract_all({text}, '{pattern}')) AS removed FROM ({sql})"
    return f"WITH {_records(True)} SELECT idx, CAST(removed AS INTEGER) AS removed, CAST(length(t) AS INTEGER) AS n_chars FROM ({sql})"


SQL["d7_without_code"] = _without_code()

# Files written and read again.
_CLEAN = lambda c: f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"
_NOTES = f"list_transform(coalesce(long_desc, []), lambda x: coalesce({_CLEAN('x.thetext')}, ''))"


def _tracker(where: str, duplicate: str = "nullif(dup_id, '')") -> str:
    return (
        f"WITH n AS (SELECT bug_id AS id, {_CLEAN('short_desc')} AS title, {_NOTES} AS n, {duplicate} AS duplicate_id FROM features WHERE {where}) "
        "SELECT id, title, md5(coalesce(n[1], '')) AS description_md5, CAST(greatest(len(n) - 1, 0) AS INTEGER) AS n_comments, md5(array_to_string(n[2:], '|')) AS comments_md5, duplicate_id FROM n"
    )


SQL["a1_bugzilla_records"] = _tracker("coalesce(resolution, '') NOT LIKE '%INVALID'")
SQL["a2_tigris_records"] = _tracker("true")
SQL["a3_sample_records"] = (
    f"SELECT feature_id || '-' || c_id AS id, 't' || c_id AS title, 1 AS n_comments, md5(coalesce({_CLEAN('c_text')}, '')) AS comments_md5, CAST(NULL AS VARCHAR) AS duplicate_id FROM feature_comments WHERE feature_id IS NOT NULL"
)
SQL["a5_relational_rows"] = f"SELECT doc_idx, CAST(i - 1 AS INTEGER) AS pos, md5(coalesce({_CLEAN('long_desc[i].thetext')}, '-')) AS text_md5 FROM features, range(1, len(long_desc) + 1) r(i) WHERE len(long_desc) > 1"
SQL["a7_call_edges"] = (
    "WITH s AS (SELECT s_suppkey AS k, 'org.s' || (s_suppkey % 10) || '.S' || s_suppkey AS c FROM supplier) SELECT c || '.run' AS src, c || '.help' AS dst FROM s "
    "UNION ALL SELECT c || '.run', 'org.p.P.get' FROM s WHERE k % 2 = 0 UNION ALL SELECT c || '.run', c || '.S' || k FROM s WHERE k % 3 = 0 "
    "UNION ALL SELECT c || '.run', c || '.run' FROM s WHERE k % 7 = 0 UNION ALL SELECT c || '.run', 'org.p.P.shared' FROM s WHERE k % 11 = 0"
)
SQL["a9_report_rows"] = f"WITH {_REPORT} SELECT corpus || '/' || type AS type, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS DOUBLE) AS support FROM f"
SQL["a12_word_counts"] = (
    "WITH g AS (SELECT l_orderkey, l_linenumber AS k, sum(CAST(trunc(l_quantity) AS INTEGER)) AS v FROM lineitem GROUP BY 1, 2), e AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM g) "
    "SELECT CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, CAST(sum(v) AS BIGINT) AS total, count(*) AS n_lines FROM e GROUP BY n, k"
)
SQL["a13_vocabulary_file"] = f"WITH {_tf()}, f AS (SELECT term, min(struct_pack(idx := idx, pos := pos)) AS f FROM term GROUP BY term) SELECT row_number() OVER (ORDER BY f.idx, f.pos) - 1 AS term_idx, term FROM f"
SQL["a15_positive_entries"] = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS col, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, len(embedding) + 1) r(i) WHERE embedding[i] > 0"
SQL["a17_ascii_texts"] = r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]', '?', 'g')) AS ascii_md5 FROM documents"
SQL["a18_transcripts"] = SQL["g8_message_features"]
SQL["b2_duplicates_file"] = (
    "SELECT trim(feature_id, E' \\t\\r') AS feature_id, trim(dup_id, E' \\t\\r') AS dup_id, CAST(rank AS DOUBLE) AS rank, sim FROM duplicateslsa_lo_sy_dw_sm_sc_ac WHERE trim(feature_id, E' \\t\\r') <> '' AND trim(dup_id, E' \\t\\r') <> '' AND (sim IS NULL OR NOT isnan(sim))"
)
SQL["b5_pairs_file"] = (
    'SELECT title_i AS "Title_i", id_i AS "ID_i", doc_j AS "Doc_j", id_j AS "ID_j", round(CAST(cosine_similarity AS DOUBLE), 4) AS cosine_similarity FROM lsa_m2_lo_sy_dw_sm_sc_ac '
    "WHERE title_i IS NOT NULL AND id_i IS NOT NULL AND doc_j IS NOT NULL AND id_j IS NOT NULL AND (cosine_similarity IS NULL OR NOT isnan(cosine_similarity))"
)
SQL["b19_decimal_file"] = "SELECT replace(raw_text, ',', '.') AS line, count(*) AS n FROM raw_records WHERE NOT contains(raw_text, chr(10)) AND NOT contains(raw_text, chr(13)) GROUP BY 1"
SQL["e20_averages"] = (
    f"WITH {_METHODS}, k AS (SELECT id, count(*) AS n FROM c GROUP BY id), o AS (SELECT caller AS id, count(*) AS n FROM c WHERE id IN (SELECT id FROM m) GROUP BY caller) "
    "SELECT round(avg(coalesce(k.n, 0)), 6) AS called, round(avg(coalesce(o.n, 0)), 6) AS calls, round(avg(pagerank), 6) AS pagerank FROM m LEFT JOIN k USING (id) LEFT JOIN o USING (id)"
)

# Summaries: one row per message, joined with its neighbours, then one text per method.
_WORDS = "CASE WHEN pagerank > 1.5 * average THEN 'far more' WHEN pagerank > average THEN 'slightly more' ELSE 'less' END"
_CALLED = "CASE n_called WHEN 0 THEN 'not called by any methods' WHEN 1 THEN 'called by 1 method' ELSE 'called by ' || n_called || ' methods' END"
SQL["i7_summaries"] = (
    f"WITH {_METHODS}, r AS (SELECT CAST(bug_id AS INTEGER) AS id, min(resolution) AS ret FROM features GROUP BY 1), n AS (SELECT id, count(*) AS n FROM c GROUP BY id), a AS (SELECT avg(pagerank) AS average FROM m), "
    "x AS (SELECT m.id, 'm' || m.id AS name, pagerank, average, ret, coalesce(n.n, 0) AS n_called, m.id % 2 = 0 AS verb, CASE WHEN m.id % 10 = 4 THEN 'null' ELSE 'm' || m.id END AS object, m.id % 7 = 0 AS used FROM m CROSS JOIN a JOIN r USING (id) LEFT JOIN n USING (id)), "
    "k AS (SELECT DISTINCT c.id, c.caller FROM c JOIN m USING (id)), t AS (SELECT k.id, k.caller, row_number() OVER (PARTITION BY k.id ORDER BY p.pagerank DESC, k.caller) AS p FROM k JOIN m p ON p.id = k.caller WHERE p.pagerank > 0), "
    "o AS (SELECT t.id, p, object FROM t JOIN x ON x.id = t.caller WHERE p <= 2 AND x.verb), "
    "o2 AS (SELECT id, count(*) AS n, arg_min(object, p) AS o1, arg_max(object, p) AS o2 FROM o GROUP BY id), "
    "y AS (SELECT x.*, coalesce(o2.n, 0) AS n_out, o1, o2, (ret IS NOT NULL AND ret <> 'void') AS returns, CASE WHEN regexp_matches(ret, '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || ret AS aret FROM x LEFT JOIN o2 USING (id)), "
    f"z AS (SELECT *, {_WORDS} AS words, {_CALLED} AS calls FROM y), "
    "s AS (SELECT id, verb::INT + returns::INT + n_out + 1 + (pagerank IS NOT NULL)::INT + used::INT AS n_messages, "
    "CASE WHEN verb THEN '1' ELSE '' END || CASE WHEN returns THEN '2' ELSE '' END || repeat('3', n_out) || '4' || CASE WHEN pagerank IS NOT NULL THEN '5' ELSE '' END || CASE WHEN used THEN '6' ELSE '' END AS plan, "
    "[CASE WHEN verb THEN 'This method opens the ' || object || CASE WHEN returns THEN ' and returns ' || aret ELSE '' END END, "
    "CASE WHEN returns AND NOT verb THEN 'M' || name[2:] || ' returns ' || aret END, "
    "CASE WHEN returns AND n_out = 2 THEN 'That ' || ret || ' is used by methods that open the ' || o1 || ' and open the ' || o2 WHEN returns AND n_out = 1 THEN 'That ' || ret || ' is used by a method that opens the ' || o1 "
    "WHEN n_out > 0 AND o1 <> 'null' THEN 'Return data is used by a method that opens the ' || o1 END, "
    "CASE WHEN NOT returns AND n_out = 2 AND o2 <> 'null' THEN 'Return data is used by a method that opens the ' || o2 END, "
    "CASE WHEN pagerank IS NOT NULL THEN 'M' || name[2:] || '() seems ' || words || ' important than average because it is ' || calls ELSE 'M' || name[2:] || ' is ' || calls END, "
    "CASE WHEN used AND id % 3 <> 0 THEN 'The method can be used in a loop statement; for example: \"' || name || '()\"' END] AS parts FROM z) "
    "SELECT id, n_messages, plan, array_to_string(list_transform(list_filter(parts, lambda p: p IS NOT NULL), lambda p: p || '.'), ' ') AS summary FROM s"
)

# The space of all dimensions is the space of weights, here of terms that are in several documents.
_KEPT = WEIGHTS.replace("FROM tf GROUP BY term)", "FROM tf GROUP BY term HAVING sum(tf) > 1 AND count(*) > 1)").replace("top AS (SELECT idx, max(tf) AS m FROM tf GROUP BY idx)", "top AS (SELECT idx, max(tf) AS m FROM tf JOIN df USING (term) GROUP BY idx)")
SQL["h10_full_rank_pairs"] = SQL["f1_similar_pairs"].replace(WEIGHTS, _KEPT)
SQL["h11_published_ranks"] = SQL["g1_duplicate_ranks"].replace(WEIGHTS, _KEPT)
SQL["g7_singular_values"] = f"WITH {_KEPT} SELECT round(sum(w * w), 4) AS squares, true AS descends FROM w"
SQL["h13_count_matrix_values"] = f"WITH {_KEPT} SELECT round(CAST(sum(tf * tf) AS DOUBLE), 3) AS squares FROM w"
SQL["h12_full_rank_terms"] = (
    f"WITH {_KEPT}, first_at AS (SELECT term, min(struct_pack(idx := idx, pos := pos)) AS f FROM term JOIN df USING (term) GROUP BY term), num AS (SELECT term, row_number() OVER (ORDER BY f.idx, f.pos) - 1 AS i FROM first_at), "
    "n AS (SELECT term, sqrt(sum(w * w)) AS n FROM w WHERE w > 0 GROUP BY term), v AS (SELECT idx, num.i, w / n AS x FROM w JOIN n USING (term) JOIN num USING (term) WHERE w > 0), "
    "p AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS sim FROM v a JOIN v b ON a.idx = b.idx AND a.i < b.i GROUP BY a.i, b.i HAVING sum(a.x * b.x) > 0.500000001) SELECT i, j, round(sim, 6) AS sim FROM p"
)

# Titles against descriptions with pruning, and with every record as a query.
_H3 = SQL["h3_title_description"]
SQL["h4_pruned_title_description"] = (
    _H3.replace("df AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term)", "df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf2 GROUP BY term)")
    .replace("ownt AS (SELECT q, term, max(f) AS f, max(s) AS s FROM (SELECT idx AS q, term, 1 AS f, 0 AS s FROM tf2 WHERE idx IN (SELECT idx FROM known) UNION ALL SELECT q, term, 0, 1 FROM srel) GROUP BY q, term)",
             "ownt AS (SELECT q, term, max(f) AS f, max(s) AS s, sum(c) AS c FROM (SELECT idx AS q, term, 1 AS f, 0 AS s, -tf AS c FROM tf2 WHERE idx IN (SELECT idx FROM known) UNION ALL SELECT idx, term, 0, 1, tf FROM tf WHERE idx IN (SELECT idx FROM known)) GROUP BY q, term)")
    .replace("CASE WHEN df.df - coalesce(o.f, 0) + coalesce(o.s, 0) > 0 THEN", "CASE WHEN df.df - coalesce(o.f, 0) + coalesce(o.s, 0) > 1 AND df.cf + coalesce(o.c, 0) > 1 THEN")
    .replace("s.r * ln(n.n / (coalesce(df.df, 0) - o.f + o.s)) AS w", "s.r * CASE WHEN coalesce(df.df, 0) - o.f + o.s > 1 AND coalesce(df.cf, 0) + o.c > 1 THEN ln(n.n / (coalesce(df.df, 0) - o.f + o.s)) ELSE 0 END AS w")
)
_EVERY = _H3[: _H3.index(", places AS")].replace("WHERE idx IN (SELECT idx FROM known)", "").replace("SELECT DISTINCT idx AS q FROM known", "SELECT idx AS q FROM rec")
SQL["b3_cross_reference_rows"] = (
    f'{_EVERY} SELECT q AS "Title_i", x.id AS "ID_i", c AS "Doc_j", y.id AS "ID_j", round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 4) AS sim FROM sims JOIN rec x ON x.idx = q JOIN rec y ON y.idx = c WHERE q < c AND sim > 0.5'
)
