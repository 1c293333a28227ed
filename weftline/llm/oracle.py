"""DuckDB statements that give the llm queries' results."""

from __future__ import annotations

SQL: dict[str, str] = {}

# Letters of other alphabets and the Latin ones they look like, written down apart from the operator's table.
_LETTERS = "А=A В=B Е=E Ѕ=S І=I Ј=J К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X а=a е=e ѕ=s і=i ј=j о=o р=p с=c у=y х=x ԁ=d ԛ=q ԝ=w һ=h Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ɑ=a ɡ=g"

_TRIM = "nullif(trim({0}, E' \\t\\r'), '')"
_LINKS = f"l AS (SELECT match_id, {_TRIM.format('feature_id')} AS a, {_TRIM.format('dup_id')} AS b, rank, sim FROM duplicateslsa_lo_sy_dw_sm_sc_ac)"

SQL["p1_found"] = f"""
    WITH RECURSIVE {_LINKS}, e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
    v AS (SELECT a AS id FROM l WHERE a IS NOT NULL UNION SELECT b FROM l WHERE b IS NOT NULL),
    r(id, g) AS (SELECT id, id FROM v UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
    SELECT id AS record_id, min(g) AS group_id FROM r GROUP BY id"""

SQL["p3_found"] = f"""
    WITH {_LINKS}, k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sim DESC, rank ASC NULLS LAST, b, match_id) AS n FROM l WHERE a <> b AND sim IS NOT NULL AND NOT isnan(sim))
    SELECT match_id FROM (SELECT match_id, row_number() OVER (PARTITION BY a ORDER BY sim DESC, rank ASC NULLS LAST, b, match_id) AS p FROM k WHERE n = 1) WHERE p <= 5"""

_TERMS = (
    "runs AS (SELECT doc_idx, bug_id, unnest(regexp_extract_all(lower(coalesce(short_desc, '') || ' ' || coalesce(long_desc[1].thetext, '')), '[a-z0-9]+')) AS term FROM features), "
    "terms AS (SELECT * FROM runs WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]'))"
)
_SETS = f"{_TERMS}, s AS (SELECT DISTINCT doc_idx, bug_id, term FROM terms WHERE doc_idx IN (SELECT doc_j FROM lsa_m2_lo_sy_dw_sm_sc_ac)), n AS (SELECT doc_idx, bug_id, count(*) AS n FROM s GROUP BY ALL)"
_NEAR = f"{_SETS}, c AS (SELECT a.doc_idx AS a, b.doc_idx AS b, count(*) AS c FROM s a JOIN s b ON a.term = b.term AND a.doc_idx < b.doc_idx GROUP BY ALL), near AS (SELECT x.doc_idx AS a, y.doc_idx AS b, x.bug_id AS bug_a, y.bug_id AS bug_b FROM c JOIN n x ON x.doc_idx = c.a JOIN n y ON y.doc_idx = c.b WHERE c.c * 10 >= (x.n + y.n - c.c) * 7)"
SQL["p4_found"] = f"WITH {_NEAR} SELECT a AS doc_a, b AS doc_b FROM near WHERE bug_a IS DISTINCT FROM bug_b"
SQL["p4_groups"] = f"""
    WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
    r(id, g) AS (SELECT doc_idx, doc_idx FROM n UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id),
    g AS (SELECT id, min(g) AS group_id FROM r GROUP BY id), k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
    words AS (SELECT doc_idx, string_agg(term, ' ' ORDER BY term) AS w FROM s GROUP BY doc_idx)
    SELECT CAST(id AS BIGINT) AS doc_idx, CAST(min(id) OVER (PARTITION BY w) AS BIGINT) AS class_id, coalesce(n_links, 0) AS n_links, CAST(group_id AS BIGINT) AS group_id FROM g JOIN words ON words.doc_idx = id LEFT JOIN k ON k.a = id"""

_COUNTS = (
    f"{_TERMS}, tf AS (SELECT doc_idx, term, count(*) AS tf FROM terms GROUP BY ALL), m AS (SELECT doc_idx, max(tf) AS m, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_idx), "
    "df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), wanted AS (SELECT title_i AS i FROM lsa_m2_lo_sy_dw_sm_sc_ac UNION SELECT doc_j FROM lsa_m2_lo_sy_dw_sm_sc_ac)"
)
SQL["p5_found"] = f"""
    WITH {_COUNTS}, x AS (SELECT doc_idx, term, round(tf / m * ln((SELECT count(*) FROM features) / df), 6) AS score FROM tf JOIN m USING (doc_idx) JOIN df USING (term) WHERE doc_idx IN (SELECT i FROM wanted))
    SELECT doc_idx, term FROM (SELECT doc_idx, term, row_number() OVER (PARTITION BY doc_idx ORDER BY score DESC, term) AS r FROM x) WHERE r = 1"""
_CHOOSE = "lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0)"
_MASS = f"exp(({_CHOOSE.format('cf', 'x')}) + ({_CHOOSE.format('(t - cf)', '(n - x)')}) - ({_CHOOSE.format('t', 'n')}))"
SQL["p5_enrichment"] = f"""
    WITH {_COUNTS}, j AS (SELECT doc_idx, term, tf, df, cf, n, (SELECT CAST(sum(cf) AS BIGINT) FROM df) AS t FROM tf JOIN m USING (doc_idx) JOIN df USING (term) WHERE doc_idx IN (SELECT i FROM wanted)),
    d AS (SELECT DISTINCT tf, n, cf, t FROM j), y AS (SELECT d.*, x FROM d, unnest(range(tf, least(n, cf) + 1)) AS u(x) WHERE n - x <= t - cf),
    p AS (SELECT tf, n, cf, least(0, log10(sum({_MASS}))) AS log10_p FROM y GROUP BY tf, n, cf),
    r AS (SELECT j.*, log10_p, row_number() OVER (PARTITION BY doc_idx ORDER BY log10_p, term) AS rank, count(*) OVER (PARTITION BY doc_idx) AS tests FROM j JOIN p USING (tf, n, cf)),
    q AS (SELECT *, least(0, min(log10_p + log10(tests / rank)) OVER (PARTITION BY doc_idx ORDER BY rank DESC)) AS lq FROM r)
    SELECT doc_idx, term, tf, df, cf, round(log10_p, 5) AS log10_p, round(10 ** lq, 5) AS q, round(-lq, 5) + 0.0 AS score FROM q"""


def _same_look() -> str:
    """The characters of the test tables: full-width forms, joined letters, blanks, unseen marks, look-alikes."""
    text = "text"
    for joined, apart in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st")):
        text = f"replace({text}, '{joined}', '{apart}')"
    text = f"regexp_replace({text}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    blanks = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    a = wide[0] + "".join(map(chr, blanks)) + "ёЁїЇ"
    b = wide[1] + " " * len(blanks) + "ëËïÏ"
    for theirs, ours in (pair.split("=") for pair in _LETTERS.split()):
        a, b = a + theirs, b + ours
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"nfc_normalize(translate({text}, {quote(a)}, {quote(b)}))"


_LOOKS = f"look AS (SELECT doc_id, text, {_same_look()} AS look FROM documents WHERE text IS NOT NULL), seen AS (SELECT * FROM look WHERE regexp_matches(look, '\\S'))"
SQL["p8_found"] = f"WITH {_LOOKS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM seen a JOIN seen b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"
SQL["p8_classes"] = f"WITH {_LOOKS}, n AS (SELECT look, count(DISTINCT text) AS n_forms FROM seen GROUP BY look) SELECT doc_id, min(doc_id) OVER (PARTITION BY look) AS look_id, min(doc_id) OVER (PARTITION BY text) AS form_id, n_forms FROM seen JOIN n USING (look)"
