"""The corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import chat, licences, quality

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str, table: str, key: str, lower: bool = True) -> str:
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if lower else "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}"


def _quality(risk: float, level: float) -> str:
    """The tables of quality rules up to ``chosen`` (stratum, signal, cutoff) and ``v`` (a row per document and signal)."""
    signal = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_words, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "word_length": "word_chars / greatest(n_words, 1)", "upper_share": "n_upper / greatest(word_chars, 1)", "bang_share": "n_bangs / greatest(n_words, 1)",
    }
    grid = ", ".join(f"('{s}', {t}, {c}::DOUBLE)" for s, cuts in quality.cutoffs().items() for t, c in enumerate(cuts))
    chains = ", ".join(f"({i}, '{s}')" for i, chain in enumerate(quality.chains()) for s in chain)
    shares = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(quality.levels(level)))
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{s}' AS signal, {e} AS v FROM m" for s, e in signal.items())
    tail = lambda k, n: f"list_sum(list_transform(range(CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({risk}) + ({n} - i) * ln(1 - {risk}))))"
    enough = lambda n: f"{n} * ln(1 - {risk}) <= ln((SELECT share FROM shares WHERE chain = 0) / n_strata)"
    return f"""
    WITH w AS (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
    r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
    m0 AS (SELECT w.doc_id, coalesce('=' || lang, '') AS stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACED}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACED}')))) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_bangs
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
    m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
    known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    v AS ({values}), grid(signal, step, cutoff) AS (VALUES {grid}), chains(chain, signal) AS (VALUES {chains}), shares(chain, share) AS (VALUES {shares}),
    first AS (SELECT doc_id, stratum, chain, good, {quality.STEPS} - max((SELECT count(*) FROM grid WHERE grid.signal = v.signal AND cutoff < v)) AS step FROM v JOIN known USING (doc_id) JOIN chains USING (signal) WHERE NOT base_failed GROUP BY ALL),
    steps AS (SELECT stratum, chain, step FROM (SELECT DISTINCT stratum FROM m), (SELECT DISTINCT chain FROM chains), range({quality.STEPS}) s(step)),
    c AS (SELECT steps.*, count(doc_id) FILTER (good) AS n, count(doc_id) FILTER (good AND first.step <= steps.step) AS k, count(doc_id) FILTER (NOT good AND first.step <= steps.step) AS bad
      FROM steps LEFT JOIN first ON first.stratum = steps.stratum AND first.chain = steps.chain GROUP BY ALL),
    t0 AS (SELECT c.*, share / n_strata AS bound, n_strata, {enough('n')} AS alone FROM c JOIN shares USING (chain), (SELECT count(DISTINCT stratum) FILTER (n > 0) AS n_strata FROM c) WHERE n_strata > 0),
    t1 AS (SELECT *, sum(n) FILTER (NOT alone) OVER r AS pool_n, sum(k) FILTER (NOT alone) OVER r AS pool_k, sum(bad) OVER r AS all_bad FROM t0 WINDOW r AS (PARTITION BY chain, step)),
    t2 AS (SELECT *, bool_and(CASE WHEN alone THEN {tail('k', 'n')} <= bound END) OVER (PARTITION BY stratum, chain ORDER BY step) AS own FROM t1),
    t3 AS (SELECT *, CASE WHEN {enough('pool_n')} THEN {tail('pool_k', 'pool_n')} <= bound ELSE coalesce(bool_and(own) OVER (PARTITION BY chain, step), false) END AND k <= {risk} * n AS lent FROM t2),
    t4 AS (SELECT *, coalesce(own, bool_and(lent) OVER (PARTITION BY stratum, chain ORDER BY step)) AS taken FROM t3),
    best AS (SELECT * FROM t4 WHERE taken QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN alone THEN bad ELSE all_bad END DESC, k, step DESC, chain) = 1),
    chosen AS (SELECT stratum, signal, cutoff FROM best JOIN chains USING (chain) JOIN grid USING (signal, step))"""


def quality_rules() -> str:
    return f"""{_quality(quality.RISK, quality.LEVEL)},
    above AS (SELECT DISTINCT doc_id FROM v JOIN chosen ON chosen.stratum = v.stratum AND chosen.signal = v.signal WHERE v > cutoff)
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND above.doc_id IS NULL AS kept FROM m LEFT JOIN above ON above.doc_id = m.doc_id"""


def quality_cutoffs(risk: float, level: float) -> str:
    return f"""{_quality(risk, level)}
    SELECT chosen.stratum, chosen.signal, cutoff, count(doc_id) FILTER (v > cutoff AND NOT base_failed) AS rejected FROM chosen LEFT JOIN v ON v.stratum = chosen.stratum AND v.signal = chosen.signal GROUP BY ALL"""


def near_duplicates() -> str:
    return f"""
    WITH RECURSIVE w AS ({words(SPACED, 'documents', 'doc_id')}),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n"""


def decontamination() -> str:
    window = "CASE WHEN len(ws) >= 13 THEN ws[i:i + 12] ELSE ws END"
    return f"""
    WITH d AS ({words(ALNUM, 'documents', 'doc_id')}), b AS ({words(ALNUM, 'benchmark', 'item_id')}),
    t AS (SELECT DISTINCT item_id, {window} AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT len(g) AS k FROM t),
    o AS (SELECT doc_id, i, k, ws[i:i + k - 1] AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
    h AS (SELECT doc_id, i, k, item_id FROM o JOIN t USING (g)),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def chat_digests() -> str:
    said = "</s>[INST] ok [/INST]"
    escaped = r"length(replace(replace({0}, '\', '\\'), '<|', '<\|'))"
    overhead = len(chat.ROLE + chat.TEXT + chat.END)
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS all_, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
      sum({overhead} + {escaped.format('role')} + {escaped.format('text')}) AS chars FROM c WHERE conv_id IS NOT NULL GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(all_) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""


def license_scan() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {i}, {n}, [{', '.join(map(quoted, grams))}])" for name, i, n, grams in licences.template_rows())
    return f"""
    WITH t(licence, template, n, b) AS (VALUES {rows}),
    l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS x FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS l FROM documents)),
    u AS (SELECT doc_id, unit, regexp_extract_all(x, '[a-z0-9]+') AS ws FROM l UNION ALL SELECT doc_id, 0, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents WHERE contains(text, chr(10))),
    s AS (SELECT doc_id, unit, k, regexp_extract_all(x, '[a-z0-9]+') AS ws FROM (SELECT doc_id, unit, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS x FROM (SELECT doc_id, unit, regexp_split_to_array(x, '[.!?]+[ \t]+') AS p FROM l))),
    w AS (SELECT doc_id, flatten(list(ws ORDER BY unit, k)) AS ws, list(unit ORDER BY unit, k) AS units, list(len(ws) ORDER BY unit, k) AS sizes FROM s WHERE len(ws) > 0 GROUP BY doc_id),
    begins AS (SELECT doc_id, ws, unnest(units) AS unit, unnest(list_transform(range(1, len(sizes) + 1), lambda i: 1 + coalesce(list_sum(list_slice(sizes, 1, i - 1)), 0))) AS place FROM w),
    near AS (SELECT doc_id, unit, list_slice(ws, place, place + {max(n for _, _, n, _ in licences.template_rows())} - 1) AS ws FROM begins),
    v AS (SELECT doc_id, unit, n AS sole, list_slice(ws, 1, n) AS ws FROM near, (SELECT DISTINCT n FROM t) UNION ALL SELECT doc_id, unit, NULL, ws FROM u),
    a AS (SELECT doc_id, unit, sole, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a FROM (SELECT DISTINCT * FROM v) WHERE len(ws) > 1),
    d AS (SELECT doc_id, unit, licence, template, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM a, t WHERE coalesce(sole = n, true) AND 2 * least(len(a), len(b)) >= {licences.LEAST} * (len(a) + len(b)))
    SELECT doc_id, CAST(unit AS INTEGER) AS unit, licence, template, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence DESC, template) AS r FROM d WHERE dice >= {licences.LEAST}) WHERE r = 1"""
