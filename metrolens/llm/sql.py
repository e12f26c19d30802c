"""DuckDB SQL of the operators' queries, over the raw tables."""

from __future__ import annotations

from metrolens.llm import licenses, rules, warc

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules() -> str:
    stats = rf"""
    d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
    g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
    h AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM g),
    r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM h),
    c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    s AS (SELECT rid, doc_id, lang, source, len(ws) AS n_words,
                 coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM l LEFT JOIN c USING (rid))"""
    values = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{name}' AS metric, CASE WHEN {b} > 0 THEN 1000 * {a} // {b} ELSE 0 END AS v, "
        f"{b} AS units, {noise} AS noise, {least} AS least FROM s WHERE n_words > 0" for name, a, b, noise, least in rules.METRICS)
    bits = f"greatest(length(bin(v)) - {rules._BITS}, 0)"
    point = lambda q: f"min(CASE WHEN upto * 100 >= rows_ * {q} THEN bucket END)"

    def level(name: str, keys: str) -> str:
        part = (keys + ", " if keys else "") + "metric"
        return f"""
    {name}n AS (SELECT {part}, bucket, count(*) AS n FROM b GROUP BY ALL),
    {name}r AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto,
                       sum(n) OVER (PARTITION BY {part}) AS rows_ FROM {name}n),
    {name} AS (SELECT {part}, max(rows_) AS rows_, {point(25)} AS q25, {point(50)} AS q50, {point(75)} AS q75
               FROM {name}r GROUP BY ALL)"""
    pick = lambda c: (f"CASE WHEN q1.rows_ >= {rules.MIN_ROWS} THEN q1.{c} "  # noqa: E731
                      f"WHEN q2.rows_ >= {rules.MIN_ROWS} THEN q2.{c} ELSE q3.{c} END AS {c}")
    return f"""WITH {stats},
    v AS ({values}),
    b AS (SELECT *, (v >> {bits}) << {bits} AS bucket FROM v),
    {level('q1', 'lang, source')}, {level('q2', 'lang')}, {level('q3', '')},
    f AS (SELECT q1.lang, q1.source, q1.metric, {pick('q25')}, {pick('q50')}, {pick('q75')},
                 CASE WHEN q2.rows_ >= {rules.MIN_ROWS} THEN q2.q75 - q2.q50 ELSE q3.q75 - q3.q50 END AS wider
          FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.metric = q2.metric
                  JOIN q3 ON q1.metric = q3.metric),
    e AS (SELECT rid, units, noise, least,
                 greatest(v - (q50 + {rules.SPREADS} * least(q75 - q50, greatest(q50 - q25, wider))),
                          q50 - {rules.SPREADS} * (q50 - q25) - v, 0)::DOUBLE AS beyond
          FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
                        AND v.metric = f.metric),
    k AS (SELECT rid, bool_and(beyond <= least OR beyond * beyond * units <= noise * noise) AS inside FROM e GROUP BY rid),
    o AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s LEFT JOIN k USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(inside, false) AS kept FROM o"""


def near_duplicates(n: int = 3, percent: int = 85) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS sh
          FROM d),
    u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
    r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
    SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
    FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""


def license_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        t = f"translate({text}, '{licenses.UPPER}', '{licenses.LOWER}')"
        t = f"regexp_replace({t}, {quoted(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
        t = f"' ' || regexp_replace({t}, '{licenses.NOT_WORD}', ' ', 'g') || ' '"
        for a, b in licenses.SPELLINGS:
            t = f"replace({t}, ' {a}', ' {b}')"
        return f"md5(trim({t}))"

    values = lambda known: "VALUES " + ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    return f"""WITH
    w AS (SELECT {canonical('t')} AS k, min(i) AS license_id FROM ({values(licenses.known_texts())}) v(i, t) GROUP BY 1),
    s AS (SELECT {canonical('t')} AS k, min(i) AS notice_id FROM ({values(licenses.known_notices())}) v(i, t) GROUP BY 1),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
    f AS (SELECT rid, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids, count(*) AS n_notices
          FROM l JOIN s ON {canonical('line')} = s.k GROUP BY rid)
    SELECT doc_id, {canonical('t')} AS text_digest, license_id, coalesce(notice_ids, '') AS notice_ids,
           coalesce(n_notices, 0) AS n_notices
    FROM d LEFT JOIN w ON {canonical('t')} = w.k LEFT JOIN f USING (rid)"""


def warc_transactions() -> str:
    digits = " || ".join(f"substr('{warc.BASE32}', ((('0x' || substr(h, {g * 5 + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
                         for g in range(8) for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id, url) AS n,
                 first(page_id) OVER (PARTITION BY h ORDER BY page_id, url) AS first_page FROM p)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {digits} AS payload_digest,
           CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN n > 1 THEN first_page END AS refers_to FROM r"""


def chat_trees() -> str:
    said = "\\### Assistant: </turn> ok"
    escaped = r"replace(replace(replace({}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"
    label = (r"CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE "
             r"CASE WHEN role IN ('System', 'User', 'Assistant') THEN '\' ELSE '' END || replace("
             + escaped.format("role") + r", ':', '\:') END")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
    t AS (SELECT *, '### ' || {label} || ': ' || {escaped.format('text')} || '</turn>' || chr(10) AS piece FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(piece))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


def dictionary_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    d{i} AS (SELECT p.rid, p.part, any_value(p.x) AS x,
                    min(list_sum(list_transform(range(1, w + 1), lambda j: (p.x[j] - c.c[j]) * (p.x[j] - c.c[j])))::BIGINT * {entries}
                        + c.entry) AS best
             FROM p JOIN c{i} c USING (part) CROSS JOIN width GROUP BY p.rid, p.part),
    a{i} AS (SELECT rid, part, x, best % {entries} AS entry, best // {entries} AS error FROM d{i})""")
        if i < rounds:
            steps.append(f"""
    m{i} AS (SELECT part, entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, width, unnest(range(1, w + 1)) r(j) GROUP BY ALL),
    f{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{i} GROUP BY ALL),
    c{i + 1} AS (SELECT part, entry, coalesce(f.c, c{i}.c) AS c FROM c{i} LEFT JOIN f{i} f USING (part, entry))""")
    return f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding,
           list_transform(embedding, lambda x: floor(256.0 * x)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    width AS (SELECT max(len(v)) // {parts} AS w FROM e),
    p AS (SELECT rid, part, v[part * w + 1:(part + 1) * w] AS x FROM e, width, unnest(range({parts})) r(part)),
    s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS entry FROM e),
    c0 AS (SELECT p.part, s.entry, p.x AS c FROM p JOIN s USING (rid) WHERE s.entry < {entries}),
    {','.join(steps)},
    k AS (SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
          FROM a{rounds} GROUP BY rid),
    b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM k JOIN e USING (rid) CROSS JOIN b"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan(), "op6_warc_transactions": warc_transactions(),
            "op2_superminhash_dedup": near_duplicates(), "op11_chat_trees": chat_trees(),
            "op13_dictionary_codes": dictionary_codes(),
            "op10_quality_rules": quality_rules()}
