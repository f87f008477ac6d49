"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

URL_FILTER = """
    WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES
        ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
        ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
        ('org/es/', 'org', '/es/', 'block')),
    cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM cut),
    whole AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path, row_number() OVER () AS n FROM parts),
    fit AS (SELECT w.*, r.rule, r.verdict, row_number() OVER (PARTITION BY w.n ORDER BY length(r.rule) DESC) AS k
            FROM whole w LEFT JOIN rules r ON (w.host = r.rule_host OR ends_with(w.host, '.' || r.rule_host)) AND starts_with(w.path, r.rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1"""

#: A crc is a fold over bytes with a table of 256 steps; it runs once for each distinct feature.
RESAMPLING = """
    WITH RECURSIVE step(v, c, k) AS (
        SELECT v, v, 0 FROM range(256) r(v)
        UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY v) AS steps FROM step WHERE k = 8),
    digit AS (SELECT map(list(d ORDER BY d), list(n ORDER BY d)) AS value FROM (SELECT unnest(list_value('0','1','2','3','4','5','6','7','8','9','A','B','C','D','E','F')) AS d, unnest(range(16)) AS n)),
    texts AS (SELECT row_number() OVER () AS n, 1 AS corpus, doc_id, coalesce(text, '') AS text FROM documents
              UNION ALL SELECT -row_number() OVER (), 0, NULL, coalesce(text, '') FROM benchmark),
    cut AS (SELECT n, corpus, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM texts),
    runs AS (SELECT n, corpus, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM cut),
    named AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
    hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: (value[h[2 * i + 1]] * 16 + value[h[2 * i + 2]])::BIGINT)),
               lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM named, crc, digit),
    places AS (SELECT n, corpus, bucket FROM runs JOIN hashed USING (feature)),
    totals AS (SELECT count(*) FILTER (corpus = 1) AS s_all, count(*) FILTER (corpus = 0) AS t_all FROM places),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000)::DOUBLE / ((s + 1) * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
              FROM (SELECT bucket, count(*) FILTER (corpus = 1) AS s, count(*) FILTER (corpus = 0) AS t FROM places GROUP BY bucket), totals),
    sums AS (SELECT n, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM places JOIN gains USING (bucket) WHERE corpus = 1 GROUP BY n),
    scored AS (SELECT doc_id, len(words) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
               FROM cut LEFT JOIN sums USING (n) WHERE corpus = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features) AS place, count(*) OVER (PARTITION BY may) AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * able // 100 THEN place END AS rank FROM ranked"""

#: An escape goes after each first character of a control string, so the rendered length is a count of these.
CHAT = """
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\\\*(s>|/s>|\\|endoftext\\|>)|\\[\\\\*/?(SYS|INST|ROLE)\\]|\\[\\\\*/TURN\\]')) AS inside FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(inside + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id"""


def vector_codes(rounds: int = 2, entries: int = 64, parts: int = 16, width: int = 4) -> str:
    """Codes by all distances, in plain joins: a round is two steps of the WITH list."""
    sides = range(1, width + 1)
    distance = " + ".join(f"(p.x{j} - b.x{j}) * (p.x{j} - b.x{j})" for j in sides)
    found = f"SELECT p.n, p.part, min(({distance}) * 256 + b.entry) AS best, " + ", ".join(f"any_value(p.x{j}) AS x{j}" for j in sides) + " FROM points p JOIN book{0} b ON p.part = b.part GROUP BY p.n, p.part"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"found{k} AS ({found.format(k)})")
        if k < rounds:
            means = ", ".join(f"CAST(floor(sum(x{j})::DOUBLE / count(*)) AS BIGINT) AS x{j}" for j in sides)
            taken = ", ".join(f"coalesce(m.x{j}, b.x{j}) AS x{j}" for j in sides)
            steps.append(f"mean{k} AS (SELECT part, best & 255 AS entry, {means} FROM found{k} GROUP BY 1, 2)")
            steps.append(f"book{k + 1} AS (SELECT b.part, b.entry, {taken} FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)")
    values = ", ".join(f"x{j}" for j in sides)
    return f"""
    WITH kept AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
                  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    points AS (SELECT n, part, {", ".join(f"q[part * {width} + {j}] AS x{j}" for j in sides)} FROM kept, range({parts}) r(part)),
    firsts AS (SELECT n, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
    book0 AS (SELECT part, entry, {values} FROM points JOIN firsts USING (n)),
    {", ".join(steps)},
    digest AS (SELECT sha256(string_agg(concat_ws(',', {values}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
    coded AS (SELECT n, string_agg(printf('%02x', (best & 255)::INTEGER), '' ORDER BY part) AS code, CAST(sum(best >> 8) AS BIGINT) AS error FROM found{rounds} GROUP BY n)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n), digest"""


ORACLE_SQL = {"op9_url_filter": URL_FILTER, "op11_resampling": RESAMPLING, "op12_chat": CHAT, "op13_vector_codes": vector_codes()}
