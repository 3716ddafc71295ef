"""SQL that must give the rows of the queries, where SQL can express them."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = ("CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END")
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: {step}), 4294967295::BIGINT)"


#: Windows of 13 words that an earlier document holds, by their whole word sequence.
REPEATS = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
    win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h FROM p),
    low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
    hit AS (SELECT win.doc_id, win.i FROM win JOIN low USING (h) WHERE first < win.doc_id),
    gone AS (SELECT DISTINCT doc_id, i + d AS j FROM hit, range(0, 13) AS r(d)),
    word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
    kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.j) AS kept, count(*) AS n
             FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

#: Pages by payload; a SHA-1 in base 32, five bits a letter.
WARC = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS sha FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY sha, size) AS keeper FROM p)
    SELECT page_id, size AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 AS INTEGER), 1)),
             'string_agg', '') AS payload_digest,
           CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < keeper THEN keeper END AS refers_to
    FROM k"""

_SPACE = r"[\x20\x09-\x0D]"
#: Row by row, the cheapest prefix for each last role, by (cost, audit).
REPAIR = rf"""
    WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations),
    damaged AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM keyed, range(2) AS r(again) WHERE how <> 0 AND (again = 0 OR how = 3)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        substr(role, 1, 1) AS ini FROM damaged),
    faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?]{_SPACE}*$') THEN 'truncated' ELSE 'fine' END AS fault,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    best(conv_id, i, last, way) AS (
        SELECT conv_id, 0::BIGINT, 'n', {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} FROM ids
        UNION ALL
        SELECT conv_id, i + 1, last, min(way) FROM (
            WITH inserted AS (
                SELECT conv_id, i, last, way FROM best
                UNION ALL
                SELECT conv_id, i, CASE last WHEN 'u' THEN 'a' ELSE 'u' END, {{'cost': way.cost + 5, 'audit': way.audit || 'I',
                    'lines': list_append(way.lines, CASE last WHEN 'u' THEN 'assistant:' ELSE 'user:' END)}} FROM best),
            met AS (SELECT p.conv_id, p.i, p.last, p.way, f.role, f.text, f.ini, f.fault, CASE p.last WHEN 'u' THEN 'a' ELSE 'u' END AS wanted,
                CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS more
                FROM inserted p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)
            SELECT conv_id, i, last, {{'cost': way.cost + 2, 'audit': way.audit || 'D', 'lines': way.lines}} AS way FROM met
            UNION ALL
            SELECT conv_id, i, ini, {{'cost': way.cost + more, 'audit': way.audit || 'K', 'lines': list_append(way.lines, role || ':' || text)}}
                FROM met WHERE fault NOT IN ('blank', 'duplicate') AND (ini = wanted OR ini = 's' AND last = 'n')
            UNION ALL
            SELECT conv_id, i, wanted, {{'cost': way.cost + 1 + more, 'audit': way.audit || 'R',
                'lines': list_append(way.lines, CASE wanted WHEN 'a' THEN 'assistant:' ELSE 'user:' END || text)}}
                FROM met WHERE fault NOT IN ('blank', 'duplicate')) GROUP BY conv_id, i, last),
    ended AS (SELECT b.conv_id, min(CASE b.last WHEN 'u' THEN {{'cost': way.cost + 5, 'audit': way.audit || 'I',
        'lines': list_append(way.lines, 'assistant:')}} ELSE way END) AS way
        FROM best b JOIN stats t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.n WHERE b.last <> 's' GROUP BY b.conv_id)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost,
        coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN stats t ON ids.conv_id IS NOT DISTINCT FROM t.conv_id
    LEFT JOIN ended e ON ids.conv_id IS NOT DISTINCT FROM e.conv_id"""


def _hashed(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


#: Level by level, two trees: of each language, and of the languages' roots.
MERKLE = f"""
    WITH RECURSIVE base AS (SELECT doc_id, lang, n_chars, {" || ".join(_hashed(c) for c in ("doc_id", "source", "lang"))} AS head,
        {_hashed("text")} AS tail, {_hashed("n_chars")} AS size, {_hashed("(n_chars + 1)")} AS size_more,
        coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 0, false) AS hit FROM documents),
    leafs AS (SELECT doc_id, lang, sha256(head || size || tail) AS leaf,
        sha256(head || CASE WHEN hit THEN size_more ELSE size END || tail) AS shown FROM base),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leafs),
    up(lang, level, i, h, m) AS (
        SELECT lang, 0, r, leaf, count(*) OVER (PARTITION BY lang) FROM placed
        UNION ALL
        SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM up WHERE m > 1
        GROUP BY lang, level, i // 2),
    subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM up WHERE m = 1),
    top(level, i, h, m) AS (
        SELECT 0, r, h, count(*) OVER () FROM subroots
        UNION ALL
        SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM top WHERE m > 1 GROUP BY level, i // 2),
    -- the way of each leaf: at each level its place and sibling, first in its language's tree, then in that of the roots
    ways AS (
        SELECT p.doc_id, p.lang, p.r, u.level AS nth, (p.r >> u.level) % 2 AS odd, s.h AS sibling
        FROM placed p JOIN (SELECT DISTINCT lang, level FROM up WHERE m > 1) u ON u.lang IS NOT DISTINCT FROM p.lang
        LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.i = xor(p.r >> u.level, 1)
        UNION ALL
        SELECT p.doc_id, p.lang, p.r, 100 + u.level, (g.r >> u.level) % 2, s.h
        FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT level FROM top WHERE m > 1) u
        LEFT JOIN top s ON s.level = u.level AND s.i = xor(g.r >> u.level, 1)),
    steps AS (SELECT *, row_number() OVER (PARTITION BY lang, r ORDER BY nth) AS step FROM ways),
    proofs AS (SELECT lang, r, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof, max(step) AS n FROM steps GROUP BY lang, r),
    fold(lang, r, step, h) AS (
        SELECT lang, r, 0::BIGINT, shown FROM placed
        UNION ALL
        SELECT f.lang, f.r, f.step + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.sibling, '') || f.h ELSE f.h || coalesce(s.sibling, '') END)
        FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.r = f.r AND s.step = f.step + 1)
    SELECT p.doc_id, p.leaf, g.h AS subroot, t.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM top WHERE m = 1) t
    LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.r = p.r
    JOIN fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.r = p.r AND f.step = coalesce(q.n, 0)"""

SQL = {"op9_repeats": REPEATS, "op11_warc": WARC, "op12_repair": REPAIR, "op13_merkle": MERKLE}
