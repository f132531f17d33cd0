"""DuckDB SQL of the manifest and conversation queries, made from their contracts alone."""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string."""
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {step}))"


def leaf_field(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar)::varchar || ':' || ({value})::varchar, '-')"


def leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(leaf_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


MERKLE = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf,
    CASE WHEN {crc32('doc_id::varchar')} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS id FROM hashed),
nodes AS (SELECT lang, 0 AS level, place, leaf AS digest FROM leaves
    UNION ALL SELECT lang, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS width FROM nodes) WHERE width > 1 GROUP BY lang, place // 2),
ends AS (SELECT lang, max(level) AS height, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes GROUP BY lang),
tops AS (SELECT 0 AS level, place, subroot AS digest FROM ends
    UNION ALL SELECT any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER () AS width FROM tops) WHERE width > 1 GROUP BY place // 2),
summit AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM tops),
steps AS (SELECT l.id, w.level AS step, (l.place >> w.level) & 1 AS odd, s.digest
    FROM leaves l JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang JOIN (SELECT DISTINCT lang, level FROM nodes) w ON w.lang IS NOT DISTINCT FROM l.lang AND w.level < e.height
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = w.level AND s.place = xor(l.place >> w.level, 1)
    UNION ALL SELECT l.id, e.height + w.level, (e.place >> w.level) & 1, s.digest
    FROM summit, leaves l JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang, (SELECT DISTINCT level FROM tops) w
    LEFT JOIN tops s ON s.level = w.level AND s.place = xor(e.place >> w.level, 1) WHERE w.level < summit.height),
folds AS (SELECT id, 0 AS step, claim AS digest FROM leaves
    UNION ALL SELECT f.id, f.step + 1, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN odd = 1 THEN s.digest || f.digest ELSE f.digest || s.digest END)
    FROM folds f JOIN steps s USING (id, step)),
folded AS (SELECT id, arg_max(digest, step) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, sha256(coalesce(string_agg(digest, '' ORDER BY step), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (id) GROUP BY id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang JOIN folded USING (id) JOIN proofs USING (id), summit
"""

#: Each repeat of a control string gets one code point more; the strings themselves by role: <s> once, [INST] [/INST], </s>, [SYS] [/SYS].
CHAT = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|SYS\\]|/SYS\\]|ROLE\\]|SAYS\\]|/ROLE\\]|\\|endoftext\\|>)', '\\1\\\\\\2\\3', 'g')) AS chars,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 11 ELSE 19 + length(role) END AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(chars + marks))::bigint AS formatted_chars FROM sized GROUP BY conv_id
"""

REPAIR = f"""
WITH RECURSIVE read AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
    {crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 AS fate FROM conversations),
copies AS (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM read WHERE fate <> 0),
spoilt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE r END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(t), copy) AS i FROM copies),
coded AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM spoilt),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id),
heads(state, cost, edits, now, said) AS (VALUES ('', 0, '', '', []::varchar[]), ('', 5, 'I', 'u', ['user:']), ('', 10, 'II', 'a', ['user:', 'assistant:']),
    ('s', 0, '', 's', []), ('s', 5, 'I', 'u', ['user:']), ('s', 10, 'II', 'a', ['user:', 'assistant:']),
    ('u', 0, '', 'u', []), ('u', 5, 'I', 'a', ['assistant:']), ('u', 10, 'II', 'u', ['assistant:', 'user:']),
    ('a', 0, '', 'a', []), ('a', 5, 'I', 'u', ['user:']), ('a', 10, 'II', 'a', ['user:', 'assistant:'])),
paths AS (SELECT conv_id, 0::bigint AS i, '' AS state, struct_pack(cost := 0, audit := '', said := []::varchar[]) AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT p.conv_id, any_value(c.i), e.next, min(struct_pack(cost := p.best.cost + h.cost + e.cost + CASE WHEN e.edit <> 'D' AND c.fault = 'truncated' THEN 5 ELSE 0 END,
        audit := p.best.audit || h.edits || e.edit, said := list_concat(p.best.said, h.said, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [c.role || ':' || c.text] ELSE [e.named || ':' || c.text] END)))
    FROM paths p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1 JOIN heads h ON h.state = p.state,
    (VALUES ('D', 2, '', '', '*'), ('K', 0, 's', 's', ''), ('K', 0, 'u', 'u', ''), ('K', 0, 'u', 'u', 's'), ('K', 0, 'u', 'u', 'a'), ('K', 0, 'a', 'a', 'u'),
        ('R', 1, 'u', 'user', ''), ('R', 1, 'u', 'user', 's'), ('R', 1, 'u', 'user', 'a'), ('R', 1, 'a', 'assistant', 'u')) AS m(edit, cost, next, named, state),
    LATERAL (SELECT m.edit, m.cost, m.named, CASE WHEN m.edit = 'D' THEN h.now ELSE m.next END AS next) AS e
    WHERE (m.edit = 'D' OR m.state = h.now AND c.fault NOT IN ('blank', 'duplicate')) AND (m.edit <> 'K' OR c.initial = m.named)
    GROUP BY p.conv_id, e.next),
ends AS (SELECT conv_id, min(struct_pack(cost := best.cost + t.cost, audit := best.audit || t.edits, said := list_concat(best.said, t.said))) AS best
    FROM paths JOIN (VALUES ('', 0, '', []::varchar[]), ('a', 0, '', []), ('u', 5, 'I', ['assistant:']), ('s', 10, 'II', ['user:', 'assistant:'])) AS t(state, cost, edits, said) USING (state)
    WHERE i = (SELECT count(*) FROM coded c WHERE c.conv_id IS NOT DISTINCT FROM paths.conv_id) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    best.cost::bigint AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
