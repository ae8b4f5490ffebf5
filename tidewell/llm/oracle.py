"""SQL twins (DuckDB) of the operators that SQL can express.

Not here: sharding and packing (their digests and token ids have no SQL function), the classifier and
the whitening.
"""

from tidewell.llm import chat_format

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
#: Every word of every text with its place.
_W = "t AS (SELECT doc_id, source, {text} AS text FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, " + _WORDS.format(t="text") + " AS ws FROM t))"

OP2 = """WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id)::INT AS rank, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20"""


def _host_rule(x: str) -> str:
    mean, var = f"(SELECT avg({x}::DOUBLE / n) FROM h)", f"(SELECT var_pop({x}::DOUBLE / n) FROM h)"
    weight = f"least(greatest(CASE WHEN {var} > 0 THEN {mean} * (1 - {mean}) / {var} - 1 ELSE 1.0 END, 1.0), 1e6)"
    return f"({x} + {mean} * {weight}) / (n + {weight})"


OP3 = f"""WITH {_W.format(text="coalesce(text, '')")},
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n, sum(length(word))::BIGINT AS chars FROM w GROUP BY 1),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT t.doc_id, source, coalesce(k.n, 0) AS n_words, coalesce(k.chars, 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(lines, 0) AS n_lines
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS symbols_failed, 100 * n_dup_lines > 50 * n_lines AS lines_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS b, sum(symbols_failed::INT) AS s, sum(lines_failed::INT) AS d FROM f GROUP BY 1),
v AS (SELECT source, greatest({_host_rule("b")}, {_host_rule("s")}, {_host_rule("d")}) >= 0.6 AS refused FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT symbols_failed AND NOT lines_failed AND NOT refused AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP4 = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, i, line, holder IS NOT NULL AND holder <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY 1"""

_RE = {c: c.replace("\\", "\\\\").replace("|", "\\|").replace("[", "\\[").replace("]", "\\]").replace("$", "\\$") for c in chat_format.CONTROL}
_ESC = "regexp_replace(regexp_replace({x}, '<(\\\\*(?:" + "|".join(_RE[c][1:] for c in chat_format.CONTROL if c[0] == "<") + "))', '<\\\\\\1', 'g'), '\\[(\\\\*(?:" + "|".join(_RE[c][2:] for c in chat_format.CONTROL if c[0] == "[") + "))', '[\\\\\\1', 'g')"
OP5 = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum({len(chat_format.TURN + chat_format.TEXT + chat_format.END) + 1} + length({_ESC.format(x="role")}) + length({_ESC.format(x="text")}))::BIGINT AS formatted_chars FROM c GROUP BY 1"""

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
OP7 = f"""WITH RECURSIVE {_W.format(text=_LOWERED)},
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) FROM w GROUP BY 1 HAVING count(*) < 5),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d), m AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""

_NEXT = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, 13)]])
OP8 = f"""WITH {_W.format(text="coalesce(text, '')")}, g AS (SELECT doc_id, word, i, {_NEXT} AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, word, i, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM g),
m AS (SELECT doc_id, word, i, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / greatest(0.05::DOUBLE, coalesce(length(regexp_replace(text, '[#*$%&|<>]+', '', 'g'))::DOUBLE / nullif(length(text), 0) * least(1.0::DOUBLE, length(text)::DOUBLE / nullif(size, 0) / 4, 10 / (length(text)::DOUBLE / nullif(size, 0))), 1.0)) AS key FROM (SELECT *, len({_WORDS.format(t="coalesce(text, '')")})::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1), a AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
b AS (SELECT *, ((SELECT sum(source_size) FROM a) - coalesce(sum(cap) OVER o, 0))::DOUBLE / ((SELECT sum(w) FROM a) - coalesce(sum(w) OVER o, 0)) AS level FROM a WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, cap <= level * w AS filled FROM b), u AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (SELECT arg_min(level, cap::DOUBLE / w) FROM t WHERE NOT filled) * w END AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM u), q AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM p),
x AS (SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) <= rest AND size > 0 AS once FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
y AS (SELECT *, rest - coalesce(sum(size) FILTER (once) OVER (PARTITION BY source), 0) AS gap FROM x),
z AS (SELECT *, size > 0 AND NOT once AND abs(size - gap) < gap AS fits FROM y),
l AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), key, doc_id) = 1 AS last FROM z)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (whole + (once OR last)::INT) ELSE 0 END::BIGINT AS taken FROM l"""

#: crc32 of a text of ASCII characters, bit by bit.
_CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({x}, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [k::BIGINT FOR k IN range(8)]), lambda d, k: xor(d >> 1, 3988292384::BIGINT * (d & 1)))))"
#: A run of at least 24 words and three periods has 16 words that stand again a period on.
OP12 = f"""WITH t AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws, {_CRC.format(x="doc_id::VARCHAR")} AS h FROM documents), d AS (SELECT doc_id, h, h // 10 AS g, len(ws)::BIGINT AS n FROM t),
o AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM t), p AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d WHERE n > 0),
w AS (SELECT p.doc_id, x.i, y.word, n FROM p JOIN o x ON x.doc_id = p.doc_id JOIN o y ON y.doc_id = p.doc_id AND y.i = CASE WHEN h % 10 = 0 AND x.i >= a THEN a + (x.i - a) % p ELSE x.i END),
g AS (SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS g FROM w), f AS (SELECT * FROM g WHERE i + 16 <= n),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n), s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS part FROM m),
l AS (SELECT doc_id, p, min(i) AS start, max(i) + 16 + p - min(i) AS length FROM s GROUP BY doc_id, p, part), r AS (SELECT doc_id, start, length, min(p) AS period FROM l WHERE length >= greatest(24, 3 * p) GROUP BY 1, 2, 3),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1), c AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r), k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS s FROM w ANTI JOIN x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(c.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

_ITEM_WORDS = "regexp_extract_all({t}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEN = "[" + ", ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, 10)]]) + "]"
OP13 = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS.format(t=_LOWERED)} AS ws FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS.format(t=_LOWERED)} AS ws FROM benchmark),
v AS (SELECT item_id, least(10, len(ws)) AS k, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0), q AS (SELECT DISTINCT item_id, k, array_to_string(ws[j : j + k - 1], ' ') AS g FROM v), z AS (SELECT DISTINCT k FROM q),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d), t AS (SELECT doc_id, i, {_TEN} AS ten FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, t.k, item_id FROM (SELECT doc_id, i, k, array_to_string(ten[1 : k], ' ') AS g FROM t, z WHERE ten[k] IS NOT NULL) t JOIN q ON t.k = q.k AND t.g = q.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

SQL = {
    "op2_mtree_search": OP2, "op3_host_quality": OP3, "op4_line_dedup": OP4, "op5_chat_format": OP5, "op7_ngram_trie_join": OP7, "op8_suffix_tree_dedup": OP8, "op10_mix_sources": OP10,
    "op12_periodic_runs": OP12, "op13_suffix_array_decontamination": OP13,
}
