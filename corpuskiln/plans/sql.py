"""DuckDB SQL of the queries in registry."""

from __future__ import annotations

_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = rf"(CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '({_END})$', ''), '{_END}') END)"
_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_SENTENCES = f"list_transform({_LINES}, lambda l: list_filter(string_split({_strip('l')}, ' '), lambda w: w <> ''))"


def _joined(s: str, between: str = " ") -> str:
    return f"coalesce(array_to_string(list_transform({s}, lambda x: coalesce(array_to_string(x, '{between}'), '')), chr(10)), '')"


#: t: doc_id, s (sentences); n: the same in lower case; w: doc_id, pos, token.
_T = f"t AS (SELECT doc_id, {_SENTENCES} AS s FROM documents)"
_N = f"{_T}, n AS (SELECT doc_id, list_transform(s, lambda x: list_filter(list_transform(x, lambda w: lower(w)), lambda w: w <> '')) AS s FROM t)"
_W = f"{_N}, w AS (SELECT doc_id, generate_subscripts(f, 1) AS pos, unnest(f) AS token FROM (SELECT doc_id, flatten(s) AS f FROM n))"


def _vocab(threshold: int = 0, max_prop: float = 1.0, limit: int | None = None) -> str:
    """w, words (all, with df and place) and v (id, token, df)."""
    cut = f"ORDER BY df DESC, fd, fp LIMIT {limit}" if limit else ""
    return f"""{_W},
words AS (SELECT token, count(DISTINCT doc_id) AS df, min(doc_id) AS fd, arg_min(pos, (doc_id, pos)) AS fp FROM w GROUP BY token),
kept AS (SELECT * FROM words WHERE df >= {threshold} AND df <= floor((SELECT count(*) FROM documents) * {max_prop}::DOUBLE) {cut}),
v AS (SELECT row_number() OVER (ORDER BY fd, fp) - 1 AS id, token, df FROM kept)"""


_V = _vocab(3, 0.5)
#: m: doc_id, sent, pos, token, id (null outside)
_M = f"""{_V},
sents AS (SELECT doc_id, generate_subscripts(s, 1) AS sent, unnest(s) AS x FROM n),
toks AS (SELECT doc_id, sent, generate_subscripts(x, 1) AS pos, unnest(x) AS token FROM sents),
m AS (SELECT toks.*, v.id, v.token AS known FROM toks LEFT JOIN v USING (token))"""
_ALL = "SELECT doc_id FROM documents"


def _hash(seed: int, column: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {column}), 1, 8) AS BIGINT)"


_PUNCT = r"[^\p{L}\p{N}]"
ORACLE_SQL: dict[str, str] = {
    "simple_tokenize": f"WITH {_T} SELECT doc_id, {_joined('s')} AS tokenized FROM t",
    "char_tokenize": f"""WITH c AS (SELECT doc_id, list_transform({_LINES}, lambda l: list_filter(string_split(l, ''), lambda c: c <> '')) AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_lines, CAST(coalesce(list_sum(list_transform(s, lambda x: len(x))), 0) AS BIGINT) AS n_chars, coalesce(array_to_string(list_transform(s, lambda x: coalesce(array_to_string(x, ' '), '')), chr(10)), '') AS chars FROM c""",
    "text_normalize": f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform({_LINES.replace("text", "lower(text)")}, lambda l: {_strip('l')}), lambda l: l <> ''), chr(10)), '') AS text FROM documents""",
    "token_normalize": f"""WITH {_T}, c AS (SELECT doc_id, list_filter(list_transform(s, lambda x: list_filter(list_transform(x, lambda w: regexp_replace(regexp_replace(lower(w), '{_PUNCT}', '', 'g'), '[0-9]', '', 'g')), lambda w: len(w) >= 3)), lambda x: len(x) > 0) AS s FROM t)
SELECT doc_id, {_joined('s')} AS tokenized FROM c""",
    "token_normalize_only_punct": f"""WITH {_T}, c AS (SELECT doc_id, list_transform(list_filter(s, lambda x: len(list_filter(x, lambda w: NOT regexp_full_match(w, '[\\p{{L}}\\p{{N}}]*'))) > 0), lambda x: list_filter(x, lambda w: len(w) > 2)) AS s FROM t)
SELECT doc_id, {_joined('s')} AS tokenized FROM c""",
    "europarl_clean": "",
    "count_invalid": "",
    "xml_extract": r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1) AS p, regexp_extract_all(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1) AS t FROM pages),
y AS (SELECT page_id, list_transform(p, lambda z: replace(replace(replace(replace(replace(regexp_replace(z, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS p,
 list_transform(t, lambda z: replace(replace(replace(replace(replace(regexp_replace(z, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS t FROM x)
SELECT page_id, t[1] AS title, CAST(len(p) AS BIGINT) AS n_nodes, coalesce(array_to_string(p, chr(10)), '') AS text FROM y""",
    "nist_tokenize": rf"""WITH c AS (SELECT doc_id, list_transform({_LINES}, lambda l: list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(l),
 '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')) AS s FROM documents)
SELECT doc_id, {_joined('s')} AS tokenized FROM c""",
    "first_words_filter": f"""WITH {_T}, c AS (SELECT doc_id, list_transform(s, lambda x: list_concat(x[1:1], list_filter(x[2:], lambda w: NOT regexp_matches(w, '^[A-Z]')))) AS s FROM t)
SELECT doc_id, {_joined('s')} AS tokenized FROM c""",
    "format_documents_truncated": f"WITH {_T}, c AS (SELECT doc_id, {_joined('s', '/')} AS x FROM t) SELECT doc_id, CASE WHEN length(x) > 200 THEN substr(x, 1, 197) || '...' ELSE x END AS shown FROM c",
    "strip_punctuation": rf"SELECT doc_id, {_strip(r'''regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')''')} AS text FROM documents",
    "segmented_round_trip": f"""WITH {_T} SELECT doc_id, CAST(coalesce(list_sum(list_transform(s, lambda x: len(x))), 0) AS BIGINT) AS n_tokens, {_joined("list_transform(s, lambda x: list_transform(x, lambda w: replace(w, '/', '@slash@')))", '/')} AS raw FROM t""",
    "map_function": r"SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) END AS n, NOT contains(text, chr(10)) AS is_invalid FROM documents",
    "corpus_stats": f"""WITH {_W}, per AS (SELECT doc_id, len(s) AS sents, coalesce(list_sum(list_transform(s, lambda x: len(x))), 0) AS tokens FROM n),
ss AS (SELECT len(x) AS ts, coalesce(list_sum(list_transform(x, lambda y: length(y))), 0) + len(x) - 1 AS cs FROM (SELECT unnest(s) AS x FROM n)),
a AS (SELECT count(*) AS docs, sum(sents) AS sents, sum(tokens) AS tokens, min(sents) AS a1, max(sents) AS a2, min(tokens) AS a3, max(tokens) AS a4 FROM per),
b AS (SELECT sum(cs) AS chars, min(cs) AS b1, max(cs) AS b2, min(ts) AS b3, max(ts) AS b4 FROM ss)
SELECT CAST((SELECT count(DISTINCT token) FROM w) AS BIGINT) AS types, CAST(tokens AS BIGINT) AS tokens, CAST(sents AS BIGINT) AS sentences, CAST(chars AS BIGINT) AS characters,
 chars / sents AS mean_chars_per_sent, CAST(b1 AS BIGINT) AS min_chars_per_sent, CAST(b2 AS BIGINT) AS max_chars_per_sent,
 tokens / sents AS mean_tokens_per_sent, CAST(b3 AS BIGINT) AS min_tokens_per_sent, CAST(b4 AS BIGINT) AS max_tokens_per_sent,
 sents / docs AS mean_sents_per_doc, CAST(a1 AS BIGINT) AS min_sents_per_doc, CAST(a2 AS BIGINT) AS max_sents_per_doc,
 tokens / docs AS mean_tokens_per_doc, CAST(a3 AS BIGINT) AS min_tokens_per_doc, CAST(a4 AS BIGINT) AS max_tokens_per_doc FROM a, b""",
    "vocab_build": f"WITH {_vocab(2)} SELECT id, token, df FROM v",
    "vocab_build_limit": f"""WITH {_vocab(3, 0.4, 300)}, stop AS (SELECT token FROM words WHERE df > floor((SELECT count(*) FROM documents) * 0.4::DOUBLE)),
inc AS (SELECT * FROM (VALUES ('corpuskiln', 0), ('the', 1)) x(token, k) WHERE token NOT IN (SELECT token FROM v) AND token NOT IN (SELECT token FROM stop))
SELECT id, token, df FROM v UNION ALL SELECT (SELECT count(*) FROM v) + row_number() OVER (ORDER BY k) - 1, token, 0 FROM inc""",
    "vocab_stopwords": f"WITH {_vocab(3, 0.3)} SELECT token FROM words WHERE df > floor((SELECT count(*) FROM documents) * 0.3::DOUBLE)",
    "vocab_oov_df": f"WITH {_V} SELECT (SELECT count(*) FROM v) AS id, count(DISTINCT doc_id) AS oov_df FROM w WHERE token NOT IN (SELECT token FROM v)",
    "vocab_stats": f"WITH {_vocab()} SELECT (SELECT count(*) FROM documents) AS num_docs, (SELECT count(*) FROM w) AS num_pos, CAST((SELECT sum(df) FROM words) AS BIGINT) AS num_nnz",
    "vocab_map": f"""WITH {_M}, l AS (SELECT doc_id, sent, string_agg(CAST(coalesce(id, (SELECT count(*) FROM v)) AS VARCHAR), ' ' ORDER BY pos) AS line FROM m GROUP BY doc_id, sent)
SELECT doc_id, coalesce(string_agg(coalesce(line, ''), chr(10) ORDER BY sent), '') AS ids FROM ({_ALL}) LEFT JOIN sents USING (doc_id) LEFT JOIN l USING (doc_id, sent) GROUP BY doc_id""",
    "vocab_map_skip": f"""WITH {_M}, l AS (SELECT doc_id, sent, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS line FROM m WHERE id IS NOT NULL GROUP BY doc_id, sent)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY sent), '') AS ids FROM ({_ALL}) LEFT JOIN l USING (doc_id) GROUP BY doc_id""",
    "vocab_unmap": f"""WITH {_M}, l AS (SELECT doc_id, sent, string_agg(coalesce(known, 'OOV'), ' ' ORDER BY pos) AS line FROM m GROUP BY doc_id, sent)
SELECT doc_id, coalesce(string_agg(coalesce(line, ''), chr(10) ORDER BY sent), '') AS text FROM ({_ALL}) LEFT JOIN sents USING (doc_id) LEFT JOIN l USING (doc_id, sent) GROUP BY doc_id""",
    "vocab_count": f"""WITH {_M}, i AS (SELECT id FROM v UNION ALL SELECT count(*) FROM v), c AS (SELECT coalesce(id, (SELECT count(*) FROM v)) AS id, count(*) AS freq FROM m GROUP BY 1)
SELECT i.id, coalesce(freq, 0) AS freq FROM i LEFT JOIN c USING (id)""",
    "doc_bow": f"WITH {_M} SELECT doc_id, id, count(*) AS freq FROM m WHERE id IS NOT NULL AND id <> 0 GROUP BY doc_id, id",
    "tfidf": f"""WITH {_M}, b AS (SELECT doc_id, id, count(*) AS freq FROM m WHERE id IS NOT NULL GROUP BY doc_id, id),
r AS (SELECT doc_id, id, freq * log2((SELECT count(*) FROM documents)::DOUBLE / count(*) OVER (PARTITION BY id)) AS x FROM b),
s AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS norm FROM r)
SELECT doc_id, id, round(CASE WHEN norm > 0 THEN x / norm ELSE 0 END, 6) AS w FROM s""",
    "doc2bow_missing": f"WITH {_M} SELECT doc_id, count(DISTINCT token) AS n_types, count(*) AS n_tokens FROM m WHERE id IS NULL GROUP BY doc_id",
    "resume_after": "SELECT doc_id FROM documents WHERE doc_id > 120",
    "conll_round_trip": f"WITH {_T}, f AS (SELECT doc_id, flatten(s) AS w FROM t) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(array_to_string(list_transform(w, lambda x: x || '/' || substr(x, 1, 1)), ' '), '') AS words FROM f",
    "cooccurrence": f"""WITH {_vocab(3)}, k AS (SELECT w.doc_id, v.id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS p FROM w JOIN v USING (token)),
d AS (SELECT unnest(generate_series(1, 15)) AS d), h AS (SELECT a.id AS x, b.id AS y, d, count(*) AS n FROM k a, d, k b WHERE b.doc_id = a.doc_id AND b.p = a.p + d GROUP BY ALL),
u AS (SELECT x AS w1, y AS w2, n / d::DOUBLE AS w FROM h UNION ALL SELECT y, x, n / d::DOUBLE FROM h)
SELECT CAST(w1 AS BIGINT) AS w1, CAST(w2 AS BIGINT) AS w2, round(sum(w), 5) AS weight FROM u GROUP BY w1, w2""",
    "trees_parsed": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS BIGINT) AS n_names, w[-1] AS last FROM w""",
    "frequent_tokens": f"WITH {_vocab()} SELECT token, df FROM v ORDER BY df DESC, id LIMIT 100",
    "group_archives": "SELECT 'archive-' || lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS VARCHAR), CAST(length(CAST(((SELECT count(*) FROM documents) - 1) // 300 AS VARCHAR)) AS INTEGER), '0') AS archive, CAST(doc_id AS VARCHAR) AS doc_name FROM documents",
    "concat_corpora": """SELECT row_number() OVER (ORDER BY src, o) - 1 AS pos, archive, doc_name, text FROM (
SELECT 0 AS src, doc_id AS o, 'corpus0_' || source AS archive, CAST(doc_id AS VARCHAR) AS doc_name, text FROM documents UNION ALL SELECT 1, item_id, 'corpus1_bench', CAST(item_id AS VARCHAR), text FROM benchmark)""",
    "interleave_corpora": """WITH d AS (SELECT 0 AS src, doc_id AS o, 'corp0_' || source AS archive, CAST(doc_id AS VARCHAR) AS doc_name FROM documents UNION ALL SELECT 1, item_id, 'corp1_bench', CAST(item_id AS VARCHAR) FROM benchmark),
l AS (SELECT src, count(*) AS n FROM d GROUP BY src), s AS (SELECT src, (SELECT max(n) FROM l)::DOUBLE / n AS step FROM l),
p AS (SELECT d.*, coalesce(sum(step) OVER (PARTITION BY src ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS progress FROM d JOIN s USING (src))
SELECT row_number() OVER (ORDER BY progress, src, o) - 1 AS pos, archive, doc_name FROM p""",
    "interleave_corpora_scaled": """WITH d AS (SELECT 0 AS src, doc_id AS o, 'corp0_' || source AS archive, CAST(doc_id AS VARCHAR) AS doc_name FROM documents UNION ALL SELECT 1, item_id, 'corp1_bench', CAST(item_id AS VARCHAR) FROM benchmark),
p AS (SELECT d.*, (row_number() OVER (PARTITION BY src ORDER BY o) - 1)::DOUBLE / count(*) OVER (PARTITION BY src) AS progress FROM d)
SELECT row_number() OVER (ORDER BY progress, src, o) - 1 AS pos, archive, doc_name FROM p""",
    "subset_corpus": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 20",
    "subset_valid": "",
    "subsample_corpus": f"SELECT doc_id FROM documents WHERE {_hash(1234, 'doc_id')} < 0.2 * 4294967296::DOUBLE",
    "subsample_size": f"SELECT doc_id FROM documents WHERE {_hash(7, 'doc_id')} < 50 / (SELECT count(*) FROM documents)::DOUBLE * 4294967296::DOUBLE",
    "split_corpus": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_hash(1234, 'doc_id')}, doc_id) <= floor(0.3::DOUBLE * (SELECT count(*) FROM documents)) THEN 'set1' ELSE 'set2' END AS \"set\" FROM documents",
    "shuffle_corpus": f"""WITH p AS (SELECT row_number() OVER (ORDER BY {_hash(999, 'doc_id')}, doc_id) - 1 AS pos, source || '__' || doc_id AS doc_name FROM documents)
SELECT pos, 'shuffled-' || lpad(CAST(pos // 100 AS VARCHAR), CAST(length(CAST(((SELECT count(*) FROM p) - 1) // 100 AS VARCHAR)) AS INTEGER), '0') AS archive, doc_name FROM p""",
    "list_filter_in": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "list_filter_out": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "align_labels": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(quality AS VARCHAR) AS quality FROM documents JOIN labels USING (doc_id)",
    "slice_sizes": """WITH a AS (SELECT role AS label, conv_id, turn, CASE WHEN lag(role) OVER (ORDER BY conv_id, turn) = role THEN 0 ELSE 1 END AS new FROM conversations),
b AS (SELECT label, sum(new) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) - 1 AS slice FROM a)
SELECT CAST(slice AS BIGINT) AS slice, label, count(*) AS n FROM b GROUP BY slice, label""",
    "conversation_turns": "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
    "embeddings_l2": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), f AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, 1.0::DOUBLE * round(sqrt(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm)))), 6) AS norm, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS place, CAST(round(unnest(v) / norm * 100000) AS BIGINT) AS x FROM f""",
    "embeddings_cosine_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank, neighbour, similarity FROM p QUALIFY rank <= 5""",
    "embeddings_plot": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings ORDER BY vec_id * 7 % 101 DESC, vec_id LIMIT 20 OFFSET 5)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.v, b.v), 5) AS distance FROM s a, s b WHERE a.vec_id < b.vec_id""",
    "embeddings_metadata": "SELECT 'w' || vec_id || chr(9) || (vec_id * 7 % 101) AS line FROM embeddings",
    "doc_embeddings": f"WITH {_vocab(5)} SELECT doc_id, count(*) AS n_tokens, count(v.token) AS n_known, coalesce(sum(v.df), 0)::DOUBLE AS df_sum FROM w LEFT JOIN v USING (token) GROUP BY doc_id",
    "term_feature_matrix": f"""WITH {_N}, x AS (SELECT unnest(s) AS s FROM n), y AS (SELECT s, unnest(generate_series(1, len(s) - 1)) AS i FROM x WHERE len(s) > 1)
SELECT s[i] AS term, s[i + 1] AS feature, count(*) AS n FROM y GROUP BY term, feature""",
    "dual_vocab": f"""WITH {_N}, x AS (SELECT unnest(s) AS s FROM n), y AS (SELECT s, unnest(generate_series(1, len(s) - 1)) AS i FROM x WHERE len(s) > 1)
SELECT 'term' AS kind, s[i] AS token, count(*) AS df FROM y GROUP BY token HAVING count(*) >= 10 UNION ALL SELECT 'feature', s[i + 1], count(*) FROM y GROUP BY s[i + 1] HAVING count(*) >= 20""",
    "term_feature_list": """SELECT source AS term, f AS feature, count(*) AS n FROM (SELECT source, unnest(['lang_' || lang, 'size_' || CAST(CAST(floor(log10(n_chars)) AS BIGINT) AS VARCHAR)]) AS f FROM documents) GROUP BY term, feature""",
    "annotated_match": rf"""WITH {_T}, x AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent, unnest(s) AS s FROM t), y AS (SELECT doc_id, sent, s, unnest(generate_series(1, len(s) - 2)) AS i FROM x WHERE len(s) > 2)
SELECT doc_id, sent, i - 1 AS start, 'a=' || s[i] || ',b=low' AS kv FROM y WHERE regexp_matches(s[i], '^[A-Z]') AND s[i + 1] = 'the' AND NOT regexp_matches(s[i + 2], '^[A-Z]|[.,]$')
UNION ALL SELECT doc_id, sent, i - 1, 'x=' || s[i] FROM y WHERE NOT regexp_matches(s[i], '^[A-Z]') AND regexp_matches(s[i], '[.,]$') AND s[i + 2] = 'of'""",
    "dependency_features": f"""WITH {_T}, x AS (SELECT unnest(s) AS s FROM t), y AS (SELECT s, unnest(generate_series(2, len(s))) AS i FROM x WHERE len(s) > 1),
z AS (SELECT s[i] AS w, s[i - 1] AS h, CASE WHEN (i - 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS rel FROM y),
f AS (SELECT w AS term, rel || '_' || h AS feature FROM z UNION ALL SELECT h, rel || 'I_' || w FROM z)
SELECT term, feature, count(*) AS n FROM f WHERE substr(term, 1, 1) IN ('t', 'a') GROUP BY term, feature""",
    "chart_data": "SELECT 'documents' AS label, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'unavailable', 0",
    "time_slices": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY day, event_type",
    "ranked_features": """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source),
p AS (SELECT lang, source, n / sum(n) OVER (PARTITION BY lang) AS pt, sum(n) OVER (PARTITION BY source) / sum(n) OVER () AS pw FROM n)
SELECT lang, source, round(0.6 * ln(pt) + 0.4 * ln(pt / pw), 6) AS relevance FROM p""",
}

_EURO = rf"""WITH a AS (SELECT doc_id, list_filter({_LINES}, lambda l: NOT starts_with(l, '<')) AS s FROM documents),
b AS (SELECT doc_id, list_transform(s, lambda l: {_strip(r"regexp_replace(regexp_replace(CASE WHEN strpos(l, '. - ') > 0 THEN substr(l, strpos(l, '. - ') + 4) ELSE l END, '^[- ]+', ''), '\([A-Z][A-Z]\) ', '', 'g')")}) AS s FROM a),
c AS (SELECT doc_id, list_filter(s, lambda l: l <> '' AND NOT (starts_with(l, '(') AND ends_with(l, ')'))) AS s FROM b)
"""
ORACLE_SQL["europarl_clean"] = _EURO + "SELECT doc_id, CASE WHEN len(s) >= 4 THEN array_to_string(s, chr(10)) END AS text, len(s) < 4 AS is_invalid FROM c"
ORACLE_SQL["count_invalid"] = _EURO + "SELECT count(*) AS n_docs, count(*) FILTER (len(s) < 4) AS n_invalid FROM c"
ORACLE_SQL["subset_valid"] = _EURO + "SELECT doc_id FROM c WHERE len(s) >= 4 ORDER BY doc_id LIMIT 50 OFFSET 10"

_TOPICS = f"{_vocab(3, 0.5, 32)}, topics AS (SELECT id % 4 AS topic, id // 4 AS rank, token AS word FROM v)"
_PAIRS = """, dw AS (SELECT DISTINCT k, word FROM sets), own AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
prs AS (SELECT a.word AS x, b.word AS y, count(*) AS n FROM dw a JOIN dw b ON a.k = b.k AND a.word < b.word GROUP BY a.word, b.word),
tp AS (SELECT a.topic, a.word AS wi, b.word AS wj FROM topics a JOIN topics b ON a.topic = b.topic AND b.rank < a.rank),
pn AS (SELECT topic, oi.n AS ni, oj.n AS nj, coalesce(prs.n, 0) AS nij FROM tp LEFT JOIN own oi ON oi.word = wi LEFT JOIN own oj ON oj.word = wj LEFT JOIN prs ON x = least(wi, wj) AND y = greatest(wi, wj))
"""
ORACLE_SQL["coherence_umass"] = f"WITH {_TOPICS}, sets AS (SELECT doc_id AS k, token AS word FROM w WHERE token IN (SELECT word FROM topics)){_PAIRS} SELECT topic, round(avg(ln((nij + 1.0::DOUBLE) / nj)), 6) AS coherence FROM pn GROUP BY topic"
_WINDOWS = f"""WITH {_TOPICS}, sizes AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), total AS (SELECT sum(greatest(n - 9, 1))::DOUBLE AS total FROM sizes),
sets AS (SELECT (doc_id, i) AS k, token AS word FROM (SELECT doc_id, token, unnest(generate_series(greatest(pos - 9, 1), least(pos, greatest(n - 9, 1)))) AS i FROM w JOIN sizes USING (doc_id) WHERE token IN (SELECT word FROM topics))){_PAIRS}"""
_PMI = "ln((nij / total + 1e-12) / ((ni / total) * (nj / total)))"
ORACLE_SQL["coherence_uci"] = f"{_WINDOWS} SELECT topic, round(avg({_PMI}), 6) AS coherence FROM pn, total GROUP BY topic"
ORACLE_SQL["coherence_npmi"] = f"{_WINDOWS} SELECT topic, round(avg({_PMI} / -ln(nij / total + 1e-12)), 6) AS coherence FROM pn, total GROUP BY topic"
ORACLE_SQL["missing_topic_words"] = f"WITH {_TOPICS} SELECT topic, word FROM topics WHERE word NOT IN (SELECT token FROM words WHERE df >= 3 AND df <= floor((SELECT count(*) FROM documents) * 0.2::DOUBLE))"

ORACLE_SQL["format_documents"] = f"WITH {_T} SELECT doc_id, {_joined('s', '/')} AS shown FROM t"
ORACLE_SQL["name_filter"] = "SELECT source AS archive, CAST(doc_id AS VARCHAR) AS doc_name, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE source IN ('src1', 'src2') AND starts_with(CAST(doc_id AS VARCHAR), '1')"
ORACLE_SQL["embeddings_concat"] = """SELECT vec_id AS idx, 'w' || vec_id AS word, vec_id * 7 % 101 AS count FROM embeddings
UNION ALL SELECT vec_id + (SELECT count(*) FROM embeddings), 'second_w' || vec_id, vec_id * 7 % 101 FROM embeddings"""
_BINS = "ceil((SELECT count(*) FROM documents) / 50.0)"
ORACLE_SQL["shuffle_linear"] = f"""SELECT row_number() OVER (ORDER BY {_hash("999:bin", "doc_id")} % CAST({_BINS} AS BIGINT), {_hash(999, "doc_id")}, doc_id) - 1 AS pos, source AS archive, CAST(doc_id AS VARCHAR) AS doc_name FROM documents"""

# sources and sinks
_NUMBERS = "array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ' ')"
ORACLE_SQL["store_corpus"] = "SELECT source AS archive, CAST(doc_id AS VARCHAR) AS doc_name, text, true AS valid FROM documents"
ORACLE_SQL["store_appended"] = "SELECT source AS archive, CAST(doc_id AS VARCHAR) AS doc_name, text FROM documents UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), text FROM benchmark"
ORACLE_SQL["text_files_written"] = "SELECT row_number() OVER (ORDER BY CAST(item_id AS VARCHAR) || '.txt') - 1 AS doc_ord, item_id || '.txt' AS doc_name, text FROM benchmark"
ORACLE_SQL["text_files_lines"] = f"SELECT CAST(doc_id AS VARCHAR) AS doc_name, coalesce(array_to_string(list_slice({_LINES}, 2, 3), chr(10)), '') AS text FROM documents"
ORACLE_SQL["text_archives_written"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_name, text FROM documents"
ORACLE_SQL["xml_nested_files"] = "SELECT CAST(item_id AS VARCHAR) AS doc_name, text || 'x < y' AS text FROM benchmark UNION ALL SELECT item_id || '-1', 'x < y' FROM benchmark"
ORACLE_SQL["vertical_text_written"] = f"""WITH d AS (SELECT item_id, regexp_replace(text, '[<>]', '', 'g') AS text FROM benchmark), s AS (SELECT item_id, list_filter({_SENTENCES}, lambda x: len(x) > 0) AS s FROM d)
SELECT CAST(item_id AS VARCHAR) AS doc_name, array_to_string(list_transform(s, lambda x: array_to_string(list_transform(x, lambda w: w || '/' || substr(w, 1, 1)), ' ')), chr(10)) AS words FROM s"""
ORACLE_SQL["word2vec_written"] = f"SELECT vec_id AS idx, 'w' || vec_id AS word, vec_id * 7 % 101 AS count, {_NUMBERS} AS numbers FROM embeddings"
ORACLE_SQL["embeddings_tsv_written"] = f"SELECT {_NUMBERS} AS numbers FROM embeddings"
ORACLE_SQL["glove_file_read"] = f"SELECT vec_id AS idx, 'w' || vec_id AS word, (SELECT count(*) FROM embeddings) - 1 - vec_id AS count, {_NUMBERS} AS numbers FROM embeddings"
ORACLE_SQL["fasttext_file_read"] = f"SELECT vec_id AS idx, 'w' || vec_id AS word, 49 - vec_id AS count, {_NUMBERS} AS numbers FROM embeddings WHERE vec_id < 50"
ORACLE_SQL["table_columns"] = "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS doc_name, role AS role_text, text AS text_text FROM conversations"
ORACLE_SQL["labelled_corpora"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_name, text, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)"
