"""SQL of the register queries, for a check on another engine."""

from __future__ import annotations

from daftar.operators.timestamps import MONTHS

_DOCS = """docs AS (SELECT * FROM gr_documents WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST, title DESC NULLS LAST) = 1)"""
_CHUNKS = """chunks AS (SELECT * FROM gr_chunks WHERE faiss_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY faiss_id) = 1)"""
_EDGES = """edges AS (SELECT DISTINCT src_id, dst_id, dst_number, dst_canon, lower(trim(kind)) AS kind, resolution, dst_date FROM gr_edges)"""
_NOISE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.\-\x{2013}\x{2014}_,;:()\[\]]+"


def canon(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(lower(translate({x}, '०१२३४५६७८९', '0123456789')), '{_NOISE}', '', 'g'), '/+', '/', 'g'), '/'), '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9ऀ-ॿ]+')"


def estimate(x: str, rate: float) -> str:
    return f"floor(1.33::DOUBLE * len(regexp_extract_all({x}, '[A-Za-z0-9]+')) + {rate}::DOUBLE * len(regexp_extract_all({x}, '[ऀ-ॿ]')))::INT"


_SIGNS = r"[\s.:：ः–-]*"
_MONTH = "CASE lower(mon) " + " ".join(f"WHEN '{n}' THEN {m}" for m, names in MONTHS.items() for n in names.split() if len(n) > 3 or not n.isascii() or n == "may") + " END"


def real_day(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1900 AND 2035 THEN strftime(try_cast(printf('%04d-%02d-%02d', {y}::INT, {m}::INT, {d}::INT) AS DATE), '%Y-%m-%d') END"


_HEADER = (
    _DOCS
    + r""", h0 AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l,
    nullif(trim(regexp_extract(text, '(?:शासन निर्णय|शासन आदेश|आदेश|परिपत्रक|अधिसूचना)\s*(?:क्रमांक|क्र)SIGNS([^\n]+)', 1)), '') AS n1,
    nullif(trim(regexp_extract(text, '(?:Government Resolution No|Government Order No|G\.R\. No|G\. R\. No|GR No|G\.R\.No|GRNo)SIGNS([^\n]+)', 1)), '') AS n2,
    translate(regexp_extract(text, '(?:दिनांक|दिनाक|तारीख|Dated|Date)SIGNS([^\n]+)', 1), '०१२३४५६७८९', '0123456789') AS day,
    nullif(trim(regexp_extract(text, '(?s)(?:विषय|Subject)\s*[:：ः]SIGNS(.*?)(?:\n\s*(?:वाचा|संदर्भ|Reference|Read|प्रस्तावना|शासन निर्णय|Preamble)\s*[:：ः]|\z)', 1)), '') AS subject FROM docs),
h1 AS (SELECT *, regexp_extract(day, '([0-9]{1,2})\s+([^\s,]+)[,\s]+([0-9]{4})', ['d', 'mon', 'y']) AS w, regexp_extract_all(day, '[0-9][0-9/.-]*[0-9]') AS runs FROM h0),
h2 AS (SELECT *, w.mon AS mon, string_split_regex(list_filter(runs, lambda r: regexp_matches(r, '^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$'))[1], '[/.-]') AS a,
  string_split(list_filter(runs, lambda r: regexp_matches(r, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$'))[1], '-') AS b FROM h1),
h3 AS (SELECT *, CASE WHEN a[3]::INT >= 100 THEN a[3]::INT WHEN a[3]::INT < 70 THEN a[3]::INT + 2000 ELSE a[3]::INT + 1900 END AS year FROM h2)""".replace("SIGNS", _SIGNS)
)

_PAGES = r"""pg AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^#\s*Page\s*(\d+)\s*$', 1) AS n,
    regexp_split_to_array(text, '(?m)^#\s*Page\s*(\d+)\s*$') AS b FROM docs WHERE text IS NOT NULL),
pages AS (
  SELECT doc_id, generate_subscripts(n, 1) - 1 AS page_pos, unnest(n)::INT AS page_no, unnest(b[2:len(n) + 1]) AS body FROM pg WHERE len(n) > 0
  UNION ALL SELECT doc_id, 0, 1, text FROM pg WHERE len(n) = 0)"""

_WINDOWS = (
    _DOCS + ", " + _PAGES
    + r""", wl AS (SELECT doc_id, page_pos, page_no, regexp_extract_all(body, '\S+') AS ws FROM pages),
w AS (SELECT doc_id, page_pos, page_no, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM wl),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_pos, i) - 1 AS pos FROM w),
c AS (SELECT *, pos // 200 AS chunk_index FROM g UNION ALL SELECT *, pos // 200 - 1 FROM g WHERE pos % 200 < 50 AND pos >= 200),
win AS (SELECT doc_id, chunk_index, arg_min(page_no, pos) AS page_start, arg_max(page_no, pos) AS page_end, count(*) AS n_words, string_agg(w, ' ' ORDER BY pos) AS chunk_text
  FROM c GROUP BY doc_id, chunk_index)"""
)

_LINES = (
    _DOCS
    + r""", li AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL)),
fl AS (SELECT *, regexp_matches(line, '^[\s\x{00A0}\x{202F}]*[-|─—\s\x{00A0}\x{202F}]{4,}[\s\x{00A0}\x{202F}]*$') AS dash, regexp_matches(line, '^[\s\x{00A0}\x{202F}]*\|.*\|.*\|') AS bar FROM li),
f2 AS (SELECT doc_id, line_no, line, bar AND NOT dash AS pipe, dash FROM fl),
isl AS (SELECT *, sum(CASE WHEN pipe OR dash THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM f2),
runs AS (SELECT doc_id, min(line_no) FILTER (pipe) AS first_line, max(line_no) AS last_line, count(*) FILTER (pipe) AS n_rows
  FROM isl WHERE pipe OR dash GROUP BY doc_id, island HAVING count(*) FILTER (pipe) >= 2)"""
)
_CELLS = r"""list_transform(list_filter(string_split(line, '|'), lambda x: x <> ''), lambda x: trim(regexp_replace(x, '[\s\x{00A0}\x{202F}]+', ' ', 'g')))"""
_SAID = (
    _LINES
    + f""", cell AS (SELECT doc_id, first_line, line_no, {_CELLS} AS c0 FROM f2 JOIN runs USING (doc_id) WHERE pipe AND line_no BETWEEN first_line AND last_line),
cut AS (SELECT doc_id, first_line, line_no, c0[1:coalesce(list_max(list_transform(c0, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)), 0)] AS c FROM cell),
hd AS (SELECT *, first(c) OVER w AS header, row_number() OVER w - 1 AS row_no FROM cut WINDOW w AS (PARTITION BY doc_id, first_line ORDER BY line_no)),
said0 AS (SELECT doc_id, first_line, row_no, header, list_filter(list_transform(range(1, least(len(header), len(c)) + 1), lambda i:
    CASE WHEN c[i] <> '' THEN CASE WHEN header[i] <> '' THEN header[i] WHEN i = 1 THEN 'row_name' ELSE 'more info' END || ' is ' || c[i] END), lambda x: x IS NOT NULL) AS parts FROM hd WHERE row_no > 0),
said AS (SELECT doc_id, first_line, row_no::INT AS row_no, array_to_string(header, ' | ') AS header, 'In this row: ' || array_to_string(parts, ', ') || '.' AS said FROM said0 WHERE len(parts) > 0)"""
)

_DENSE = """rows AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
qs AS (SELECT row_id AS query_id, vec AS qvec FROM rows WHERE row_id % 100 = 0),
pairs AS (SELECT query_id, row_id, label, round(list_inner_product(vec, qvec), 6) AS score FROM rows, qs)"""


def dense(k: int, where: str = "TRUE", name: str = "dn") -> str:
    return f"{name} AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM pairs WHERE {where} QUALIFY rank <= {k})"


_TEXTS = (
    _DOCS + ", " + _CHUNKS
    + f""", crow AS (SELECT faiss_id AS row_id, gr_id AS doc_id, content_type, text, {tokens('text')} AS tk FROM chunks WHERE text IS NOT NULL),
qu AS (SELECT faiss_id AS query_id, d.title AS text FROM chunks c JOIN docs d ON c.gr_id = d.doc_id WHERE faiss_id % 100 = 0 AND d.title IS NOT NULL),
df AS (SELECT term, count(*) AS n FROM (SELECT row_id, unnest(list_distinct(tk)) AS term FROM crow) GROUP BY term),
st AS (SELECT count(*) AS n_rows, avg(len(tk)) AS avgdl FROM crow),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(tk) AS term FROM crow) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM qu) GROUP BY ALL),
ix AS (SELECT term, n, ln(n_rows - n + 0.5) - ln(n + 0.5) AS idf, n_rows, avgdl FROM df, st)"""
)


def bm25(k: int, form: str = "fts", name: str = "sp") -> str:
    k1, idf, keep = ("1.2", "CASE WHEN idf > 0 THEN idf ELSE 1e-6 END", "TRUE") if form == "fts" else ("1.5", "CASE WHEN idf >= 0 THEN idf ELSE 0.25 * (SELECT avg(idf) FROM ix) END", "score > 0")
    return f"""{name}0 AS (SELECT query_id, row_id, round(sum(({idf}) * qn * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * len(tk) / avgdl))), 6) AS score
  FROM qt JOIN ix USING (term) JOIN tf USING (term) JOIN crow USING (row_id) GROUP BY query_id, row_id),
{name} AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM {name}0 WHERE {keep} QUALIFY rank <= {k})"""


def fused(name: str = "fu", a: str = "dn", b: str = "sp") -> str:
    return f"""{name}0 AS (SELECT query_id, row_id, min(dr) AS dense_rank, min(sr) AS sparse_rank FROM
    (SELECT query_id, row_id, rank AS dr, NULL::INT AS sr FROM {a} UNION ALL SELECT query_id, row_id, NULL, rank FROM {b}) GROUP BY ALL),
{name}1 AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS fused FROM {name}0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, row_id)::INT AS fused_rank FROM {name}1)"""


def gated(src: str, threshold: float, name: str = "gt", keep: int = 12, floor: int = 2) -> str:
    return f"""{name}0 AS (SELECT *, score >= {threshold} AS ok, bool_or(score >= {threshold}) OVER (PARTITION BY query_id) AS anyok FROM {src}),
{name} AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank, NOT anyok AS low_confidence
  FROM {name}0 WHERE ok OR NOT anyok QUALIFY rank <= CASE WHEN anyok THEN {keep} ELSE {floor} END)"""


_HITS60 = "WITH " + _DENSE + ", " + dense(60)
_SCORED = (
    "WITH " + _TEXTS + ", " + bm25(10)
    + """, rel AS (SELECT DISTINCT faiss_id AS query_id, gr_id AS doc_id FROM chunks WHERE faiss_id % 100 = 0),
rk AS (SELECT sp.query_id, sp.rank, sp.score, crow.doc_id, rel.doc_id IS NOT NULL AS good FROM sp JOIN crow USING (row_id) LEFT JOIN rel ON rel.query_id = sp.query_id AND rel.doc_id = crow.doc_id),
sc AS (SELECT query_id, CASE WHEN good THEN 'keep' ELSE 'reject' END AS kind, max(score) AS score FROM rk GROUP BY ALL)"""
)

_BUILT = (
    "WITH " + _DOCS
    + f""", tg AS (SELECT doc_id AS t_id, {canon('gr_number')} AS cn, date AS t_date FROM docs WHERE {canon('gr_number')} IS NOT NULL),
rf0 AS (SELECT doc_id AS src_id, supersedes, generate_subscripts(refs, 1) AS pos, unnest(refs) AS r FROM docs WHERE refs IS NOT NULL),
rf AS (SELECT src_id, supersedes, pos, r.number AS dst_number, r.date AS dst_date, {canon('r.number')} AS dst_canon FROM rf0),
fr AS (SELECT * FROM rf WHERE dst_canon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_id, dst_canon ORDER BY pos) = 1),
m AS (SELECT src_id, dst_canon, dst_number, dst_date, supersedes, count(t_id) FILTER (t_id <> src_id) AS others, count(t_id) FILTER (t_id = src_id) AS own,
    count(t_id) FILTER (t_id <> src_id AND t_date = dst_date) AS same_day, min(t_id) FILTER (t_id <> src_id) AS other, min(t_id) FILTER (t_id <> src_id AND t_date = dst_date) AS day_other
  FROM fr LEFT JOIN tg ON cn = dst_canon GROUP BY ALL),
be AS (SELECT src_id, CASE WHEN others = 1 THEN other WHEN others > 1 AND same_day = 1 THEN day_other END AS dst_id, dst_number, dst_canon,
    CASE WHEN coalesce(supersedes, FALSE) THEN 'supersedes' ELSE 'cites' END AS kind,
    CASE WHEN others = 0 THEN 'dangling' WHEN others = 1 OR same_day = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, dst_date, others > 1 AND same_day = 1 AS by_date
  FROM m WHERE NOT (others = 0 AND own > 0))"""
)

_CHAIN = (
    "WITH RECURSIVE " + _DOCS + ", " + _EDGES
    + """, cd AS (SELECT "at", list(src_id ORDER BY coalesce(date, '') DESC, src_id DESC) AS cands FROM
    (SELECT DISTINCT e.dst_id AS "at", e.src_id, d.date FROM edges e JOIN docs d ON d.doc_id = e.src_id WHERE kind = 'supersedes' AND dst_id IS NOT NULL) GROUP BY "at"),
wk AS (
  SELECT "at" AS doc_id, "at" AS cur, ["at"] AS seen, 0 AS hop FROM cd WHERE "at" IN (SELECT doc_id FROM docs)
  UNION ALL
  SELECT doc_id, nx, list_append(seen, nx), hop + 1 FROM
    (SELECT w.doc_id, w.seen, w.hop, list_filter(c.cands, lambda x: NOT list_contains(w.seen, x))[1] AS nx FROM wk w JOIN cd c ON c."at" = w.cur WHERE w.hop < 10) WHERE nx IS NOT NULL),
ch AS (SELECT doc_id, hop, cur AS next_id FROM wk WHERE hop > 0)"""
)

_NEAR = (
    "WITH " + _DOCS + ", " + _EDGES
    + """, lk0 AS (SELECT src_id AS a, dst_id AS b, 0 AS way FROM edges WHERE dst_id IS NOT NULL UNION ALL SELECT dst_id, src_id, 1 FROM edges WHERE dst_id IS NOT NULL),
lk AS (SELECT a, b, min(way) AS way FROM lk0 WHERE a <> b GROUP BY a, b),
r0 AS (SELECT doc_id AS root_id FROM docs WHERE doc_id LIKE '%00'),
d0 AS (SELECT root_id, root_id AS node_id, 0 AS distance, 0 AS way FROM r0),
d1 AS (SELECT root_id, b AS node_id, 1 AS distance, min(lk.way) AS way FROM d0 JOIN lk ON a = node_id GROUP BY ALL),
d1n AS (SELECT * FROM d1 WHERE (root_id, node_id) NOT IN (SELECT (root_id, node_id) FROM d0)),
d2 AS (SELECT root_id, b AS node_id, 2 AS distance, min(lk.way) AS way FROM d1n JOIN lk ON a = node_id GROUP BY ALL),
d2n AS (SELECT * FROM d2 WHERE (root_id, node_id) NOT IN (SELECT (root_id, node_id) FROM d0 UNION SELECT (root_id, node_id) FROM d1))"""
)


def near(parts: str) -> str:
    return _NEAR + f", al AS ({parts}) SELECT root_id, node_id, distance FROM al QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY distance, way, node_id) <= 60"


_TRIM = "WITH " + _TEXTS + ", " + bm25(12)


def trimmed(budget: int) -> str:
    return f"""ev AS (SELECT sp.query_id, sp.row_id, sp.rank, text, {estimate('text', 2.0)} AS cost FROM sp JOIN crow USING (row_id)),
t0 AS (SELECT *, row_number() OVER w AS block_no, sum(cost) OVER w AS spent FROM ev WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
t1 AS (SELECT *, block_no = 1 OR spent <= {budget} AS kept FROM t0),
tr AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS dropped FROM t1)"""


_ANSWERS = r"""WITH an0 AS (SELECT DISTINCT id, content, sources FROM messages WHERE lower(trim(role)) = 'assistant' AND content IS NOT NULL),
an AS (SELECT id, content, list_filter(coalesce(TRY(json_transform(try_cast(sources AS JSON), '[{"n": "INTEGER", "gr_number": "VARCHAR"}]')), []), lambda s: s.n IS NOT NULL) AS blocks FROM an0),
ci AS (SELECT id, content, blocks, list_transform(blocks, lambda s: s.n) AS ns, list_sort(list_distinct(list_transform(regexp_extract_all(content, '\[(\d{1,9})\]', 1), lambda x: x::INT))) AS c FROM an),
cv AS (SELECT id, content, blocks, ns, list_filter(c, lambda x: list_contains(ns, x)) AS valid, list_filter(c, lambda x: NOT list_contains(ns, x)) AS phantom FROM ci),
fl AS (SELECT *, len(blocks) > 0 AS in_corpus, len(valid) > 0 AS cited, len(phantom) = 0 AS grounded, coalesce(list_contains(valid, ns[1]), FALSE) AS correct,
    length(trim(regexp_replace(content, '\[\d+\]', '', 'g'))) < 15 AS degenerate,
    regexp_matches(content, '(?i)not (?:found|available|contained|mentioned|covered)|no (?:information|relevant)|(?:cannot|could not|unable to) (?:answer|find)|nothing (?:about|on)|(?:does|do) not (?:appear to |seem to )?(?:cover|contain|provide|include|mention|have)|माहिती (?:उपलब्ध )?नाही|(?:उपलब्ध|समाविष्ट|नमूद) नाही|आढळ(?:त|ली|ले|ला) नाही|सापडली नाही') AS refused FROM cv)"""

_RERANKED = f"""cp AS (SELECT fu.query_id, row_id, fused_rank FROM fu JOIN chunks ON faiss_id = row_id WHERE fused_rank <= 120 QUALIFY row_number() OVER (PARTITION BY fu.query_id, gr_id ORDER BY fused_rank) <= 2),
c4 AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) <= 40),
qw AS (SELECT query_id, term, ln(1 + (SELECT n_rows FROM st)::DOUBLE / (1 + coalesce(n, 0))) AS w FROM qt LEFT JOIN df USING (term)),
tot AS (SELECT query_id, sum(w) AS total FROM qw GROUP BY query_id), met AS (SELECT c4.query_id, c4.row_id, sum(w) AS met FROM c4 JOIN qw USING (query_id) JOIN tf ON tf.row_id = c4.row_id AND tf.term = qw.term GROUP BY ALL),
rr AS (SELECT c4.query_id, c4.row_id, round(coalesce(met / total, 0), 6) AS score FROM c4 LEFT JOIN met USING (query_id, row_id) LEFT JOIN tot USING (query_id)),
{gated("rr", 0.5)},
ev AS (SELECT gt.query_id, gt.row_id, gt.rank, gt.score, low_confidence, text, {estimate("text", 2.0)} AS cost FROM gt JOIN crow USING (row_id) WHERE gt.query_id IN (SELECT query_id FROM qu)),
t0 AS (SELECT *, row_number() OVER w AS block_no, sum(cost) OVER w AS spent FROM ev WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
t1 AS (SELECT *, block_no = 1 OR spent <= 3000 AS kept FROM t0), tr AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS dropped FROM t1)"""

ORACLE = {
    "superseding_substring": "WITH " + _DOCS + """, a AS (SELECT DISTINCT gr_number AS asked FROM docs WHERE doc_id LIKE '%00' AND gr_number <> ''), p AS (SELECT doc_id, unnest(refs) AS r FROM docs WHERE supersedes)
        SELECT DISTINCT asked, doc_id FROM p JOIN a ON contains(r.number, asked)""",
    "canonical_backfill": "WITH " + _DOCS + f" SELECT doc_id, coalesce(gr_number_canon, {canon('gr_number')}) AS gr_number_canon FROM docs",
    "neighbour_arcs": "WITH " + _DOCS + ", " + _EDGES + """, r0 AS (SELECT doc_id AS root_id FROM docs WHERE doc_id LIKE '%00'), e AS (SELECT DISTINCT src_id, dst_id, kind FROM edges WHERE dst_id IS NOT NULL AND src_id <> dst_id),
        x AS (SELECT root_id, src_id AS node_id, CASE WHEN kind = 'supersedes' THEN 'newer' ELSE 'older' END AS role FROM e JOIN r0 ON dst_id = root_id UNION ALL SELECT root_id, dst_id, 'older' FROM e JOIN r0 ON src_id = root_id),
        y AS (SELECT root_id, node_id, min(role) AS role FROM x GROUP BY ALL),
        z AS (SELECT root_id, role, node_id, row_number() OVER (PARTITION BY root_id, role ORDER BY date DESC NULLS LAST, node_id) AS place, greatest(count(*) OVER (PARTITION BY root_id, role) - 7, 0) AS hidden FROM y JOIN docs ON doc_id = node_id)
        SELECT root_id, role, node_id, place::INT AS place, hidden::BIGINT AS hidden FROM z WHERE place <= 7""",
    "message_sources": """SELECT id, max(coalesce(json_array_length(try_cast(sources AS JSON)), 0))::INT AS n_sources, max(coalesce(json_array_length(try_cast(warnings AS JSON)), 0))::INT AS n_warnings FROM messages GROUP BY id""",
    "prompt_sizes": _TRIM + ", " + trimmed(1000) + f""", bl AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS ctx FROM tr WHERE kept GROUP BY query_id),
        pr AS (SELECT qu.query_id, 'Context:' || chr(10) || coalesce(ctx, '') || chr(10) || chr(10) || 'Question: ' || qu.text || chr(10) || 'Cite the blocks you use.' AS u FROM qu LEFT JOIN bl USING (query_id)),
        sz AS (SELECT query_id, {estimate("'Answer only from the numbered blocks.'", 1.2)} + {estimate('u', 1.2)} AS tokens FROM pr) SELECT query_id, tokens, tokens > 1200 AS over FROM sz""",
    "own_conversations": "SELECT DISTINCT id, user_id FROM conversations WHERE user_id = 'u002' OR user_id IS NULL",
    "active_user_lookup": "SELECT id, username, role FROM users WHERE active = 1 AND username IS NOT NULL",
    "conversation_cascade": """WITH g AS (SELECT id FROM conversations WHERE user_id IS NULL) SELECT (SELECT count(DISTINCT id) FROM conversations WHERE id NOT IN (SELECT id FROM g)) AS n_conversations,
        (SELECT count(DISTINCT id) FROM messages WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT id FROM g)) AS n_messages""",
    "hybrid_answer_context": "WITH " + _TEXTS + ", " + _DENSE + ", " + dense(60) + ", " + bm25(20) + ", " + fused() + ", " + _RERANKED + " SELECT query_id, row_id, block_no::INT AS block_no, score, low_confidence, dropped::BIGINT AS dropped FROM tr WHERE kept",
    "piece_ids": "WITH " + _WINDOWS + " SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS faiss_id, doc_id AS gr_id, chunk_index::INT AS chunk_index FROM win",
    "tokenize_counts": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "term_document_frequency": f"WITH {_CHUNKS} SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM chunks WHERE text IS NOT NULL) GROUP BY term",
    "canonical_numbers": f"SELECT number, {canon('number')} AS canon FROM (SELECT dst_number AS number FROM gr_edges UNION SELECT gr_number FROM gr_documents) WHERE number IS NOT NULL",
    "language_detect": """SELECT doc_id, CASE WHEN d + l = 0 THEN NULL WHEN d >= l THEN 'mr' ELSE 'en' END AS language FROM
        (SELECT doc_id, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents WHERE text IS NOT NULL)""",
    "token_estimate": f'SELECT doc_id, {estimate("text", 2.0)} AS "full", {estimate("text", 1.2)} AS "local" FROM documents WHERE text IS NOT NULL',
    "categories": "WITH " + _DOCS + """ SELECT doc_id, CASE WHEN contains(text, 'शासन निर्णय') OR contains(lower(text), 'government resolution') THEN 'government resolution (GR)'
        WHEN contains(text, 'शासन आदेश') OR contains(lower(text), 'government order') THEN 'government order (GO)' WHEN contains(text, 'परिपत्रक') OR contains(lower(text), 'circular') THEN 'circular'
        WHEN contains(text, 'अधिसूचना') OR contains(lower(text), 'notification') THEN 'notification' WHEN contains(text, 'कार्यालयीन आदेश') OR contains(lower(text), 'office order') THEN 'office order' END AS category
        FROM docs WHERE text IS NOT NULL""",
    "header_metadata": "WITH " + _HEADER + r""" SELECT doc_id, substring(nullif(trim(regexp_replace(regexp_replace(coalesce(n1, n2),
          '(?:^|[^ऀ-ॿ])(?:दिनांक|दिनाक|तारीख|दि|Dated|Date|Dt)SIGNS[0-9०-९].*$|\s{2,}.*$|।.*$', ''), '\s+', ' ', 'g'), ' .,;:।-–'), ''), 1, 80) AS gr_number,
        coalesce(NAMED, DAYFIRST, YEARFIRST) AS date,
        regexp_replace(coalesce(list_filter(l, lambda x: ends_with(x, 'विभाग') AND length(x) <= 65)[1], list_filter(l, lambda x: ends_with(x, 'Department') AND length(x) <= 70)[1]), '\s+', ' ', 'g') AS department,
        substring(regexp_replace(coalesce(subject, list_filter(l, lambda x: length(x) > 25 AND NOT starts_with(x, '#') AND NOT contains(x, 'महाराष्ट्र शासन'))[1]), '\s+', ' ', 'g'), 1, 300) AS title,
        CASE WHEN contains(text, 'शासन निर्णय') OR contains(lower(text), 'government resolution') THEN 'government resolution (GR)'
          WHEN contains(text, 'शासन आदेश') OR contains(lower(text), 'government order') THEN 'government order (GO)' WHEN contains(text, 'परिपत्रक') OR contains(lower(text), 'circular') THEN 'circular'
          WHEN contains(text, 'अधिसूचना') OR contains(lower(text), 'notification') THEN 'notification' WHEN contains(text, 'कार्यालयीन आदेश') OR contains(lower(text), 'office order') THEN 'office order' END AS category,
        CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) + len(regexp_extract_all(text, '[A-Za-z]')) = 0 THEN NULL
          WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) >= len(regexp_extract_all(text, '[A-Za-z]')) THEN 'mr' ELSE 'en' END AS language FROM h3""".replace("SIGNS", _SIGNS)
    .replace("NAMED", real_day("try_cast(w.y AS INT)", f"({_MONTH})", "try_cast(w.d AS INT)")).replace("DAYFIRST", real_day("year", "a[2]", "a[1]")).replace("YEARFIRST", real_day("b[1]::INT", "b[2]", "b[3]")),
    "date_from_id": r"SELECT DISTINCT doc_id, CASE WHEN regexp_matches(doc_id, '^\d{8}') THEN doc_id[1:4] || '-' || doc_id[5:6] || '-' || doc_id[7:8] END AS day FROM gr_documents",
    "number_shape": r"""SELECT DISTINCT dst_number, contains(dst_number, '/') AND length(dst_number) <= 80 AND regexp_matches(dst_number, '[\d०-९]')
        AND NOT regexp_matches(dst_number, '^[\d०-९]{1,4}[/.\-][\d०-९]{1,2}[/.\-][\d०-९]{2,4}\.?$') AS is_number FROM gr_edges WHERE dst_number IS NOT NULL""",
    "short_titles": r"SELECT DISTINCT id, CASE WHEN length(t) <= 60 THEN t ELSE t[1:59] || '…' END AS short_title FROM (SELECT id, trim(regexp_replace(title, '[\s\x{00A0}\x{202F}]+', ' ', 'g')) AS t FROM conversations)",
    "page_split": "WITH " + _DOCS + ", " + _PAGES + r" SELECT doc_id, page_pos::INT AS page_pos, page_no, len(regexp_extract_all(body, '\S+'))::INT AS n_words FROM pages",
    "chunk_windows": "WITH " + _WINDOWS + " SELECT doc_id, chunk_index::INT AS chunk_index, page_start, page_end, n_words::INT AS n_words, md5(chunk_text) AS digest FROM win",
    "chunk_counts": "WITH " + _DOCS + ", " + _PAGES + r", n AS (SELECT doc_id, sum(len(regexp_extract_all(body, '\S+'))) AS n FROM pages GROUP BY doc_id) SELECT doc_id, ceil(n / 200)::BIGINT AS n_chunks FROM n WHERE n > 0",
    "table_runs": "WITH " + _LINES + " SELECT doc_id, first_line::INT AS first_line, last_line::INT AS last_line, n_rows FROM runs",
    "table_sentences": "WITH " + _SAID + " SELECT doc_id, first_line::INT AS first_line, row_no, header, said FROM said",
    "prose_without_tables": "WITH " + _LINES + """, k AS (SELECT * FROM f2 WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = f2.doc_id AND f2.line_no BETWEEN r.first_line AND r.last_line)),
        t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM k GROUP BY doc_id) SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM t""",
    "dense_topk": "WITH " + _DENSE + ", " + dense(10) + " SELECT * FROM dn",
    "dense_topk_filtered": "WITH " + _DENSE + ", " + dense(10, "label = 3") + " SELECT * FROM dn",
    "dense_topk_by_modality": "WITH " + _CHUNKS + ", " + _DENSE + """, px AS (SELECT p.*, content_type AS modality FROM pairs p JOIN chunks c ON c.faiss_id = p.row_id WHERE content_type IN ('text', 'table')),
        md AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, row_id) <= CASE modality WHEN 'text' THEN 20 ELSE 10 END)
        SELECT query_id, row_id, score, modality, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM md""",
    "bm25_fts_topk": "WITH " + _TEXTS + ", " + bm25(10) + " SELECT * FROM sp",
    "bm25_okapi_topk": "WITH " + _TEXTS + ", " + bm25(10, "okapi") + " SELECT * FROM sp",
    "bm25_filtered_overfetch": "WITH " + _TEXTS + ", " + bm25(40) + """ SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank
        FROM (SELECT query_id, row_id, score FROM sp WHERE row_id IN (SELECT row_id FROM crow WHERE content_type = 'table')) QUALIFY rank <= 10""",
    "dense_score_for_id": "WITH " + _TEXTS + ", " + bm25(10) + ", " + _DENSE + " SELECT sp.query_id, sp.row_id, p.score AS cosine FROM sp LEFT JOIN pairs p ON p.query_id = sp.query_id AND p.row_id = sp.row_id",
    "related_documents": "WITH " + _CHUNKS + ", " + _DENSE + ", " + dense(30) + """, o AS (SELECT dn.query_id, c.gr_id AS doc_id, max(dn.score) AS score FROM dn JOIN chunks c ON c.faiss_id = dn.row_id
        LEFT JOIN chunks q ON q.faiss_id = dn.query_id WHERE q.gr_id IS NULL OR c.gr_id <> q.gr_id GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o.score DESC, doc_id)::INT AS rank FROM o QUALIFY rank <= 5""",
    "rrf_fuse": "WITH " + _TEXTS + ", " + _DENSE + ", " + dense(60) + ", " + bm25(20) + ", " + fused() + " SELECT * FROM fu",
    "per_document_cap": "WITH " + _TEXTS + ", " + _DENSE + ", " + dense(60) + ", " + bm25(20) + ", " + fused() + """ SELECT query_id, row_id, gr_id AS doc_id, fused_rank FROM fu JOIN chunks ON faiss_id = row_id
        WHERE fused_rank <= 120 QUALIFY row_number() OVER (PARTITION BY query_id, gr_id ORDER BY fused_rank) <= 2""",
    "gate_and_floor": _HITS60 + ", " + gated("dn", 0.55) + " SELECT q.query_id, row_id, score, rank, coalesce(low_confidence, TRUE) AS low_confidence FROM qs q LEFT JOIN gt ON gt.query_id = q.query_id",
    "empty_filter_abstains": "WITH " + _DENSE + ", " + dense(10, "label = -1") + ", " + gated("dn", 0.55) + " SELECT q.query_id, row_id, score, rank, coalesce(low_confidence, TRUE) AS low_confidence FROM qs q LEFT JOIN gt ON gt.query_id = q.query_id",
    "rerank_lexical": "WITH " + _TEXTS + ", " + bm25(40) + """, qw AS (SELECT query_id, term, ln(1 + (SELECT n_rows FROM st)::DOUBLE / (1 + coalesce(n, 0))) AS w FROM qt LEFT JOIN df USING (term)),
        tot AS (SELECT query_id, sum(w) AS total FROM qw GROUP BY query_id), met AS (SELECT sp.query_id, sp.row_id, sum(w) AS met FROM sp JOIN qw USING (query_id) JOIN tf ON tf.row_id = sp.row_id AND tf.term = qw.term GROUP BY ALL),
        sc AS (SELECT sp.query_id, sp.row_id, round(coalesce(met / total, 0), 6) AS rerank FROM sp LEFT JOIN met USING (query_id, row_id) LEFT JOIN tot USING (query_id))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, row_id)::INT AS rank FROM sc""",
    "merge_user_uploads": "WITH " + _DENSE + ", " + dense(20, "label < 5", "da") + ", " + dense(20, "label >= 5", "db") + ", " + gated("da", 0.3, "ga") + ", " + gated("db", 0.3, "gb") + """,
        b AS (SELECT query_id, row_id, score, low_confidence, 0 AS extra FROM ga UNION ALL SELECT query_id, row_id, score, low_confidence, 1 FROM gb)
        SELECT query_id, row_id, score, low_confidence AND max(extra) OVER (PARTITION BY query_id) = 0 AS low_confidence, extra, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, extra, row_id)::INT AS rank FROM b""",
    "upload_hybrid_no_floor": "WITH " + _TEXTS + ", " + _DENSE + ", " + dense(20) + ", " + bm25(20, "okapi") + ", " + fused() + """ SELECT fu.query_id, fu.row_id, p.score AS cosine, row_number() OVER (PARTITION BY fu.query_id ORDER BY fused_rank)::INT AS rank
        FROM fu JOIN pairs p ON p.query_id = fu.query_id AND p.row_id = fu.row_id WHERE p.score >= 0.3 QUALIFY rank <= 6""",
    "edges_build": _BUILT + " SELECT * FROM be",
    "edge_counts": _BUILT + """ SELECT count(*) AS edges, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (by_date) AS resolved_by_date, count(*) FILTER (resolution = 'dangling') AS dangling,
        count(*) FILTER (resolution = 'ambiguous') AS ambiguous, count(*) FILTER (kind = 'supersedes') AS supersedes FROM be""",
    "edges_outgoing": f"WITH {_EDGES} SELECT src_id, count(*) AS n_out, count(dst_id) AS n_resolved FROM edges GROUP BY src_id",
    "edges_incoming": f"WITH {_EDGES} SELECT dst_id, count(*) AS n_in FROM edges WHERE dst_id IS NOT NULL GROUP BY dst_id",
    "graph_stats": f"WITH {_EDGES} SELECT resolution, kind, count(*) AS n_edges, count(DISTINCT src_id) AS n_sources FROM edges GROUP BY ALL",
    "dangling_references": f"WITH {_EDGES} SELECT dst_canon, count(*) AS n, min(dst_number) AS printed FROM edges WHERE resolution = 'dangling' GROUP BY dst_canon",
    "supersede_chain": _CHAIN + " SELECT * FROM ch",
    "neighbourhood_depth1": near("SELECT * FROM d0 UNION ALL SELECT * FROM d1n"),
    "neighbourhood_depth2": near("SELECT * FROM d0 UNION ALL SELECT * FROM d1n UNION ALL SELECT * FROM d2n"),
    "supersede_warnings": _CHAIN + """, x AS (SELECT ch.doc_id, hop, coalesce(d.gr_number, '?') || ' (' || coalesce(d.date, 'unknown date') || ')' AS nm FROM ch JOIN docs d ON d.doc_id = next_id),
        y AS (SELECT doc_id, max(hop) AS hops, arg_min(nm, hop) AS a, arg_max(nm, hop) AS z FROM x GROUP BY doc_id)
        SELECT doc_id, 'Order ' || gr_number || ' was replaced by ' || a || CASE WHEN hops > 1 THEN ', later by ' || z || ', the latest known.' ELSE '.' END AS warning FROM y JOIN docs USING (doc_id) WHERE gr_number IS NOT NULL""",
    "citation_presence": "WITH " + _DOCS + ", " + _EDGES + f""", c AS (SELECT dst_canon, count(*) AS n FROM edges WHERE dst_canon IS NOT NULL GROUP BY dst_canon),
        h AS (SELECT {canon('gr_number')} AS dst_canon, min(doc_id) AS doc_id FROM docs GROUP BY 1) SELECT c.dst_canon, n, doc_id FROM c LEFT JOIN h ON h.dst_canon = c.dst_canon""",
    "list_documents_page": "WITH " + _DOCS + """ SELECT doc_id, gr_number, date, title FROM docs WHERE coalesce(title ILIKE '%the%', FALSE) OR coalesce(gr_number ILIKE '%the%', FALSE) OR doc_id ILIKE '%the%'
        ORDER BY date DESC NULLS LAST, doc_id DESC LIMIT 50 OFFSET 50""",
    "list_documents_total": "WITH " + _DOCS + " SELECT count(*) AS total FROM docs WHERE coalesce(title ILIKE '%the%', FALSE) OR coalesce(gr_number ILIKE '%the%', FALSE) OR doc_id ILIKE '%the%'",
    "find_document": "WITH " + _DOCS + """, a AS (SELECT DISTINCT dst_number AS asked FROM gr_edges WHERE edge_id % 100 = 0 AND dst_number IS NOT NULL)
        SELECT asked, doc_id FROM a JOIN docs ON doc_id = asked OR contains(lower(gr_number), lower(asked))
        QUALIFY row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN doc_id = asked THEN 0 WHEN gr_number = asked THEN 1 ELSE 2 END, length(gr_number), doc_id) = 1""",
    "document_chunks": "WITH " + _CHUNKS + " SELECT gr_id AS doc_id, chunk_index, faiss_id, content_type, 1.0::DOUBLE AS score FROM chunks",
    "corpus_stats": "WITH " + _DOCS + ", " + _CHUNKS + " SELECT count(*) AS documents, count(DISTINCT department) AS departments, min(date) AS first_date, max(date) AS last_date, (SELECT count(*) FROM chunks) AS chunks FROM docs",
    "stats_by_department": "WITH " + _DOCS + " SELECT department, count(*) AS documents FROM docs GROUP BY department",
    "facet_filter_ids": "WITH " + _DOCS + ", " + _CHUNKS + " SELECT faiss_id FROM chunks WHERE gr_id IN (SELECT doc_id FROM docs WHERE date >= '2015-01-01' AND date <= '2020-12-31' AND language = 'mr')",
    "document_text_joined": "WITH " + _CHUNKS + ", t AS (SELECT gr_id AS doc_id, string_agg(text, chr(10) ORDER BY chunk_index NULLS FIRST, faiss_id) AS t FROM chunks GROUP BY gr_id) SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM t",
    "context_trim_budget": _TRIM + ", " + trimmed(3000) + " SELECT query_id, row_id, block_no::INT AS block_no, spent::BIGINT AS spent, dropped::BIGINT AS dropped FROM tr WHERE kept",
    "format_blocks": "WITH " + _DOCS + ", " + _CHUNKS + """, b AS (SELECT faiss_id, '[' || (chunk_index + 1) || '] (' || concat_ws(', ', nullif(concat_ws(' — ', nullif(title, ''), nullif(gr_number, ''), nullif(date, '')), ''),
        CASE WHEN page_start = coalesce(page_end, page_start) THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END, content_type) || ')' || chr(10) || chunks.text AS b FROM chunks JOIN docs ON doc_id = gr_id)
        SELECT faiss_id, md5(b) AS digest, length(b)::INT AS n_chars FROM b""",
    "history_window_budget": f"""WITH m AS (SELECT DISTINCT * FROM messages WHERE conversation_id IS NOT NULL AND content IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id) AS k FROM m),
        b AS (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY k DESC) AS back, {estimate('content', 2.0)} AS tk FROM n QUALIFY back <= 4),
        s AS (SELECT *, sum(tk) OVER (PARTITION BY conversation_id ORDER BY back) AS spent FROM b) SELECT conversation_id, id, back::INT AS back, spent::BIGINT AS spent FROM s WHERE spent <= 800""",
    "recency_window": """WITH m AS (SELECT DISTINCT id, conversation_id, created_at FROM messages WHERE conversation_id IS NOT NULL),
        l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) <= 6)
        SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id)::INT AS place FROM l""",
    "source_citations": _ANSWERS + " SELECT id, array_to_string(valid, ',') AS valid, array_to_string(phantom, ',') AS phantom FROM cv",
    "source_citations_resolved": _ANSWERS + " SELECT DISTINCT id, s.n AS block_no, s.gr_number AS gr_number FROM (SELECT id, unnest(list_filter(blocks, lambda b: list_contains(valid, b.n))) AS s FROM cv)",
    "hard_abstention": _HITS60 + ', t AS (SELECT query_id, max(score) AS "top" FROM dn WHERE row_id <> query_id GROUP BY query_id) SELECT query_id, "top", "top" < 0.30 AS abstains FROM t',
    "abstain_language": "SELECT DISTINCT ON (id, content) id, CASE WHEN regexp_matches(content, '[ऀ-ॿ]') THEN 'mr' ELSE 'en' END AS language FROM messages WHERE content IS NOT NULL",
    "prompt_messages": _TRIM + ", " + trimmed(1000) + """, bl AS (SELECT query_id, string_agg('[' || block_no || '] ' || text, chr(10) || chr(10) ORDER BY block_no) AS ctx FROM tr WHERE kept GROUP BY query_id)
        SELECT qu.query_id, 2 AS n_messages, md5('Context:' || chr(10) || coalesce(ctx, '') || chr(10) || chr(10) || 'Question: ' || qu.text || chr(10) || 'Cite the blocks you use.') AS digest FROM qu LEFT JOIN bl USING (query_id)""",
    "conversation_list": """WITH c AS (SELECT DISTINCT id, user_id, title, created_at FROM conversations), n AS (SELECT conversation_id, count(DISTINCT id) AS n FROM messages GROUP BY 1)
        SELECT id, user_id, title, created_at, coalesce(n, 0) AS n_messages FROM c LEFT JOIN n ON conversation_id = id""",
    "daily_token_quota": 'SELECT user_id, ts::DATE::VARCHAR AS "day", round(sum(value), 4) AS used, round(greatest(500.0 - sum(value), 0), 4) AS remaining FROM events GROUP BY 1, 2',
    "audit_latest": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "feedback_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
    "hit_at_k_mrr": _SCORED + """, f AS (SELECT query_id, min(rank) AS top FROM rk WHERE good GROUP BY query_id), q AS (SELECT DISTINCT query_id FROM qu)
        SELECT count(*) AS n_queries, count(*) FILTER (top = 1) AS hit1, count(*) FILTER (top <= 5) AS hit5, round(avg(coalesce(1.0::DOUBLE / top, 0)), 9) AS mrr FROM q LEFT JOIN f USING (query_id)""",
    "score_separation": _SCORED + " SELECT kind, count(*) AS n, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90 FROM sc GROUP BY kind",
    "suggested_threshold": _SCORED + """, q AS (SELECT quantile_cont(score, 0.25) FILTER (kind = 'keep') AS lo, quantile_cont(score, 0.75) FILTER (kind = 'reject') AS hi FROM sc)
        SELECT round((lo + hi) / 2, 4) AS threshold, round(lo - hi, 4) AS gap FROM q""",
    "source_answer_metrics": _ANSWERS + """ SELECT in_corpus, count(*) AS n, count(*) FILTER (cited) AS cited, count(*) FILTER (grounded) AS grounded, count(*) FILTER (correct) AS correct, count(*) FILTER (degenerate) AS degenerate,
        count(*) FILTER (refused) AS refused FROM fl GROUP BY in_corpus""",
    "source_failure_labels": _ANSWERS + """, l AS (SELECT CASE WHEN NOT grounded THEN 'PHANTOM' END AS label FROM fl WHERE in_corpus
        UNION ALL SELECT CASE WHEN degenerate THEN 'DEGENERATE' WHEN NOT correct THEN 'WRONG-SOURCE' WHEN NOT cited THEN 'UNCITED' END FROM fl WHERE in_corpus
        UNION ALL SELECT CASE WHEN NOT refused THEN 'NO-ABSTAIN' END FROM fl WHERE NOT in_corpus) SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label""",
    "dense_id_space": "WITH " + _CHUNKS + ", a AS (SELECT count(*) AS n_rows, count(DISTINCT faiss_id) AS n_ids, min(faiss_id) AS first_id, max(faiss_id) AS last_id FROM chunks) SELECT *, n_rows = n_ids AND first_id = 0 AND last_id = n_rows - 1 AS dense FROM a",
    "orphan_chunks": "WITH " + _CHUNKS + " SELECT faiss_id, gr_id FROM chunks WHERE NOT EXISTS (SELECT 1 FROM gr_documents d WHERE d.doc_id = gr_id)",
    "empty_documents": "WITH " + _DOCS + " SELECT doc_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM gr_chunks c WHERE c.gr_id = doc_id AND c.faiss_id IS NOT NULL)",
    "upsert_keep_latest": "WITH " + _DOCS + " SELECT doc_id, gr_number, date, title, ingested_at FROM docs",
    "resume_anti_join": "WITH " + _DOCS + " SELECT doc_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM gr_chunks c WHERE c.gr_id = doc_id AND c.faiss_id IS NOT NULL)",
    "truncate_from_id": "WITH " + _DOCS + ", " + _CHUNKS + " SELECT count(*) AS n_chunks, (SELECT count(*) FROM docs WHERE doc_id IN (SELECT gr_id FROM chunks WHERE faiss_id < 1000)) AS n_documents FROM chunks WHERE faiss_id < 1000",
}
