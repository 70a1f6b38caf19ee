"""DuckDB SQL with the results of the queries, by name."""

from ..functions.generate import QUESTION_TEMPLATE, SYSTEM_PROMPT
from ..functions.guard import GREETINGS, NO_INFORMATION, NOT_FULLY_VERIFIED, NOT_VERIFIED, OFF_TOPIC, OUT_OF_SCOPE, STOPWORDS
from ..operators.overview import DIALOGUE, SLIDES
from . import chunk_sql


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(map(lit, STOPWORDS)) + "]"
SRC = "SELECT doc_id AS id, source AS notebook_id, text, lang, sha256(text) AS content_hash FROM documents"
REGISTRY = f"SELECT content_hash, min(id) AS first_id, count(*)::BIGINT AS n_refs, arg_min(text, id) AS text FROM ({SRC}) GROUP BY content_hash"


def words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-zA-Z]{{3,}}')), lambda w: NOT list_contains({STOP}, w))"


QUESTIONS = "SELECT conv_id, turn, conv_id || '-' || turn AS question_id, 'src' || (conv_id % 20) AS notebook_id, text AS question FROM conversations WHERE role = 'user'"
PHRASES = rf"""(trim(question) <> '' AND NOT regexp_matches(lower(question), '^\s*(?:{"|".join(GREETINGS).replace("'", "''")})\b') AND NOT regexp_matches(lower(question), '{"|".join(OFF_TOPIC)}'))"""
BUDGET = f"""
WITH s AS (SELECT * FROM ({SRC}) WHERE length(text) > 0),
r AS (SELECT notebook_id, id, length(text) AS chars, row_number() OVER w AS n, sum(length(text)) OVER w AS running FROM s WINDOW w AS (PARTITION BY notebook_id ORDER BY id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, max(n > 1 AND running > 30000) OVER (PARTITION BY notebook_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS over FROM r),
b AS (SELECT notebook_id, count(*)::BIGINT AS total_count, sum(chars) FILTER (NOT over)::BIGINT AS total_chars, count(*) FILTER (NOT over)::BIGINT AS used_count FROM k GROUP BY notebook_id)
"""


def top(metric: str, extra: str = "") -> str:
    pair = "list_zip(e.embedding, q.embedding)"
    score = f"1 - list_sum(list_transform({pair}, lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"
    if metric == "cosine":
        dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
        score = f"{dot('e.embedding', 'q.embedding')} / sqrt({dot('e.embedding', 'e.embedding')} * {dot('q.embedding', 'q.embedding')})"
    return f"""
s AS (SELECT q.vec_id AS question_id, e.label, e.vec_id, round({score}, 6) AS score FROM embeddings e, q),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id, label ORDER BY score DESC, vec_id) AS place FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, label, vec_id) AS rank FROM p WHERE place <= 3)"""


MANY = "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), "
PROVENANCE = (
    MANY + top("l2") + """,
n AS (SELECT (doc_id % 15)::INT AS label, arg_min(source, doc_id) AS filename FROM documents WHERE doc_id % 15 % 3 <> 0 GROUP BY 1),
v AS (SELECT question_id, rank, vec_id, coalesce(filename, 'unknown') AS filename, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 7 END AS page, coalesce(d.text, '') AS text, score
      FROM h LEFT JOIN n USING (label) LEFT JOIN documents d ON d.doc_id = h.vec_id WHERE rank <= 5)
"""
)
PROMPTS = f"""
WITH q AS (SELECT *, CASE WHEN turn % 4 = 0 THEN '' ELSE notebook_id END AS context FROM ({QUESTIONS})),
p AS (SELECT *, CASE WHEN context = '' THEN question ELSE {lit(QUESTION_TEMPLATE[0])} || context || {lit(QUESTION_TEMPLATE[1])} || question END AS asked FROM q),
k AS (SELECT *, 'system:' || '<|think|>' || {lit(SYSTEM_PROMPT)} || '|user:' || asked AS key FROM p)
"""
TOKENS = r"regexp_extract_all(question, '\S+')"

CHUNKS = "WITH RECURSIVE " + chunk_sql.chunks("SELECT doc_id AS key, text FROM documents")
#: Benchmark items asked to notebooks; chunks of their contents by the hash embedder; the best three of a content, five in all.
ASKED = f"""
WITH RECURSIVE {chunk_sql.chunks(f"SELECT content_hash AS key, text FROM ({REGISTRY})")},
src AS ({SRC}),
q AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS notebook_id, QUESTION AS question FROM benchmark),
qw AS (SELECT question_id, notebook_id, unnest({words('question')}) AS word FROM q WHERE {PHRASES}),
vw AS (SELECT DISTINCT notebook_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z]{{3,}}')) AS word FROM src),
hit AS (SELECT DISTINCT question_id FROM qw JOIN vw USING (notebook_id, word)),
own AS (SELECT DISTINCT notebook_id, content_hash FROM src),
cv AS (SELECT key, chunk_index, document, {chunk_sql.vector("document", 64)} AS v FROM chunk),
qv AS (SELECT q.*, {chunk_sql.vector("question", 64, "query")} AS v FROM q JOIN hit USING (question_id)),
sc AS (SELECT question_id, key, chunk_index, round(1 - list_sum(list_transform(list_zip(cv.v, qv.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 12) AS score FROM qv JOIN own USING (notebook_id) JOIN cv ON cv.key = own.content_hash),
b3 AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY score DESC, chunk_index) AS place FROM sc),
b5 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key, chunk_index) AS rank FROM b3 WHERE place <= 3),
fn AS (SELECT content_hash AS key, arg_min(notebook_id || '.txt', id) AS filename FROM src WHERE notebook_id IN (SELECT notebook_id FROM q) GROUP BY 1),
ht AS (SELECT question_id, rank, filename, chunk_index + 1 AS page, document FROM b5 JOIN chunk USING (key, chunk_index) JOIN fn USING (key) WHERE rank <= 5),
ct AS (SELECT question_id, count(DISTINCT (filename, page))::INT AS n_sources, string_agg('[Source ' || rank || '] (' || filename || ', Page ' || page || ')' || chr(10) || document, chr(10) || chr(10) ORDER BY rank) AS context FROM ht GROUP BY 1),
ci AS (SELECT question_id, '[' || string_agg('{{"filename":"' || filename || '","page":' || page || '}}', ',' ORDER BY r) || ']' AS cited FROM (SELECT question_id, filename, page, min(rank) AS r FROM ht GROUP BY 1, 2, 3) GROUP BY 1),
j AS (SELECT q.*, hit.question_id IS NOT NULL AS in_scope, coalesce(context, '') AS context, coalesce(n_sources, 0) AS n_sources, coalesce(cited, '[]') AS cited FROM q LEFT JOIN hit USING (question_id) LEFT JOIN ct USING (question_id) LEFT JOIN ci USING (question_id)),
m AS (SELECT *, {lit(QUESTION_TEMPLATE[0])} || context || {lit(QUESTION_TEMPLATE[1])} || question AS asked FROM j),
s AS (SELECT *, '[mock answer ' || substr(sha256('system:<|think|>' || {lit(SYSTEM_PROMPT)} || '|user:' || asked), 1, 8) || '] Based on the provided sources, here is a response to: ' || substr(asked, 1, 60) || '.' AS said FROM m),
g AS (SELECT *, len(list_intersect({words('said')}, {words('context')})) / len({words('said')}) AS share FROM s),
a AS (SELECT *, CASE WHEN NOT in_scope THEN {lit(OUT_OF_SCOPE)} WHEN context = '' THEN {lit(NO_INFORMATION)} WHEN len({words('context')}) = 0 THEN said || {lit(NOT_VERIFIED)} WHEN share >= 0.5 THEN said ELSE said || {lit(NOT_FULLY_VERIFIED)} END AS answer,
        CASE WHEN trim(coalesce(question, '')) = '' THEN 'Question is required.' WHEN in_scope AND context <> '' AND length(question) % 7 = 0 THEN 'ValueError: refused' END AS error FROM g)
"""
#: Events that the watermark of a stream, a day behind the newest, has passed; with their number for each user.
PASSED = """m AS (SELECT (epoch_us(max(ts)) // 1000 - 86400000) * 1000 AS mark FROM events),
e AS (SELECT *, epoch_us(ts) AS us, (props->>'k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events, m WHERE epoch_us(ts) <= mark),"""
#: State after each event of a job (states by their place), then what each event ended; twelve hours are 43200000000.
JOB_RUNS = f"""
WITH RECURSIVE {PASSED}
v AS (SELECT user_id, n, us, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS k FROM e),
r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS run, 0::BIGINT AS state, NULL::BIGINT AS since, NULL::BIGINT AS started, 0::BIGINT AS steps, 0::BIGINT AS refused, NULL::BIGINT AS k, NULL::BIGINT AS us,
        false AS stuck, false AS refuse FROM (SELECT DISTINCT user_id FROM v)
  UNION ALL
  SELECT user_id, n,
    CASE WHEN NOT refuse AND (k = 1 OR open IS NULL) THEN run + 1 ELSE run END, CASE WHEN refuse THEN now ELSE k END, CASE WHEN refuse THEN since WHEN k >= 4 THEN NULL ELSE us END,
    CASE WHEN refuse THEN open WHEN k >= 4 THEN NULL WHEN k = 1 OR open IS NULL THEN us ELSE open END, CASE WHEN refuse THEN own WHEN k >= 4 THEN 0 WHEN k = 1 OR open IS NULL THEN 1 ELSE own + 1 END,
    CASE WHEN refuse THEN no + (open IS NOT NULL)::BIGINT WHEN k >= 4 OR k = 1 OR open IS NULL THEN 0 ELSE no END, k, us, stuck, refuse
  FROM (SELECT *, k <> 1 AND (now = 5 OR (k = 5 AND now = 4) OR (k <> 5 AND k <= now)) AS refuse
    FROM (SELECT r.user_id, v.n, v.k, v.us, r.run, coalesce(r.since + 43200000000 < v.us, false) AS idle, idle AS stuck, CASE WHEN NOT idle THEN r.since END AS since, CASE WHEN idle THEN 5 ELSE r.state END AS now,
            CASE WHEN NOT idle THEN r.started END AS open, CASE WHEN idle THEN 0 ELSE r.steps END AS own, CASE WHEN idle THEN 0 ELSE r.refused END AS no
          FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1))),
b AS (SELECT r.user_id::VARCHAR AS job, r.run AS new_run, r.k, r.us, r.stuck, r.refuse, p.run, p.state, p.since, p.started, p.steps, p.refused, NOT r.stuck AND p.started IS NOT NULL AS going FROM r JOIN r p ON p.user_id = r.user_id AND p.n = r.n - 1),
l AS (SELECT r.* FROM r JOIN (SELECT user_id, max(n) AS n FROM r GROUP BY 1) USING (user_id, n)),
s AS (SELECT ['queued', 'scripting', 'synthesizing', 'ready', 'failed'] AS names)
SELECT job, run, 'failed' AS status, 'stuck' AS reason, started, since + 43200000000 AS ended, steps, refused FROM b WHERE stuck
UNION ALL SELECT job, run, names[state], 'queued anew', started, us, steps, refused FROM b, s WHERE k = 1 AND going
UNION ALL SELECT job, new_run, names[k], 'step', CASE WHEN going THEN started ELSE us END, us, CASE WHEN going THEN steps + 1 ELSE 1 END, CASE WHEN going THEN refused ELSE 0 END FROM b, s WHERE NOT refuse AND k >= 4
UNION ALL SELECT user_id::VARCHAR, run, 'failed', 'stuck', started, since + 43200000000, steps, refused FROM l, m WHERE since + 43200000000 <= mark
"""
#: The same for voice connections; six hours are 21600000000.
VOICE_HISTORY = f"""
WITH RECURSIVE {PASSED}
v AS (SELECT user_id, n, us, event_id AS seq, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'view' THEN 'start' WHEN 'click' THEN 'audio' WHEN 'purchase' THEN 'stop' ELSE CASE WHEN k % 2 = 0 THEN 'cancel' ELSE 'disconnect' END END AS event,
        CASE WHEN k % 10 <> 0 THEN k END AS nb, value >= 5 AS auth, k % 4 <> 0 AS owner FROM e),
r AS (SELECT user_id, 0::BIGINT AS n, false AS live, NULL::BIGINT AS held, NULL::BIGINT AS started, NULL::BIGINT AS last, 0::BIGINT AS turns FROM (SELECT DISTINCT user_id FROM v)
  UNION ALL
  SELECT user_id, n, CASE WHEN event = 'connect' THEN auth WHEN event = 'disconnect' THEN false ELSE live END,
    CASE WHEN fresh THEN nb WHEN gone THEN NULL ELSE own END, CASE WHEN fresh THEN us WHEN gone OR own IS NULL THEN NULL ELSE started END,
    CASE WHEN fresh THEN us WHEN gone OR own IS NULL THEN NULL WHEN live OR event = 'connect' THEN us ELSE last END, CASE WHEN fresh OR gone OR own IS NULL THEN 0 WHEN live AND event = 'stop' THEN turns + 1 ELSE turns END
  FROM (SELECT v.*, r.live, r.started, r.last, r.turns, CASE WHEN NOT coalesce(r.last + 21600000000 < v.us, false) THEN r.held END AS own, r.live AND event = 'start' AND nb IS NOT NULL AND owner AS fresh, r.live AND event IN ('cancel', 'disconnect') AS gone
        FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1)),
b AS (SELECT v.*, p.live, p.held, p.started, p.last, p.turns, coalesce(p.last + 21600000000 < v.us, false) AS over FROM v JOIN r p ON p.user_id = v.user_id AND p.n = v.n - 1),
y AS (SELECT *, CASE WHEN event = 'connect' THEN CASE WHEN NOT auth THEN 'rejected' END WHEN NOT live THEN NULL WHEN event = 'start' THEN CASE WHEN nb IS NULL THEN 'error: notebook_id required' WHEN NOT owner THEN 'error: not owner' ELSE 'ready' END
        WHEN event = 'audio' THEN 'error: audio must be sent via HTTP POST /voice/turn' WHEN event = 'stop' THEN 'sending' WHEN event = 'cancel' THEN 'cancelled' END AS reply FROM b),
l AS (SELECT r.* FROM r JOIN (SELECT user_id, max(n) AS n FROM r GROUP BY 1) USING (user_id, n))
SELECT user_id::VARCHAR AS sid, seq, 'reply' AS kind, reply AS text, NULL::BIGINT AS notebook_id, NULL::BIGINT AS user_id, NULL::BIGINT AS started, NULL::BIGINT AS ended, NULL::BIGINT AS turns FROM y WHERE reply IS NOT NULL
UNION ALL SELECT user_id::VARCHAR, NULL, 'end', 'expired', held, user_id, started, last + 21600000000, turns FROM b WHERE over
UNION ALL SELECT user_id::VARCHAR, seq, 'end', CASE event WHEN 'start' THEN 'started anew' WHEN 'cancel' THEN 'cancelled' ELSE 'disconnected' END, held, user_id, started, us, turns FROM b
  WHERE live AND NOT over AND held IS NOT NULL AND (event IN ('cancel', 'disconnect') OR (event = 'start' AND nb IS NOT NULL AND owner))
UNION ALL SELECT user_id::VARCHAR, NULL, 'end', 'expired', held, user_id, started, last + 21600000000, turns FROM l, m WHERE last + 21600000000 <= mark
"""

SPOKEN = "'## Head' || chr(10) || '- **a** [Source 1] , `c` ' || text"
#: Formatted text to spoken text by other patterns: a neighbour that may not be a letter is taken along and put back.
for _pattern, _by in [
    (r"(?i)\[source\s+\d+(\s*,\s*source\s+\d+)*\]", ""), (r"```[^\n]*\n?", ""), (r"`([^`]*)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^\n]+?)\*\*", r"\1"),
    (r"(?m)(^|[^\pL\pN_])__([^\n]+?)__($|[^\pL\pN_])", r"\1\2\3"), (r"(?m)(^|[^\pL\pN_])\*([^\n]+?)\*($|[^\pL\pN_])", r"\1\2\3"), (r"\[([^\]]*)\]\([^\)]*\)", r"\1"),
    (r"(?m)^[\-\*]\s+", ""), (r"(?m)^[\-\*]{3,}\s*$", ""), (r"\s+([.,;:!?)])", r"\1"), (r"\n{3,}", r"\n\n"), (r"^\s+|\s+$", ""),
]:
    SPOKEN = f"regexp_replace({SPOKEN}, {lit(_pattern)}, {lit(_by) if _by != chr(92) + 'n' + chr(92) + 'n' else 'chr(10) || chr(10)'}, 'g')"
NTH = lambda k: rf"coalesce(string_split_regex(text, '\s+')[{k}], '-')"

#: Texts in pages of forty lines, without white space at the ends of a page.
PDF = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id % 5 <> 3),
p AS (SELECT *, unnest(range(1, (len(lines) + 39) // 40 + 1)) AS page FROM l),
t AS (SELECT doc_id, page::INT AS page, regexp_replace(array_to_string(lines[40 * (page - 1) + 1:40 * page], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM p)"""

#: Texts within the budget, and the length of a script by their characters.
CHOSEN = f"""{BUDGET},
c AS (SELECT k.notebook_id, string_agg(s.text, chr(10) || chr(10) ORDER BY k.id) AS texts, least(greatest(sum(k.chars) // 150, 60), 480)::INT AS a FROM k JOIN s USING (notebook_id, id) WHERE NOT over GROUP BY 1)"""
DIALOGUE_ASKED = (
    "You are a creative assistant that produces engaging two-host podcast dialogues. Given source texts, write a natural conversation between Ava and Andrew that summarizes and discusses the key points. ",
    "The hosts should alternate turns, reference the sources naturally, and keep it engaging. Ava should introduce herself as Ava, and Andrew should introduce himself as Andrew. Never use generic labels like 'Host A' or 'Host B' — always use their real names. "
    'IMPORTANT: In the JSON, use "host": "A" for Ava and "host": "B" for Andrew. Respond as JSON: {"dialogue": [{"host": "A", "text": "..."}, {"host": "B", "text": "..."}, ...]}',
)
SLIDES_ASKED = (
    "You are an expert educator creating a narrated video presentation. Given source texts, produce a slide-by-slide script with narration. "
    """

RULES:
- Generate exactly 5-8 slides (title + 4-7 content slides + summary).
- Each slide has a short heading (max 8 words) and 2-3 very short bullet points (max 6 words each).
- Bullets are visual anchors only — the narration carries the depth.
- Each slide has a narration: 2-4 conversational sentences (max 60 words) that explain, connect, and elaborate. Do NOT just read the bullets aloud. Use analogies, transitions, and an enthusiastic expert tone.
- The title slide narration should introduce the topic enthusiastically.
- The summary slide narration should recap key takeaways.
""",
    'Respond as JSON: {"slides": [{"type": "title", "heading": "Short Title", "bullets": ["Brief subtitle"], "narration": "Welcome! Today we are going to explore..."}, {"type": "content", "heading": "Key Concept", "bullets": ["Point 1", "Point 2"], '
    '"narration": "Let me explain this in more detail..."}, {"type": "summary", "heading": "Key Takeaways", "bullets": ["Takeaway 1", "Takeaway 2"], "narration": "To wrap up, here is what we covered..."}...]}',
)

ORACLE_SQL = {
    "pdf_pages": PDF + """ SELECT doc_id, page, md5(text) AS digest, NULL::VARCHAR AS error FROM t
UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: a stream without its end' FROM documents WHERE doc_id % 5 = 3""",
    "pdf_texts": PDF + """ SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest, max(page)::INT AS page_count, NULL::VARCHAR AS error FROM t GROUP BY 1
UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: a stream without its end' FROM documents WHERE doc_id % 5 = 3""",
    "image_rows": """
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, (i - 1)::INT AS image_idx, md5(lines[i]) AS digest FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)""",
    "image_row_texts": """
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM documents),
i AS (SELECT doc_id, i, '[Image ' || i || ']' || chr(10) || '[mock OCR text recognition page ' || substr(sha256(lines[i]), 1, 8) || '] The document contains searchable content extracted via mock OCR.' AS t FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE i % 3 <> 0)
SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS digest FROM i GROUP BY 1""",
    "image_sizes": """
WITH s AS (SELECT p_partkey, (p_partkey * 37 % 50 + 1)::INT AS w, (p_partkey * 91 % 40 + 1)::INT AS h FROM part), f AS (SELECT *, least(1::DOUBLE, 16::DOUBLE / greatest(w, h)) AS scale FROM s),
t AS (SELECT p_partkey, w, h, greatest(1, trunc(w * scale))::INT AS v, greatest(1, trunc(h * scale))::INT AS g FROM f),
x AS (SELECT p_partkey, w, h, v, g, unnest(range(v)) AS x FROM t), y AS (SELECT *, unnest(range(g)) AS y FROM x),
a AS (SELECT *, unnest(range(x * w // v, ((x + 1) * w + v - 1) // v)) AS i FROM y), b AS (SELECT *, unnest(range(y * h // g, ((y + 1) * h + g - 1) // g)) AS j FROM a),
c AS (SELECT p_partkey, x, y, sum((least((i + 1) * v, (x + 1) * w) - greatest(i * v, x * w)) * (least((j + 1) * g, (y + 1) * h) - greatest(j * g, y * h)) * ((7 * i + 13 * j + p_partkey) % 256))::BIGINT // any_value(w * h) AS p FROM b GROUP BY 1, 2, 3)
SELECT p_partkey, 'png' AS format, any_value(w) AS width, any_value(h) AS height, any_value(v) AS to_width, any_value(g) AS to_height, md5(string_agg(p::VARCHAR, ',' ORDER BY y, x)) AS digest FROM c JOIN t USING (p_partkey) GROUP BY 1""",
    "speech_inputs": """
WITH e AS (SELECT event_id, (props->>'k')::INT AS k, [8000, 11025, 16000, 22050, 44100, 48000][event_id % 6 + 1] AS rate, (event_id % 2 + 1)::INT AS c FROM events),
n AS (SELECT *, k * 40 + 1 AS frames, (k * 40 + 1) * 1000 // rate AS ms, k % 17 = 0 AS broken, k % 17 <> 0 AND 56 + (k * 40 + 1) * c * 2 > 12000 AS large FROM e)
SELECT event_id, CASE WHEN NOT broken AND NOT large THEN ms END::INT AS duration_ms, CASE WHEN NOT broken AND NOT large THEN rate END::INT AS from_rate,
  CASE WHEN NOT broken AND NOT large AND ms <= 250 THEN (frames * 16000 + rate - 1) // rate END::INT AS n_samples,
  CASE WHEN large THEN 'AudioTooLongError: Audio upload exceeds 12000 bytes.' WHEN broken THEN 'UnsupportedAudioFormatError: Could not decode audio (.wav): no RIFF file' WHEN ms > 250 THEN 'AudioTooLongError: Audio exceeds 250 ms.' END AS error FROM n""",
    "script_requests": CHOSEN + f""" SELECT notebook_id,
  md5('system:' || {lit(DIALOGUE_ASKED[0])} || 'The dialogue should be about ' || a || ' seconds when spoken (~' || floor(a * 2.5)::INT || ' words). ' || {lit(DIALOGUE_ASKED[1])} || '|user:' || CASE WHEN length(notebook_id) % 2 = 0 THEN 'Focus the discussion on: ' || notebook_id || chr(10) || chr(10) ELSE '' END
    || 'Write a two-host podcast dialogue based on these source texts:' || chr(10) || chr(10) || texts) AS dialogue,
  md5('system:' || {lit(SLIDES_ASKED[0])} || '- Total narration across all slides should be about ' || a || ' seconds when spoken (~' || floor(a * 2.5)::INT || ' words total). ' || {lit(SLIDES_ASKED[1])} || '|user:' || CASE WHEN length(notebook_id) % 2 = 0 THEN 'Focus the presentation on: ' || notebook_id || chr(10) || chr(10) ELSE '' END
    || 'Create a narrated video presentation based on these source texts:' || chr(10) || chr(10) || texts) AS slides FROM c""",
    "scripts_made": CHOSEN + r""", asks AS (SELECT notebook_id, 'dialogue' AS part, 'Write a two-host podcast dialogue based on these source texts:' || chr(10) || chr(10) || texts AS asked FROM c
  UNION ALL SELECT notebook_id, 'slides', 'Create a narrated video presentation based on these source texts:' || chr(10) || chr(10) || texts FROM c),
q AS (SELECT *, length(asked) % 11 = 0 AS failed, length(asked) % 7 = 0 AS odd, replace(replace(substr(asked, greatest(1, length(asked) - 39)), chr(10), ' '), '"', chr(39)) AS quoted FROM asks),
t AS (SELECT *, regexp_replace(quoted, '^\s+', '') AS lead, regexp_replace(quoted, '^\s+|\s+$', '', 'g') AS both_ends FROM q)
SELECT notebook_id, part, CASE WHEN failed THEN 'ValueError: too much' END AS error, CASE WHEN failed OR odd THEN 0 WHEN part = 'dialogue' THEN 3 ELSE 1 END::INT AS n,
  md5(CASE WHEN failed OR odd THEN '' WHEN part = 'dialogue' THEN 'A ' || lead || ' 0' || chr(10) || 'B ' || lead || ' 1' || chr(10) || 'A ' || lead || ' 2' ELSE 'content ' || both_ends || ' ' || length(asked) || ' ' || both_ends END) AS digest FROM t""",
    "summaries_kept": CHOSEN + f""", g AS (SELECT notebook_id, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS signature, coalesce(try_cast(substr(notebook_id, 4) AS INT), 1) AS k FROM ({SRC}) WHERE content_hash IS NOT NULL GROUP BY 1),
m AS (SELECT g.*, 'Summarize the following source texts and suggest 5 questions:' || chr(10) || chr(10) || texts AS asked FROM g LEFT JOIN c ON c.notebook_id = g.notebook_id),
p AS (SELECT *, 'You are a helpful assistant that summarizes documents. Given the source texts, produce a concise summary (max 150 words) and 5 suggested questions a user might ask. Respond as JSON: {{"summary": "...", "suggested_questions": ["q1", ...]}}' AS prompt FROM m)
SELECT notebook_id, CASE WHEN k % 4 = 0 THEN 'old' WHEN asked IS NULL THEN 'No sources have been uploaded yet.'
  ELSE '[mock answer ' || substr(sha256('system:' || prompt || '|user:' || asked), 1, 8) || '] Based on the provided sources, here is a response to: ' || substr(asked, 1, 60) || '.' END AS summary,
  (k % 12 = 0)::INT AS n_questions, signature AS content_signature, k % 4 = 0 AS skipped FROM p""",
    "appended_rows": """
SELECT (SELECT max(event_id) FROM events WHERE event_id % 2 = 0) + row_number() OVER (ORDER BY ts) AS id, ts AS created_at FROM events WHERE event_id % 2 = 1""",
    "token_vectors": r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), l AS (SELECT doc_id, text, coalesce(ws[-1], '-') AS w FROM w)
SELECT doc_id, CASE WHEN text <> '' THEN length(w) || ',' || ord(w[1:1]) || ',' || ord(w[-1:]) END AS vector FROM l""",
    "source_references": f"""
WITH s AS ({SRC}) SELECT id AS doc_id, CASE WHEN content_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content_hash, notebook_id) - 1 END::BIGINT AS here,
  CASE WHEN content_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content_hash) - count(*) OVER (PARTITION BY content_hash, notebook_id) END::BIGINT AS elsewhere FROM s""",
    "user_by_name": "SELECT c_custkey, c_name, 'Customer#000000007' AS asked FROM customer WHERE c_name = 'Customer#000000007'",
    "seeded_admins": """
SELECT n_nationkey::BIGINT AS id, n_name AS username, CASE WHEN n_name = 'NATION_3' THEN 'admin' ELSE 'user' END AS role, CASE WHEN n_name = 'NATION_3' THEN 'new' ELSE 'old' END AS password_hash FROM nation
UNION ALL SELECT max(n_nationkey) + 1, 'admin', 'admin', 'first' FROM nation""",
    "user_list": "SELECT c_custkey AS id, c_name AS username, DATE '2024-01-01' + (c_nationkey * 7 % 25)::INT AS created_at FROM customer ORDER BY created_at, id LIMIT 20",
    "newest_sources": "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 20",
    "source_list": """
WITH e AS (SELECT *, (props->>'k')::INT AS k FROM events)
SELECT event_id AS id, event_type || '.pdf' AS filename, 'pdf' AS content_type, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, k * 100 AS char_count, CASE WHEN k % 3 <> 0 THEN k END AS page_count,
  CASE WHEN k % 5 = 0 THEN 'broken' END AS error_message, CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k % 7 = 0 OR epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END END AS created_at FROM e""",
    "length_requests": BUDGET + """, t AS (SELECT notebook_id, least(greatest(total_chars // 150, 60), 480)::INT AS a, least(greatest(total_chars // 150, 90), 300)::INT AS b FROM b)
SELECT notebook_id, 'The dialogue should be about ' || a || ' seconds when spoken (~' || floor(a * 2.5)::INT || ' words). ' AS dialogue,
  '- Total narration across all slides should be about ' || b || ' seconds when spoken (~' || floor(b * 2.5)::INT || ' words total). ' AS slides FROM t""",
    "collection_texts": MANY + top("l2") + ", t AS (SELECT s.*, d.text, row_number() OVER (PARTITION BY question_id, label ORDER BY score DESC, s.vec_id) AS n FROM s JOIN documents d ON d.doc_id = s.vec_id)"
    " SELECT question_id, label, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n), '')) AS digest FROM t WHERE n <= 2 GROUP BY 1, 2",
    "collections_left": "SELECT label, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS total FROM embeddings WHERE label % 3 <> 0 GROUP BY 1",
    "dialogue_markers": r"""
SELECT conv_id, turn, 0::INT AS pos, 'A' AS host, md5(regexp_replace(text, '^\s+', '') || '"}, {') AS digest FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'B', md5('he said "no" "}, {') FROM conversations UNION ALL SELECT conv_id, turn, 2, 'B', md5('"}, {') FROM conversations
UNION ALL SELECT conv_id, turn, 3, 'A', md5(role || CASE WHEN turn % 2 = 0 THEN '"}]}' ELSE '' END) FROM conversations""",
    "final_answers": r"""
WITH c AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN regexp_replace(text || ' end', '^\s+', '') WHEN 1 THEN '<|channel|thought' || chr(10) || role || '<channel|>' ELSE t END) AS digest FROM c""",
    "script_signatures": "SELECT conv_id, substr(sha256(string_agg(text, '|' ORDER BY turn)), 1, 12) AS signature FROM conversations GROUP BY 1",
    "reply_names": r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) WHEN 3 THEN CASE WHEN page_id % 3 > 0 THEN substr(url, 1, (page_id % 3)::INT) END END AS name FROM pages""",
    "latencies": "SELECT event_id, trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000)::INT AS latency_ms FROM events",
    "wrapped_lines": r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda acc, w: CASE WHEN length(regexp_extract(acc, '[^\n]*$')) + 1 + length(w) <= 40 THEN acc || ' ' || w ELSE acc || chr(10) || w END) END AS lines FROM w)
SELECT conv_id, turn, CASE WHEN lines = '' THEN 0 ELSE len(string_split(lines, chr(10))) END::INT AS n_lines, md5(lines) AS digest FROM l""",
    "audible_slides": "SELECT user_id, count(*)::BIGINT AS n_slides, bool_or(user_id % 3 <> 0 AND event_type = 'view') AS any_audio FROM events GROUP BY 1",
    "clean_for_tts": f"SELECT doc_id, md5({SPOKEN}) AS digest FROM (SELECT doc_id, text FROM documents)",
    "markdown_html": r"""
WITH l AS (SELECT conv_id, turn, string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)) AS lines FROM conversations)
SELECT conv_id, turn, md5('<h2 class="md-heading">Head</h2><ul class="md-list"><li><em>a</em></li><li>b</li></ul><blockquote class="md-blockquote">' || lines[1] || '</blockquote>' || CASE WHEN len(lines) > 1 THEN '<p>' || array_to_string(lines[2:], ' ') || '</p>' ELSE '' END) AS digest FROM l""",
    "markdown_parts": f"""
WITH e AS (SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM conversations)
SELECT conv_id, turn, '<ol class="md-list"><li><strong>' || {NTH(1)} || '</strong> and <code class="md-code">' || {NTH(2)} || 'a*&lt;b&gt;*</code></li><li><a href="https://example.org/' || {NTH(4)} || '" target="_blank" rel="noopener noreferrer">' || {NTH(3)}
  || '</a> <em>' || {NTH(5)} || '</em> x_y_z [no](ftp://n)</li></ol><hr class="md-hr"><h3 class="md-heading">' || {NTH(6)} || ' &amp; co</h3><ul class="md-list"><li>' || {NTH(7)} || '</li></ul><pre class="md-code-block"><code># ' || {NTH(8)}
  || ' &lt;i&gt;' || chr(10) || chr(10) || '- ' || {NTH(9)} || '</code></pre><p>last <em>' || {NTH(10)} || '</em> line</p><p>new</p>' AS html FROM e""",
    "ann_exact": MANY + top("l2") + " SELECT question_id, vec_id, label, score, rank::INT AS rank FROM h WHERE rank <= 5",
    "ann_recall": MANY + top("l2") + " SELECT count(DISTINCT question_id)::BIGINT AS n_questions, count(*)::BIGINT AS n_hits, true AS enough FROM h WHERE rank <= 5",
    "stream_distinct": "SELECT DISTINCT sha256(text) AS content_hash FROM documents",
    "guarded_models": """
WITH e AS (SELECT event_id, event_type = 'view' AS skipped, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id, NOT skipped AND k % 7 <> 0 AND k % 11 <> 0 AS ok, CASE WHEN NOT skipped AND k % 7 <> 0 AND k % 11 <> 0 THEN 'said ' || k END AS value,
  CASE WHEN skipped THEN NULL WHEN k % 7 = 0 THEN 'ValueError: refused ' || k WHEN k % 11 = 0 THEN 'RuntimeError: HTTP 429' END AS error,
  CASE WHEN skipped THEN 0 WHEN k % 7 = 0 THEN 1 WHEN k % 5 = 0 OR k % 11 = 0 THEN 2 ELSE 1 END::INT AS attempts FROM e""",
    "job_runs": JOB_RUNS,
    "voice_history": VOICE_HISTORY,
    "registry_dedup": f"SELECT content_hash, 'doc_' || substr(content_hash, 1, 59) AS collection, first_id, n_refs, length(text)::INT AS char_count FROM ({REGISTRY})",
    "collection_names": f"SELECT id AS doc_id, 'doc_' || substr(content_hash, 1, 59) AS collection, substr(content_hash, 1, 16) || '_0' AS first_chunk FROM ({SRC})",
    "shared_refcount": f"SELECT content_hash, count(*)::BIGINT AS n_refs, count(DISTINCT notebook_id)::BIGINT AS n_notebooks FROM ({SRC}) GROUP BY 1 HAVING count(DISTINCT notebook_id) > 1",
    "orphan_content": f"WITH s AS ({SRC}) SELECT DISTINCT content_hash FROM s WHERE notebook_id = 'src0' AND content_hash NOT IN (SELECT content_hash FROM s WHERE notebook_id <> 'src0')",
    "cascade_delete_counts": """
SELECT 'users' AS name, count(*)::BIGINT AS n_left FROM nation WHERE n_nationkey <> 0
UNION ALL SELECT 'notebooks', count(*) FROM customer WHERE c_nationkey <> 0
UNION ALL SELECT 'sources', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS NULL OR c_nationkey <> 0
UNION ALL SELECT 'messages', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND (c_nationkey IS NULL OR c_nationkey <> 0)""",
    "dedup_matrix": f"""
SELECT content_hash, CASE WHEN bool_or(lang = 'en') AND coalesce(max(text) FILTER (id % 3 <> 0), '') <> '' THEN 'cached' WHEN bool_or(lang = 'en') THEN 'drop_and_ingest'
  WHEN coalesce(max(text) FILTER (id % 3 <> 0), '') <> '' THEN 'rebuild' ELSE 'ingest' END AS action FROM ({SRC}) GROUP BY content_hash""",
    "status_update": f"""
SELECT id, CASE WHEN id % 3 <> 0 THEN 'queued' WHEN trim(text) = '' THEN 'partial' ELSE 'ready' END AS status, CASE WHEN id % 3 = 0 THEN length(text) ELSE 0 END::BIGINT AS char_count,
  CASE WHEN id % 2 = 0 THEN 'old' END AS error_message FROM ({SRC})""",
    "recovery_rebuild": f"WITH s AS ({SRC}) SELECT content_hash, length(any_value(text))::INT AS char_count FROM s WHERE content_hash NOT IN (SELECT content_hash FROM s WHERE lang = 'en') AND text <> '' GROUP BY 1",
    "notebook_source_counts": "SELECT source AS notebook_id, count(*)::BIGINT AS n_sources, count(*) >= 50 AS at_cap FROM documents GROUP BY 1",
    "admin_dashboard": """
SELECT n_nationkey AS id, n_name AS username, count(DISTINCT c_custkey)::BIGINT AS n_notebooks, count(o_orderkey)::BIGINT AS n_sources
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "user_sources": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7",
    "role_changes": """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'admin' ELSE 'disabled' END AS after_disable, CASE WHEN n_nationkey % 5 = 0 THEN 'admin' ELSE 'user' END AS after_enable, n_nationkey % 5 <> 1 AS may_sign_in FROM nation""",
    "settings_change": "SELECT c_custkey, CASE WHEN c_custkey % 12 < 9 THEN 'avatar-' || (c_custkey % 12) || '.png' ELSE 'avatar-0.png' END AS avatar FROM customer",
    "notebook_list": "SELECT source AS notebook_id, count(*)::BIGINT AS n_sources, max(doc_id) AS newest FROM documents GROUP BY 1 ORDER BY newest DESC, 1 LIMIT 10",
    "status_filter": r"SELECT source AS notebook_id, CASE WHEN regexp_matches(text, '\S') THEN 'ready' ELSE 'partial' END AS status, count(*)::BIGINT AS n FROM documents WHERE length(text) <= 20000 GROUP BY 1, 2",
    "content_signature": f"SELECT notebook_id, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS signature FROM ({SRC}) GROUP BY 1",
    "signature_skip": f"""
WITH s AS (SELECT *, coalesce(try_cast(substr(notebook_id, 4) AS INT) % 3 = 0, false) AND id = max(id) OVER (PARTITION BY notebook_id) AS late FROM ({SRC})),
g AS (SELECT notebook_id, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS s, sha256(string_agg(content_hash, '|' ORDER BY content_hash) FILTER (NOT late)) AS t FROM s GROUP BY 1)
SELECT notebook_id, coalesce(s = t, false) AS skipped FROM g""",
    "budget_selection": BUDGET + "SELECT notebook_id, total_count, total_chars, used_count FROM b",
    "budget_texts": BUDGET + "SELECT notebook_id, id AS doc_id, chars::INT AS chars, running::BIGINT AS running FROM k WHERE NOT over",
    "duration_target": BUDGET + ", t AS (SELECT notebook_id, least(greatest(total_chars // 150, 60), 480)::INT AS seconds FROM b) SELECT notebook_id, seconds, floor(seconds * 2.5)::INT AS words FROM t",
    "meaningful_words": f"SELECT doc_id, len({words('text')})::INT AS n_words, md5(array_to_string(list_sort({words('text')}), ' ')) AS digest FROM documents",
    "scope_check": f"""
WITH v AS (SELECT DISTINCT notebook_id, unnest({words('text')}) AS word FROM ({SRC})), q AS ({QUESTIONS}),
w AS (SELECT question_id, notebook_id, unnest({words('question')}) AS word FROM q WHERE {PHRASES}), h AS (SELECT DISTINCT question_id FROM w JOIN v USING (notebook_id, word))
SELECT conv_id, turn, h.question_id IS NOT NULL AS in_scope FROM q LEFT JOIN h USING (question_id)""",
    "groundedness": f"""
WITH t AS (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations),
w AS (SELECT *, {words('text')} AS a, {words('before')} AS c FROM t WHERE role = 'assistant'),
g AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN before = '' THEN 1 WHEN len(a) = 0 THEN 0 WHEN len(c) = 0 THEN 1 WHEN len(list_intersect(a, c)) / len(a) >= 0.25 THEN 0 ELSE 2 END AS k FROM w)
SELECT conv_id, turn, k = 0 AS grounded, md5(text || CASE k WHEN 1 THEN {lit(NOT_VERIFIED)} WHEN 2 THEN {lit(NOT_FULLY_VERIFIED)} ELSE '' END) AS result FROM g""",
    "vector_topk": MANY + top("l2") + " SELECT question_id, label, vec_id, score, place::INT AS place FROM p WHERE place <= 3",
    "vector_topk_cosine": MANY + top("cosine") + " SELECT question_id, label, vec_id, score, place::INT AS place FROM p WHERE place <= 3",
    "multi_collection_topk": MANY + top("cosine") + " SELECT question_id, vec_id, label, score, rank::INT AS rank FROM h WHERE rank <= 5",
    "batch_retrieval": MANY + top("l2") + " SELECT question_id, vec_id, label, score, rank::INT AS rank FROM h WHERE rank <= 5",
    "retrieval_provenance": PROVENANCE + "SELECT question_id, rank::INT AS rank, vec_id, filename, page, text, score FROM v",
    "citation_dedup": PROVENANCE + "SELECT question_id, filename, page, min(rank)::INT AS rank, filename || CASE WHEN coalesce(page, 0) <> 0 THEN ' p.' || page ELSE '' END AS label FROM v GROUP BY question_id, filename, page",
    "context_string": PROVENANCE + r"SELECT question_id, string_agg('[Source ' || rank || '] (' || filename || coalesce(', Page ' || page, '') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM v GROUP BY question_id",
    "hash_embedding_norm": f"""
SELECT doc_id, len(v)::INT AS dim, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, md5(array_to_string(list_transform(v, lambda x: floor(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS digest
FROM (SELECT doc_id, {chunk_sql.vector("text", 1024)} AS v FROM documents WHERE text <> '')""",
    "chunks": CHUNKS + " SELECT key AS doc_id, chunk_index, chunk_index + 1 AS page, length(document)::INT AS n_chars, md5(document) AS digest FROM chunk",
    "chunk_stats": CHUNKS + " SELECT key AS doc_id, count(*)::BIGINT AS n_chunks, max(chunk_index + 1)::INT AS last_page, sum(length(document))::BIGINT AS n_chars FROM chunk GROUP BY 1",
    "ask_notebooks": ASKED.replace("QUESTION AS", "text AS") + " SELECT question_id, notebook_id, in_scope, answer, length(context)::INT AS context_chars, n_sources FROM a",
    "stream_ask": ASKED.replace("QUESTION AS", "CASE WHEN item_id % 11 = 0 THEN ' ' ELSE text END AS") + r""", w AS (SELECT question_id::VARCHAR AS question_id, error, list_append(
  CASE WHEN NOT in_scope OR context = '' THEN [to_json({'token': answer})::VARCHAR]
       ELSE list_transform(list_concat(list_transform(regexp_extract_all(said, '\S+'), lambda w: w || ' '), CASE WHEN answer <> said THEN [substr(answer, length(said) + 1)] ELSE []::VARCHAR[] END), lambda x: to_json({'token': x})::VARCHAR) END,
  '{"sources":' || cited || ',"done":true}') AS frames FROM a),
f AS (SELECT question_id, CASE WHEN error IS NULL THEN frames ELSE ['{"error":"' || error || '","done":true}'] END AS frames FROM w)
SELECT question_id, (i - 1)::INT AS seq, frames[i] AS payload FROM (SELECT question_id, frames, unnest(range(1, len(frames) + 1)) AS i FROM f)""",
    "content_type": r"""
WITH n AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) || ['.PDF', '.docx', '.xyz', '', '.tar.md'][page_id % 5 + 1] AS filename FROM pages),
x AS (SELECT *, lower(regexp_extract(filename, '[^./]\.*(\.[^./]+)$', 1)) AS ext FROM n)
SELECT page_id, filename, CASE WHEN ext IN ('.pdf', '.docx', '.pptx', '.txt', '.md') THEN ext[2:] END AS content_type FROM x""",
    "basename_sanitize": r"SELECT page_id, CASE WHEN page_id % 7 < 2 THEN NULL ELSE regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) END AS name FROM pages",
    "upload_validation": """
WITH u AS (SELECT page_id, ['a.html', 'b.txt', 'c.md', 'd.pdf', '..', '', 'e'][page_id % 7 + 1] AS f, page_id % 11 = 0 AS empty, page_id % 13 = 0 AS capped FROM pages),
e AS (SELECT page_id, CASE WHEN capped THEN 'Source limit reached (50).' WHEN empty THEN 'No file provided.' WHEN f = '' THEN 'No file selected.' WHEN f = '..' THEN 'Invalid filename.'
  WHEN f IN ('a.html', 'e') THEN 'Unsupported file type: ' || f WHEN f = 'd.pdf' THEN 'File content does not match its extension: ' || f END AS error FROM u)
SELECT page_id, (CASE WHEN error IS NOT NULL THEN 400 WHEN page_id % 2 = 0 THEN 200 ELSE 201 END)::INT AS http_status, error FROM e""",
    "redact_url": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'postgresql://***@' || regexp_extract(url, '://(.*)$', 1) ELSE url END AS url FROM pages",
    "chat_history": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, role, md5(text) AS digest FROM t WHERE n <= 100",
    "qa_pairs": """
WITH t AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, answer FROM t WHERE role = 'user' AND r = 'assistant'""",
    "prompt_build": PROMPTS + "SELECT conv_id, turn, md5(key) AS digest, 2::INT AS n FROM k",
    "mock_answer": PROMPTS + "SELECT conv_id, turn, '[mock answer ' || substr(sha256(key), 1, 8) || '] Based on the provided sources, here is a response to: ' || substr(asked, 1, 60) || '.' AS answer FROM k",
    "mock_tokens": f"SELECT conv_id, turn, len({TOKENS})::INT AS n_tokens, md5(array_to_string(list_transform({TOKENS}, lambda w: w || ' '), '')) AS digest FROM ({QUESTIONS})",
    "sse_frames": "SELECT conv_id, turn, 'data: ' || to_json({'token': text}) || chr(10) || chr(10) AS frame FROM conversations",
    "persisted_messages": """
WITH t AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT * FROM t WHERE role = 'user' AND r = 'assistant')
SELECT conv_id || '-' || turn AS question_id, conv_id AS notebook_id, 0::INT AS seq, 'user' AS role, md5(text) AS digest, NULL::VARCHAR AS sources_json FROM p
UNION ALL SELECT conv_id || '-' || turn, conv_id, 1, 'assistant', md5(answer), CASE WHEN conv_id % 3 = 1 THEN '[{"filename":"f' || conv_id || '"' || CASE WHEN turn % 4 <> 0 THEN ',"page":' || turn ELSE '' END || '}]' END FROM p""",
    "host_alternation": """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, pos::INT AS pos, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS label, CASE WHEN pos % 2 = 0 THEN 'A' ELSE 'B' END AS host FROM t""",
    "summary_parse": """
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN ' {broken ' ELSE text END AS summary,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE array_to_string(list_transform(range(1, least(turn % 8 + 1, 5) + 1), lambda k: 'q' || k), ',') END AS questions FROM conversations""",
    "dialogue_parse": r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, turn, 0::INT AS pos, 'A' AS host, text FROM c WHERE text <> '' UNION ALL SELECT conv_id, turn, CASE WHEN text <> '' THEN 1 ELSE 0 END::INT, 'B', 'end' FROM c""",
    "slides_parse": r"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS heading FROM conversations)
SELECT conv_id, turn, 'content' AS type, heading, 'one,' || role AS bullets, heading AS narration FROM c WHERE heading <> ''""",
    "voice_map": "SELECT event_id, ['en-US-AvaNeural', 'en-US-AndrewNeural', 'en-US-EmmaNeural', 'en-US-RyanNeural', 'en-US-AvaNeural'][user_id % 5 + 1] AS voice FROM events",
    "stand_in_models": """
SELECT page_id, '[mock OCR table recognition ' || substr(sha256(html), 1, 8) || '] | Col A | Col B |' || chr(10) || '| 1 | 2 |' AS image_text,
  '[mock transcription ' || substr(sha256(html), 1, 8) || '] What databases are mentioned in the sources?' AS heard FROM pages""",
    "json_props": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS sum_k, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "status_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*)::BIGINT AS n_events FROM events GROUP BY 1",
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """
WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start FROM events UNION ALL SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY FROM events) SELECT start, count(*)::BIGINT AS n FROM w GROUP BY 1""",
    "events_session": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""",
    "stream_registry": f"SELECT content_hash, 'doc_' || substr(content_hash, 1, 59) AS collection, length(text)::BIGINT AS char_count, first_id FROM ({REGISTRY})",
    "stream_windows": """
WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM events GROUP BY 1)
SELECT start, n FROM w, m WHERE start + INTERVAL 1 DAY <= mark""",
    "voice_sessions": """
WITH e AS (SELECT user_id::VARCHAR AS sid, event_id AS seq, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'rejected' END
  WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'error: notebook_id required' WHEN event_id % 11 = 0 THEN 'error: not owner' ELSE 'ready' END
  WHEN 2 THEN 'error: audio must be sent via HTTP POST /voice/turn' WHEN 3 THEN 'sending' WHEN 4 THEN 'cancelled' END AS reply FROM events) SELECT * FROM e WHERE reply IS NOT NULL""",
    "status_transitions": """
WITH s AS (SELECT event_id, user_id, ts, (event_id % 6)::INT AS k FROM events), l AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s),
n AS (SELECT ['none', 'queued', 'scripting', 'synthesizing', 'ready', 'failed'] AS names)
SELECT event_id, names[b + 1] AS before, names[k + 1] AS state, k = 1 OR (k = 5 AND b < 4) OR (k <> 5 AND k > b AND b <> 5) AS allowed FROM l, n WHERE b IS NOT NULL""",
    "ndjson_tokens": "SELECT conv_id, turn, md5(text) AS digest, turn % 2 = 1 AS done FROM conversations WHERE conv_id % 7 <> 0 AND text IS NOT NULL",
    "chat_frames": f"""
WITH t AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, conv_id || '-' || turn AS question_id, regexp_extract_all(answer, '\\S+') AS words FROM t WHERE role = 'user' AND r = 'assistant'),
k AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN [{lit(OUT_OF_SCOPE)}] WHEN turn % 4 = 0 THEN list_append(list_transform(words, lambda w: w || ' '), {lit(NOT_VERIFIED)}) ELSE list_transform(words, lambda w: w || ' ') END AS tokens FROM p),
f AS (SELECT question_id, list_append(list_transform(tokens, lambda x: to_json({{'token': x}})::VARCHAR),
  '{{"sources":[{{"filename":"f' || conv_id || '","page":' || CASE WHEN conv_id % 2 = 0 THEN turn::VARCHAR ELSE 'null' END || '}}],"latency_ms":' || turn || ',"done":true}}') AS frames FROM k)
SELECT question_id, (i - 1)::INT AS seq, frames[i] AS payload FROM (SELECT question_id, frames, unnest(range(1, len(frames) + 1)) AS i FROM f)""",
    "file_ingestion": rf"""
WITH f AS (SELECT printf('%012d', id) || CASE WHEN id % 9 = 0 THEN '.bin' WHEN id % 2 = 0 THEN '.txt' ELSE '.md' END AS filename, text, content_hash FROM ({SRC})),
g AS (SELECT content_hash, min(filename) AS first, any_value(text) AS text FROM f GROUP BY 1),
o AS (SELECT content_hash, CASE WHEN first LIKE '%.bin' THEN 'failed' WHEN regexp_matches(text, '\S') THEN 'ready' ELSE 'partial' END AS status, length(text) AS n FROM g)
SELECT round::INT AS round, filename, CASE WHEN round = 2 AND status = 'ready' THEN 'cached' ELSE 'ingest' END AS action, status, CASE WHEN status = 'ready' THEN n ELSE 0 END::INT AS char_count,
  CASE status WHEN 'failed' THEN 'Unsupported file type' WHEN 'partial' THEN 'No text could be extracted from the file.' END AS error_message
FROM f JOIN o USING (content_hash), (SELECT unnest([1, 2]) AS round)""",
    "stored_chunks": f"""WITH RECURSIVE {chunk_sql.chunks(f"SELECT content_hash AS key, text FROM ({REGISTRY}) WHERE first_id % 3 = 0")}
SELECT substr(key, 1, 16) || '_' || chunk_index AS id, chunk_index + 1 AS page, md5(document) AS digest FROM chunk""",
    "selected_texts": f"{BUDGET} SELECT k.notebook_id, count(*)::INT AS n_texts, md5(string_agg(s.text, chr(10) ORDER BY k.id)) AS digest, sum(k.chars)::BIGINT AS total_chars FROM k JOIN s USING (notebook_id, id) WHERE NOT over GROUP BY 1",
    "stand_in_scripts": f"""
WITH f AS (SELECT source AS notebook_id, arg_min(text, doc_id) AS text FROM documents WHERE length(text) > 0 GROUP BY 1),
m AS (SELECT notebook_id, substr(sha256(notebook_id || ':' || substr(text, 1, 50)), 1, 8) AS mark FROM f),
p(part, pos, kind, text) AS (VALUES {", ".join([f"('dialogue', {k}, '{'AB'[k % 2]}', {lit(t)})" for k, t in enumerate(DIALOGUE)] + [f"('slide', {k}, {lit(t)}, {lit('|'.join([h, *b, n]))})" for k, (t, h, b, n) in enumerate(SLIDES)])})
SELECT notebook_id, part, pos::INT AS pos, kind, replace(text, '{{}}', mark) AS text FROM m, p""",
    "audio_outcomes": "SELECT user_id, count(*) FILTER (event_id % 50 = 0)::BIGINT AS n_ok, CASE WHEN count(*) FILTER (event_id % 50 = 0) > 0 THEN 'ready' ELSE 'failed' END AS status FROM events GROUP BY 1",
    "audio_verdicts": """
SELECT event_id, CASE WHEN event_id * 7919 % 20000000 > 10485760 THEN 'Audio upload exceeds 10 MB limit.' WHEN event_id % 90 > 60 THEN 'Audio exceeds 60s recording limit.' END AS error FROM events""",
    "slide_manifest": "SELECT user_id, event_id AS pos, event_type || '.png' AS image, CASE WHEN event_id % 4 = 0 THEN 5::DOUBLE ELSE round((event_id % 97)::DOUBLE / 8 + 0.5::DOUBLE, 1) END AS duration FROM events",
    "option_values": """
WITH r AS (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN [' True ', '1', 'no', '', 'YES', '12', ' 7 ', 'x'][page_id % 8 + 1] END AS raw FROM pages)
SELECT page_id, lower(trim(coalesce(raw, 'False'))) IN ('true', '1', 'yes') AS flag, coalesce(CASE WHEN regexp_matches(trim(raw), '^[0-9]+$') THEN trim(raw)::INT END, 5) AS number,
  CASE WHEN coalesce(raw, '') <> '' THEN '<set>' ELSE '<unset>' END AS shown FROM r""",
    "error_classes": """
WITH m AS (SELECT event_id, ['HTTP 429 Too Many Requests', 'Read timed out', 'Connection reset', 'HTTP 401', '403 Forbidden', 'TIMEOUT', 'broken'][event_id % 7 + 1] AS message FROM events)
SELECT event_id, CASE WHEN message LIKE '%401%' THEN 401 WHEN message LIKE '%403%' THEN 403 END::INT AS status, regexp_matches(lower(message), '429|timeout|timed out|connection') AS retryable FROM m""",
    "account_rules": "SELECT c_custkey, c_custkey % 140 BETWEEN 1 AND 120 AS name_ok, c_custkey % 300 BETWEEN 8 AND 256 AS password_ok FROM customer",
    "image_fit": """
WITH s AS (SELECT p_partkey, (p_partkey * 37 % 5000 + 1)::INT AS w, (p_partkey * 91 % 4000 + 1)::INT AS h FROM part), f AS (SELECT *, least(1::DOUBLE, 2048::DOUBLE / greatest(w, h)) AS scale FROM s)
SELECT p_partkey, trunc(w * scale)::INT AS width, trunc(h * scale)::INT AS height FROM f""",
    "data_urls": "SELECT page_id, md5('data:text/html;base64,' || base64(encode(html))) AS digest FROM pages",
    "ocr_gate": """
SELECT doc_id, (doc_id % 8 < 4 OR length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) < 200) AND (doc_id % 4 = 0 OR (doc_id % 4 IN (1, 2) AND doc_id % 3 > 0)) AS needs_ocr FROM documents""",
    "image_texts": """
SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), CASE WHEN text <> '' THEN '[Image 1]' || chr(10) || text END, '[Image 3]' || chr(10) || role)) AS digest FROM conversations""",
    "sse_tokens": "SELECT conv_id, turn, md5(coalesce(text, '') || role) AS digest FROM conversations",
    "message_sources": "SELECT conv_id, turn, (conv_id % 3 = 0)::INT AS n, CASE WHEN conv_id % 3 = 0 THEN 'f' || conv_id ELSE '' END AS filenames, CASE WHEN conv_id % 3 = 0 THEN turn END::INT AS page FROM conversations",
    "office_texts": r"""
WITH l AS (SELECT doc_id, doc_id % 2 = 1 AS odd, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, odd, list_filter(lines, lambda x: regexp_matches(x, '\S')) AS all_lines, list_filter(lines[1:1], lambda x: regexp_matches(x, '\S')) AS first, list_filter(lines[2:], lambda x: regexp_matches(x, '\S')) AS rest FROM l),
t AS (SELECT doc_id, odd, CASE WHEN odd THEN array_to_string(all_lines, chr(10) || chr(10)) ELSE concat_ws(chr(10) || chr(10), nullif(array_to_string(first, ''), ''), nullif(array_to_string(rest, chr(10)), '')) END AS text FROM k)
SELECT doc_id, CASE WHEN odd THEN 'docx' ELSE 'pptx' END AS kind, true AS magic_ok, md5(text) AS digest, odd::INT AS n_images, NULL::VARCHAR AS error FROM t""",
}
