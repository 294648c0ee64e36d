"""DuckDB SQL for the queries that it can express on whole tables."""

from __future__ import annotations

from tallyframe.llm import url_filter

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM firsts
"""

MIXING = rf"""
WITH best AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id
), sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{_WORD}'))::BIGINT AS size,
         -ln((('0x' || md5('20:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) || ':'
           || row_number() OVER (PARTITION BY d.doc_id, d.source, md5(coalesce(d.text, ''))))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(b.weight, 1.0) AS key
  FROM documents d LEFT JOIN best b USING (doc_id)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), turns AS (
  SELECT *, (ARRAY[1.0, 2.0, 3.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS stop FROM sources
), levels AS (
  SELECT *, stop / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM turns
), settled AS (
  SELECT arg_min(level, ratio) FILTER (WHERE level <= ratio) AS level FROM levels
), plans AS (
  SELECT source, source_size, least(stop, weight * coalesce(s.level, 'Infinity'::DOUBLE)) AS target FROM levels, settled s
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM plans
), placed AS (
  SELECT z.doc_id, z.size, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS budget,
         sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized z JOIN budgets b ON z.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - (upto - size))))::BIGINT AS taken
FROM placed
"""

PASSAGES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS k FROM docs WHERE len(w) >= 35
), windows AS (
  SELECT s.r, s.k, array_to_string(d.w[s.k:s.k + 34], ' ') AS seq FROM starts s JOIN docs d USING (r)
), repeated AS (
  SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 35)) AS i FROM windows JOIN repeated USING (seq)
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
), counts AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN counts c USING (r) LEFT JOIN kept k USING (r)
"""


def url_vocabulary(rules: tuple[url_filter.Rule, ...], vocabulary: url_filter.Vocabulary = url_filter.Vocabulary()) -> str:
    listed = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    terms = [(t, 0.0, True) for t in vocabulary.strict] + [(t, w, False) for t, w in vocabulary.soft.items()]
    listed_terms = ", ".join(f"('{t}', {w}::DOUBLE, {hard})" for t, w, hard in terms)
    return rf"""
WITH rules(rule, h, p, verdict) AS (VALUES {listed}), terms(term, weight, hard) AS (VALUES {listed_terms}),
split AS (
  SELECT page_id, url,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split, rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
), hits AS (
  SELECT page_id, bool_or(hard) OR sum(weight) >= {vocabulary.limit} AS bad
  FROM pages, terms WHERE regexp_matches(lower(url), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN h.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id) LEFT JOIN hits h USING (page_id)
"""


_COMPONENTS = """
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (
  SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), parts AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
"""

VECTORS = f"""
WITH RECURSIVE pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.93
), {_COMPONENTS}, degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(p.component_id, v.vec_id) AS component_id,
       coalesce(p.component_id, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degrees d ON d.a = v.vec_id LEFT JOIN parts p ON p.node = v.vec_id
"""

NEAR_DOCUMENTS = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM docs WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id,
       coalesce(p.component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes n USING (doc_id) LEFT JOIN parts p ON p.node = d.doc_id
"""


def chat_format(quoting: str) -> str:
    """Digests of the turns themselves, and the length that marks and escapes give them."""
    tails = r"(s>|/s>|\+\]|SYS\]|INST\]|/INST\]|ROLE\]|/ROLE\])"
    escaped = rf"regexp_replace({{}}, '([<\[])(\\*){tails}', '\1\2\\\3', 'g')"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '{quoting}'), (-7, 1, 'assistant', '{quoting}')
), beside AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) IS DISTINCT FROM role AS opens FROM turns
), sized AS (
  SELECT *, length({escaped.format("text")}) + CASE WHEN NOT opens THEN 3 ELSE CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6
    WHEN 'assistant' THEN 7 + 4 ELSE 13 + length({escaped.format("role")}) END END AS chars FROM beside
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS terms
  FROM documents
), sizes AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), lengths AS (
  SELECT r, doc_id, 100 - 90 + ((90 * len(terms)::BIGINT * n_docs) // n_terms) AS m FROM docs, sizes WHERE len(terms) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, sizes WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored JOIN lengths USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


# Costs, letters and lines of the best ending from each state: nothing yet, after system, after user,
# after assistant. Rows are taken from the last to the first.
def _state(number: int) -> str:
    options = [f"{{'c': 4 + b{number}.c, 's': 'D' || b{number}.s, 'l': b{number}.l}}"]
    for initial, state in {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[number]:
        kept = f"{{'c': extra + b{state}.c, 's': 'K' || b{state}.s, 'l': list_prepend(role || ':' || text, b{state}.l)}}"
        options.append(f"CASE WHEN fault NOT IN (1, 2) AND role[1] = '{initial}' THEN {kept} END")
    added, state = ("assistant", 3) if number == 2 else ("user", 2)
    cast = f"{{'c': 3 + extra + b{state}.c, 's': 'R' || b{state}.s, 'l': list_prepend('{added}:' || text, b{state}.l)}}"
    options.append(f"CASE WHEN fault NOT IN (1, 2) THEN {cast} END")
    return f"list_min([x FOR x IN [{', '.join(options)}] IF x IS NOT NULL])"


def _inserted(state: int, then: int) -> str:
    role = "assistant" if state == 2 else "user"
    return f"{{'c': 3 + e{then}.c, 's': 'I' || e{then}.s, 'l': list_prepend('{role}:', e{then}.l)}}"


_ENDING = "STRUCT(c BIGINT, s VARCHAR, l VARCHAR[])"

TURN_REPAIR = rf"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
  FROM conversations
), dealt AS (
  SELECT n.* EXCLUDE codes, xor(4294967295, list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS fate
  FROM named n, bytes
), harmed AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible FROM harmed
), judged AS (
  SELECT *, CASE WHEN visible = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), rows AS (
  SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM judged
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 1)::BIGINT AS blank,
         count_if(fault = 2)::BIGINT AS duplicate, count_if(fault = 3)::BIGINT AS truncated,
         count_if(before[1] || role[1] NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), endings(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, n + 1, {{'c': 0, 's': '', 'l': []}}::{_ENDING}, {{'c': 6, 's': 'II', 'l': ['user:', 'assistant:']}}::{_ENDING},
         {{'c': 3, 's': 'I', 'l': ['assistant:']}}::{_ENDING}, {{'c': 0, 's': '', 'l': []}}::{_ENDING} FROM facts
  UNION ALL
  SELECT conv_id, i, least(e0, {_inserted(0, 2)}, i2), least(e1, {_inserted(1, 2)}, i2), least(e2, {_inserted(2, 3)}), least(e3, {_inserted(3, 2)})
  FROM (SELECT *, {{'c': 6 + e3.c, 's': 'II' || e3.s, 'l': list_concat(['user:', 'assistant:'], e3.l)}} AS i2
    FROM (SELECT r.conv_id, r.i, {_state(0)} AS e0, {_state(1)} AS e1, {_state(2)} AS e2, {_state(3)} AS e3
      FROM endings e JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i - 1))
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost,
       coalesce(b0.s, '') AS audit, sha256(coalesce(array_to_string(b0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN endings e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = 1
"""
