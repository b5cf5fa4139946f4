"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from docspark.registry import queries as q
from docspark.functions.clean import COMMON_ENTITIES
from docspark.functions.tokens import ENGLISH_STOP_WORDS, SENTENCE

# Python's white space, spelled out: DuckDB's \s is ASCII only.
SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def drop(column: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({column}, {text(pattern)}, {text(by)}, 'g')"


def clean(column: str, mode: str = "reference") -> str:
    column = drop(column, rf"^{SPACE}+|{SPACE}+$")
    column = drop(column, SPACE + ("{2,}" if mode == "reference" else "+"), " ")
    column = drop(column, "<.*?>")
    column = f"replace({column}, '\\r\\n', '')"
    column = drop(column, r"[^\x00-\x7F]+")
    return drop(column, r"[\x00-\x1F\x7F]+")


def strip(column: str) -> str:
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    ):
        column = drop(column, pattern)
    for name, char in COMMON_ENTITIES.items():  # all but these two may lack the semicolon
        column = drop(column, f"&{name};" + ("" if name in ("apos", "#39") else "?"), char)
    return column


def words(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), {text(NON_WORD)}), lambda w: w <> '')"


def cap(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def group_one(column: str, pattern: str) -> str:
    return f"nullif(regexp_extract({column}, {text(pattern)}, 1), '')"


# Log-likelihood of k hits in n trials of chance p; nothing where a factor is to the power 0.
def likelihood(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN ({k}) * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN (({n}) - ({k})) * ln(1 - {p}) ELSE 0 END)"


def clipped(p: str) -> str:
    return f"least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"


BARE = r"""regexp_replace({}, '^["''(\[{{«“„‘]+|["'')\]}}»”’,;:]+$', '', 'g')"""
TYPES = rf"""raw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS l FROM documents),
tok AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM raw),
bared AS (SELECT doc_id, i, t, {BARE.format('t')} AS w FROM tok),
words AS (SELECT doc_id, i, t, w, lower(regexp_replace(w, '\.$', '')) AS type, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM bared),
counts AS (SELECT type, count(*) FILTER (ends_with(w, '.')) AS with_period, count(*) FILTER (NOT ends_with(w, '.')) AS plain
    FROM words WHERE regexp_matches(w, '^[\p{{L}}\p{{M}}.]*\p{{L}}\.?$') GROUP BY type),
totals AS (SELECT sum(with_period)::DOUBLE AS periods, sum(with_period + plain)::DOUBLE AS n FROM counts),
scores AS (SELECT type, with_period, plain, 2 * ({likelihood('with_period', '(with_period + plain)', '0.99::DOUBLE')} - {likelihood('with_period', '(with_period + plain)', '(periods / n)')})
    * exp(-(length(type) - dots)::DOUBLE) * (dots + 1) * pow((length(type) - dots)::DOUBLE, -plain::DOUBLE) AS score
    FROM (SELECT *, length(type) - length(replace(type, '.', '')) AS dots FROM counts), totals WHERE with_period > 0)"""

HELD_OUT = "SELECT lang, count(*) AS n, true AS accurate"
FOLD = "FROM documents WHERE doc_id % 4 = 0 GROUP BY lang"

# ---- shared sub-queries -------------------------------------------------------------------------

PATHS = f"""
SELECT page_id, {group_one('url', q.PAGE_LABELS['category'])} AS category,
       coalesce({group_one('url', q.PAGE_LABELS['subcategory'])}, 'unknown') AS subcategory,
       coalesce({group_one('url', q.PAGE_LABELS['target_id'])}, 'unknown') AS target_id
FROM pages WHERE {group_one('url', q.PAGE_LABELS['category'])} IS NOT NULL
"""

SEGMENTS = f"""
SELECT page_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos, unnest(found) AS segment
FROM (SELECT page_id, regexp_extract_all(html, {text(q.PAGE_UNIT)}, 1) AS found FROM pages)
"""

SENTENCES = f"""
SELECT doc_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos, unnest(found) AS sentence
FROM (SELECT doc_id, list_filter([trim(s) FOR s IN regexp_extract_all(text, {text(SENTENCE)})], lambda s: s <> '') AS found
      FROM documents)
"""

STOPS = ", ".join(text(word) for word in ENGLISH_STOP_WORDS)
KEPT = f"""
SELECT doc_id, [CASE WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN 'NUM' ELSE lower(t) END FOR t IN
    list_filter(string_split_regex(text, {text(NON_WORD)}),
        lambda t: (regexp_matches(t, '^\\p{{L}}+$') OR regexp_matches(t, '^\\p{{Nd}}+$'))
                  AND NOT list_contains([{STOPS}], lower(t)))] AS tokens
FROM documents
"""
FREQUENCIES = "SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM kept) GROUP BY term"
PRUNED = """
SELECT row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, term, df
FROM (SELECT * FROM frequencies WHERE df >= 30 AND df <= 0.5 * (SELECT count(*) FROM kept))
"""


def language_model(fit_text: str) -> str:
    """CTEs counts, totals, size, grid: the naive Bayes model fitted on ``documents``."""
    return f"""
occurrences AS (SELECT lang, unnest({words(fit_text)}) AS term FROM documents),
profile AS (SELECT term FROM occurrences GROUP BY term),
counts AS (SELECT lang, term, count(*) AS n FROM occurrences JOIN profile USING (term) GROUP BY lang, term),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
size AS (SELECT count(*) AS v FROM profile),
grid AS (SELECT t.term, l.lang, ln(((coalesce(c.n, 0) + 1) / (l.total + size.v))::DOUBLE) AS lp
         FROM profile t CROSS JOIN totals l CROSS JOIN size
         LEFT JOIN counts c ON c.term = t.term AND c.lang = l.lang)"""


def predictions(rows: str, keys: str, column: str) -> str:
    """CTE predicted(keys, prediction) over CTE ``rows``; rows without a known word are absent."""
    return f"""
said AS (SELECT {keys}, term, count(*) AS n FROM (SELECT {keys}, unnest({words(column)}) AS term FROM {rows}) GROUP BY {keys}, term),
ranked AS (SELECT {keys}, g.lang, row_number() OVER (PARTITION BY {keys}
                  ORDER BY round(sum(said.n * g.lp), 8) DESC, g.lang) AS place
           FROM said JOIN grid g USING (term) GROUP BY {keys}, g.lang),
predicted AS (SELECT {keys}, lang AS prediction FROM ranked WHERE place = 1)"""


ENGLISH = f"""
WITH {language_model(clean('text', 'safe'))},
segments AS ({SEGMENTS}),
cleaned AS (SELECT * FROM (SELECT page_id, pos, {clean(strip('segment'))} AS segment FROM segments) WHERE segment <> ''),
{predictions('cleaned', 'page_id, pos', 'segment')},
english AS (SELECT page_id, pos, segment FROM cleaned JOIN predicted USING (page_id, pos) WHERE prediction = 'en')
"""

IDS = f"""
vocabulary AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) + 3 AS id
    FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({words('text')})) AS term FROM documents)
          GROUP BY term))"""


def ids(rows: str, keys: str, column: str, max_len: int) -> str:
    return f"""
first_words AS (SELECT {keys}, list_slice({words(column)}, 1, {max_len - 2}) AS ws FROM {rows}),
numbered AS (SELECT {keys}, generate_subscripts(ws, 1) AS i, unnest(ws) AS term FROM first_words),
looked_up AS (SELECT {keys}, list(coalesce(v.id, 3) ORDER BY i) AS ids
    FROM numbered LEFT JOIN vocabulary v USING (term) GROUP BY {keys}),
id_lists AS (SELECT {keys}, coalesce(ids, []) AS ids FROM first_words LEFT JOIN looked_up USING ({keys}))"""


def padded(keys: str, max_len: int) -> str:
    return f"""
SELECT {keys}, array_to_string(list_concat([0], ids, [2], [1 FOR x IN range({max_len - 2} - len(ids))]), ' ') AS ids,
       array_to_string(list_concat([1 FOR x IN range(len(ids) + 2)], [0 FOR x IN range({max_len - 2} - len(ids))]), ' ') AS mask,
       array_to_string([0 FOR x IN range({max_len})], ' ') AS token_type_ids
FROM id_lists"""


SCORED = f"""
hidden AS (SELECT vec_id, label, list_transform(range({q.WIDTH}), lambda j: greatest(list_sum(
    list_transform(range({q.INPUTS}), lambda i: embedding[i + 1]::DOUBLE * cos(0.1::DOUBLE * i * j))), 0)) AS h FROM embeddings),
scored AS (SELECT vec_id, label, list_transform(range({q.CLASSES}), lambda k: list_sum(
    list_transform(range({q.WIDTH}), lambda j: h[j + 1] * sin(0.3::DOUBLE * j + k)))) AS scores FROM hidden),
losses AS (SELECT vec_id, list_max(scores) + ln(list_sum([exp(v - list_max(scores)) FOR v IN scores])) - scores[label + 1] AS loss
    FROM scored),
decoded AS (SELECT vec_id, 'class' || label AS label, 'class' || (list_position(scores, list_max(scores)) - 1) AS prediction FROM scored)"""

ENTRIES = """
decoded AS (SELECT label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS prediction FROM embeddings)"""


def report(decoded: str) -> str:
    return f"""
WITH {decoded},
names AS (SELECT label AS name FROM decoded UNION SELECT prediction FROM decoded WHERE prediction IS NOT NULL),
sides AS (SELECT name, (SELECT count(*) FROM decoded d WHERE d.label = name) AS support,
                  (SELECT count(*) FROM decoded d WHERE d.prediction = name) AS predicted,
                  (SELECT count(*) FROM decoded d WHERE d.label = name AND d.prediction = name) AS hits FROM names),
ratios AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
                  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM sides),
metrics AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ratios)
SELECT CAST(name AS VARCHAR) AS class, round(p::DOUBLE, 6) AS precision, round(r::DOUBLE, 6) AS recall,
       round(f::DOUBLE, 6) AS f1, support FROM metrics
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
       round(sum(hits) / sum(support), 6), {cap('sum(support)')} FROM metrics
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), {cap('sum(support)')} FROM metrics
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), {cap('sum(support)')} FROM metrics"""


CURVE = f"""
log AS (SELECT user_id AS run, CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END::BIGINT AS epoch, event_id, value AS loss,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok FROM events),
steps AS (SELECT run, epoch, event_id, row_number() OVER w - 1 AS step, sum(loss) OVER w AS loss_sum, sum(ok) OVER w AS ok_sum
          FROM log WINDOW w AS (PARTITION BY run, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT run, epoch, event_id, step, round(loss_sum / (step + 1), 4) AS loss,
                 round((ok_sum / (step + 1))::DOUBLE, 4) AS accuracy
          FROM steps WHERE step % {q.REPORT_EVERY} = 0 AND step <> 0)"""

LEMMA_VALUES = ", ".join(f"({text(form)}, {text(lemma)})" for form, lemma in q.LEMMAS.items())
ALIAS_CASES = " ".join(f"WHEN {text(alias)} THEN {text(name)}" for alias, name in q.LANGUAGE_NAMES.items())
WIDE = ", ".join(
    f"{cap(f'''count(*) FILTER (prediction = 'class{k}')''')} AS pred_class{k}" for k in range(q.CLASSES)
)

LEMMA_RULES = f"""kept AS ({KEPT}), frequencies AS ({FREQUENCIES}),
pairs AS (SELECT DISTINCT w.term AS form, l.term AS lemma FROM frequencies w, (VALUES {', '.join(f"('{e}')" for e in q.ENDINGS)}) AS x(e), frequencies l
    WHERE ends_with(w.term, e) AND l.term = left(w.term, length(w.term) - length(e)) AND l.df > w.df),
cuts AS (SELECT form, length(form) - length(lemma) AS cut, '' AS add FROM pairs),
every AS (SELECT right(form, k) AS suffix, cut, add FROM cuts, range(0, 7) AS x(k) WHERE k <= length(form) AND k >= cut),
tallied AS (SELECT suffix, cut, add, count(*) AS n FROM every GROUP BY suffix, cut, add),
rules AS (SELECT * FROM tallied QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) = 1 AND n >= 2)"""

ORACLE = {
    "path_labels": PATHS,
    "category_alias": f"SELECT page_id, CASE category {ALIAS_CASES} ELSE category END AS category FROM ({PATHS})",
    "segment_extract": SEGMENTS,
    "segment_filter": f"SELECT * FROM ({SEGMENTS}) WHERE regexp_matches(segment, '<b[\\s/>]')",
    "strip_html": f"SELECT page_id, {strip('html')} AS text FROM pages",
    "clean_documents": f"SELECT * FROM (SELECT doc_id, {clean('text')} AS text FROM documents) WHERE text <> ''",
    "english_segments": f"{ENGLISH} SELECT * FROM english",
    "rejoin_segments": f"""{ENGLISH} SELECT page_id, count(*) AS n_segments, string_agg(segment, ' ' ORDER BY pos) AS text
FROM english GROUP BY page_id""",
    "rejoin_turns": """SELECT conv_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "csv_round_trip": f"""SELECT * FROM (SELECT doc_id, {clean('text')} AS sources, lang AS categories, source AS subcategories,
lpad(CAST(doc_id AS VARCHAR), 8, '0') AS targetids FROM documents) WHERE sources <> ''""",
    "lang_profile": f"""WITH {language_model('text')}
SELECT lang, term, n, round(lp, 6) AS log_prob FROM counts JOIN grid USING (lang, term)""",
    "lang_predict": f"""WITH {language_model('text')}, {predictions('documents', 'doc_id', 'text')}
SELECT doc_id, lang, prediction FROM documents LEFT JOIN predicted USING (doc_id)""",
    "lang_report": report(
        f"""{language_model('text')}, {predictions('documents', 'doc_id', 'text')},
decoded AS (SELECT lang AS label, prediction FROM documents LEFT JOIN predicted USING (doc_id))"""
    ),
    "sentence_split": SENTENCES,
    "sentence_vote": f"""WITH {language_model('text')}, sentences AS ({SENTENCES}),
{predictions('sentences', 'doc_id, pos', 'sentence')},
votes AS (SELECT doc_id, prediction, count(prediction) AS votes, min(pos) AS first
          FROM documents LEFT JOIN sentences USING (doc_id) LEFT JOIN predicted USING (doc_id, pos) GROUP BY doc_id, prediction)
SELECT doc_id, prediction, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) = 1""",
    "ngram_classify": f"""WITH said AS (SELECT doc_id, lang, {words('text')} AS ws FROM documents),
used AS (SELECT doc_id, lang, false AS pair, unnest(ws) AS gram FROM said
    UNION ALL SELECT doc_id, lang, true, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM said),
kept AS (SELECT gram, pair FROM used GROUP BY gram, pair),
counts AS (SELECT k.gram, k.pair, l.lang, count(u.gram) AS n FROM kept k CROSS JOIN (SELECT DISTINCT lang FROM documents) l
    LEFT JOIN used u ON u.gram = k.gram AND u.pair = k.pair AND u.lang = l.lang GROUP BY k.gram, k.pair, l.lang),
sizes AS (SELECT lang, (sum(n) + count(*))::DOUBLE AS t FROM counts WHERE NOT pair GROUP BY lang),
weights AS (SELECT c.gram, c.pair, c.lang, CASE WHEN NOT c.pair THEN ln((c.n + 1) / t) WHEN c.n = 0 THEN 0
        ELSE ln(c.n / f.n) - ln(0.4::DOUBLE) - ln((g.n + 1) / t) END AS w
    FROM counts c JOIN sizes USING (lang)
    LEFT JOIN counts f ON c.pair AND NOT f.pair AND f.lang = c.lang AND f.gram = split_part(c.gram, ' ', 1)
    LEFT JOIN counts g ON c.pair AND NOT g.pair AND g.lang = c.lang AND g.gram = split_part(c.gram, ' ', 2)),
scores AS (SELECT u.doc_id, s.lang, sum(coalesce(w.w, CASE WHEN u.pair THEN 0 ELSE -ln(s.t) END)) AS score
    FROM (SELECT doc_id, gram, pair FROM used) u CROSS JOIN sizes s
    LEFT JOIN weights w ON w.gram = u.gram AND w.pair = u.pair AND w.lang = s.lang GROUP BY u.doc_id, s.lang),
best AS (SELECT doc_id, lang FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 8) DESC, lang) = 1)
SELECT doc_id, best.lang AS prediction FROM documents LEFT JOIN best USING (doc_id)""",
    "nested_text": r"""WITH tokens AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS token FROM
(SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?[A-Za-z][^<>]*>|[^<]+|<') AS l FROM pages)),
named AS (SELECT *, lower(nullif(regexp_extract(token, '^</?(?:[\w.-]+:)?([A-Za-z][\w.-]*)', 1), '')) AS name FROM tokens),
tags AS (SELECT page_id, name, 2 * i AS place, CASE WHEN starts_with(token, '</') THEN -1 ELSE 1 END AS step FROM named WHERE name IN ('article', 'p', 'h1')
    UNION ALL SELECT page_id, name, 2 * i + 1, -1 FROM named WHERE name IN ('article', 'p', 'h1') AND ends_with(token, '/>') AND NOT starts_with(token, '</')),
summed AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY place) AS s FROM tags),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id, name ORDER BY place)) AS low,
    least(0, coalesce(min(s) OVER (PARTITION BY page_id, name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS earlier FROM summed),
levels AS (SELECT *, s - low + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth FROM lows WHERE NOT (step = -1 AND low < earlier)),
elements AS (SELECT * FROM (SELECT *, coalesce(lead(place) OVER (PARTITION BY page_id, name, depth ORDER BY place), 4611686018427387903) AS fin FROM levels) WHERE step = 1),
units AS (SELECT u.page_id, u.place, u.depth, u.fin, min(c.place) FILTER (c.name = 'p') AS first FROM elements u
    JOIN elements c ON c.page_id = u.page_id AND c.place > u.place AND c.place < u.fin
    WHERE u.name = 'article' GROUP BY ALL HAVING count(*) FILTER (c.name = 'h1') > 0),
children AS (SELECT u.*, least(c.fin, u.fin) AS until FROM units u LEFT JOIN elements c ON c.page_id = u.page_id AND c.place = u.first)
SELECT c.page_id, c.place, c.depth::BIGINT AS depth, CASE WHEN c.first IS NOT NULL THEN coalesce(string_agg(CASE WHEN starts_with(n.token, '<![CDATA[')
    THEN n.token[10:-4] ELSE n.token END, '' ORDER BY n.i), '') END AS text
FROM children c LEFT JOIN named n ON n.page_id = c.page_id AND 2 * n.i > c.first AND 2 * n.i < c.until AND n.name IS NULL AND NOT starts_with(n.token, '<!--')
GROUP BY c.page_id, c.place, c.depth, c.first""",
    "unit_scan": "SELECT source AS category, lang AS subcategory, doc_id, coalesce(text, '') AS segment FROM documents WHERE lang = 'en' AND source IS NOT NULL",
    "abbreviations": f"WITH {TYPES} SELECT type, with_period, plain, round(score, 6) AS score FROM scores",
    "sentences_learned": rf"""WITH {TYPES},
short AS (SELECT type FROM scores WHERE score >= 0.3),
following AS (SELECT type, regexp_replace(after, '\.$', '') AS next FROM words WHERE after IS NOT NULL AND regexp_matches(w, '[.!?]$')),
breaks AS (SELECT lower(next) AS type, count(*) AS k FROM following
    WHERE regexp_matches(next, '^[\p{{L}}\p{{M}}.]*\p{{L}}$') AND type NOT IN (SELECT type FROM short) GROUP BY 1),
b AS (SELECT sum(k)::DOUBLE AS m FROM breaks),
s AS (SELECT type, k, with_period + plain AS c, n, m, {clipped('k / m')} AS here, {clipped('(with_period + plain - k) / (n - m)')} AS other, {clipped('(with_period + plain) / n')} AS chance
    FROM breaks JOIN counts USING (type), totals, b),
starters AS (SELECT type FROM s WHERE k / m > c / n AND 2 * ({likelihood('k', 'm', 'here')} + {likelihood('(c - k)', '(n - m)', 'other')}
    - {likelihood('k', 'm', 'chance')} - {likelihood('(c - k)', '(n - m)', 'chance')}) >= 30),
ends AS (SELECT doc_id, i, t, (after IS NULL) OR (regexp_matches(w, '[.!?]$') AND NOT (ends_with(w, '.') AND type IN (SELECT type FROM short)
    AND NOT (regexp_matches(after, '^\p{{Lu}}') AND lower(regexp_replace(after, '\.$', '')) IN (SELECT type FROM starters)))) AS last FROM words),
placed AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ends)
SELECT doc_id, pos::BIGINT AS pos, string_agg(t, ' ' ORDER BY i) AS sentence FROM placed GROUP BY doc_id, pos""",
    "lemma_rules": f"WITH {LEMMA_RULES} SELECT suffix, cut, add, n FROM rules",
    "lemma_induced": f"""WITH {LEMMA_RULES}, met AS (SELECT f.term, r.cut, r.add, k FROM frequencies f, range(0, 7) AS x(k), rules r
    WHERE k <= length(f.term) AND r.suffix = right(f.term, k) AND length(f.term) - r.cut >= 2)
SELECT f.term, coalesce(arg_max(left(f.term, length(f.term) - m.cut) || m.add, m.k), f.term) AS value FROM frequencies f LEFT JOIN met m ON m.term = f.term GROUP BY f.term""",
    "token_filter": f"""SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM
(SELECT doc_id, tokens[1:50] AS tokens FROM ({KEPT.replace("(text,", "(substring(text, 1, 1000000),")}))""",
    "lemma_lookup": f"""WITH kept AS ({KEPT}), lemmas(form, lemma) AS (VALUES {LEMMA_VALUES}),
long AS (SELECT doc_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS t FROM kept),
joined AS (SELECT doc_id, string_agg(coalesce(lemma, t), ' ' ORDER BY i) AS lemmas FROM long LEFT JOIN lemmas ON form = t GROUP BY doc_id)
SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM kept LEFT JOIN joined USING (doc_id)""",
    "vocab_df": f"WITH kept AS ({KEPT}) {FREQUENCIES}",
    "vocab_prune": f"WITH kept AS ({KEPT}), frequencies AS ({FREQUENCIES}) SELECT * FROM ({PRUNED}) WHERE term_id < 100000",
    "vocab_topk": f"WITH kept AS ({KEPT}), frequencies AS ({FREQUENCIES}) SELECT * FROM frequencies ORDER BY df DESC, term LIMIT 100",
    "bag_of_words": f"""WITH kept AS ({KEPT}), frequencies AS ({FREQUENCIES}), pruned AS ({PRUNED})
SELECT doc_id, term_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM kept) JOIN pruned USING (term)
GROUP BY doc_id, term_id""",
    "sequence_ids": f"""WITH {IDS}, {ids('documents', 'doc_id', 'text', 1 << 31)}
SELECT doc_id, array_to_string(ids, ' ') AS ids FROM id_lists""",
    "sequence_pad": f"WITH {IDS}, {ids('benchmark', 'item_id', 'text', q.MAX_LEN)} {padded('item_id', q.MAX_LEN)}",
    "document_sequences": f"WITH {IDS}, {ids('documents', 'doc_id', 'text', q.MAX_LEN)} {padded('doc_id', q.MAX_LEN)}",
    "long_sequences": f"WITH {IDS}, {ids('documents', 'doc_id', 'text', q.LONG_LEN)} {padded('doc_id', q.LONG_LEN)}",
    "sentence_sequences": f"""WITH {IDS}, sentences AS ({SENTENCES}),
{ids('sentences', 'doc_id, pos', 'sentence', q.SENTENCE_LEN)} {padded('doc_id, pos', q.SENTENCE_LEN)}""",
    "sequence_vote": f"""WITH {IDS}, sentences AS ({SENTENCES}), {ids('sentences', 'doc_id, pos', 'sentence', q.SENTENCE_LEN)},
scored AS (SELECT doc_id, pos, list_transform(range(1, 5), lambda k: list_sum([sin(x * k) FOR x IN list_concat([0], ids, [2])])) AS scores
    FROM id_lists),
labelled AS (SELECT doc_id, pos, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS prediction FROM scored),
votes AS (SELECT doc_id, prediction, count(prediction) AS votes, min(pos) AS first
    FROM documents LEFT JOIN labelled USING (doc_id) GROUP BY doc_id, prediction)
SELECT doc_id, prediction, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) = 1""",
    "text_cast": "SELECT doc_id, CASE WHEN quality > 0 THEN CAST(quality AS VARCHAR) ELSE 'nan' END AS text FROM labels",
    "tokens_persisted": f"""WITH kept AS ({KEPT}), long AS (SELECT doc_id, unnest(tokens) AS term FROM kept)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM long GROUP BY term""",
    "feature_concat": """SELECT vec_id, CAST(generate_subscripts(f, 1) - 1 AS BIGINT) AS j, round(unnest(f), 6) AS value FROM
(SELECT vec_id, list_concat([CASE WHEN label % 3 = t THEN 0.5 ELSE 0 END::DOUBLE FOR t IN range(3)], embedding::DOUBLE[]) AS f FROM embeddings)""",
    "topic_sums": "SELECT doc_id, 9::BIGINT AS n_topics, true AS whole FROM documents",
    "topic_bound": f"SELECT unnest(range({q.PASSES})) AS pass, true AS rises",
    "vector_projection": f"""WITH kept AS ({KEPT}), frequencies AS ({FREQUENCIES}), pruned AS ({PRUNED}),
bag AS (SELECT doc_id, term_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM kept) JOIN pruned USING (term) GROUP BY doc_id, term_id)
SELECT doc_id, j, round(sum(ln(1 + tf) * sin(0.7::DOUBLE * (term_id + 1) * (j + 1))), 6) AS value FROM bag, range({q.WIDTH}) AS r(j) GROUP BY doc_id, j""",
    "head_stepwise": "SELECT true AS same_stop, true AS stopped",
    "svm_held_out": f"{HELD_OUT}, true AS same_after_load {FOLD}",
    "head_held_out": f"{HELD_OUT} {FOLD}",
    "sequences_held_out": f"{HELD_OUT}, true AS same_after_load, true AS low_loss {FOLD}",
    "long_sequences_held_out": f"{HELD_OUT}, true AS same_after_load, true AS low_loss {FOLD}",
    "doc_prefix": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10",
    "combined_features": f"""SELECT doc_id, length(text) || ' ' || n || ' ' || quality || ' ' || toxic AS features
FROM documents JOIN labels USING (doc_id)
JOIN (SELECT doc_id, len(list_filter([trim(s) FOR s IN regexp_extract_all(text, {text(SENTENCE)})], lambda s: s <> '')) AS n
      FROM documents) USING (doc_id)""",
    "label_index": "SELECT row_number() OVER (ORDER BY source) - 1 AS label_id, source AS label FROM (SELECT DISTINCT source FROM documents)",
    "class_counts": "SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang",
    "one_hot": """SELECT doc_id, array_to_string([CASE WHEN l = lang THEN 1 ELSE 0 END FOR l IN
(SELECT list(DISTINCT lang ORDER BY lang) FROM documents)], ' ') AS target FROM documents""",
    "head_forward": f"""WITH {SCORED}
SELECT vec_id, CAST(generate_subscripts(scores, 1) - 1 AS BIGINT) AS class, round(unnest(scores), 6) AS score FROM scored""",
    "rbf_features": f"""WITH mapped AS (SELECT vec_id, list_transform(range({q.FOURIER}), lambda j: sqrt(2.0::DOUBLE / {q.FOURIER}) * cos(list_sum(
    list_transform(range({q.INPUTS}), lambda i: embedding[i + 1]::DOUBLE * sin(1.7::DOUBLE * (i + 1) * (j + 1)))) + j)) AS z FROM embeddings)
SELECT vec_id, CAST(generate_subscripts(z, 1) - 1 AS BIGINT) AS j, round(unnest(z), 6) AS value FROM mapped""",
    "argmax_label": f"WITH {SCORED} SELECT vec_id, label, prediction FROM decoded",
    "cross_entropy": f"WITH {SCORED} SELECT vec_id, round(loss, 6) AS loss FROM losses",
    "validation_loss": f"WITH {SCORED} SELECT count(loss) AS n_docs, round(avg(loss), 6) AS loss FROM losses",
    "epoch_loss": f"""WITH {SCORED},
placed AS (SELECT loss, (row_number() OVER (ORDER BY vec_id) - 1) // {q.BATCH} AS batch FROM losses),
batches AS (SELECT batch, avg(loss) AS l FROM placed GROUP BY batch)
SELECT count(*) AS n_batches, round(avg(l), 6) AS loss FROM batches""",
    "accuracy": f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (label = prediction) AS n_correct,
round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy FROM decoded""",
    "confusion_long": f"""WITH {SCORED}, names AS (SELECT DISTINCT label AS name FROM decoded)
SELECT a.name AS label, b.name AS prediction, (SELECT count(*) FROM decoded d WHERE d.label = a.name AND d.prediction = b.name) AS n
FROM names a CROSS JOIN names b""",
    "confusion_wide": f"WITH {SCORED} SELECT label, {WIDE} FROM decoded GROUP BY label",
    "classification_report": report(SCORED),
    "report_union": report(ENTRIES),
    "report_labels": f"WITH {ENTRIES} SELECT label FROM decoded UNION SELECT prediction FROM decoded",
    "unseen_predictions": f"""WITH {ENTRIES} SELECT prediction, count(*) AS n FROM decoded
WHERE prediction NOT IN (SELECT label FROM decoded) GROUP BY prediction""",
    "majority_vote": """SELECT user_id, event_type AS prediction, votes FROM
(SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first FROM events GROUP BY user_id, event_type)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) = 1""",
    "minibatch": f"""SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // {q.BATCH} AS batch_id
FROM documents""",
    "file_batch": f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {q.BATCH} AS batch_id FROM documents",
    "epoch_summary": f"""WITH {CURVE} SELECT run, epoch, count(*) AS n_batches, round(avg(loss), 4) AS loss,
round((sum(ok) / count(*))::DOUBLE, 4) AS accuracy FROM log GROUP BY run, epoch""",
    "training_curve": f"WITH {CURVE} SELECT run, epoch, step, loss, accuracy FROM curve",
    "early_stop": f"""WITH {CURVE},
before AS (SELECT *, greatest(coalesce(max(accuracy) OVER (PARTITION BY run ORDER BY event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS peak_before FROM curve),
islands AS (SELECT *, sum(CASE WHEN accuracy > peak_before THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY event_id
               ROWS UNBOUNDED PRECEDING) AS island FROM before),
misses AS (SELECT *, sum(CASE WHEN accuracy > peak_before THEN 0 ELSE 1 END) OVER (PARTITION BY run, island ORDER BY event_id
               ROWS UNBOUNDED PRECEDING) AS missed FROM islands)
SELECT run, epoch, step, loss, accuracy, peak_before AS peak FROM misses WHERE missed = {q.PATIENCE}
QUALIFY row_number() OVER (PARTITION BY run ORDER BY event_id) = 1""",
    "topic_dense": """WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS topic
FROM (SELECT DISTINCT event_type FROM events)),
shares AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY user_id, event_type),
every AS (SELECT user_id, event_type, topic FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN kinds)
SELECT user_id, topic, round((CASE WHEN share >= 0.2 THEN share ELSE 0 END)::DOUBLE, 6) AS score
FROM every LEFT JOIN shares USING (user_id, event_type)""",
}
