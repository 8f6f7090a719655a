"""The same results in SQL, written independently of the Spark plans, for DuckDB."""

from __future__ import annotations

from speechtab import constants as K
from speechtab.plans import bindings as B
from speechtab.plans import catalog

WS = K.WHITESPACE
SPACES = f"[{WS}]+"
DAY = B.DAY_MICROS


def _quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _double(value: float) -> str:
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


def _micro(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACES}'), lambda w: w <> '')"


def _chars(text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split({text}, '') END)"


def _tokens(words: str, silence) -> str:
    drop = f" AND t NOT IN ({_quoted(silence)})" if silence else ""
    return (
        f"list_filter(list_transform({words}, lambda t: lower(trim(t, '{WS}'))), "
        f"lambda t: t <> ''{drop})"
    )


#: Codes of one byte each, because DuckDB's distance counts bytes.
_CODES = "(SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) FROM range(1, 127) AS t(i))"


def _char_edit(left: str, right: str, signs: str) -> str:
    """Characters spelled in codes of one byte; null, which no row should be, if they are too many."""
    spelled = [f"translate({x}, {signs}, {_CODES}[1:length({signs})])" for x in (left, right)]
    return f"(CASE WHEN length({signs}) <= 126 THEN levenshtein({spelled[0]}, {spelled[1]}) END)"


def _signs(left: str, right: str) -> str:
    return f"array_to_string(list_distinct(string_split({left} || {right}, '')), '')"


def _word_edit(left: str, right: str, shared: str) -> str:
    """As for characters; words of one side only match nothing and share a code."""
    def spelled(words: str, own: int) -> str:
        # An empty list joins to null.
        return (
            f"coalesce(array_to_string(list_transform({words}, "
            f"lambda w: chr((coalesce(list_position({shared}, w), {own - 2}) + 2)::INTEGER)), ''), '')"
        )

    return f"(CASE WHEN len({shared}) <= 124 THEN levenshtein({spelled(left, 1)}, {spelled(right, 2)}) END)"


def _shared(left: str, right: str) -> str:
    return f"list_distinct(list_intersect({left}, {right}))"


def _repeats(items: str) -> str:
    return f"len(list_filter(range(1, len({items})), lambda i: {items}[i] = {items}[i + 1]))"


SAID = """
pieces AS (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.!?\\n]+') AS p FROM documents),
numbered AS (SELECT *, unnest(range(1, len(p) + 1)) AS part FROM pieces),
said AS (SELECT doc_id, source, lang, part, p[part] AS raw FROM numbered
         WHERE replace(p[part], ' ', '') <> '')
"""
CLIPS = SAID + f""",
clips AS (SELECT * FROM (
  SELECT concat_ws('_', source, doc_id, part) AS sample_id, source AS speaker_id, lang, doc_id, part,
         coalesce(array_to_string({_tokens("string_split(raw, ' ')", B.SILENCE)}, ' '), '') AS transcript,
         length(raw) AS num_frames FROM said) WHERE transcript <> '')
"""
PAIRS = CLIPS + f""",
spoken AS (SELECT *, {_micro("transcript")} AS said, md5(concat_ws('|', '0', doc_id, part)) AS h FROM clips),
marked AS (SELECT *, list_transform(said, lambda w, i: CASE h[(i * 7) % 32 + 1]
             WHEN '0' THEN NULL WHEN '1' THEN repeat('{B.BLOT}', length(w)) WHEN '2' THEN w || ' ' || w
             WHEN '3' THEN w || ' ' WHEN '4' THEN coalesce(said[i + 1], w)
             WHEN '5' THEN substring(w, 2) || substring(w, 1, 1) ELSE w END) AS heard FROM spoken),
pairs AS (SELECT sample_id, speaker_id, lang, doc_id, part, transcript AS reference,
            CASE WHEN starts_with(h, '00') THEN ''
              ELSE coalesce(array_to_string(list_filter(heard, lambda w: w IS NOT NULL), ' '), '') END AS prediction
          FROM marked),
split_words AS (SELECT *, string_split(reference, ' ') AS rw, {_micro("reference")} AS ru,
                  string_split(prediction, ' ') AS pw, {_micro("prediction")} AS pu,
                  {_signs("prediction", "reference")} AS signs FROM pairs),
common AS (SELECT *, {_shared("pw", "rw")} AS sw, {_shared("pu", "ru")} AS su FROM split_words),
scored AS (SELECT *, {_word_edit("pw", "rw", "sw")} AS word_errors_macro, {_word_edit("pu", "ru", "su")} AS word_errors_micro,
             {_char_edit("prediction", "reference", "signs")} AS char_errors, len(rw) AS words_macro,
             len(ru) AS words_micro, length(reference) AS chars, prediction = reference AS exact FROM common)
"""
SPLIT = f"""
speakers AS (SELECT DISTINCT source AS speaker_id FROM documents),
ranked AS (SELECT speaker_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{K.SPLIT_SEED}', speaker_id)),
             speaker_id) AS r, count(*) OVER () AS n FROM speakers),
held AS (SELECT *, greatest(1, round_even(n * {_double(K.HOLDOUT_SHARE)}, 0)) AS h FROM ranked),
split_dim AS (SELECT speaker_id, CASE WHEN n < 3 THEN NULL WHEN r <= h THEN 'test'
                WHEN r <= 2 * h THEN 'validation' ELSE 'train' END AS split FROM held)
"""
DOCSPLIT = SPLIT + """,
assigned AS (SELECT d.doc_id, d.source AS speaker_id, md5(d.text) AS text_key, s.split
             FROM documents d JOIN split_dim s ON d.source = s.speaker_id)
"""
MACRO = """
  round(avg(word_errors_macro / greatest(words_macro, 1)), 6) + 0.0 AS macro_wer,
  round(avg(char_errors / greatest(chars, 1)), 6) + 0.0 AS macro_cer,
  round(avg(exact::INTEGER), 6) + 0.0 AS sentence_exact_match, count(*) AS clips"""
MICRO = """
  round(sum(word_errors_micro) / nullif(sum(words_micro), 0), 6) + 0.0 AS micro_wer,
  round(sum(char_errors) / nullif(sum(chars), 0), 6) + 0.0 AS micro_cer,
  sum(word_errors_micro)::BIGINT AS word_errors, sum(words_micro)::BIGINT AS words,
  sum(char_errors)::BIGINT AS char_errors, sum(chars)::BIGINT AS chars"""
WORDS = """
listed AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS line_no FROM listed),
lines AS (SELECT doc_id, line_no, w[line_no] AS word FROM placed)
"""
NOTES = """
listed AS (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), chr(9), ' '), ' ') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS line_no FROM listed),
lines AS (SELECT doc_id, line_no, w[line_no] AS word, md5(w[line_no])[1] <> '0' AS whole FROM placed)
"""
EVENT_LINES = """
lines AS (SELECT user_id, event_id, epoch_us(ts) AS start,
            epoch_us(ts) + round_even(value * 1000000, 0)::BIGINT AS "end" FROM events
          WHERE event_type <> 'error'),
seen AS (SELECT *, lag("end", 1, -1) OVER (PARTITION BY user_id ORDER BY start, event_id) AS previous_end
         FROM lines),
checked AS (SELECT *, CASE WHEN start < 0 THEN 'negative_start' WHEN "end" <= start THEN 'empty_interval'
              WHEN start < previous_end THEN 'overlap' END AS violation FROM seen)
"""
FRAMES = f"""
frames AS (SELECT user_id AS clip, event_id AS frame, epoch_us(ts) AS moment,
             CASE WHEN event_type NOT IN ({_quoted(B.UNSEEN)}) THEN value / 1000 END AS x,
             CASE WHEN event_type NOT IN ({_quoted(B.UNSEEN)})
               THEN (props->>'$.k')::DOUBLE / 100 END AS y FROM events)
"""
BOXES = FRAMES + f""",
pictures AS (SELECT concat_ws('_', clip, moment // {DAY}) AS clip_id,
               concat_ws('_', clip, moment // {DAY} // 3) AS speaker_id, moment // {DAY // 24} AS picture, x, y
             FROM frames),
extents AS (SELECT clip_id, speaker_id, picture, count(x) AS points, min(x) AS xl, max(x) AS xh,
              min(y) AS yl, max(y) AS yh FROM pictures GROUP BY 1, 2, 3),
sizes AS (SELECT *, greatest(greatest(xh - xl, 0.04e0) * 1.55e0, greatest(yh - yl, 0.025e0) * 2e0 * 2e0) AS w,
            (xl + xh) / 2 AS cx, (yl + yh) / 2 AS cy FROM extents),
moved AS (SELECT *, greatest(0, -(cx - w / 2)) - greatest(0, cx + w / 2 - 1) AS sx,
            greatest(0, -(cy - w / 4)) - greatest(0, cy + w / 4 - 1) AS sy FROM sizes),
boxes AS (SELECT clip_id, speaker_id, picture, points, CASE WHEN points > 0 THEN cx - w / 2 + sx END AS x1,
            CASE WHEN points > 0 THEN cy - w / 4 + sy END AS y1,
            CASE WHEN points > 0 THEN cx + w / 2 + sx END AS x2,
            CASE WHEN points > 0 THEN cy + w / 4 + sy END AS y2 FROM moved),
clip_boxes AS (SELECT clip_id, speaker_id, count(x1) AS valid_detections, count(*) AS sampled_frames,
                 median(x1) AS x1, median(y1) AS y1, median(x2) AS x2, median(y2) AS y2
               FROM boxes GROUP BY 1, 2)
"""
FOUR = ", ".join(f"round({c}, 10) + 0.0 AS {c}" for c in ("x1", "y1", "x2", "y2"))
MEDIANS = ", ".join(f"median({c}) AS {c}" for c in ("x1", "y1", "x2", "y2"))
FALLBACK = BOXES + f""",
per_speaker AS (SELECT speaker_id, {MEDIANS} FROM clip_boxes WHERE x1 IS NOT NULL GROUP BY 1),
overall AS (SELECT {MEDIANS} FROM clip_boxes WHERE x1 IS NOT NULL),
placed AS (SELECT c.clip_id, c.speaker_id, c.valid_detections, c.sampled_frames,
    coalesce(c.x1, s.x1, o.x1) AS x1, coalesce(c.y1, s.y1, o.y1) AS y1,
    coalesce(c.x2, s.x2, o.x2) AS x2, coalesce(c.y2, s.y2, o.y2) AS y2,
    CASE WHEN c.x1 IS NOT NULL THEN 'detected' WHEN s.x1 IS NOT NULL THEN 'speaker_median'
         WHEN o.x1 IS NOT NULL THEN 'global_median' END AS source
  FROM clip_boxes c LEFT JOIN per_speaker s USING (speaker_id) CROSS JOIN overall o)
"""
LOGITS = """
steps AS (SELECT vec_id AS sample_id, least(8, 4 + label) AS length, embedding AS e, unnest(range(0, 8)) AS t
          FROM embeddings),
logits AS (SELECT sample_id, length, t::INTEGER AS t, e[t * 8 + 1 : t * 8 + 8] AS scores FROM steps)
"""
TOKENS = LOGITS + """,
tokens AS (SELECT sample_id, t, (list_position(scores, list_max(scores)) - 1)::INTEGER AS token
           FROM logits WHERE t < length)
"""
GREEDY = TOKENS + f""",
before AS (SELECT *, lag(token, 1, -1) OVER (PARTITION BY sample_id ORDER BY t) AS previous FROM tokens),
letters AS (SELECT sample_id, string_agg(('{B.LOGIT_LETTERS}')[token], '' ORDER BY t) AS s FROM before
            WHERE token <> previous AND token >= 1 GROUP BY 1)
SELECT DISTINCT t.sample_id, trim(regexp_replace(coalesce(s, ''), ' +', ' ', 'g')) AS text
FROM tokens t LEFT JOIN letters USING (sample_id)
"""
POINTS = """
spread AS (SELECT vec_id AS sample_id, embedding AS e, unnest(range(0, 32)) AS point FROM embeddings),
points AS (SELECT sample_id, point, e[2 * point + 1]::DOUBLE AS x, e[2 * point + 2]::DOUBLE AS y FROM spread)
"""


def _scaled(values) -> str:
    scale = lambda v: (v + K.TEMPLATE_PADDING) / (2 * K.TEMPLATE_PADDING + 1) * K.TEMPLATE_SIZE
    return "[" + ", ".join(_double(scale(v)) for v in values) + "]"


FIT = POINTS + f""",
matched AS (SELECT *, {_scaled(K.TEMPLATE_X)}[point + 1] AS u, {_scaled(K.TEMPLATE_Y)}[point + 1] AS v FROM points),
centred AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(u) OVER w AS mu, avg(v) OVER w AS mv
            FROM matched WINDOW w AS (PARTITION BY sample_id)),
sums AS (SELECT sample_id, count(*) AS points, any_value(mx) AS mx, any_value(my) AS my,
   any_value(mu) AS mu, any_value(mv) AS mv,
   sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS vs, sum((u - mu) * (u - mu) + (v - mv) * (v - mv)) AS vt,
   sum((x - mx) * (u - mu)) AS a, sum((x - mx) * (v - mv)) AS b,
   sum((y - my) * (u - mu)) AS c, sum((y - my) * (v - mv)) AS d FROM centred GROUP BY 1),
turned AS (SELECT *, a * d - b * c > 0 AS turn, sqrt(vt / vs) AS s FROM sums),
scaled AS (SELECT *, s / CASE WHEN turn THEN sqrt((a + d) * (a + d) + (b - c) * (b - c))
    ELSE sqrt((a - d) * (a - d) + (b + c) * (b + c)) END AS k FROM turned),
matrix AS (SELECT sample_id, points, mx, my, mu, mv,
   k * CASE WHEN turn THEN a + d ELSE a - d END AS m00, k * CASE WHEN turn THEN c - b ELSE b + c END AS m01,
   k * CASE WHEN turn THEN b - c ELSE b + c END AS m10, k * CASE WHEN turn THEN a + d ELSE d - a END AS m11
  FROM scaled),
fitted AS (SELECT sample_id, points, m00, m01, m10, m11, mu - m00 * mx - m01 * my AS tx,
             mv - m10 * mx - m11 * my AS ty FROM matrix)
"""
DIALOGUE = f"""
turns AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\\n]+') AS p FROM conversations),
parts AS (SELECT *, unnest(range(1, len(p) + 1)) AS part FROM turns),
dialogue AS (SELECT * FROM (SELECT concat_ws('_', conv_id, turn, part) AS sample_id,
    coalesce(array_to_string({_tokens("string_split(p[part], ' ')", ())}, ' '), '') AS reference
  FROM parts WHERE replace(p[part], ' ', '') <> '') WHERE reference <> '')
"""


def _draw(kind: str) -> str:
    return f"('0x' || md5(concat_ws('|', '{kind}', seed, sample_id))[1:4])::INTEGER::DOUBLE"


NBEST = DIALOGUE + f""",
variants AS (SELECT sample_id, reference, unnest(['0', '1', '2', '3']) AS seed FROM dialogue),
heard AS (SELECT sample_id, seed, list_transform({_micro("reference")}, lambda w, i:
            {{'w': w, 'h': md5(concat_ws('|', seed, sample_id, i))[1]}}) AS marks FROM variants),
spelled AS (SELECT sample_id, -{_draw("am")} / 4096 AS am_score, -{_draw("lm")} / 8192 AS lm_score,
   coalesce(array_to_string(list_transform(list_filter(marks, lambda m: m.h <> '0'),
     lambda m: CASE WHEN m.h = '1' THEN repeat('{B.BLOT}', length(m.w)) ELSE m.w END), ' '), '') AS text FROM heard),
weighted AS (SELECT *, unnest([1.0e0, 1.25e0, 1.5e0, 1.75e0]) AS alpha FROM spelled),
based AS (SELECT *, am_score + alpha * lm_score AS base_score FROM weighted WHERE text <> ''),
best AS (SELECT sample_id, alpha, text, am_score, lm_score, base_score, len({_micro("text")}) AS word_count
  FROM based QUALIFY row_number() OVER (PARTITION BY sample_id, alpha, text
    ORDER BY base_score DESC, am_score DESC) = 1)
"""
BETAS = "[" + ", ".join(_double(b) for b in K.TUNING_BETAS) + "]"
CHOSEN = NBEST + f""",
cells AS (SELECT *, unnest({BETAS}) AS beta FROM best),
chosen AS (SELECT sample_id, alpha, beta, text AS prediction FROM cells
  QUALIFY row_number() OVER (PARTITION BY sample_id, alpha, beta
    ORDER BY am_score + alpha * lm_score + beta * word_count DESC, text) = 1)
"""
GRID = CHOSEN + f""",
everything AS (SELECT sample_id, reference, alpha, beta FROM dialogue,
  (SELECT unnest([1.0e0, 1.25e0, 1.5e0, 1.75e0]) AS alpha), (SELECT unnest({BETAS}) AS beta)),
completed AS (SELECT e.sample_id, e.reference, e.alpha, e.beta, coalesce(c.prediction, '') AS prediction
  FROM everything e LEFT JOIN chosen c USING (sample_id, alpha, beta)),
distinct_pairs AS (SELECT DISTINCT sample_id, reference, prediction FROM completed),
listed AS (SELECT *, {_micro("prediction")} AS pu, {_micro("reference")} AS ru, {_signs("prediction", "reference")} AS signs
   FROM distinct_pairs),
common AS (SELECT *, {_shared("pu", "ru")} AS su FROM listed),
measured AS (SELECT sample_id, prediction, len(ru) AS wn, length(reference) AS cn,
   {_word_edit("pu", "ru", "su")} AS we, {_char_edit("prediction", "reference", "signs")} AS ce FROM common),
rates AS (SELECT alpha, beta, round(sum(we) / sum(wn), 9) + 0.0 AS wer, round(sum(ce) / sum(cn), 9) + 0.0 AS cer
  FROM completed JOIN measured USING (sample_id, prediction) GROUP BY 1, 2)
"""
SEQUENCES = """
sequences AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS seq FROM lineitem GROUP BY 1),
batched AS (SELECT *, (row_number() OVER (ORDER BY l_orderkey) - 1) // 2 AS batch_id FROM sequences)
"""


def _counts(order: int) -> str:
    grams = " UNION ALL ".join(
        f"""SELECT {n} AS "order", array_to_string(t[i : i + {n - 1}], ' ') AS ngram FROM
        (SELECT t, unnest(range(1, len(t) - {n - 2})) AS i FROM spelled)""" for n in range(1, order + 1)
    )
    return f"""
said AS (SELECT lower(replace(text, chr(10), ' ')) AS s FROM conversations),
spelled AS (SELECT list_concat(list_concat(['<s>'], list_transform({_chars("s")},
              lambda c: CASE WHEN c = ' ' THEN '<sp>' ELSE c END)), ['</s>']) AS t FROM said),
counts AS (SELECT "order", ngram, count(*) AS count FROM ({grams}) GROUP BY 1, 2)
"""


def _model(order: int) -> str:
    """Textbook recursion, one order after the other."""
    sql = _counts(order) + f""",
adjusted AS (
  SELECT "order", ngram, count FROM counts
  WHERE "order" = {order} OR ("order" > 1 AND starts_with(ngram, '<s>'))
  UNION ALL
  SELECT "order" - 1, regexp_replace(ngram, '^[^ ]+ ', ''), count(*) FROM counts
  WHERE "order" > 1 GROUP BY 1, 2),
grams AS (SELECT *, CASE WHEN "order" = 1 THEN '' ELSE regexp_replace(ngram, ' [^ ]+$', '') END AS context,
            CASE WHEN "order" = 1 THEN '' ELSE regexp_replace(ngram, '^[^ ]+ ', '') END AS suffix FROM adjusted),
tallies AS (SELECT "order", sum((count = 1)::INT)::DOUBLE AS n1, sum((count = 2)::INT)::DOUBLE AS n2,
   sum((count = 3)::INT)::DOUBLE AS n3, sum((count = 4)::INT)::DOUBLE AS n4 FROM adjusted GROUP BY 1),
guesses AS (SELECT "order", n1 / nullif(n1 + 2 * n2, 0) AS y, * EXCLUDE ("order") FROM tallies),
raw AS (SELECT "order", 1 - 2 * y * n2 / nullif(n1, 0) AS a, 2 - 3 * y * n3 / nullif(n2, 0) AS b,
          3 - 4 * y * n4 / nullif(n3, 0) AS c FROM guesses),
discounts AS (SELECT "order", CASE WHEN ok THEN a ELSE 0.5 END AS a, CASE WHEN ok THEN b ELSE 1.0 END AS b,
    CASE WHEN ok THEN c ELSE 1.5 END AS c FROM
  (SELECT *, coalesce(a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 2 AND c BETWEEN 0 AND 3, false) AS ok FROM raw)),
costed AS (SELECT g.*, CASE g.count WHEN 1 THEN d.a WHEN 2 THEN d.b ELSE d.c END AS discount
  FROM grams g JOIN discounts d USING ("order")),
contexts AS (SELECT "order", context, sum(count) AS total, sum(discount) / sum(count) AS gamma
  FROM costed GROUP BY 1, 2),
shares AS (SELECT c."order", c.ngram, c.suffix, (c.count - c.discount) / t.total AS share, t.gamma
  FROM costed c JOIN contexts t ON c."order" = t."order" AND c.context = t.context),
p1 AS (SELECT "order", ngram, share + gamma / ((SELECT count(*) FROM shares WHERE "order" = 1) + 1) AS prob
       FROM shares WHERE "order" = 1)"""
    for n in range(2, order + 1):
        sql += f""",
p{n} AS (SELECT s."order", s.ngram, s.share + s.gamma * l.prob AS prob
  FROM shares s JOIN p{n - 1} l ON s.suffix = l.ngram WHERE s."order" = {n})"""
    union = " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, order + 1))
    return sql + f""",
probs AS ({union} UNION ALL SELECT 1, '<unk>', gamma / ((SELECT count(*) FROM shares WHERE "order" = 1) + 1)
  FROM contexts WHERE "order" = 1),
backoffs AS (SELECT "order" - 1 AS "order", context AS ngram, log10(gamma) AS log10_backoff
  FROM contexts WHERE "order" > 1),
model AS (SELECT "order"::INTEGER AS "order", ngram, log10(prob) AS log10_prob, log10_backoff
  FROM probs FULL JOIN backoffs USING ("order", ngram))
"""


def _walk(order: int) -> tuple[str, str]:
    """Joins and value that walk each window ``w`` from the longest context to the shortest."""
    joins, total, back = "", "", []
    for n in range(order, 0, -1):
        joins += f"""
  LEFT JOIN model m{n} ON m{n}.log10_prob IS NOT NULL AND len(w) >= {n} AND m{n}.ngram = array_to_string(w[len(w) - {n - 1} :], ' ')"""
        if n > 1:
            joins += f"""
  LEFT JOIN model b{n} ON b{n}.log10_backoff IS NOT NULL AND len(w) >= {n} AND b{n}.ngram = array_to_string(w[len(w) - {n - 1} : len(w) - 1], ' ')"""
        penalty = "".join(f" + coalesce(b{k}.log10_backoff, 0)" for k in back)
        total += f" WHEN m{n}.ngram IS NOT NULL THEN m{n}.log10_prob{penalty}"
        back.append(n)
    rest = "".join(f" + coalesce(b{k}.log10_backoff, 0)" for k in range(2, order + 1))
    return joins, f"CASE{total} ELSE (SELECT log10_prob FROM model WHERE ngram = '<unk>'){rest} END"


def _ln_sum(a: str, b: str) -> str:
    """ln(e^a + e^b); null stands for minus infinity."""
    return (
        f"(CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} "
        f"ELSE greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b}))) END)"
    )


def _beam(order: int, letters: str, width: int, alpha: float, beta: float, steps: int = 8) -> str:
    """The search step by step, over a table of what each letter costs behind each context."""
    joins, value = _walk(order)
    spelled = "list_transform(string_split({}, ''), lambda c: CASE WHEN c = ' ' THEN '<sp>' ELSE c END)"
    context = f"(CASE WHEN length(prefix) >= {order - 1} THEN right(prefix, {order - 1}) ELSE prefix END)"
    words = "len(list_filter(string_split(prefix, ' '), lambda x: x <> ''))"
    total = f"{_ln_sum('pb', 'pnb')} + {_double(alpha)} * lm + {_double(beta)} * {words}"
    sql = "RECURSIVE " + _model(order).lstrip() + f""",
letters AS (SELECT unnest(range(1, {len(letters) + 1})) AS i, unnest(string_split('{letters}', '')) AS c),
contexts_of AS (SELECT '' AS p UNION ALL SELECT p || c FROM contexts_of, letters WHERE length(p) < {order - 1}),
asked AS (SELECT p, token, list_concat(list_concat(CASE WHEN length(p) < {order - 1} THEN ['<s>'] ELSE []::VARCHAR[] END,
    CASE WHEN p = '' THEN []::VARCHAR[] ELSE {spelled.format('p')} END), [CASE WHEN token = ' ' THEN '<sp>' ELSE token END]) AS w
  FROM contexts_of, (SELECT c AS token FROM letters UNION ALL SELECT '</s>')),
costs AS MATERIALIZED (SELECT p, token, {value} * ln(10::DOUBLE) AS cost FROM asked{joins}),
{LOGITS.strip()},
peaks AS (SELECT sample_id, length, t, list_transform(scores, lambda x: x::DOUBLE - list_max(scores)::DOUBLE) AS s FROM logits),
log_probs AS MATERIALIZED (SELECT sample_id, length, t,
    list_transform(s, lambda x: x - ln(list_sum(list_transform(s, lambda y: exp(y))))) AS lp FROM peaks),
beam0 AS (SELECT DISTINCT sample_id, '' AS prefix, 0::DOUBLE AS pb, NULL::DOUBLE AS pnb, 0::DOUBLE AS lm FROM logits)"""
    for t in range(steps):
        sql += f""",
live{t} AS (SELECT b.*, lp, right(prefix, 1) AS final, {_ln_sum('pb', 'pnb')} AS merged
  FROM beam{t} b JOIN log_probs r ON b.sample_id = r.sample_id AND r.t = {t} AND r.length > {t}),
moves{t} AS (SELECT sample_id, prefix, merged + lp[1] AS b, pnb + lp[i + 1] AS s, lm, true AS stays
    FROM live{t} LEFT JOIN letters ON c = final
  UNION ALL SELECT sample_id, prefix || c, NULL, (CASE WHEN final = c THEN pb ELSE merged END) + lp[i + 1], lm + cost, false
    FROM live{t} CROSS JOIN letters JOIN costs ON p = {context} AND token = c
    WHERE final <> c OR pb IS NOT NULL),
met{t} AS (SELECT sample_id, prefix, max(b) AS pb, max(s) FILTER (stays) AS s1, max(s) FILTER (NOT stays) AS s2,
    coalesce(max(lm) FILTER (stays), max(lm)) AS lm FROM moves{t} GROUP BY 1, 2),
summed{t} AS (SELECT sample_id, prefix, pb, {_ln_sum('s1', 's2')} AS pnb, lm FROM met{t}),
beam{t + 1} AS MATERIALIZED (
  SELECT sample_id, prefix, pb, pnb, lm FROM summed{t}
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {total} DESC, prefix) <= {width}
  UNION ALL SELECT b.* FROM beam{t} b JOIN log_probs r ON b.sample_id = r.sample_id AND r.t = {t} AND r.length <= {t})"""
    return sql + f"""
SELECT sample_id, {_double(alpha)} AS alpha, array_to_string(list_filter(string_split(prefix, ' '), lambda x: x <> ''), ' ') AS text,
  round({_ln_sum('pb', 'pnb')}, 6) + 0.0 AS am_score, round(lm + cost, 6) + 0.0 AS lm_score, {words}::INTEGER AS word_count
FROM beam{steps} JOIN costs ON p = {context} AND token = '</s>'"""


def _score_sentences(order: int) -> str:
    joins, value = _walk(order)
    return _model(order) + f""",
asked AS (SELECT item_id, list_concat(list_concat(['<s>'], list_transform({_chars("lower(text)")},
    lambda c: CASE WHEN c = ' ' THEN '<sp>' ELSE c END)), ['</s>']) AS t FROM benchmark),
ends AS (SELECT item_id, t, unnest(range(2, len(t) + 1)) AS i FROM asked),
windows AS (SELECT item_id, t[greatest(i - {order - 1}, 1) : i] AS w FROM ends),
scored AS (SELECT item_id, {value} AS lp FROM windows{joins})
SELECT item_id, round(sum(lp), 6) + 0.0 AS log10_prob, count(*) AS tokens,
  round(sum(lp) * ln(10), 6) + 0.0 AS ln_prob FROM scored GROUP BY 1
"""


def _positions(column: str, samples: int) -> list[str]:
    low, width = K.SAMPLE_BAND
    steps = [low + width * i / max(samples - 1, 1) for i in range(samples)]
    return [f"least(round_even({column} * {_double(s)}, 0)::BIGINT, {column} - 1)" for s in steps]


def statements() -> dict[str, str]:
    sql = {
        "error_rates_by_split": f"""WITH {PAIRS}, {SPLIT}
            SELECT split, {MACRO}, {MICRO} FROM scored JOIN split_dim USING (speaker_id) GROUP BY 1""",
        "error_counts_by_clip": f"""WITH {PAIRS} SELECT sample_id, word_errors_macro::INTEGER AS word_errors_macro,
            words_macro::INTEGER AS words_macro, word_errors_micro::INTEGER AS word_errors_micro,
            words_micro::INTEGER AS words_micro, char_errors::INTEGER AS char_errors,
            chars::INTEGER AS chars, exact FROM scored""",
        "macro_error_rates": f"WITH {PAIRS} SELECT speaker_id, {MACRO} FROM scored GROUP BY 1",
        "micro_error_rates": f"WITH {PAIRS} SELECT lang, {MICRO} FROM scored GROUP BY 1",
        "prediction_pairing": """SELECT coalesce(d.doc_id, l.doc_id) AS sample_id, l.quality, d.n_chars,
            CASE WHEN l.doc_id IS NULL THEN 'no_prediction' WHEN d.doc_id IS NULL THEN 'no_reference'
            ELSE 'paired' END AS status FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
        "run_parity": """WITH a AS (SELECT doc_id, sha256(trim(text)) AS label, length(text) + quality * 0.5e0 AS score
              FROM documents JOIN labels USING (doc_id)),
            e AS (SELECT doc_id, sha256(text) AS label, n_chars::DOUBLE AS score FROM documents),
            j AS (SELECT e.doc_id, a.doc_id IS NOT NULL AS both_sides, a.label = e.label AS l,
              abs(a.score - e.score) <= 1e-6 + 1e-6 * abs(e.score) AS s FROM e LEFT JOIN a USING (doc_id))
            SELECT doc_id, CASE WHEN both_sides THEN 'both' ELSE 'missing' END AS presence,
              both_sides AND coalesce(l, false) AS label_equal, both_sides AND coalesce(s, false) AS score_equal,
              both_sides AND coalesce(l AND s, false) AS equal FROM j""",
        "weighted_loss": """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0.0 AS loss
            FROM lineitem GROUP BY 1""",
        "transcripts_from_lines": f"""WITH {WORDS} SELECT doc_id, string_agg(t, ' ' ORDER BY line_no) AS transcript FROM
            (SELECT doc_id, line_no, lower(trim(word, '{WS}')) AS t FROM lines)
            WHERE t <> '' AND t NOT IN ({_quoted(B.SILENCE)}) GROUP BY 1""",
        "alignment_rows": f"""WITH {NOTES}, rows AS (SELECT doc_id, line_no, whole,
              lower(trim(word, '{WS}')) AS t FROM lines)
            SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN whole THEN (line_no - 1) * 10 END AS start,
              CASE WHEN whole THEN line_no * 10 END AS "end", CASE WHEN whole THEN t END AS token,
              whole AND t IN ({_quoted(B.SILENCE)}) AS is_silence,
              CASE WHEN NOT whole THEN 'column_count' END AS error FROM rows""",
        "alignment_spaced_tokens": f"""WITH {NOTES}, rows AS (SELECT doc_id, line_no,
              string_split(trim(concat_ws(' ', (line_no - 1) * 10, CASE WHEN whole THEN (line_no * 10)::VARCHAR END,
              word), '{WS}'), ' ') AS p FROM lines)
            SELECT doc_id, line_no::INTEGER AS line_no, replace(replace(upper(p[3]), 'ß', 'SS'), 'ẞ', 'SS') AS token
            FROM rows WHERE len(p) >= 3 AND lower(p[3]) NOT IN ({_quoted(B.SILENCE)})""",
        "interval_checks": f"""WITH {EVENT_LINES} SELECT user_id, event_id, start, "end", previous_end, violation
            FROM checked""",
        "first_interval_violations": f"""WITH {EVENT_LINES} SELECT user_id, start, event_id, violation,
            count(*) OVER (PARTITION BY user_id) AS violations FROM checked WHERE violation IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) = 1""",
        "rejects_log": f"""WITH {NOTES} SELECT doc_id,
            doc_id || chr(9) || 'ValueError: line ' || line_no || ' column_count' AS line FROM lines WHERE NOT whole""",
        "speaker_mismatches": """SELECT source || '_' || doc_id AS sample_id, 'src' || length(text) % 20 AS path_speaker,
            source AS speaker_id FROM documents WHERE source <> 'src' || length(text) % 20""",
        "unknown_characters": f"""WITH c AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(
              {_chars("lower(text)")}, lambda c: NOT contains('{K.SERBIAN_LETTERS}', c)))) AS u FROM documents)
            SELECT doc_id, coalesce(array_to_string(u, ' '), '') AS unknown, CASE WHEN text = '' THEN 'empty_transcript'
              WHEN len(u) > 0 THEN 'unknown_characters' END AS problem FROM c""",
        "required_steps": f"""WITH {CLIPS}, listed AS (SELECT *, {_chars("transcript")} AS c FROM clips)
            SELECT sample_id, num_frames::INTEGER AS num_frames, (len(c) + {_repeats("c")})::INTEGER AS required_steps,
            len(c) + {_repeats("c")} <= num_frames AS feasible FROM listed""",
        "feasibility_report": f"""WITH {CLIPS}, listed AS (SELECT *, {_chars("transcript")} AS c FROM clips),
            f AS (SELECT speaker_id, len(c) + {_repeats("c")} <= num_frames AS ok FROM listed)
            SELECT speaker_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
            count(*) FILTER (ok) > 0 AS usable FROM f GROUP BY 1""",
        "shortest_feasible": f"""WITH {CLIPS}, listed AS (SELECT *, {_chars("transcript")} AS c FROM clips),
            f AS (SELECT sample_id, num_frames, len(c) + {_repeats("c")} AS required_steps FROM listed)
            SELECT sample_id, num_frames::INTEGER AS num_frames, required_steps::INTEGER AS required_steps FROM f
            WHERE required_steps <= num_frames ORDER BY num_frames, sample_id LIMIT 25""",
        "duplicate_texts": """SELECT md5(text) AS text_key, count(*) AS copies FROM documents GROUP BY 1
            HAVING count(*) > 1""",
        "rule_report": """WITH r AS (SELECT unnest([
              {'rule': 'value_not_negative', 'bad': NOT (value >= 0)},
              {'rule': 'value_below_400', 'bad': NOT (value < 400)},
              {'rule': 'known_type', 'bad': event_type NOT IN ('view', 'signup', 'error', 'purchase', 'click')},
              {'rule': 'has_props', 'bad': (props->>'$.k') IS NULL},
              {'rule': 'props_in_unit_range', 'bad': NOT ((props->>'$.k')::DOUBLE / 100 < 0.95e0)}]) AS x FROM events)
            SELECT x.rule AS rule, count(*) AS checked, count(*) FILTER (x.bad) AS violations,
              count(*) FILTER (x.bad) = 0 AS passed FROM r GROUP BY 1""",
        "allowed_speakers": f"""WITH {CLIPS} SELECT sample_id, speaker_id, num_frames::INTEGER AS num_frames FROM clips
            WHERE speaker_id IN ('src1', 'src3', 'src11')""",
        "forbidden_tokens": f"""WITH d AS (SELECT 'doc' || doc_id AS document, text FROM documents UNION ALL
              SELECT 'page' || page_id, html FROM pages)
            SELECT document, unnest(list_filter([{_quoted(catalog.FORBIDDEN)}], lambda t: contains(text, t))) AS token
            FROM d""",
        "encoded_targets": f"""WITH {DIALOGUE}, c AS (SELECT sample_id, list_transform({_chars("reference")},
              lambda c: CASE WHEN contains('{K.SERBIAN_LETTERS}', c) THEN instr('{K.SERBIAN_LETTERS}', c)
              ELSE -1 END) AS ids FROM dialogue)
            SELECT sample_id, array_to_string(ids, ',') AS ids,
              trim(coalesce(array_to_string(list_transform(list_filter(ids, lambda i: i >= 1),
                lambda i: ('{K.SERBIAN_LETTERS}')[i]), ''), '')) AS decoded,
              (len(ids) + {_repeats("ids")})::INTEGER AS required_steps FROM c""",
        "language_model_tokens": f"""WITH {DIALOGUE} SELECT sample_id, array_to_string(list_transform(
            {_chars("reference")}, lambda c: CASE WHEN c = ' ' THEN '<sp>' ELSE c END), ' ') AS tokens FROM dialogue""",
        "inventory_names": """WITH n AS (SELECT p_partkey, ['conv1.', 'gru2.', 'FC.', 'pool.', 'conv3.', 'gru1.', 'conv2.'][p_size % 7 + 1]
              || p_partkey AS name FROM part)
            SELECT p_partkey, name, CASE WHEN name[1:6] IN ('conv1.', 'conv2.') THEN 'conv_early'
              WHEN name[1:6] = 'conv3.' THEN 'conv3' WHEN name[1:5] = 'gru1.' THEN 'gru1' WHEN name[1:5] = 'gru2.'
              THEN 'gru2' WHEN name[1:3] = 'FC.' THEN 'head' ELSE 'error' END AS grouped FROM n""",
        "nfc_text": "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents",
        "media_pairing": """SELECT coalesce(d.doc_id, l.doc_id) AS sample_id, d.source AS speaker_id,
            d.n_chars AS num_frames, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'no_annotation'
            WHEN d.doc_id IS NULL THEN 'no_media' ELSE 'paired' END AS status
            FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
        "unpaired_examples": """(SELECT 'no_annotation' AS status, doc_id AS sample_id FROM documents
              WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 2 LIMIT 5)
            UNION ALL (SELECT 'no_media', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
              ORDER BY 2 LIMIT 5)""",
        "key_differences": """SELECT doc_id AS sample_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT
            SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT
            SELECT doc_id FROM documents)""",
        "manifest": f"""WITH t AS (SELECT doc_id, source, n_chars, 24.0e0 + length(lang) + length(source) / 7 AS fps,
              coalesce(array_to_string({_tokens("string_split(replace(text, chr(10), ' '), ' ')", B.SILENCE)}, ' '), '') AS s
              FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
            c AS (SELECT *, {_chars("s")} AS c FROM t)
            SELECT doc_id AS sample_id, source AS speaker_id, md5(s) AS transcript, n_chars AS num_frames,
              round_even(fps * 1e6, 0) / 1e6 AS fps, 128 AS width, 64 AS height,
              round_even(n_chars / fps * 1e6, 0) / 1e6 AS duration_s, len(c)::INTEGER AS target_length,
              (len(c) + {_repeats("c")})::INTEGER AS min_ctc_frames, n_chars > 0 AS media_valid FROM c""",
        "distinct_speakers": "SELECT DISTINCT source AS speaker_id FROM documents",
        "split_assignment": f"WITH {DOCSPLIT} SELECT doc_id, speaker_id, split FROM assigned",
        "split_counts": f"""WITH {DOCSPLIT} SELECT split, count(*) AS samples, count(DISTINCT speaker_id) AS speakers
            FROM assigned GROUP BY 1""",
        "split_leaks": f"""WITH {DOCSPLIT}, k AS (SELECT text_key AS leaked, split, 'text' AS kind FROM assigned UNION ALL
              SELECT speaker_id, split, 'speaker' FROM assigned)
            SELECT leaked, min(split) AS first_split, max(split) AS last_split, kind FROM k GROUP BY leaked, kind
            HAVING count(DISTINCT split) > 1""",
        "split_documents": f"""WITH {DOCSPLIT} SELECT split, to_json({{'split': split, 'speaker_id': speaker_id,
            'samples': count(*)}})::VARCHAR AS document FROM assigned GROUP BY split, speaker_id""",
        "first_existing_path": """SELECT d.doc_id AS sample_id, CASE WHEN toxic = 1 THEN 'alignment' WHEN quality = 1
            THEN 'align' END AS folder, CASE WHEN toxic = 1 THEN 'alignment/' || d.doc_id || '.align' WHEN quality = 1
            THEN 'align/' || d.doc_id || '.align' END AS path FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "inventory_reconciliation": """WITH o AS (SELECT l_partkey AS name, max(l_quantity)::INTEGER AS shape
              FROM lineitem GROUP BY 1)
            SELECT coalesce(p.p_partkey, o.name) AS name, p.p_size AS current_shape, o.shape AS offered_shape,
              CASE WHEN o.name IS NULL THEN 'missing' WHEN p.p_partkey IS NULL THEN 'unexpected'
              WHEN p.p_size = o.shape THEN 'loaded' ELSE 'skipped_shape' END AS status
            FROM part p FULL JOIN o ON p.p_partkey = o.name""",
        "inventory_differences": """WITH o AS (SELECT l_partkey AS name, max(l_quantity)::INTEGER AS shape
              FROM lineitem GROUP BY 1),
            d AS (SELECT DISTINCT coalesce(p.p_partkey, o.name)::VARCHAR AS name FROM part p
              FULL JOIN o ON p.p_partkey = o.name WHERE p.p_size IS DISTINCT FROM o.shape),
            a AS (SELECT unnest(['1', '2', '3', 'no_such_part']) AS name)
            SELECT name, 'not_allowed' AS problem FROM d WHERE name NOT IN (SELECT name FROM a) UNION ALL
            SELECT name, 'not_differing' FROM a WHERE name NOT IN (SELECT name FROM d)""",
        "resume_states": """WITH j AS (SELECT d.doc_id, d.source, CASE WHEN quality * 40 + toxic * 5 > 0
              THEN quality * 40 + toxic * 5 END AS f, toxic = 1 AS logged, quality FROM documents d
              LEFT JOIN labels USING (doc_id))
            SELECT doc_id AS sample_id, source AS speaker_id, CASE WHEN f IS NULL THEN 'todo' WHEN logged THEN 'carried'
              ELSE 'rebuilt' END AS state, CASE WHEN f IS NULL THEN NULL WHEN logged THEN 60 ELSE f END AS decoded_frames,
              CASE WHEN f IS NULL THEN NULL WHEN logged THEN 45 + quality ELSE f END AS landmark_frames,
              (CASE WHEN f IS NULL THEN NULL WHEN logged THEN 15 - quality ELSE 0 END)::BIGINT AS dropped_frames
            FROM j""",
        "work_left": """SELECT doc_id AS sample_id, source AS speaker_id, n_chars AS num_frames FROM documents WHERE doc_id
            NOT IN (SELECT doc_id FROM labels WHERE quality * 40 + toxic * 5 > 0)""",
        "reusable_evaluations": """WITH c AS (SELECT DISTINCT sha256(text) AS s FROM documents JOIN labels USING (doc_id)
              WHERE quality = 1)
            SELECT doc_id, CASE WHEN sha256(text) IN (SELECT s FROM c) THEN 'reuse' ELSE 'evaluate' END AS action
            FROM documents""",
        "file_list": f"""WITH u AS (SELECT page_id, trim(url) AS path, string_split(trim(url), '/') AS p FROM pages
              WHERE trim(url) <> '')
            SELECT page_id, path, CASE WHEN len(p) >= 4 THEN p[-4] END AS speaker_id,
              CASE WHEN len(p) >= 4 THEN p[-1] END AS name, CASE WHEN len(p) < 4 THEN 'path_too_short' END AS error
            FROM u""",
        "content_fingerprints": """SELECT lang || '/' || source || '/' || doc_id AS relative_path,
            strlen(text)::INTEGER AS bytes, sha256(text) AS sha256 FROM documents""",
        "selected_paths": """SELECT '/' || source || '/alignment/' || doc_id || '.align' AS path FROM documents
            WHERE n_chars > 1500 AND lang IN ('en', 'de')""",
        "frame_folders": r"""WITH n AS (SELECT split_part(url, '/', 3) AS folder, regexp_replace(regexp_replace(
              string_split(url, '/')[-1], '[?#].*$', ''), '\.[^.]*$', '') AS stem FROM pages)
            SELECT folder, count(try_cast(stem AS BIGINT)) AS frames,
              count(*) - count(try_cast(stem AS BIGINT)) AS bad_names FROM n GROUP BY 1""",
        "listed_files": """WITH f AS (SELECT 'spk' || source AS folder, * FROM documents UNION ALL
              SELECT 'spk~', * FROM documents WHERE doc_id % 10 = 0)
            SELECT folder || '/ser/video_a/' || doc_id || '.mp4' AS relative_path,
              CASE WHEN n_chars % 3 <> 0 THEN strlen(text) ELSE 0 END AS bytes FROM f""",
        "discovered_files": """SELECT doc_id::VARCHAR AS sample_id, 'spk' || source AS speaker_id,
            'spk' || source || '/ser/video_a/' || doc_id || '.mp4' AS path,
            (CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS copies FROM documents""",
        "file_inventory": """WITH f AS (SELECT 'spk' || source AS folder, * FROM documents UNION ALL
              SELECT 'spk~', * FROM documents WHERE doc_id % 10 = 0),
            c AS (SELECT folder, doc_id, CASE WHEN n_chars % 3 <> 0 THEN text ELSE '' END AS content FROM f)
            SELECT folder || '/ser/video_a/' || doc_id || '.mp4' AS relative_path, strlen(content) AS bytes,
              sha256(content) AS sha256 FROM c""",
        "folder_disagreements": """SELECT l.doc_id AS sample_id, d.source AS media_speaker,
              'src' || (l.doc_id + l.toxic) % 20 AS annotation_speaker
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.source <> 'src' || (l.doc_id + l.toxic) % 20""",
        "vocabulary_documents": f"""WITH c AS (SELECT DISTINCT lang, unnest({_chars("lower(text)")}) AS symbol FROM documents),
            s AS (SELECT lang, list(symbol ORDER BY symbol) AS symbols FROM c GROUP BY 1)
            SELECT lang, '{K.BLANK_SYMBOL}' AS blank, len(symbols)::INTEGER AS n_symbols, array_to_string(symbols, '') AS symbols,
              list_position(symbols, 'e')::INTEGER AS id_of_e, list_position(symbols, '0')::INTEGER AS id_of_zero FROM s""",
        "block_index": """WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) AS position FROM documents)
            SELECT (position - 1) // 100 AS block_id, min(position) AS first_position, max(position) AS last_position,
              count(*) AS rows FROM p GROUP BY 1""",
        "stitched_history": """WITH e AS (SELECT conv_id::VARCHAR AS run_id, turn, role, length(text)::DOUBLE AS size,
              max(turn) FILTER (turn < 2) OVER (PARTITION BY conv_id) AS last FROM conversations)
            SELECT run_id, (CASE WHEN turn < 2 THEN turn ELSE turn - 2 + coalesce(last + 1, 0) END)::INTEGER AS epoch,
              CASE WHEN turn < 2 THEN 'first' ELSE 'second' END AS stage, size AS train_loss,
              (size + 1) / 2 AS validation_wer, (size + 1) / 4 AS validation_cer,
              round(1e0 / (turn + 1), 9) AS head_rate, length(role)::DOUBLE AS role_rate FROM e""",
        "box_roundtrip": f"""WITH {FALLBACK} SELECT clip_id AS sample_id, {FOUR}, valid_detections::INTEGER AS valid_detections,
            sampled_frames::INTEGER AS sampled_frames, source FROM placed""",
        "block_summary": """WITH p AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS position FROM documents)
            SELECT (position - 1) // 100 AS block_id, min(position) AS first_position, max(position) AS last_position,
              count(*) FILTER (n_chars >= 1000) AS results, count(*) FILTER (n_chars < 1000) AS failures
            FROM p GROUP BY 1""",
        "restored_blocks": """SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) AS position,
            (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS block_id FROM documents""",
        "manifest_roundtrip": f"""WITH {CLIPS}, listed AS (SELECT *, {_chars("transcript")} AS c FROM clips)
            SELECT sample_id, speaker_id, speaker_id || '/' || sample_id || '.mp4' AS video_path,
              speaker_id || '/' || sample_id || '.align' AS alignment_path, transcript,
              round_even(num_frames / 25e0 * 1e6, 0) / 1e6 AS duration_s, num_frames::INTEGER AS num_frames,
              25e0 AS fps, 128 AS width, 64 AS height, len(c)::INTEGER AS target_length,
              (len(c) + {_repeats("c")})::INTEGER AS min_ctc_frames FROM listed""",
        "results_log": """WITH e AS (SELECT *, event_id % 2 = 0 AS late,
              CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END AS position FROM events)
            SELECT user_id::VARCHAR AS sample_id, event_type AS speaker, 'v' AS video, 'o' AS output,
              event_id AS decoded_frames, event_id AS landmark_frames, 0::BIGINT AS dropped_frames
            FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY late DESC, position DESC) = 1""",
        "incremental_intake": """SELECT event_id, user_id, event_type, value,
            CASE WHEN event_type <> 'error' AND value > 10 THEN 'result' ELSE 'failure' END AS status FROM events""",
        "frame_boxes": f"WITH {BOXES} SELECT clip_id, speaker_id, picture, points, {FOUR} FROM boxes",
        "clip_boxes": f"""WITH {BOXES} SELECT clip_id, speaker_id, valid_detections, sampled_frames, {FOUR}
            FROM clip_boxes""",
        "speaker_medians": f"""WITH {BOXES}, m AS (SELECT speaker_id, CASE grouping(speaker_id) WHEN 1 THEN 'overall' ELSE 'speaker' END AS scope, {MEDIANS}
            FROM clip_boxes WHERE x1 IS NOT NULL GROUP BY GROUPING SETS ((speaker_id), ()))
            SELECT speaker_id, scope, {FOUR} FROM m""",
        "fallback_boxes": f"""WITH {FALLBACK} SELECT clip_id, speaker_id, valid_detections, sampled_frames, {FOUR}, source
            FROM placed""",
        "fallback_counts": f"WITH {FALLBACK} SELECT source, count(*) AS clips FROM placed GROUP BY 1",
        "heavy_medians": f"""WITH {FRAMES} SELECT clip, round(median(x), 10) + 0.0 AS x, round(median(y), 10) + 0.0 AS y
            FROM frames WHERE x IS NOT NULL GROUP BY 1""",
        "pixel_boxes": f"""WITH {BOXES} SELECT clip_id, trunc(x1 * 1280)::INTEGER AS px1, trunc(y1 * 720)::INTEGER AS py1,
            trunc(x2 * 1280)::INTEGER AS px2, trunc(y2 * 720)::INTEGER AS py2 FROM clip_boxes WHERE x1 IS NOT NULL""",
        "sampling_positions": f"""SELECT doc_id, concat_ws(',', {', '.join(_positions('n_chars', 5))}) AS sampled,
            concat_ws(',', 0, trunc((n_chars - 1) / 2)::BIGINT, n_chars - 1) AS spread,
            round(least(1, 1024 / greatest(n_chars, 720)), 9) AS scale FROM documents""",
        "sampled_frames": f"""WITH c AS (SELECT l_orderkey, max(l_linenumber)::BIGINT + 1 AS n FROM lineitem GROUP BY 1),
            w AS (SELECT DISTINCT l_orderkey, unnest([{', '.join(_positions('n', 3))}]) AS frame FROM c)
            SELECT l.l_orderkey AS clip, l_linenumber::BIGINT AS frame, l_partkey FROM lineitem l
            JOIN w ON l.l_orderkey = w.l_orderkey AND l.l_linenumber = w.frame""",
        "quality_sample": """WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1),
            n AS (SELECT greatest(30 - count(*), 0) AS room FROM f),
            r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents
              WHERE doc_id NOT IN (SELECT doc_id FROM f)),
            c AS (SELECT doc_id, 'first' AS role FROM f UNION ALL SELECT doc_id, 'longest' FROM r, n WHERE k <= room)
            SELECT c.doc_id AS sample_id, d.source AS speaker_id, d.n_chars AS num_frames, role, quality
            FROM c JOIN documents d USING (doc_id) LEFT JOIN labels l ON l.doc_id = c.doc_id""",
        "processing_summary": f"""WITH {FRAMES} SELECT clip, count(*) AS decoded_frames, count(x) AS landmark_frames,
            count(*) - count(x) AS dropped_frames FROM frames GROUP BY 1""",
        "review_clips": f"""WITH {FRAMES}, s AS (SELECT clip, concat_ws('_', clip, moment // {DAY}) AS sample_id,
              count(*) AS decoded_frames, count(x) AS landmark_frames, count(*) - count(x) AS dropped_frames
              FROM frames GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY sample_id) AS a,
              row_number() OVER (PARTITION BY clip ORDER BY dropped_frames DESC, sample_id DESC) AS b FROM s)
            SELECT CASE WHEN a = 1 THEN 'first' ELSE 'worst' END AS role, clip, sample_id, decoded_frames,
              landmark_frames, dropped_frames FROM r WHERE a = 1 OR b = 1""",
        "gap_fill": f"""WITH {FRAMES}, n AS (SELECT clip, frame, x, y,
              last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS bf,
              last_value(x IGNORE NULLS) OVER b AS bx, last_value(y IGNORE NULLS) OVER b AS by_,
              first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS af,
              first_value(x IGNORE NULLS) OVER a AS ax, first_value(y IGNORE NULLS) OVER a AS ay FROM frames
              WINDOW b AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     a AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
            SELECT clip, frame, x, y, CASE WHEN x IS NOT NULL THEN x WHEN bf IS NULL THEN ax WHEN af IS NULL THEN bx
              ELSE bx + (frame - bf) / (af - bf) * (ax - bx) END AS x_filled, CASE WHEN y IS NOT NULL THEN y
              WHEN bf IS NULL THEN ay WHEN af IS NULL THEN by_ ELSE by_ + (frame - bf) / (af - bf) * (ay - by_) END
              AS y_filled FROM n""",
        "renumbered_frames": f"""WITH {FRAMES}, k AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip
            ORDER BY frame) AS frame_no FROM frames WHERE x IS NOT NULL)
            SELECT clip, frame, frame_no, lpad(frame_no::VARCHAR, 6, '0') AS stem FROM k""",
        "point_extents": f"""WITH {POINTS} SELECT sample_id, count(*) AS points, {', '.join(
            f'round({f}({c}), 6) + 0.0 AS {c}_{n}' for c in 'xy'
            for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))} FROM points GROUP BY 1""",
        "similarity_fit": f"""WITH {FIT} SELECT sample_id, points, {', '.join(
            f'round({c}, 4) + 0.0 AS {c}' for c in ('m00', 'm01', 'm10', 'm11', 'tx', 'ty'))} FROM fitted""",
        "crop_windows": f"""WITH {FIT}, c AS (SELECT sample_id, trunc(avg(m00 * x + m01 * y + tx))::INTEGER AS cx,
              trunc(avg(m10 * x + m11 * y + ty))::INTEGER AS cy FROM points JOIN fitted USING (sample_id)
              WHERE point >= 12 GROUP BY 1)
            SELECT sample_id, cx, cy, cx - 80 AS "left", cx + 80 AS "right", cy - 40 AS top, cy + 40 AS bottom,
              cx - 80 >= 0 AND cy - 40 >= 0 AND cx + 80 <= 256 AND cy + 40 <= 256 AS inside FROM c""",
        "mirrored_pixels": """WITH m AS (SELECT vec_id, embedding AS e, ('0x' || md5(concat_ws('|', '42', vec_id))[1:8])::BIGINT
              / 4294967296.0e0 > 0.5e0 AS mirrored, unnest(range(0, 64)) AS i FROM embeddings)
            SELECT vec_id, mirrored, i::INTEGER AS i, round(e[CASE WHEN mirrored THEN i // 8 * 8 + 8 - i % 8
              ELSE i + 1 END]::DOUBLE / 255, 9) AS v FROM m""",
        "detector_frames": """WITH p AS (SELECT vec_id, embedding AS e, unnest(range(0, 16)) AS point FROM embeddings
              WHERE embedding[1] >= 0)
            SELECT vec_id, point::INTEGER AS point, round(e[2 * point + 1]::DOUBLE, 6) + 0.0 AS x,
              round(e[2 * point + 2]::DOUBLE, 6) + 0.0 AS y FROM p""",
        "argmax_steps": f"WITH {TOKENS} SELECT sample_id, t, token FROM tokens",
        "log_softmax": f"""WITH {LOGITS}, c AS (SELECT sample_id, t, list_max(scores)::DOUBLE AS m, scores,
              unnest(range(0, 8)) AS class FROM logits)
            SELECT sample_id, t, class::INTEGER AS class, round(scores[class + 1]::DOUBLE - (m + ln(list_sum(
              list_transform(scores, lambda s: exp(s::DOUBLE - m))))), 6) AS lp FROM c""",
        "greedy_decode": f"WITH {GREEDY}",
        "greedy_decode_by_steps": f"WITH {GREEDY}",
        "scored_clips": """WITH s AS (SELECT vec_id, least(8, 5 + label)::INTEGER AS length, embedding AS e,
              unnest(range(0, 8)) AS t FROM embeddings)
            SELECT vec_id, length, t::INTEGER AS t, (list_position(e[t * 8 + 1 : t * 8 + 8],
              list_max(e[t * 8 + 1 : t * 8 + 8])) - 1)::INTEGER AS token FROM s""",
        "ngram_counts": f"""WITH {_counts(K.LM_ORDER)} SELECT "order", ngram, count FROM counts""",
        "kneser_ney_model": f"""WITH {_model(K.LM_ORDER)} SELECT "order", ngram, round(log10_prob, 8) + 0.0 AS log10_prob,
            round(log10_backoff, 8) + 0.0 AS log10_backoff FROM model""",
        "beam_candidates": f"WITH {_beam(K.LM_ORDER, B.LOGIT_LETTERS, 100, 0.5, 0.5)}",
        "sentence_scores": f"WITH {_score_sentences(K.LM_ORDER)}",
        "words_per_sentence": f"""WITH {DIALOGUE} SELECT len({_micro("reference")})::INTEGER AS n_words,
            count(*) AS sentences FROM dialogue GROUP BY 1""",
        "words_by_position": f"""WITH {DIALOGUE}, l AS (SELECT {_micro("reference")} AS w FROM dialogue),
            p AS (SELECT w, unnest(range(1, len(w) + 1)) AS position FROM l)
            SELECT position::INTEGER AS position, w[position] AS word, count(*) AS occurrences FROM p GROUP BY 1, 2""",
        "position_sizes": f"""WITH {DIALOGUE}, l AS (SELECT {_micro("reference")} AS w FROM dialogue),
            p AS (SELECT w, unnest(range(1, len(w) + 1)) AS position FROM l)
            SELECT position::INTEGER AS position, count(DISTINCT w[position]) AS distinct_words, count(*) AS words
            FROM p GROUP BY 1""",
        "best_per_text": f"""WITH {NBEST} SELECT sample_id, alpha, text, round(am_score, 6) + 0.0 AS am_score,
            round(lm_score, 6) + 0.0 AS lm_score, round(base_score, 6) + 0.0 AS base_score,
            word_count::INTEGER AS word_count FROM best""",
        "selected_candidates": f"WITH {CHOSEN} SELECT sample_id, alpha, beta, prediction FROM chosen",
        "grid_rates": f"WITH {GRID} SELECT alpha, beta, wer, cer FROM rates",
        "grid_ranking": f"WITH {GRID} SELECT alpha, beta, wer, cer FROM rates ORDER BY wer, cer, alpha, beta LIMIT 10",
        "early_stopping": """WITH h AS (SELECT conv_id AS run_id, turn AS epoch, length(text) / 1000 AS wer
              FROM conversations),
            p AS (SELECT *, min(wer) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING) AS pb FROM h),
            i AS (SELECT *, pb IS NULL OR wer < pb AS improved FROM p),
            b AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS best_epoch
              FROM i),
            c AS (SELECT *, greatest(epoch - greatest(best_epoch, 0), 0) AS without_improvement FROM b),
            s AS (SELECT *, epoch >= 1 AND without_improvement >= 2 AS stops FROM c)
            SELECT run_id, epoch, wer, improved, best_epoch, least(pb, wer) AS best_so_far, without_improvement, stops
            FROM s QUALIFY coalesce(epoch <= min(CASE WHEN stops THEN epoch END) OVER (PARTITION BY run_id), true)""",
        "best_epochs": """WITH b AS (SELECT conv_id AS run_id, turn AS best_epoch, length(text) / 1000 AS w
              FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) = 1)
            SELECT run_id, best_epoch, round(w, 9) + 0.0 AS best_wer, round(1.0e0 - w, 9) + 0.0 AS absolute_gain,
              round((1.0e0 - w) / 1.0e0, 9) + 0.0 AS relative_gain FROM b""",
        "epoch_batches": """WITH e AS (SELECT o_orderkey, unnest([0, 1]) AS epoch FROM orders),
            n AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws('|', 'epoch', epoch + 42,
              o_orderkey)), o_orderkey) AS position FROM e)
            SELECT o_orderkey, epoch, position, (position - 1) // 2 AS batch_id FROM n""",
        "ordered_batches": """WITH e AS (SELECT c_name, unnest([0, 1]) AS epoch FROM customer),
            n AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY c_name) AS position FROM e)
            SELECT c_name, epoch, position, (position - 1) // 3 AS batch_id FROM n""",
        "batch_lengths": f"""WITH {SEQUENCES} SELECT batch_id, max(len(seq))::INTEGER AS max_length FROM batched
            GROUP BY 1""",
        "padded_batches": f"""WITH {SEQUENCES}, m AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch_id) AS n FROM batched)
            SELECT l_orderkey, batch_id, len(seq)::INTEGER AS true_length, n::INTEGER AS padded_length,
              array_to_string(list_concat(seq, list_transform(range(0, n - len(seq)), lambda i: 0)), ',') AS padded
            FROM m""",
        "padded_to_length": f"""WITH {SEQUENCES} SELECT l_orderkey, len(seq) > 5 AS too_long, CASE WHEN len(seq) <= 5 THEN
            array_to_string(list_concat(seq, list_transform(range(0, 5 - len(seq)), lambda i: 0)), ',') END AS padded
            FROM batched""",
        "numeric_order": """SELECT replace(c_name, 'Customer#', '') AS stem,
            try_cast(replace(c_name, 'Customer#', '') AS BIGINT) AS number FROM customer""",
        "first_examples": f"""WITH {PAIRS} SELECT sample_id, prediction, reference FROM pairs ORDER BY sample_id
            LIMIT 10""",
    }
    # The documents hold the rows of these.
    sql["audit_documents"], sql["quality_documents"] = sql["feasibility_report"], sql["quality_sample"]
    return sql
