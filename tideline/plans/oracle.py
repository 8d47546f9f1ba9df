"""The same queries as SQL over the same tables, for checking results."""

from __future__ import annotations

from tideline.functions.text import stopwords
from tideline.operators import classify
from tideline.plans import samples
from tideline.plans.catalog import LANGUAGES, SEGMENTS, STARS, VOTE_LANGUAGES


def _list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def _r(x: str, n: int) -> str:
    return f"(round_even(({x}) * 1e{n}, 0) / 1e{n})"


def _pct(new: str, old: str) -> str:
    change = _r(f"(CAST({new} AS DOUBLE) - {old}) / abs(CAST({old} AS DOUBLE)) * 100.0", 2)
    return f"CASE WHEN {old} = 0 THEN NULL ELSE {change} END"


def _share(part: str, whole: str) -> str:
    return _r(f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100.0", 2)


WINDOW = """CASE WHEN {d} IS NULL THEN 'unknown'
  WHEN {d} BETWEEN DATE '1998-04-01' AND DATE '1998-05-20' THEN 'pre'
  WHEN {d} BETWEEN DATE '1998-05-21' AND DATE '1998-05-24' THEN 'during'
  WHEN {d} BETWEEN DATE '1998-05-25' AND DATE '1998-06-15' THEN 'post'
  WHEN {d} BETWEEN DATE '1997-04-01' AND DATE '1997-05-20' THEN 'baseline_pre'
  WHEN {d} BETWEEN DATE '1997-05-21' AND DATE '1997-05-24' THEN 'baseline_during'
  WHEN {d} BETWEEN DATE '1997-05-25' AND DATE '1997-06-15' THEN 'baseline_post'
  ELSE 'outside' END"""

OBS = f"""obs0 AS (
  SELECT o_orderkey AS review_id, lower(trim(r_name)) AS city,
    CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED') THEN CAST(o_orderdate AS DATE) END AS review_date,
    o_totalprice AS rating, CAST(left(o_orderpriority, 1) AS INTEGER) AS topic,
    lower(c_mktsegment) AS emotion_label, o_orderstatus AS stay_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
obs AS (
  SELECT *, CASE WHEN topic <= 2 THEN 'negative' WHEN topic = 3 THEN 'neutral' ELSE 'positive' END AS sentiment_label,
    (topic - 3) * 0.5::DOUBLE AS sentiment_score, {WINDOW.format(d='review_date')} AS temporal_window
  FROM obs0)"""

PAIRS = "pairs(window_event, window_baseline) AS (VALUES ('pre', 'baseline_pre'), ('during', 'baseline_during'), ('post', 'baseline_post'))"
EVENT = "('pre', 'during', 'post')"
PAIRED = "('pre', 'during', 'post', 'baseline_pre', 'baseline_during', 'baseline_post')"
PLACE = "replace(temporal_window, 'baseline_', '') AS \"window\", CASE WHEN temporal_window LIKE 'baseline%' THEN '1997' ELSE '1998' END AS year"

TEXTS = """texts AS (
  SELECT doc_id AS review_id, lang, source, text AS text_positive,
    CASE WHEN lang = 'de' THEN '---' WHEN lang <> 'es' THEN text END AS text_negative FROM documents)"""
CLEAN = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
SPACE = r"\s\p{Z}"


def _tokens(column: str) -> str:
    return f"list_filter(string_split({CLEAN.format(c=column)}, ' '), lambda t: t <> '')"


def _word_tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _vote(words: str, least: int = 1) -> str:
    hits = [
        f"len(list_filter(list_distinct({words}), lambda t: t IN {_list([w for w in stopwords(name) if len(w) >= least])}))"
        for name in VOTE_LANGUAGES.values()
    ]
    codes = list(VOTE_LANGUAGES)
    best = f"greatest({', '.join(hits)})"
    cases = " ".join(f"WHEN {h} = {best} THEN '{c}'" for c, h in zip(codes, hits))
    return f"CASE {cases} END"


def _voted() -> str:
    return f"""{TEXTS},
worded AS (SELECT *, {_tokens('text_positive')} AS words FROM texts),
voted AS (SELECT *, {_vote('words')} AS predicted, {_vote('words', 3)} AS predicted_long FROM worded)"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


WORDS = f"{TEXTS}, docs AS (SELECT *, {_word_tokens('text_positive')} AS words FROM texts)"


def _lexicon(words: str) -> str:
    weight = " ".join(f"WHEN t = '{w}' THEN {v}::DOUBLE" for w, v in samples.LEXICON.items())
    found = f"list_filter(list_transform({words}, lambda t: CASE {weight} END), lambda w: w IS NOT NULL)"
    return f"coalesce(list_avg({found}), 0.0::DOUBLE)"


POLAR = "CASE WHEN p > 0.05 THEN 'positive' WHEN p < -0.05 THEN 'negative' ELSE 'neutral' END"


def _emotion_counts(words: str, language: str) -> str:
    out = []
    for code, lists in samples.EMOTIONS.items():
        counts = ", ".join(
            f"len(list_filter({words}, lambda t: t IN {_list(members)}))" for members in lists.values()
        )
        out.append(f"WHEN {language} = '{code}' THEN [{counts}]")
    return "CASE " + " ".join(out) + " ELSE [0, 0, 0, 0] END"


EMOTION_NAMES = "['joy', 'anger', 'fear', 'sadness']"

SHARES_WINDOW = f"""counts AS (
  SELECT {PLACE}, topic, count(*) AS "count" FROM obs WHERE temporal_window IN {PAIRED} AND topic IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, {_share('"count"', 'sum("count") OVER (PARTITION BY "window", year)')} AS pct FROM counts)"""
SHARES_GROUP = f"""counts_g AS (
  SELECT city, topic, count(*) AS "count" FROM obs WHERE temporal_window IN {EVENT} AND city IN ('europe', 'asia') GROUP BY ALL),
shares_g AS (SELECT *, {_share('"count"', 'sum("count") OVER (PARTITION BY city)')} AS pct FROM counts_g)"""

VOLUME = f"""volume AS (
  SELECT city, window_event, window_baseline, reviews_event, reviews_baseline,
    {_pct('reviews_event', 'reviews_baseline')} AS pct_change
  FROM (SELECT city, window_event, window_baseline,
      count(*) FILTER (temporal_window = window_event) AS reviews_event,
      count(*) FILTER (temporal_window = window_baseline) AS reviews_baseline
    FROM obs, pairs GROUP BY ALL))"""

CHANGE = f"""cells AS (
  SELECT city, temporal_window, count(*) AS n, {_r('avg(sentiment_score)', 4)} AS mean,
    {_share("count(*) FILTER (sentiment_label = 'positive')", 'count(*)')} AS pos,
    {_share("count(*) FILTER (sentiment_label = 'negative')", 'count(*)')} AS neg
  FROM obs GROUP BY ALL),
change AS (
  SELECT g.city, p.window_event AS "window", e.n AS review_count_event, e.mean AS mean_sentiment_event,
    e.pos AS pct_positive_event, e.neg AS pct_negative_event, b.n AS review_count_baseline,
    b.mean AS mean_sentiment_baseline, b.pos AS pct_positive_baseline, b.neg AS pct_negative_baseline,
    {_pct('coalesce(e.mean, 0)', 'coalesce(b.mean, 0)')} AS pct_change_mean_sentiment,
    {_pct('coalesce(e.pos, 0)', 'coalesce(b.pos, 0)')} AS pct_change_positive,
    {_pct('coalesce(e.neg, 0)', 'coalesce(b.neg, 0)')} AS pct_change_negative
  FROM (SELECT DISTINCT city FROM obs) g CROSS JOIN pairs p
    LEFT JOIN cells e ON e.city = g.city AND e.temporal_window = p.window_event
    LEFT JOIN cells b ON b.city = g.city AND b.temporal_window = p.window_baseline)"""

PLACES = f"""sides AS (
  SELECT temporal_window, city, count(*) AS review_count, {_r('avg(sentiment_score)', 4)} AS mean_sentiment,
    {_share("count(*) FILTER (sentiment_label = 'positive')", 'count(*)')} AS pct_positive,
    {_share("count(*) FILTER (sentiment_label = 'negative')", 'count(*)')} AS pct_negative,
    {_share("count(*) FILTER (sentiment_label = 'neutral')", 'count(*)')} AS pct_neutral
  FROM obs WHERE city IN ('europe', 'asia') AND temporal_window IN {EVENT} GROUP BY ALL),
diffs AS (
  SELECT t.temporal_window, {_r('t.mean_sentiment - c.mean_sentiment', 4)} AS diff_mean_sentiment,
    {_pct('t.pct_positive', 'c.pct_positive')} AS diff_pct_positive,
    {_pct('t.pct_negative', 'c.pct_negative')} AS diff_pct_negative
  FROM sides t JOIN sides c ON t.temporal_window = c.temporal_window AND t.city = 'europe' AND c.city = 'asia'),
places AS (SELECT s.*, diff_mean_sentiment, diff_pct_positive, diff_pct_negative FROM sides s LEFT JOIN diffs USING (temporal_window))"""


def _long(section: str, source: str, group: str, window: str, measures: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {group} AS group_name, {window} AS window_name, '{m}' AS measure, CAST({v} AS DOUBLE) AS value FROM {source}"
        for m, v in measures.items()
    )


CHANGE_MEASURES = [
    "review_count_event", "mean_sentiment_event", "pct_positive_event", "pct_negative_event",
    "review_count_baseline", "mean_sentiment_baseline", "pct_positive_baseline", "pct_negative_baseline",
    "pct_change_mean_sentiment", "pct_change_positive", "pct_change_negative",
]
PLACE_MEASURES = [
    "review_count", "mean_sentiment", "pct_positive", "pct_negative", "pct_neutral",
    "diff_mean_sentiment", "diff_pct_positive", "diff_pct_negative",
]


def _emotion_columns(extra: str = "") -> str:
    return ", ".join(f"count(*) FILTER (emotion_label = '{s}'{extra}) AS emotion_{s}" for s in SEGMENTS)


def _report(predicted: str) -> str:
    names = ", ".join(f"('{x}')" for x in LANGUAGES)
    return f"""figures AS (
  SELECT label, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2.0 * hits / nullif(claimed + support, 0), 0) AS f1, support
  FROM (SELECT label, count(*) FILTER (lang = label) AS support, count(*) FILTER ({predicted} = label) AS claimed,
      count(*) FILTER (lang = label AND {predicted} = label) AS hits
    FROM voted, (VALUES {names}) AS names(label) GROUP BY label)),
report AS (
  SELECT label, precision, recall, f1, support FROM figures
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM figures
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM figures
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg((lang = {predicted})::INT) AS a, count(*) AS n FROM voted))"""


def _summary(name: str, predicted: str) -> str:
    return f"""SELECT '{name}' AS model, CAST(max(support) FILTER (label = 'accuracy') AS BIGINT) AS n_samples,
  {_r("max(f1) FILTER (label = 'accuracy')", 4)} AS accuracy, {_r("max(f1) FILTER (label = 'macro avg')", 4)} AS macro_f1,
  {_r("max(f1) FILTER (label = 'weighted avg')", 4)} AS weighted_f1
  FROM (WITH {_report(predicted)} SELECT * FROM report)"""


def _natural(extra: str) -> str:
    return f"""WITH {TEXTS}, r AS (SELECT * FROM texts) {extra}"""


def _letters() -> str:
    """CTEs up to ``letters``: the language of every document by groups of three letters."""
    each = lambda f: ", ".join(f(x) for x in LANGUAGES)
    best = f"greatest({each(lambda x: f's_{x}')})"
    return f"""{WORDS},
counted AS (SELECT review_id, lang, w, count(*) AS n FROM (SELECT review_id, lang, unnest(words) AS w FROM docs) GROUP BY ALL),
grams AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))) AS f
  FROM (SELECT DISTINCT w FROM counted)),
wide AS (SELECT f, {each(lambda x: f"coalesce(sum(n) FILTER (lang = '{x}'), 0) AS {x}")}
  FROM counted JOIN grams USING (w) WHERE review_id % 5 <> 0 AND lang IN {_list(LANGUAGES)} GROUP BY f),
total AS (SELECT {each(lambda x: f'sum({x}) AS t_{x}')}, count(*) AS v FROM wide),
logs AS (SELECT f, {each(lambda x: f'ln(CAST({x} + 1 AS DOUBLE) / CAST(t_{x} + v AS DOUBLE)) AS l_{x}')} FROM wide, total),
spelled AS (SELECT w, {each(lambda x: f'sum(l_{x}) AS w_{x}')} FROM grams JOIN logs USING (f) GROUP BY w),
sums AS (SELECT review_id, {each(lambda x: f'sum(n * w_{x}) AS s_{x}')} FROM counted JOIN spelled USING (w) GROUP BY review_id),
letters AS (SELECT review_id, CASE {' '.join(f"WHEN s_{x} = {best} THEN '{x}'" for x in LANGUAGES)} END AS language,
  {_r(f"1.0 / ({' + '.join(f'exp(s_{x} - {best})' for x in LANGUAGES)})", 4)} AS language_score
  FROM docs LEFT JOIN sums USING (review_id))"""


JUDGED = f"""{WORDS}, judged AS (SELECT docs.*, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS truth
  FROM docs LEFT JOIN labels ON doc_id = review_id)"""


def _induced() -> str:
    """CTEs up to ``lexicon``."""
    odds = lambda n, t: f"ln(({n} + a) / ({t} + 0.1::DOUBLE * (tp + tq) - {n} - a))"
    z = f"({odds('p', 'tp')} - {odds('q', 'tq')}) / sqrt(1 / (p + a) + 1 / (q + a))"
    return f"""{JUDGED},
c AS (SELECT word, CAST(count(*) FILTER (truth = 'positive') AS DOUBLE) AS p, CAST(count(*) FILTER (truth = 'negative') AS DOUBLE) AS q
  FROM (SELECT truth, unnest(words) AS word FROM judged WHERE truth IS NOT NULL AND review_id % 5 <> 0) GROUP BY word),
weighed AS (SELECT word, p, q, 0.1::DOUBLE * (p + q) AS a, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM c),
lexicon AS (SELECT word, {_r('z / (1 + abs(z))', 6)} AS weight, z FROM (SELECT word, {_r(z, 6)} AS z FROM weighed) WHERE abs(z) >= 1.96)"""


def _bayes() -> str:
    """CTEs up to ``fitted``: naive Bayes over words, a model a language."""
    kinds = ("negative", "positive")
    each = lambda f: ", ".join(f(x) for x in kinds)
    return f"""{JUDGED},
teach AS (SELECT * FROM judged WHERE truth IS NOT NULL AND review_id % 5 <> 0),
wide AS (SELECT lang, w, {each(lambda x: f"CAST(count(*) FILTER (truth = '{x}') AS DOUBLE) AS {x}")}
  FROM (SELECT lang, truth, unnest(words) AS w FROM teach) GROUP BY ALL),
total AS (SELECT lang, {each(lambda x: f'sum({x}) AS t_{x}')}, count(*) AS v FROM wide GROUP BY lang),
logs AS (SELECT lang, w, {each(lambda x: f'ln(({x} + 1) / (t_{x} + v)) AS l_{x}')} FROM wide JOIN total USING (lang)),
sums AS (SELECT review_id, {each(lambda x: f'sum(l_{x}) AS s_{x}')}
  FROM (SELECT review_id, lang, unnest(words) AS w FROM judged) JOIN logs USING (lang, w) GROUP BY review_id),
prior AS (SELECT lang, {each(lambda x: f"ln((count(*) FILTER (truth = '{x}') + 1) / CAST(count(*) + 2 AS DOUBLE)) AS p_{x}")} FROM teach GROUP BY lang),
both_sums AS (SELECT judged.*, coalesce(s_negative, 0) + p_negative AS a, coalesce(s_positive, 0) + p_positive AS b
  FROM judged LEFT JOIN prior USING (lang) LEFT JOIN sums USING (review_id)),
fitted AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN a >= b THEN 'negative' ELSE 'positive' END AS predicted,
  {_r('1.0 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))', 4)} AS probability FROM both_sums)"""


RULES = f"""{WORDS}, forms AS (SELECT form, count(*) AS tf FROM (SELECT unnest(words) AS form FROM docs) GROUP BY form),
changes AS (SELECT f.form, k AS cut FROM forms f, (VALUES (1), (2)) ks(k), forms l
  WHERE length(f.form) >= 6 AND l.form = left(f.form, length(f.form) - k) AND l.tf > f.tf),
seen AS (SELECT right(form, size) AS suffix, cut, count(*) AS n FROM changes, range(1, 6) sizes(size)
  WHERE size >= cut AND size <= length(form) GROUP BY ALL HAVING count(*) >= 2),
rules AS (SELECT suffix, CAST(cut AS INTEGER) AS cut, '' AS "add", n
  FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut) AS rn FROM seen) WHERE rn = 1)"""

DIST = ("(sum(a.p * ln(a.p / ((a.p + b.p) / 2)) + b.p * ln(b.p / ((a.p + b.p) / 2)))"
        " + ln(2) * (2 - sum(a.p) - sum(b.p))) / 2")
CLUSTERS = f"""{WORDS}, tf AS (SELECT source AS cluster, word, count(*) AS tf
  FROM (SELECT source, unnest(words) AS word FROM docs WHERE source IS NOT NULL) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["language_letters"] = f"WITH {_letters()} SELECT review_id, language, language_score FROM letters"
    held = _letters() + f""", worded AS (SELECT * REPLACE ({_tokens('text_positive')} AS words) FROM docs),
      every AS (SELECT *, {_vote('words')} AS predicted FROM worded),
      voted AS (SELECT every.*, coalesce(language, 'unknown') AS predicted_long FROM every JOIN letters USING (review_id) WHERE review_id % 5 = 0)"""
    sql["language_quality"] = f"WITH {held} {_summary('stop-words', 'predicted')} UNION ALL {_summary('letters', 'predicted_long')}"
    sql["induced_lexicon"] = f"WITH {_induced()} SELECT word, weight, z FROM lexicon"
    degree = "CASE word " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in classify.DEGREES.items()) + " END"
    sql["scoped_polarity"] = rf"""WITH {_induced()},
      listed AS (SELECT review_id, unnest(m) AS word, generate_subscripts(m, 1) AS pos
        FROM (SELECT review_id, regexp_extract_all(lower(coalesce(text_positive, '')), '[\p{{L}}\p{{N}}_]+|[.,;:!?]') AS m FROM texts)),
      marked AS (SELECT review_id, pos, weight,
        max(CASE WHEN word IN {_list(classify.NEGATIONS)} THEN pos END) OVER before AS no_at,
        max(CASE WHEN word IN {_list(classify.SPAN_ENDS)} THEN pos END) OVER before AS end_at,
        lag({degree}) OVER (PARTITION BY review_id ORDER BY pos) AS degree
        FROM listed LEFT JOIN lexicon USING (word)
        WINDOW before AS (PARTITION BY review_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      scored AS (SELECT review_id, avg(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, weight * coalesce(degree, 1.0::DOUBLE)))
          * CASE WHEN pos - no_at <= {classify.NEGATION_REACH} AND no_at > coalesce(end_at, -1) THEN {classify.NEGATED}::DOUBLE ELSE 1.0::DOUBLE END) AS p
        FROM marked WHERE weight IS NOT NULL GROUP BY review_id),
      s AS (SELECT review_id, coalesce(p, 0.0::DOUBLE) AS p FROM texts LEFT JOIN scored USING (review_id))
      SELECT review_id, {POLAR} AS sentiment_label, {_r('p', 4)} AS sentiment_score FROM s"""
    sql["sentiment_fitted"] = f"WITH {_bayes()} SELECT review_id, predicted, probability FROM fitted"
    truth = _summary("naive Bayes", "predicted").replace("lang =", "truth =")
    for x in LANGUAGES:
        truth = truth.replace(f"('{x}'), ", "").replace(f", ('{x}')", "").replace(f"('{x}')", "('negative'), ('positive')")
    sql["sentiment_quality"] = f"""WITH {_bayes()}, voted AS (SELECT truth, coalesce(predicted, 'none') AS predicted
      FROM fitted WHERE review_id % 5 = 0 AND truth IS NOT NULL) {truth}"""
    sql["suffix_rules"] = f"WITH {RULES} SELECT * FROM rules"
    sql["lemmatize_rules"] = f"""WITH {RULES},
      ends AS (SELECT form, cut, row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) AS rn
        FROM forms, range(1, 6) sizes(size) JOIN rules ON suffix = right(form, size) WHERE size <= length(form))
      SELECT f.form, CASE WHEN cut < length(f.form) THEN left(f.form, length(f.form) - cut) ELSE f.form END AS lemma
      FROM forms f LEFT JOIN ends e ON e.form = f.form AND rn = 1"""
    sql["topic_similarity"] = f"""WITH {CLUSTERS},
      w AS (SELECT cluster, word, tf * ln(1.0::DOUBLE + (SELECT avg(s) FROM (SELECT CAST(sum(tf) AS DOUBLE) AS s FROM tf GROUP BY cluster))
        / CAST(sum(tf) OVER (PARTITION BY word) AS DOUBLE)) AS w FROM tf),
      u AS (SELECT cluster, word, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS w FROM w)
      SELECT a.cluster AS a, b.cluster AS b, {_r('sum(a.w * b.w)', 6)} AS similarity FROM u a JOIN u b ON a.word = b.word AND a.cluster < b.cluster GROUP BY ALL"""
    sql["topic_relevance"] = f"""WITH {CLUSTERS.replace('source AS cluster', 'lang AS cluster').replace('SELECT source, unnest', 'SELECT lang, unnest').replace('source IS', 'lang IS')},
      n AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY cluster) AS DOUBLE) AS size, CAST(sum(tf) OVER (PARTITION BY word) AS DOUBLE) AS f,
        CAST(sum(tf) OVER () AS DOUBLE) AS whole FROM tf),
      r AS (SELECT cluster, word, {_r('0.6 * ln(tf / size) + 0.4 * ln((tf / size) / (f / whole))', 6)} AS relevance,
        {_r("f / whole * sum(tf / f * ln((tf / f) / (size / whole))) OVER (PARTITION BY word)", 9)} AS saliency FROM n)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY relevance DESC, word) AS INTEGER) AS "rank" FROM r) WHERE "rank" <= 10"""
    sql["topic_distances"] = f"""WITH {CLUSTERS},
      p AS (SELECT cluster, word, tf / CAST(sum(tf) OVER (PARTITION BY cluster) AS DOUBLE) AS p FROM tf)
      SELECT a.cluster AS a, b.cluster AS b, {_r(DIST, 6)} AS distance
      FROM p a JOIN p b ON a.word = b.word AND a.cluster < b.cluster GROUP BY ALL"""
    sql["union_by_name"] = """SELECT doc_id AS id, text, lang FROM documents
      UNION ALL BY NAME SELECT conv_id AS id, turn, role, text FROM conversations"""
    sql["roundtrip_stage"] = f"WITH {OBS} SELECT review_id, city, rating, temporal_window FROM obs"
    sql["incremental_pending"] = "SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://')"
    sql["stream_ingest"] = "SELECT event_id, user_id, event_type, value FROM events"
    sql["resumable_ingest"] = "SELECT event_id, user_id, event_type, value, true AS noted FROM events WHERE event_type <> 'error'"
    unescape = "replace(replace(replace(replace({c}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    edges = _strip("t")
    article = (
        r"list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'), "
        f"lambda t: {edges}), lambda t: t <> '')"
    )
    heading = r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
    sql["page_cards"] = f"""SELECT page_id, 0 AS card, {unescape.format(c=f"(SELECT {edges} FROM (SELECT {heading} AS t))")} AS review_title,
      {unescape.format(c=f"array_to_string({article}, '')")} AS text_positive FROM pages"""
    sql["review_cards"] = """SELECT doc_id AS page_id, 0 AS card, 'here' AS city, 'House ' || upper(lang[1]) || lower(lang[2:]) AS property,
      CAST(doc_id % 5 + 1 AS INTEGER) AS property_stars, CAST((doc_id % 10) || '.' || (doc_id % 7) AS DOUBLE) AS rating, source AS review_title,
      CAST(doc_id % 9 + 1 AS INTEGER) AS nights_stayed, lang || ' ' || doc_id AS text_positive, '' AS text_negative FROM documents"""
    sql["page_links"] = r"""WITH t AS (
        SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*>'),
          lambda x: trim(regexp_extract(x, '(?is)\shref\s*=\s*(.*)>$', 1))) AS tails FROM pages),
      a AS (SELECT page_id, list_filter(list_transform(tails, lambda r: replace(CASE
          WHEN r LIKE '"%' THEN split_part(r, '"', 2) WHEN r LIKE '''%' THEN split_part(r, '''', 2)
          ELSE regexp_extract(r, '^[^\s>]+') END, '&amp;', '&')), lambda h: contains(h, '/')) AS h FROM t),
      u AS (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS pos FROM a),
      v AS (SELECT CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://site.example' || href END AS url, page_id, pos FROM u),
      f AS (SELECT url, page_id AS first_page, pos AS first_pos,
        row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM v)
      SELECT url, first_page, CAST(first_pos AS INTEGER) AS first_pos FROM f WHERE rn = 1"""
    sql["url_parts"] = r"""SELECT page_id, CASE WHEN NOT contains(url, 'https://') THEN 'unknown' ELSE array_to_string(list_transform(
      regexp_extract_all(replace(split_part(split_part(url, 'https://', 2), '.example.', 1), '-', ' '), '\p{L}+|[^\p{L}]+'),
      lambda w: upper(w[1]) || lower(w[2:])), '') END AS property FROM pages"""
    sql["benchmark_labels"] = """SELECT doc_id, text, 'positive' AS label FROM documents JOIN labels USING (doc_id)
      WHERE quality = 1 AND text IS NOT NULL"""
    mark = "CASE WHEN toxic = 1 THEN ' mixed' WHEN quality = 1 THEN ' Positive ' WHEN quality = 0 THEN 'NEGATIVE' END"
    gold = f"SELECT doc_id, lang, coalesce(trim(lower({mark})), '') AS annotation FROM documents LEFT JOIN labels USING (doc_id)"
    sql["gold_rejects"] = f"""SELECT CASE WHEN annotation IN ('', 'nan', 'none') THEN 'blank'
      WHEN annotation IN ('positive', 'negative') THEN 'valid' ELSE 'invalid' END AS status, count(*) AS n
      FROM ({gold}) GROUP BY 1"""
    sql["gold_rows"] = f"SELECT * FROM ({gold}) WHERE annotation IN ('positive', 'negative')"
    sql["head_n"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100"
    sql["random_n"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100"

    sql["placeholder_null"] = f"WITH {TEXTS} SELECT review_id, nullif(text_negative, '---') AS text_negative FROM texts"
    sql["date_range_keep_null"] = f"""WITH {OBS} SELECT review_id, review_date FROM obs
      WHERE review_date IS NULL OR review_date BETWEEN DATE '1997-04-01' AND DATE '1998-06-15'"""
    sql["takewhile_recent"] = """WITH l AS (SELECT event_id, user_id,
        CASE WHEN event_type <> 'error' THEN DATE '2024-01-01' + CAST(floor(value) AS INTEGER) END AS day FROM events),
      m AS (SELECT *, coalesce(max((day < DATE '2024-01-03')::INT) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS UNBOUNDED PRECEDING), 0) AS stopped FROM l)
      SELECT event_id, user_id, day FROM m WHERE stopped = 0"""
    sql["valid_docs"] = rf"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '[^{SPACE}]')"
    sql["canonical_group"] = """SELECT n_nationkey, lower(trim(n_name)) AS key,
      upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation"""
    sql["coerce_numeric"] = r"""SELECT event_id, TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS number,
      TRY_CAST(event_type AS DOUBLE) AS event_type FROM events"""

    sql["italian_dates"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS review_date FROM orders"
    sql["assign_window"] = f"WITH {OBS} SELECT review_id, temporal_window FROM obs"
    sql["read_reviews_headers"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
      CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 1 THEN CAST(n_chars AS VARCHAR) END AS n_chars
      FROM documents"""
    sql["append_report"] = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
      SELECT * FROM c UNION ALL SELECT * FROM c"""
    sql["tag_by_file"] = "SELECT 'pre' AS temporal_window, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL"
    sql["column_names"] = "SELECT doc_id, source, lang AS language, CAST(NULL AS DOUBLE) AS rating FROM documents"
    sql["strict_dates"] = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS review_date
      FROM orders"""
    sql["slugs"] = r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^\p{L}\p{N}_]+', '_', 'g'), '_') AS slug
      FROM part"""
    sql["top_class"] = """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'mid' ELSE 'small' END AS label,
      CASE WHEN p_size % 3 = 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM part"""
    sql["clean_text"] = f"SELECT doc_id AS review_id, {CLEAN.format(c='text')} AS clean FROM documents"
    stop = _list(stopwords("italian", "english"))
    sql["stopword_filter"] = f"""SELECT doc_id AS review_id,
      array_to_string(list_filter({_tokens('text')}, lambda t: t NOT IN {stop}), ' ') AS kept FROM documents"""
    lemma = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in samples.LEMMAS.items()) + " ELSE t END"
    sql["lemmatize_dict"] = f"""SELECT doc_id AS review_id,
      array_to_string(list_transform({_tokens('text')}, lambda t: {lemma}), ' ') AS lemmas FROM documents"""
    sql["review_features"] = rf"""WITH {TEXTS} SELECT review_id,
      CAST(len(regexp_extract_all(text_positive, '[^{SPACE}]+')) AS INTEGER) AS review_length,
      coalesce(text_negative <> '---', false) AS has_negative FROM texts"""
    number = "CAST(p_size || '.' || (p_partkey % 10) AS DOUBLE)"
    sql["parse_rating"] = f"SELECT p_partkey, CASE WHEN {number} > 10 THEN {_r(number + ' / 10', 2)} ELSE {number} END AS rating FROM part"
    sql["parse_int_prefix"] = """SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS stars,
      CAST(left(o_orderpriority, 1) AS INTEGER) AS nights, CAST(NULL AS INTEGER) AS "none" FROM orders"""
    quoted = "' « ' || text || ' »' || chr(10)"
    sql["strip_quotes"] = f"SELECT doc_id, {_strip(f'trim({_strip(quoted)}, {chr(39)}«»{chr(39)})')} AS text FROM documents"
    sql["star_sentiment"] = f"WITH {OBS} SELECT review_id, sentiment_label, sentiment_score FROM obs"
    sql["normalise_labels"] = f"""WITH {OBS} SELECT review_id, sentiment_label AS three_class,
      CASE WHEN topic <= 2 THEN 'negative' ELSE 'positive' END AS two_class,
      CASE WHEN topic % 2 = 1 THEN 'positive' ELSE 'negative' END AS "binary" FROM obs"""

    voted = _voted()
    collapse = rf"""CASE WHEN text_positive IS NULL OR NOT regexp_matches(text_positive, '[^{SPACE}]') THEN 'unknown'
      WHEN predicted IN ('it', 'en') THEN predicted ELSE 'it' END"""
    sql["language_vote"] = f"WITH {voted} SELECT review_id, predicted, predicted_long FROM voted"
    sql["language_collapse"] = f"WITH {voted} SELECT review_id, {collapse} AS language FROM voted"
    lexical = f"""WITH {WORDS}, s AS (SELECT review_id, {_lexicon('words')} AS p FROM docs)
      SELECT review_id, {POLAR} AS sentiment_label, {_r('p', 4)} AS sentiment_score FROM s"""
    sql["lexicon_sentiment"] = lexical
    sql["lexicon_sentiment_table"] = lexical
    sql["emotion_dispatch"] = f"""WITH w AS (SELECT conv_id, turn, {_tokens('text')} AS words FROM conversations),
      v AS (SELECT *, {_vote('words')} AS language FROM w),
      c AS (SELECT *, {_emotion_counts('words', 'language')} AS counts FROM v)
      SELECT conv_id, turn,
        CASE WHEN list_sum(counts) = 0 THEN 'unknown' ELSE {EMOTION_NAMES}[list_position(counts, list_max(counts))] END AS emotion_label,
        CASE WHEN list_sum(counts) = 0 THEN 0.0::DOUBLE ELSE {_r('list_max(counts)::DOUBLE / list_sum(counts)::DOUBLE', 4)} END AS emotion_score
      FROM c"""
    shown = rf"CASE WHEN regexp_matches(text, '[^{SPACE}]') THEN text ELSE ' ' END"
    sql["score_text_stub"] = f"""WITH t AS (SELECT doc_id, {shown} AS t FROM documents),
      s AS (SELECT doc_id, (length(t) - length(replace(t, 'e', '')))::DOUBLE / length(t)::DOUBLE AS score FROM t)
      SELECT doc_id AS review_id, CASE WHEN score > 0.1::DOUBLE THEN 'positive' ELSE 'negative' END AS label, score FROM s"""
    sql["sentiment_scored"] = f"""WITH {voted}, s AS (SELECT *, {_lexicon('words')} AS p FROM voted)
      SELECT review_id, {POLAR} AS sentiment_label, {_r('p', 4)} AS sentiment_score, {collapse} AS detected_language FROM s"""

    sql["vocabulary"] = f"""WITH {WORDS}, u AS (SELECT review_id, unnest(words) AS term FROM docs),
      c AS (SELECT term, count(*) AS tf, count(DISTINCT review_id) AS df FROM u GROUP BY term)
      SELECT term, tf, df FROM c WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM docs WHERE len(words) > 0)
      ORDER BY tf DESC, term"""
    sql["class_tfidf"] = f"""WITH {WORDS}, u AS (SELECT lang AS cluster, unnest(words) AS word FROM docs),
      t AS (SELECT cluster, word, count(*) AS tf FROM u GROUP BY ALL),
      f AS (SELECT word, sum(tf) AS f FROM t GROUP BY word),
      a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM t GROUP BY cluster)),
      w AS (SELECT cluster, word, {_r('tf * ln(1.0 + (SELECT a FROM a) / f)', 6)} AS weight FROM t JOIN f USING (word)),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, word) AS rank FROM w)
      SELECT cluster, word, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
    sql["subset_sizes"] = f"""WITH {WORDS} SELECT lang, source, count(*) AS n, count(*) FILTER (len(words) > 0) AS n_valid,
      count(*) FILTER (len(words) > 0) >= 10 AS modelled FROM docs GROUP BY ALL"""
    sql["term_frequency"] = f"""WITH {WORDS}, u AS (SELECT lang, source, unnest(words) AS word FROM docs),
      c AS (SELECT lang, source, word, count(*) AS "count" FROM u GROUP BY ALL),
      n AS (SELECT lang, source, count(*) AS n_texts FROM docs WHERE len(words) > 0 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY "count" DESC, word) AS rank FROM c)
      SELECT lang, source, word, "count", CAST(rank AS INTEGER) AS rank, n_texts FROM r JOIN n USING (lang, source) WHERE rank <= 100"""
    spread = ", ".join([f"count(*) FILTER (topic = {s}) AS topic_{s}" for s in STARS]
                       + [f"count(*) FILTER (stay_type = '{s.upper()}') AS stay_{s}" for s in ("f", "o", "p")])
    sql["topic_distribution"] = f"WITH {OBS} SELECT temporal_window, {spread} FROM obs GROUP BY 1"

    for name, by in (("sentiment_window", "temporal_window"), ("sentiment_group", "city")):
        sql[name] = f"""WITH {OBS} SELECT {by}, avg(sentiment_score) AS mean_sentiment,
          count(sentiment_score) AS review_count, {_emotion_columns()} FROM obs GROUP BY 1"""
    types = ", ".join(f"count(*) FILTER (event_type = '{t}') AS emotion_{t}"
                      for t in ("click", "error", "purchase", "signup", "view"))
    sql["emotion_pivot"] = f"SELECT user_id, {types} FROM events GROUP BY 1"
    sql["volumetric"] = f"WITH {OBS}, {PAIRS}, {VOLUME} SELECT * FROM volume"
    sql["window_counts"] = f"""WITH {OBS} SELECT temporal_window, count(*) AS review_count,
      CAST(NULL AS DOUBLE) AS pct_change_vs_baseline FROM obs GROUP BY 1"""
    sql["sentiment_change"] = f"WITH {OBS}, {PAIRS}, {CHANGE} SELECT * FROM change"
    sql["sentiment_change_emotion"] = f"""WITH {OBS}, {PAIRS}, {CHANGE},
      em AS (SELECT temporal_window AS "window", {_emotion_columns()} FROM obs GROUP BY 1)
      SELECT c.*, em.* EXCLUDE ("window") FROM change c LEFT JOIN em USING ("window")"""
    sql["target_vs_control"] = f"WITH {OBS}, {PLACES} SELECT * FROM places"
    sql["category_share_window"] = f"WITH {OBS}, {SHARES_WINDOW} SELECT * FROM shares"
    sql["category_share_group"] = f"WITH {OBS}, {SHARES_GROUP} SELECT * FROM shares_g"
    top_w = 'row_number() OVER (PARTITION BY "window", year ORDER BY "count" DESC, topic)'
    top_g = 'row_number() OVER (PARTITION BY city ORDER BY "count" DESC, topic)'
    sql["top3_categories"] = f"""WITH {OBS}, {SHARES_WINDOW}, r AS (SELECT *, CAST({top_w} AS INTEGER) AS rank FROM shares)
      SELECT * FROM r WHERE rank <= 3"""
    sql["key_findings"] = f"""WITH {OBS}, {PAIRS}, {VOLUME}, {CHANGE}, {PLACES}, {SHARES_WINDOW}, {SHARES_GROUP},
      tw AS (SELECT *, {top_w} AS rank FROM shares), tg AS (SELECT *, {top_g} AS rank FROM shares_g),
      tot AS (SELECT count(*) AS n, count(*) FILTER (city = 'europe') AS t FROM obs),
      tw3 AS (SELECT * FROM tw WHERE rank <= 3), tg3 AS (SELECT * FROM tg WHERE rank <= 3)
      {_long('totals', 'tot', "'all'", "'all'", {'reviews': 'n', 'target_reviews': 't'})}
      UNION ALL {_long('volume', 'volume', 'city', 'window_event', {c: c for c in ('reviews_event', 'reviews_baseline', 'pct_change')})}
      UNION ALL {_long('sentiment_change', 'change', 'city', '"window"', {c: c for c in CHANGE_MEASURES})}
      UNION ALL {_long('target_vs_control', 'places', 'city', 'temporal_window', {c: c for c in PLACE_MEASURES})}
      UNION ALL {_long('top_topics_window', 'tw3', "year || '#' || rank", '"window"', {'topic': 'topic', 'pct': 'pct'})}
      UNION ALL {_long('top_topics_group', 'tg3', "city || '#' || rank", "'all'", {'topic': 'topic', 'pct': 'pct'})}"""
    sql["temporal_summary"] = f"""WITH {OBS} SELECT city, temporal_window, count(rating) AS n,
      {_r('avg(rating)', 3)} AS rating_mean, {_r('stddev_samp(rating)', 3)} AS rating_std,
      {_r('avg(sentiment_score)', 3)} AS sentiment_mean FROM obs WHERE temporal_window IN {EVENT} GROUP BY ALL"""
    sql["box_stats"] = f"""WITH {OBS}, o AS (SELECT * FROM obs WHERE temporal_window IN {EVENT}),
      q AS (SELECT city, temporal_window, count(*) AS n, avg(rating) AS mean, quantile_cont(rating, 0.25) AS q1,
        quantile_cont(rating, 0.5) AS median, quantile_cont(rating, 0.75) AS q3 FROM o GROUP BY ALL),
      f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
      w AS (SELECT city, temporal_window, min(rating) FILTER (rating >= lo) AS wl, max(rating) FILTER (rating <= hi) AS wh,
        count(*) FILTER (rating < lo OR rating > hi) AS n_outliers FROM o JOIN f USING (city, temporal_window) GROUP BY ALL)
      SELECT city, temporal_window, n, {_r('mean', 4)} AS mean, {_r('q1', 4)} AS q1, {_r('median', 4)} AS median, {_r('q3', 4)} AS q3,
        {_r('least(wl, q1)', 4)} AS whisker_low, {_r('greatest(wh, q3)', 4)} AS whisker_high, n_outliers
      FROM q JOIN w USING (city, temporal_window)"""
    sql["box_outliers"] = """WITH i AS (SELECT l_returnflag, l_extendedprice / l_quantity AS l_price FROM lineitem),
      q AS (SELECT l_returnflag, quantile_cont(l_price, 0.25) AS q1, quantile_cont(l_price, 0.75) AS q3 FROM i GROUP BY 1)
      SELECT l_returnflag, l_price FROM i JOIN q USING (l_returnflag)
      WHERE l_price < q1 - 0.5 * (q3 - q1) OR l_price > q3 + 0.5 * (q3 - q1)"""
    sql["year_compare"] = f"""WITH {OBS}, p AS (SELECT {PLACE}, rating, sentiment_score FROM obs
        WHERE city = 'europe' AND temporal_window IN {PAIRED})
      SELECT "window", year, {_r('avg(rating)', 4)} AS rating, {_r('avg(sentiment_score)', 4)} AS sentiment, count(*) AS n
      FROM p GROUP BY ALL"""

    sql["stratified_sample"] = """WITH d AS (SELECT doc_id AS review_id, lang,
        row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
      SELECT row_number() OVER (ORDER BY md5('42:mix:' || review_id)) AS id, review_id, lang, '' AS annotation FROM d WHERE rn <= 30"""
    sql["sample_stats"] = f"""WITH {voted}, e AS (SELECT *, {_strip('text_positive')} AS t FROM voted)
      SELECT source, count(*) FILTER (t <> '') AS n_raw, count(*) FILTER (length(t) >= 10 AND predicted = 'en') AS n_eligible,
        least(count(*) FILTER (length(t) >= 10 AND predicted = 'en'), 30) AS n_sampled FROM e GROUP BY 1"""
    names = ", ".join(f"('{x}')" for x in LANGUAGES)
    sql["confusion_matrix"] = f"""WITH {voted}, l(label) AS (VALUES {names})
      SELECT t.label AS truth, p.label AS predicted, count(v.review_id) AS n FROM l t CROSS JOIN l p
      LEFT JOIN voted v ON v.lang = t.label AND v.predicted_long = p.label GROUP BY ALL"""
    sql["class_report"] = f"""WITH {voted}, {_report('predicted_long')} SELECT label, {_r('precision', 4)} AS precision,
      {_r('recall', 4)} AS recall, {_r('f1', 4)} AS f1, CAST(support AS BIGINT) AS support FROM report"""
    hit = "avg((lang = predicted_long)::INT)"
    sql["accuracy_by_slice"] = f"WITH {voted} SELECT source, {hit} AS accuracy, count(*) AS n FROM voted GROUP BY 1"
    sql["mean_slice_accuracy"] = f"""WITH {voted}, s AS (SELECT source, {hit} AS a FROM voted GROUP BY 1)
      SELECT {_r('avg(a)', 6)} AS mean_accuracy, count(*) AS n_slices FROM s"""
    sql["model_comparison"] = f"""WITH {voted} {_summary('all words', 'predicted')} UNION ALL {_summary('long words', 'predicted_long')}"""
    sql["label_union"] = f"""WITH {voted} SELECT lang AS label FROM voted UNION SELECT {collapse} FROM voted"""

    sql["stage_join"] = "SELECT doc_id AS review_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
    keys = ("l.lang = r.lang AND l.text_positive = r.text_positive "
            "AND l.text_negative IS NOT DISTINCT FROM r.text_negative")
    sql["natural_key_join"] = f"""WITH {TEXTS}, j AS (SELECT l.review_id, l.lang, r.source,
        row_number() OVER (PARTITION BY l.review_id ORDER BY r.review_id) AS rn FROM texts l LEFT JOIN texts r ON {keys})
      SELECT review_id, lang, source FROM j WHERE rn = 1"""
    sql["natural_key_fanout"] = f"""WITH {TEXTS}, j AS (SELECT l.review_id, l.lang, count(*) AS m FROM texts l
        LEFT JOIN texts r ON {keys} GROUP BY ALL)
      SELECT lang, count(*) AS n_rows, CAST(sum(m) AS BIGINT) AS n_joined FROM j GROUP BY 1"""
    day = "CAST(o_orderdate AS DATE)"
    sql["window_range_join"] = f"SELECT o_orderkey, {day} AS order_day, {WINDOW.format(d=day)} AS window_label FROM orders"
    sql["semi_windows"] = f"SELECT o_orderkey, {day} AS order_day FROM orders WHERE {WINDOW.format(d=day)} <> 'outside'"
    return sql
