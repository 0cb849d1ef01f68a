"""DuckDB SQL for the registered queries of the core."""

from __future__ import annotations

from tidemark.functions.extract import CONFIDENCE, CONTEXT_WORDS, NAME, WORD
from tidemark.functions.text import COMPANY_WORDS, ITEM_GROUPS, ITEM_NAMES, SECURITY_WORDS
from tidemark.operators.noise import FORECAST, PRESS_RELEASE, PRICE_RECAP, PROMO, RELEASE_OUTLETS, SPAM
from tidemark.operators.scoring import LexiconScorer
from tidemark.plans.queries import AUTHOR_CAP, AUTHOR_RULES, BOTS, NEWS

TICKER = "replace(regexp_replace(upper(trim(ticker, ' \t\n\r')), '^\\$', ''), '-', '.')"
NOW = "posts_now AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY collected_at DESC, engagement DESC) = 1)"
TICKERS = f"tickers_now AS (SELECT post_id, {TICKER} AS ticker, max(confidence) AS confidence FROM post_tickers GROUP BY ALL)"
TYPED = f"typed AS (SELECT post_id, {TICKER} AS ticker, match_type, confidence FROM post_tickers QUALIFY row_number() OVER (PARTITION BY post_id, {TICKER} ORDER BY coalesce(confidence, -1) DESC, match_type DESC) = 1)"
SCORES = f"scores_now AS (SELECT post_id, {TICKER} AS ticker, model, label, score, scored_at FROM post_scores)"
EFFECTIVE = """effective AS (SELECT post_id, ticker, label, score FROM scores_now WHERE model IN ('secondpass', 'lextone')
  QUALIFY row_number() OVER (PARTITION BY post_id, ticker ORDER BY list_position(['secondpass', 'lextone'], model), scored_at DESC, label NULLS FIRST, score NULLS FIRST) = 1)"""
BARS = f"""bars AS (SELECT ticker, date, close, volume FROM (SELECT {TICKER} AS ticker, date, close, volume FROM prices_daily WHERE close IS NOT NULL AND NOT isnan(close) AND close > 0)
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY close DESC, coalesce(volume, -1) DESC) = 1)"""
FILINGS = f"filings_now AS (SELECT * REPLACE ({TICKER} AS ticker) FROM sec_filings QUALIFY row_number() OVER (PARTITION BY accession ORDER BY fetched_at DESC, accepted_at DESC NULLS LAST) = 1)"
NUMBERS = ["attention_z", "sentiment", "momentum", "breadth", "composite_bull", "composite_bear", "rel_volume", "ret_5d", "ret_30d", "updown_vol_ratio"]
MARKS = ["early_chatter_flag", "insider_buy_flag", "events", "red_flag"]
_clean = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in NUMBERS)
_order = ", ".join(f"{c} DESC NULLS LAST" for c in ["mentions", "composite_bull", "composite_bear", *[c for c in NUMBERS if not c.startswith("composite")], *MARKS])
SIGNALS = f"""signals_now AS (SELECT * FROM (SELECT CAST(date_trunc('week', week_start) AS DATE) AS week_start, {TICKER} AS ticker, mentions, {_clean}, {", ".join(MARKS)} FROM weekly_signals)
  QUALIFY row_number() OVER (PARTITION BY week_start, ticker ORDER BY {_order}) = 1)"""
FRIDAY = "CAST(created_at AS DATE) + CAST((12 - isodow(created_at)) % 7 AS INTEGER)"
MENTIONS = f"""{NOW}, {TICKERS}, {SCORES}, {EFFECTIVE}, every_mention AS (SELECT p.id AS post_id, t.ticker, p.source, p.community, p.author_id, p.author_age_days, p.author_karma, p.created_at, p.engagement, p.content_hash, p.title, p.body, e.label, e.score
  FROM posts_now p JOIN tickers_now t ON t.post_id = p.id LEFT JOIN effective e ON e.post_id = p.id AND e.ticker = t.ticker WHERE t.confidence >= 0.5),
dated AS (SELECT *, CAST(floor((epoch_us(CAST(f + 1 AS TIMESTAMP)) - epoch_us(created_at) - 1) / 86400000000.0) AS INTEGER) AS day FROM (SELECT *, {FRIDAY} + 7 * j AS f FROM every_mention, (SELECT CAST(unnest(range(7)) AS INTEGER) AS j))),
mentions AS (SELECT *, f - 4 AS week, day // 7 AS block, ln(1 + CAST(greatest(coalesce(engagement, 0), 0) AS DOUBLE)) AS weight FROM dated WHERE day BETWEEN 0 AND 36)"""
_mean = lambda b: f"coalesce(sum(score * weight) FILTER (WHERE block = {b}) / nullif(sum(weight) FILTER (WHERE block = {b} AND score IS NOT NULL), 0), avg(score) FILTER (WHERE block = {b}))"
_z = lambda c: f"coalesce(CASE WHEN count({c}) OVER w < 2 OR stddev_pop({c}) OVER w < 1e-12 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END, 0)"


def _attention(rows: str) -> str:
    return f"""live AS (SELECT DISTINCT week, ticker FROM {rows} WHERE day < 7), daily AS (SELECT week, ticker, day, sum(weight) AS w FROM {rows} GROUP BY ALL),
grid AS (SELECT live.week, live.ticker, d.day, coalesce(w, 0) AS w FROM live CROSS JOIN (SELECT unnest(range(37)) AS day) d LEFT JOIN daily ON daily.week = live.week AND daily.ticker = live.ticker AND daily.day = d.day),
att AS (SELECT week, ticker, greatest(-10, least(10, (avg(w) FILTER (WHERE day < 7) - avg(w) FILTER (WHERE day >= 7)) / greatest(stddev_pop(w) FILTER (WHERE day >= 7), 1.0))) AS attention_z FROM grid GROUP BY week, ticker)"""


def _components(rows: str) -> str:
    return f"""{_attention(rows)},
comp AS (SELECT week, ticker, count(*) FILTER (WHERE block = 0) AS mentions, count(DISTINCT author_id) FILTER (WHERE block = 0) AS n_authors, {_mean(0)} AS sentiment, {_mean(1)} AS sentiment_prev,
  ln(1 + count(DISTINCT author_id) FILTER (WHERE block = 0)) + ln(1 + count(DISTINCT community) FILTER (WHERE block = 0)) + ln(1 + count(DISTINCT source) FILTER (WHERE block = 0)) AS breadth FROM {rows} GROUP BY week, ticker),
components AS (SELECT comp.*, attention_z, sentiment - sentiment_prev AS momentum FROM comp JOIN att USING (week, ticker) WHERE mentions > 0),
zs AS (SELECT *, {_z("attention_z")} AS a, {_z("sentiment")} AS s, {_z("momentum")} AS m, {_z("breadth")} AS b FROM components WINDOW w AS (PARTITION BY week)),
composed AS (SELECT *, 0.35 * a + 0.35 * s + 0.15 * m + 0.15 * b AS composite_bull, 0.35 * a - 0.35 * s - 0.15 * m + 0.15 * b AS composite_bear FROM zs)"""


_rounded = lambda *names: ", ".join(f"round({c}, 9) AS {c}" for c in names)
_week = "strftime(week, '%Y-%m-%d') AS week"
SHOWN_COMPONENTS = f"SELECT {_week}, ticker, mentions, n_authors, {_rounded('attention_z', 'sentiment', 'sentiment_prev', 'momentum', 'breadth')} FROM components"
SIMHASH = """hashes AS (SELECT id, [CAST('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 16) AS UBIGINT) FOR i IN range(1, len(w) - 1)] AS h
  FROM (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[a-z0-9$'']+') AS w FROM posts_now) WHERE len(w) >= 12),
sim AS (SELECT id, bit_or(CASE WHEN len([x FOR x IN h IF (x >> b) & 1 = 1]) * 2 > len(h) THEN CAST(1 AS UBIGINT) << b ELSE CAST(0 AS UBIGINT) END) AS s FROM hashes, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY id),
forms AS (SELECT DISTINCT s FROM sim), alike AS (SELECT x.s AS x, y.s AS y FROM forms x JOIN forms y ON x.s < y.s AND bit_count(xor(x.s, y.s)) <= 3)"""


def _near_copies(rows: str) -> str:
    """copies (week, id) among rows (week, id, created_at): later posts of a hash, and near ones of kept posts in order."""
    none = "{'a': '', 'b': '', 'd': CAST([] AS VARCHAR[])}"
    return f"""hashed AS (SELECT DISTINCT week, r.id, r.created_at, s FROM {rows} r JOIN sim ON sim.id = r.id),
firsts AS (SELECT week, s, min({{'c': created_at, 'i': id}}) AS f FROM hashed GROUP BY ALL),
edges AS (SELECT p.week, least(p.f, q.f) AS a, greatest(p.f, q.f) AS b FROM alike JOIN firsts p ON p.s = x JOIN firsts q ON q.s = y AND q.week = p.week),
folded AS (SELECT week, list_reduce(list({{'a': a.i, 'b': b.i, 'd': CAST([] AS VARCHAR[])}} ORDER BY b, a), lambda acc, x: CASE WHEN list_contains(acc.d, x.a) THEN acc ELSE {{'a': '', 'b': '', 'd': acc.d || [x.b]}} END, {none}) AS r FROM edges GROUP BY week),
copies AS (SELECT week, id FROM hashed JOIN firsts USING (week, s) WHERE id <> f.i UNION SELECT week, unnest(r.d) FROM folded)"""


PANEL = f"""{BARS}, {SIGNALS}, asof_close AS (SELECT ticker, f AS friday, close FROM (SELECT ticker, date, close, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS f FROM bars)
  QUALIFY row_number() OVER (PARTITION BY ticker, f ORDER BY date DESC) = 1),
panel AS (SELECT s.*, b.close / a.close - 1 AS ret_prior, c.close / b.close - 1 AS ret_same, d.close / c.close - 1 AS ret_next FROM signals_now s
  LEFT JOIN asof_close a ON a.ticker = s.ticker AND a.friday = s.week_start + 4 - 14 LEFT JOIN asof_close b ON b.ticker = s.ticker AND b.friday = s.week_start + 4 - 7
  LEFT JOIN asof_close c ON c.ticker = s.ticker AND c.friday = s.week_start + 4 LEFT JOIN asof_close d ON d.ticker = s.ticker AND d.friday = s.week_start + 4 + 7)"""
SPEAR = """ranked AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
ics AS (SELECT {by}, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-12 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM ranked GROUP BY {by} HAVING count(*) >= 5)"""
ROLLING = f"""{NOW},
pairs AS (SELECT DISTINCT post_id, {TICKER} AS ticker FROM post_tickers),
daily AS (SELECT ticker, CAST(created_at AS DATE) AS d, sum(greatest(coalesce(engagement, 0), 0)) AS v, count(*) AS n FROM pairs JOIN posts_now ON id = post_id GROUP BY ALL),
span AS (SELECT ticker, min(d) AS a, max(d) AS b FROM daily GROUP BY ticker),
grid AS (SELECT ticker, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
filled AS (SELECT grid.ticker, a, grid.d, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM grid LEFT JOIN daily ON daily.ticker = grid.ticker AND daily.d = grid.d),
totals AS (SELECT ticker, a, d, CAST(sum(v) OVER w7 AS BIGINT) AS sum_7, CAST(sum(n) OVER w7 AS BIGINT) AS count_7, CAST(sum(v) OVER w30 AS BIGINT) AS sum_30, CAST(sum(n) OVER w30 AS BIGINT) AS count_30 FROM filled
  WINDOW w7 AS (PARTITION BY ticker ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY ticker ORDER BY d ROWS 29 PRECEDING))"""
PM = f"{NOW}, {TICKERS}, pm AS (SELECT p.*, t.ticker, (DATE '2025-05-16' - ({FRIDAY})) / 7 AS block FROM posts_now p JOIN tickers_now t ON t.post_id = p.id)"
WEEKM = f"{NOW}, {TICKERS}, {SCORES}, {EFFECTIVE}, wm AS (SELECT p.*, t.ticker, e.label, e.score FROM posts_now p JOIN tickers_now t ON t.post_id = p.id LEFT JOIN effective e ON e.post_id = p.id AND e.ticker = t.ticker WHERE created_at >= TIMESTAMP '2025-05-10' AND created_at < TIMESTAMP '2025-05-17')"
TOP = "(SELECT ticker FROM tickers_now GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(patterns: list[str], text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {_q(p)}, 'i')" for p in patterns) + ")"


_release = f"({_any(PRESS_RELEASE[1:], 't')} OR (regexp_matches(t, '^.{{0,60}}\\bannounces?\\b', 'i') AND NOT regexp_matches(t, '\\bamong\\b', 'i')) OR lower(trim(coalesce(community, ''))) IN ({', '.join(map(_q, RELEASE_OUTLETS))}))"
_words = _q(COMPANY_WORDS.replace("(?iU)", "(?i)"))
_suffix = _q(SECURITY_WORDS)
_name = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in ITEM_NAMES.items()) + "}"
_group = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(_q, v))}) THEN {i}" for i, v in enumerate(ITEM_GROUPS.values())) + " END"
_label = "[" + ", ".join(map(_q, ITEM_GROUPS)) + "]"
_weight = " * ".join(f"CASE WHEN source = {_q(s)} AND {c} < {r[least]} THEN {r[w]} ELSE 1 END" for s, r in AUTHOR_RULES.items() for c, least, w in (("author_age_days", "min_age_days", "new_account_weight"), ("author_karma", "min_karma", "low_karma_weight")))

_symbol = lambda x, part, letters: f"CASE WHEN regexp_full_match({x}, '{letters}{{1,5}}\\.{letters}') THEN {part.format(x)} WHEN regexp_full_match(split_part({x}, '.', 1), '{letters}{{1,5}}') THEN {part.format(f'split_part({x}, {_q(".")}, 1)')} END"
TEXTS = f"""{NOW}, texts AS (SELECT id, regexp_replace(regexp_replace(coalesce(title, '') || chr(10) || coalesce(body, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '(^|[^{WORD}/])/?[ru]/[{WORD}]+', '\\1 ', 'g') AS text FROM posts_now),
dollar AS (SELECT id, list_sort(list_distinct([{_symbol("x", "upper({})", "[A-Za-z]")} FOR x IN regexp_extract_all(text, '(?:^|[^{WORD}$])\\$([{WORD}]+(?:\\.[{WORD}]+)?)', 1)])) AS symbols FROM texts)"""
NAMES = f"names AS (SELECT {TICKER} AS ticker, lower(trim(regexp_replace(regexp_replace(regexp_replace(company_name, {_words}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s&''-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS name FROM ticker_universe)"
EXTRACTED = f"""{TEXTS}, {NAMES}, known AS (SELECT DISTINCT ticker FROM names),
cash AS (SELECT id, ticker FROM (SELECT id, unnest(symbols) AS ticker FROM dollar) JOIN known USING (ticker)),
cut AS (SELECT id, ap, ticker, regexp_extract_all(lower(text), '[{NAME}]+|[^{NAME}]') AS p FROM texts JOIN (SELECT name, min(ticker) AS ticker, regexp_extract_all(name, '[{NAME}]+|[^{NAME}]') AS ap FROM names WHERE name <> '' GROUP BY name) ON contains(lower(text), name)),
hits AS (SELECT id, {{'upto': i + len(ap), 'at': i, 't': [ticker]}} AS h FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut) WHERE p[i:i + len(ap) - 1] = ap),
alias AS (SELECT id, unnest(r.t) AS ticker FROM (SELECT id, list_reduce(list(h ORDER BY h.at, h.upto DESC), lambda a, x: CASE WHEN x.at >= a.upto THEN {{'upto': x.upto, 'at': x.at, 't': a.t || x.t}} ELSE a END) AS r FROM hits GROUP BY id)),
lines AS (SELECT id, gate, unnest(l) AS line FROM (SELECT id, regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l, regexp_matches(text, '\\$\\s?[0-9]|[0-9]\\s?%') OR list_has_any(regexp_extract_all(lower(text), '[a-z]+'), [{", ".join(map(_q, CONTEXT_WORDS))}]) AS gate FROM texts)),
plausible AS (SELECT list(ticker) AS tickers FROM known WHERE ticker NOT IN ('ALL', 'NOW', 'FOR')),
quiet AS (SELECT id, gate, [{_symbol("x", "{}", "[A-Z]")} FOR x IN regexp_extract_all(line, '(?:^|[^{WORD}$.])([{WORD}]+(?:\\.[{WORD}]+)?)', 1)] AS found FROM lines, plausible
  WHERE len([x FOR x IN regexp_extract_all(line, '(?:^|[^{WORD}$])([{WORD}]+)', 1) IF regexp_full_match(x, '[A-Z]{{2,}}') AND NOT list_contains(tickers, x)]) < 3),
bare AS (SELECT DISTINCT id, ticker, gate FROM (SELECT id, gate, unnest(found) AS ticker FROM quiet), plausible WHERE list_contains(tickers, ticker) AND len(replace(ticker, '.', '')) >= 2),
every AS (SELECT id, ticker, 'cashtag' AS kind, {CONFIDENCE["cashtag"]} AS confidence FROM cash UNION ALL SELECT id, ticker, 'alias', {CONFIDENCE["alias"]} FROM alias
  UNION ALL SELECT id, ticker, 'bare', {CONFIDENCE["bare"]} FROM bare WHERE gate OR id IN (SELECT id FROM cash) OR id IN (SELECT id FROM alias))"""

EVENTS = f"""codes AS (SELECT ticker, CAST(coalesce(accepted_at, CAST(filing_date AS TIMESTAMP)) AS DATE) AS d, trim(unnest(string_split(items, ','))) AS code FROM filings_now WHERE form IN ('8-K', '8-K/A')),
coded AS (SELECT DISTINCT ticker, d + CAST((12 - isodow(d)) % 7 AS INTEGER) - 4 AS week, code, {_group} AS g, {_name}[code] AS name FROM codes WHERE code <> ''),
reds AS (SELECT ticker, week, string_agg(name, ', ' ORDER BY name) FILTER (WHERE g = 4) AS reds FROM coded GROUP BY ALL), shown AS (SELECT DISTINCT ticker, week, g FROM coded WHERE g IS NOT NULL),
events AS (SELECT r.ticker, r.week, string_agg(CASE WHEN g = 4 THEN 'Red flag: ' || reds ELSE {_label}[g + 1] END, '; ' ORDER BY g) AS events, any_value(reds) IS NOT NULL AS red_flag FROM reds r LEFT JOIN shown l ON l.ticker = r.ticker AND l.week = r.week GROUP BY ALL)"""
CONTEXT = """lagged AS (SELECT ticker, date, close, CAST(volume AS DOUBLE) AS volume, lag(close) OVER w AS p, lag(date) OVER w AS p_at, lag(close, 5) OVER w AS s, lag(date, 5) OVER w AS s_at, lag(close, 21) OVER w AS l, lag(date, 21) OVER w AS l_at FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
served AS (SELECT *, f - 6 AS start, close - CASE WHEN f - p_at <= 60 THEN p END AS change FROM (SELECT *, date + CAST((12 - isodow(date)) % 7 AS INTEGER) + 7 * j AS f FROM lagged, (SELECT CAST(unnest(range(10)) AS INTEGER) AS j)) WHERE f - date <= 60),
sums AS (SELECT ticker, f - 4 AS week, max({'d': date, 'c': close, 's': CASE WHEN f - s_at <= 60 THEN s END, 'l': CASE WHEN f - l_at <= 60 THEN l END}) AS t, avg(volume) FILTER (WHERE date >= start) AS v, avg(volume) FILTER (WHERE date < start AND date >= start - 30) AS b,
  sum(volume) FILTER (WHERE date >= start AND change > 0) AS up, sum(volume) FILTER (WHERE date >= start AND change < 0) AS down FROM served GROUP BY ticker, f),
context AS (SELECT ticker, week, t.c / t.s - 1 AS ret_5d, t.c / t.l - 1 AS ret_30d, CASE WHEN b > 0 THEN v / b END AS rel_volume, CASE WHEN down > 0 THEN coalesce(up, 0) / down END AS updown_vol_ratio FROM sums)"""
_key = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(company_name, {_words}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s&''-]', ' ', 'g'), '\\s+', ' ', 'g')))"
_names = lambda text, form: f"regexp_matches({text}, '(?:^|[^{WORD}])\\$?' || regexp_escape({form}) || '(?:$|[^{WORD}])')"
_kind = f"CASE WHEN {_release} THEN 'press_release' WHEN {_any(PROMO, 't')} THEN 'promo' WHEN {_any(PRICE_RECAP, 't')} AND NOT {_any(FORECAST, 't')} THEN 'price_recap' ELSE 'news' END"
_social = "source IN ('reddit', 'stocktwits')"
FILTERED = f"""{MENTIONS}, {SIMHASH}, once AS (SELECT * FROM mentions QUALIFY content_hash IS NULL OR post_id = first_value(post_id) OVER (PARTITION BY week, content_hash ORDER BY created_at, post_id)),
once_posts AS (SELECT DISTINCT week, post_id AS id, created_at FROM once), {_near_copies("once_posts")},
clean AS (SELECT *, coalesce(title, '') || ' ' || coalesce(body, '') AS whole, coalesce(title, '') AS t, CASE WHEN source = 'news' THEN nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') END AS headline
  FROM once ANTI JOIN copies ON copies.week = once.week AND copies.id = once.post_id WHERE NOT {_any(SPAM, "coalesce(title, '') || ' ' || coalesce(body, '')")}),
single AS (SELECT * FROM clean QUALIFY headline IS NULL OR post_id = first_value(post_id) OVER (PARTITION BY week, headline ORDER BY created_at, post_id)),
known_forms AS (SELECT DISTINCT ticker, unnest([k, split_part(k, ' ', 1)]) AS form, k FROM (SELECT {TICKER} AS ticker, {_key} AS k FROM ticker_universe)),
forms_of AS (SELECT ticker, list(form) AS keys FROM known_forms WHERE form <> '' AND (form = k OR length(form) >= 4) GROUP BY ticker),
judged AS (SELECT single.*, CASE WHEN source = 'news' THEN map {{{", ".join(f"{_q(k)}: {w}" for k, w in NEWS["kind_weights"].items())}}}[{_kind}] * CASE WHEN {_names("whole", "single.ticker")} OR len([k FOR k IN keys IF {_names("lower(whole)", "k")}]) > 0 THEN 1 ELSE {NEWS["off_topic_weight"]} END ELSE 1 END AS quality
  FROM single LEFT JOIN forms_of ON forms_of.ticker = single.ticker),
busy AS (SELECT week, block, author_id FROM judged WHERE {_social} AND author_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT post_id) > {BOTS["max_posts"]}),
weighed AS (SELECT j.* REPLACE (ln(1 + greatest(greatest(coalesce(CAST(engagement AS DOUBLE), 0), 0), CASE WHEN source = 'news' THEN 10.0 ELSE 0 END)) * author_weight * quality AS weight)
  FROM (SELECT judged.*, CAST(({_weight}) * CASE WHEN {_social} AND busy.author_id IS NOT NULL THEN {BOTS["weight"]} ELSE 1 END AS DOUBLE) AS author_weight FROM judged LEFT JOIN busy ON busy.week = judged.week AND busy.block = judged.block AND busy.author_id = judged.author_id) j WHERE author_weight * quality > 0),
filtered AS (SELECT * FROM weighed QUALIFY author_id IS NULL OR NOT {_social} OR row_number() OVER (PARTITION BY week, block, ticker, author_id, {_social} ORDER BY weight DESC, post_id) <= {AUTHOR_CAP})"""

LEADLAG = f"""long AS (SELECT week_start, s.signal, h.horizon, CASE s.signal WHEN 'sentiment' THEN sentiment WHEN 'momentum' THEN momentum WHEN 'attention_z' THEN attention_z WHEN 'composite_bull' THEN composite_bull ELSE composite_bear END AS x, CASE h.horizon WHEN 'ret_prior' THEN ret_prior WHEN 'ret_same' THEN ret_same ELSE ret_next END AS y
  FROM panel, (SELECT unnest(['sentiment', 'momentum', 'attention_z', 'composite_bull', 'composite_bear']) AS signal) s, (SELECT unnest(['ret_prior', 'ret_same', 'ret_next']) AS horizon) h), {SPEAR.format(by="week_start, signal, horizon")},
lead_lag AS (SELECT signal, horizon, count(*) AS weeks, avg(ic) AS mean_ic, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(*))) END AS t_stat, avg(CAST(ic > 1e-12 AS INTEGER)) AS share_positive FROM ics WHERE ic IS NOT NULL GROUP BY ALL)"""
SPREAD = """k AS (SELECT week_start, ret_next AS y, count(*) OVER (PARTITION BY week_start) AS n, row_number() OVER (PARTITION BY week_start ORDER BY composite_bull, ticker) AS r FROM panel WHERE composite_bull IS NOT NULL AND ret_next IS NOT NULL),
b AS (SELECT week_start, y, greatest(((r - 1) * 5 + n - 2) // greatest(n - 1, 1), 1) - 1 AS b FROM k WHERE n >= 5), s AS (SELECT week_start, avg(y) FILTER (WHERE b = 4) - avg(y) FILTER (WHERE b = 0) AS spread FROM b GROUP BY week_start)"""
ADDED = f"""k AS (SELECT week_start, composite_bull AS a, rel_volume AS e, ret_next AS y FROM panel WHERE composite_bull IS NOT NULL AND rel_volume IS NOT NULL AND ret_next IS NOT NULL),
z AS (SELECT *, a + 0.15 * CASE WHEN count(*) OVER w < 2 OR stddev_pop(e) OVER w < 1e-12 THEN 0 ELSE (e - avg(e) OVER w) / stddev_pop(e) OVER w END AS b FROM k WINDOW w AS (PARTITION BY week_start)),
long AS (SELECT week_start, 'a' AS kind, a AS x, y FROM z UNION ALL SELECT week_start, 'b', b, y FROM z), {SPEAR.format(by="week_start, kind")}"""


def _hits(pick: str, n: int, side: str, require: str) -> str:
    beats = "ret_next > m" if side == "bull" else "ret_next < m"
    return f"""r AS (SELECT * FROM panel WHERE ret_next IS NOT NULL), m AS (SELECT week_start, median(ret_next) AS m FROM r GROUP BY week_start),
c AS (SELECT * FROM r WHERE {require} AND {pick} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY {pick} DESC, ticker) <= {n}),
hits AS (SELECT count(*) AS picks, count(*) FILTER (WHERE {beats}) AS hits, count(DISTINCT week_start) AS weeks, count(*) FILTER (WHERE {beats}) / nullif(count(*), 0) AS hit_rate FROM c JOIN m USING (week_start))"""


def _figures(part: str, ctes: str, source: str, **measures: str) -> str:
    inner = " UNION ALL ".join(f"SELECT '{k}' AS measure, CAST(({v}) AS DOUBLE) AS value FROM {source}" for k, v in measures.items())
    return f"SELECT '{part}' AS part, measure, round(value, 9) AS value FROM (WITH {ctes} {inner})"


BACKTEST = " UNION ALL ".join([
    _figures("panel", "w AS (SELECT count(DISTINCT week_start) AS n FROM panel WHERE ret_next IS NOT NULL)", "w", weeks_with_returns="n", enough_data="n >= 12"),
    *[_figures(f"ic_{side}", f"long AS (SELECT week_start, composite_{side} AS x, ret_next AS y FROM panel), {SPEAR.format(by='week_start')}, known AS (SELECT count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS sd, avg(CAST(ic > 1e-12 AS INTEGER)) AS p FROM ics WHERE ic IS NOT NULL)", "known", mean_ic="m", t_stat="CASE WHEN sd > 1e-12 THEN m / (sd / sqrt(n)) END", weeks="n", share_positive="p") for side in ("bull", "bear")],
    _figures("quintile_spread", f"{SPREAD}, q AS (SELECT avg(spread) AS m, count(*) AS n FROM s)", "q", mean="m", weeks="n"),
    *[_figures(f"{side}_{name}", _hits(pick.format(side), 20, side, need), "hits", picks="picks", hits="hits", hit_rate="hit_rate", weeks="weeks") for side, sign in (("bull", ">"), ("bear", "<")) for name, pick, need in (("list", "composite_{}", f"attention_z > 0 AND sentiment {sign} 0"), ("baseline_mentions", "mentions", "true"))],
    _figures("rel_volume", f"{ADDED}, q AS (SELECT avg(ic) FILTER (WHERE kind = 'a') AS a, avg(ic) FILTER (WHERE kind = 'b') AS b FROM ics)", "q", mean_ic_base="a", mean_ic_with="b", improves="b > a"),
])

_sentences = lambda text: f"[trim(x) FOR x IN string_split(regexp_replace(regexp_replace({text}, '([.!?])[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) IF trim(x) <> '']"

ORACLE = {
    "post_cashtags": f"WITH {TEXTS} SELECT id, array_to_string([x FOR x IN symbols IF x IS NOT NULL], ',') AS symbols FROM dollar WHERE len([x FOR x IN symbols IF x IS NOT NULL]) > 0",
    "extracted_tickers": f"WITH {EXTRACTED} SELECT id AS post_id, ticker, kind AS match_type, CAST(confidence AS DOUBLE) AS confidence FROM every QUALIFY row_number() OVER (PARTITION BY id, ticker ORDER BY confidence DESC, kind DESC) = 1",
    "p2_found": f"WITH {ROLLING} SELECT ticker, strftime(d, '%Y-%m-%d') AS on_day FROM totals WHERE d >= a + 29 AND count_30 >= 12 AND sum_7 * 30 > sum_30 * 21",
    "p2_totals": f"WITH {ROLLING} SELECT ticker, strftime(d, '%Y-%m-%d') AS on_day, sum_7, round(sum_7 / 7.0, 9) AS avg_7, count_7, sum_30, round(sum_30 / 30.0, 9) AS avg_30, count_30 FROM totals",
    "mentions_effective_scores": f"WITH {NOW}, {TICKERS}, {SCORES}, {EFFECTIVE} SELECT t.post_id, t.ticker, label, round(score, 9) AS score FROM posts_now p JOIN tickers_now t ON t.post_id = p.id LEFT JOIN effective e ON e.post_id = t.post_id AND e.ticker = t.ticker WHERE t.confidence >= 0.5",
    "attention_z": f"WITH {MENTIONS}, {_attention('mentions')} SELECT {_week}, ticker, round(attention_z, 9) AS attention_z FROM att",
    "weekly_components": f"WITH {MENTIONS}, {_components('mentions')} {SHOWN_COMPONENTS}",
    "composite_scores": f"WITH {MENTIONS}, {_components('mentions')} SELECT {_week}, ticker, {_rounded('composite_bull', 'composite_bear')} FROM composed",
    "filtered_mentions": f"WITH {FILTERED} SELECT {_week}, post_id, ticker, round(weight, 9) AS weight FROM filtered",
    "filtered_components": f"WITH {FILTERED}, {_components('filtered')} {SHOWN_COMPONENTS}",
    "weekly_ranking": f"""WITH {FILTERED}, {_components('filtered')}, {BARS}, {CONTEXT}, {FILINGS}, {EVENTS},
        placed AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY week) * (1 - CAST(0.9 AS DOUBLE)))) AS n, row_number() OVER (PARTITION BY week ORDER BY composite_bull DESC NULLS LAST, ticker) AS up_place, row_number() OVER (PARTITION BY week ORDER BY composite_bear DESC NULLS LAST, ticker) AS down_place FROM composed)
        SELECT strftime(p.week, '%Y-%m-%d') AS week, p.ticker, mentions, {_rounded('attention_z', 'sentiment', 'momentum', 'breadth', 'composite_bull', 'composite_bear', 'ret_5d', 'ret_30d', 'rel_volume', 'updown_vol_ratio')}, CAST(NULL AS BOOLEAN) AS insider_buy_flag,
          coalesce((up_place <= n OR down_place <= n) AND abs(ret_5d) < 0.03 AND rel_volume > 1.2, false) AS early_chatter_flag, events, coalesce(red_flag, false) AS red_flag
        FROM placed p LEFT JOIN context x ON x.week = p.week AND x.ticker = p.ticker LEFT JOIN events v ON v.week = p.week AND v.ticker = p.ticker""",
    "near_duplicate_posts": f"WITH {NOW}, {SIMHASH}, own AS (SELECT 0 AS week, id, created_at FROM posts_now), {_near_copies('own')} SELECT id AS post_id FROM copies",
    "session_context": f"WITH {BARS}, {CONTEXT} SELECT {_week}, ticker, {_rounded('ret_5d', 'ret_30d', 'rel_volume', 'updown_vol_ratio')} FROM context",
    "heating_up": f"""WITH {SIGNALS}, sides AS (SELECT week_start, ticker, 'bull' AS side, composite_bull AS v FROM signals_now WHERE attention_z > 0 AND sentiment > 0 UNION ALL SELECT week_start, ticker, 'bear', composite_bear FROM signals_now WHERE attention_z > 0 AND sentiment < 0)
        SELECT strftime(week_start, '%Y-%m-%d') AS week, side, CAST(row_number() OVER (PARTITION BY week_start, side ORDER BY v DESC NULLS LAST, ticker) AS INTEGER) AS rank, ticker FROM sides QUALIFY rank <= 20""",
    "drop_reposts": f"WITH {PM} SELECT id AS post_id, ticker FROM pm QUALIFY content_hash IS NULL OR id = first_value(id) OVER (PARTITION BY content_hash ORDER BY created_at, id)",
    "drop_syndicated": f"""WITH {PM}, k AS (SELECT *, CASE WHEN source = 'news' THEN nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') END AS h FROM pm)
        SELECT id AS post_id, ticker FROM k QUALIFY h IS NULL OR id = first_value(id) OVER (PARTITION BY h ORDER BY created_at, id)""",
    "drop_spam": f"WITH {NOW}, t AS (SELECT id, coalesce(title, '') || ' ' || coalesce(body, '') AS t FROM posts_now) SELECT id FROM t WHERE NOT {_any(SPAM, 't')}",
    "headline_kinds": f"WITH {NOW}, h AS (SELECT id, community, title AS t FROM posts_now WHERE title IS NOT NULL) SELECT id, CASE WHEN {_release} THEN 'press_release' WHEN {_any(PROMO, 't')} THEN 'promo' WHEN {_any(PRICE_RECAP, 't')} AND NOT {_any(FORECAST, 't')} THEN 'price_recap' ELSE 'news' END AS kind FROM h",
    "author_weights": f"""WITH {PM}, busy AS (SELECT block, author_id FROM pm WHERE source IN ('reddit', 'stocktwits') AND author_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 40)
        SELECT pm.id AS post_id, ticker, round(({_weight}) * CASE WHEN source IN ('reddit', 'stocktwits') AND busy.author_id IS NOT NULL THEN 0.1 ELSE 1 END, 9) AS author_weight FROM pm LEFT JOIN busy ON busy.block = pm.block AND busy.author_id = pm.author_id""",
    "cap_per_author": f"""WITH {PM} SELECT id AS post_id, ticker FROM pm QUALIFY author_id IS NULL OR source NOT IN ('reddit', 'stocktwits')
        OR row_number() OVER (PARTITION BY block, ticker, author_id, source IN ('reddit', 'stocktwits') ORDER BY coalesce(engagement, 0) DESC, id) <= 5""",
    "post_weights": f"WITH {NOW} SELECT id, round(ln(1 + greatest(greatest(coalesce(CAST(engagement AS DOUBLE), 0), 0), CASE WHEN source = 'news' THEN 10.0 ELSE 0 END)) * CASE WHEN source = 'news' THEN 0.5 ELSE 1.0 END, 9) AS weight FROM posts_now",
    "content_hashes": f"WITH {NOW} SELECT id, sha256(trim(regexp_replace(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS content, CASE WHEN coalesce(author_id, '') <> '' THEN substr(sha256(lower(author_id)), 1, 16) END AS author FROM posts_now",
    "headline_keys": f"WITH {NOW} SELECT id, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') AS headline FROM posts_now WHERE title IS NOT NULL",
    "company_names": f"""WITH b AS (SELECT ticker, company_name, trim(regexp_replace(regexp_replace(regexp_replace(company_name, {_words}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s&''-]', ' ', 'g'), '\\s+', ' ', 'g')) AS bare,
          lower(trim(regexp_replace(regexp_replace(regexp_replace(company_name, {_words}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS okey FROM ticker_universe)
        SELECT ticker, trim(regexp_replace(split_part(company_name, ' - ', 1), {_suffix}, '')) AS name, CASE WHEN length(okey) >= 4 THEN okey END AS org,
          coalesce(list_aggregate([x FOR x IN CASE WHEN length(split_part(lower(bare), ' ', 1)) >= 4 AND split_part(lower(bare), ' ', 1) <> lower(bare) THEN [lower(bare), split_part(lower(bare), ' ', 1)] ELSE [lower(bare)] END IF x <> ''], 'string_agg', '|'), '') AS keys FROM b""",
    "filing_items": f"WITH {FILINGS}, c AS (SELECT accession, [trim(x) FOR x IN string_split(coalesce(items, ''), ',') IF trim(x) <> '' AND trim(x) <> '9.01'] AS codes FROM filings_now) SELECT accession, coalesce(list_aggregate([coalesce({_name}[x], 'Item ' || x) FOR x IN codes], 'string_agg', '; '), '') AS described FROM c",
    "filing_events": f"WITH {FILINGS}, {EVENTS.replace('WHERE form IN', 'WHERE true OR form IN')} SELECT ticker, {_week}, events, red_flag FROM events",
    "dollar_volume": f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars) SELECT ticker, round(avg(close * volume), 2) AS avg_dollar_volume FROM k WHERE back <= 30 GROUP BY ticker HAVING avg(close * volume) > 0",
    "early_chatter": f"""WITH {SIGNALS}, k AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY week_start) * (1 - CAST(0.9 AS DOUBLE)))) AS n, row_number() OVER (PARTITION BY week_start ORDER BY composite_bull DESC NULLS LAST, ticker) AS b, row_number() OVER (PARTITION BY week_start ORDER BY composite_bear DESC NULLS LAST, ticker) AS s FROM signals_now)
        SELECT strftime(week_start, '%Y-%m-%d') AS week, ticker, coalesce((b <= n OR s <= n) AND abs(ret_5d) < 0.03 AND rel_volume > 1.2, false) AS early_chatter_flag, coalesce(rel_volume > 1.2 AND ret_5d < -0.02 AND sentiment > 0, false) AS divergence FROM k""",
    "return_panel": f"WITH {PANEL} SELECT strftime(week_start, '%Y-%m-%d') AS week, ticker, round(ret_prior, 9) AS ret_prior, round(ret_same, 9) AS ret_same, round(ret_next, 9) AS ret_next FROM panel",
    "lead_lag": f"WITH {PANEL}, {LEADLAG} SELECT signal, horizon, weeks, {_rounded('mean_ic', 't_stat', 'share_positive')} FROM lead_lag",
    "quintile_spread": f"WITH {PANEL}, {SPREAD} SELECT strftime(week_start, '%Y-%m-%d') AS week, round(spread, 9) AS spread, round(product(1 + spread) OVER (ORDER BY week_start ROWS UNBOUNDED PRECEDING) - 1, 9) AS cumulative FROM s",
    "hit_rate": f"WITH {PANEL}, {_hits('composite_bull', 10, 'bull', 'sentiment > 0')} SELECT picks, hits, weeks, round(hit_rate, 9) AS hit_rate FROM hits",
    "added_signal": f"WITH {PANEL}, {ADDED} SELECT round(avg(ic) FILTER (WHERE kind = 'a'), 9) AS mean_ic_base, round(avg(ic) FILTER (WHERE kind = 'b'), 9) AS mean_ic_with, avg(ic) FILTER (WHERE kind = 'b') > avg(ic) FILTER (WHERE kind = 'a') AS improves FROM ics",
    "backtest": f"WITH {PANEL} {BACKTEST}",
    "verdicts": f"""WITH {PANEL}, {LEADLAG} SELECT signal, CASE WHEN n IS NULL OR p IS NULL THEN 'unknown' WHEN abs(nt) >= 2 AND n > 0 AND abs(n) >= abs(p) THEN 'leads' WHEN abs(nt) >= 2 AND n < 0 THEN 'reverse' WHEN abs(pt) >= 2 AND abs(p) > abs(n) THEN 'follows' ELSE 'none' END AS verdict
        FROM (SELECT signal, max(mean_ic) FILTER (WHERE horizon = 'ret_prior') AS p, max(t_stat) FILTER (WHERE horizon = 'ret_prior') AS pt, max(mean_ic) FILTER (WHERE horizon = 'ret_next') AS n, max(t_stat) FILTER (WHERE horizon = 'ret_next') AS nt FROM lead_lag GROUP BY signal)""",
    "scorer_agreement": f"""WITH {SCORES}, l AS (SELECT * FROM scores_now WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id, ticker, model ORDER BY scored_at DESC, score DESC) = 1),
        b AS (SELECT t.score AS t, m.score AS m FROM l t JOIN l m ON m.post_id = t.post_id AND m.ticker = t.ticker WHERE t.model = 'stocktwits_tag' AND m.model = 'lextone'),
        c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE abs(m) > 0.1 AND sign(m) = sign(t)) AS agree, count(*) FILTER (WHERE abs(m) <= 0.1) AS neutral, count(*) FILTER (WHERE abs(m) > 0.1 AND sign(m) <> sign(t)) AS opposite FROM b)
        SELECT pairs, agree, neutral, opposite, round(agree / nullif(pairs, 0), 9) AS accuracy, round(agree / nullif(agree + opposite, 0), 9) AS accuracy_when_decisive FROM c""",
    "untagged_posts": f"WITH {NOW}, {TYPED} SELECT id FROM posts_now p WHERE NOT EXISTS (SELECT 1 FROM typed t WHERE t.post_id = p.id AND t.match_type <> 'source')",
    "pending_pairs": f"WITH {NOW}, {TICKERS}, {SCORES}, todo AS (SELECT post_id, ticker FROM tickers_now t WHERE NOT EXISTS (SELECT 1 FROM scores_now s WHERE s.model = 'secondpass' AND s.post_id = t.post_id AND s.ticker = t.ticker)) SELECT post_id, ticker, count(*) OVER (PARTITION BY post_id) AS n_tickers FROM todo WHERE post_id IN (SELECT id FROM posts_now)",
    "post_sentences": f"WITH {NOW}, p AS (SELECT id, {_sentences('body')} AS s FROM posts_now WHERE body IS NOT NULL) SELECT id, CAST(len(s) AS INTEGER) AS n FROM p",
    "lexicon_scores": f"""WITH {NOW}, {TICKERS}, pairs AS (SELECT p.id, t.ticker, concat_ws(chr(10), nullif(title, ''), nullif(body, '')) AS whole, count(*) OVER (PARTITION BY p.id) AS n FROM tickers_now t JOIN posts_now p ON p.id = t.post_id),
        named AS (SELECT *, [x FOR x IN {_sentences('whole')} IF regexp_matches(x, '(?i)(?:^|[^{WORD}$])\\$?' || regexp_escape(ticker) || '(?:$|[^{WORD}])')] AS own FROM pairs),
        words AS (SELECT id, ticker, regexp_extract_all(lower(CASE WHEN n > 1 AND len(own) > 0 THEN array_to_string(own, ' ') ELSE whole END), '\\p{{L}}+') AS w FROM named),
        counts AS (SELECT *, len([x FOR x IN w IF x IN ({", ".join(map(_q, sorted(LexiconScorer().positive)))})]) AS p, len([x FOR x IN w IF x IN ({", ".join(map(_q, sorted(LexiconScorer().negative)))})]) AS m FROM words),
        s AS (SELECT *, CASE WHEN p + m > 0 THEN (p - m) / (p + m) ELSE 0 END AS score FROM counts)
        SELECT id AS post_id, ticker, CASE WHEN score > 0.1 THEN 'pos' WHEN score < -0.1 THEN 'neg' ELSE 'neu' END AS label, CAST(score AS DOUBLE) AS score FROM s""",
    "trained_scores": f"""WITH {NOW}, {SCORES}, texts AS (SELECT id, regexp_extract_all(lower(concat_ws(chr(10), title, body)), '\\p{{L}}+') AS w FROM posts_now),
        labelled AS (SELECT label, w FROM scores_now JOIN texts ON id = post_id WHERE model = 'secondpass' AND label IN ('pos', 'neg', 'neu')), each AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest(w) AS word FROM labelled) GROUP BY ALL),
        l AS (SELECT unnest(['pos', 'neg', 'neu']) AS label), size AS (SELECT count(DISTINCT word) AS v FROM each), mass AS (SELECT l.label, coalesce(sum(n), 0) AS n FROM l LEFT JOIN each ON each.label = l.label GROUP BY l.label),
        prior AS (SELECT l.label, ln((count(labelled.label) + 1) / CAST((SELECT count(*) FROM labelled) + 3 AS DOUBLE)) AS lp FROM l LEFT JOIN labelled ON labelled.label = l.label GROUP BY l.label),
        model AS (SELECT word, mass.label, ln((coalesce(max(each.n) FILTER (WHERE each.label = mass.label), 0) + 1) / CAST(mass.n + v AS DOUBLE)) AS lp FROM each, mass, size GROUP BY word, mass.label, mass.n, v),
        sums AS (SELECT id, label, sum(lp) AS lp FROM (SELECT id, unnest(w) AS word FROM texts) JOIN model USING (word) GROUP BY ALL),
        logs AS (SELECT texts.id, prior.label, coalesce(sums.lp, 0) + prior.lp AS lp FROM texts CROSS JOIN prior LEFT JOIN sums ON sums.id = texts.id AND sums.label = prior.label),
        wide AS (SELECT id, max(lp) FILTER (WHERE label = 'pos') AS a, max(lp) FILTER (WHERE label = 'neg') AS b, max(lp) FILTER (WHERE label = 'neu') AS c FROM logs GROUP BY id),
        shares AS (SELECT id, 1 / (1 + exp(least(b - a, 700)) + exp(least(c - a, 700))) AS p, 1 / (exp(least(a - b, 700)) + 1 + exp(least(c - b, 700))) AS m, 1 / (exp(least(a - c, 700)) + exp(least(b - c, 700)) + 1) AS u FROM wide)
        SELECT id, CASE WHEN p >= greatest(m, u) THEN 'pos' WHEN m >= u THEN 'neg' ELSE 'neu' END AS label, round(p - m, 6) AS score FROM shares""",
    "second_pass_picks": f"""WITH {NOW}, {TICKERS}, {SCORES}, base AS (SELECT * FROM scores_now WHERE model = 'lextone' AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id, ticker ORDER BY scored_at DESC, score DESC) = 1),
        k AS (SELECT p.id AS post_id, t.ticker, p.engagement, b.score, row_number() OVER (PARTITION BY t.ticker, date_trunc('week', p.created_at) ORDER BY p.engagement DESC NULLS LAST, p.id) <= 5 AS top FROM posts_now p JOIN tickers_now t ON t.post_id = p.id JOIN base b ON b.post_id = p.id AND b.ticker = t.ticker WHERE p.created_at >= TIMESTAMP '2025-06-17')
        SELECT post_id, ticker, top FROM k WHERE (top OR abs(score) < 0.3) AND NOT EXISTS (SELECT 1 FROM scores_now s WHERE s.model = 'secondpass' AND s.post_id = k.post_id AND s.ticker = k.ticker) ORDER BY top DESC, engagement DESC NULLS LAST, post_id, ticker LIMIT 2000""",
    "week_summary": f"WITH {WEEKM} SELECT ticker, count(*) AS mentions, count(DISTINCT id) AS posts, count(DISTINCT author_id) AS authors, count(*) FILTER (WHERE label = 'pos') AS pos, count(*) FILTER (WHERE label = 'neg') AS neg, count(*) FILTER (WHERE label = 'neu') AS neu, round(avg(score), 12) AS avg_score FROM wm GROUP BY ticker",
    "community_breakdown": f"WITH {WEEKM} SELECT source, community, count(*) AS posts, round(avg(score), 12) AS avg_score FROM wm GROUP BY ALL",
    "top_posts": f"WITH {WEEKM}, f AS (SELECT * FROM wm WHERE ticker = {TOP} QUALIFY row_number() OVER (PARTITION BY coalesce(content_hash, id) ORDER BY created_at, id) = 1) SELECT id AS post_id, engagement, coalesce(title, body) AS title FROM f ORDER BY engagement DESC NULLS LAST, created_at DESC, id LIMIT 25",
    "daily_trend": f"""WITH {NOW}, {TICKERS}, {SCORES}, {EFFECTIVE}, {BARS}, d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2025-04-01', TIMESTAMP '2025-05-31', INTERVAL 1 DAY)) AS DATE) AS on_day),
        m AS (SELECT CAST(created_at AS DATE) AS on_day, count(*) AS n, avg(score) AS s FROM posts_now p JOIN tickers_now t ON t.post_id = p.id LEFT JOIN effective e ON e.post_id = p.id AND e.ticker = t.ticker WHERE t.ticker = {TOP} GROUP BY ALL)
        SELECT strftime(d.on_day, '%Y-%m-%d') AS on_day, coalesce(n, 0) AS mentions, round(s, 12) AS avg_score, round(close, 9) AS close FROM d LEFT JOIN m ON m.on_day = d.on_day LEFT JOIN bars b ON b.date = d.on_day AND b.ticker = {TOP}""",
    "tracked_tickers": f"WITH {TICKERS} SELECT ticker, count(*) AS mentions FROM tickers_now GROUP BY ticker",
    "ticker_picker": f"""WITH {NOW}, {TICKERS}, m AS (SELECT ticker, count(*) AS n FROM tickers_now WHERE post_id IN (SELECT id FROM posts_now WHERE created_at >= TIMESTAMP '2025-06-20') GROUP BY ticker ORDER BY n DESC, ticker LIMIT 50),
        u AS (SELECT ticker, 0 AS part, -CAST(n AS DOUBLE) AS key FROM m UNION ALL SELECT {TICKER}, 1, -avg_dollar_volume_30d FROM ticker_universe WHERE avg_dollar_volume_30d IS NOT NULL), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY part, key) = 1)
        SELECT ticker, CAST(row_number() OVER (ORDER BY part, key, ticker) AS INTEGER) AS place FROM b QUALIFY place <= 100""",
    "week_filings": f"""WITH {FILINGS}, c AS (SELECT accession, ticker, [trim(x) FOR x IN string_split(coalesce(items, ''), ',') IF trim(x) <> '' AND trim(x) <> '9.01'] AS codes FROM filings_now WHERE form IN ('8-K', '8-K/A') AND coalesce(accepted_at, CAST(filing_date AS TIMESTAMP)) >= TIMESTAMP '2025-05-10' AND coalesce(accepted_at, CAST(filing_date AS TIMESTAMP)) < TIMESTAMP '2025-05-17')
        SELECT accession, ticker, coalesce(list_aggregate([coalesce({_name}[x], 'Item ' || x) FOR x IN codes], 'string_agg', ', '), '') AS items FROM c""",
    "stamps_grid": "SELECT strftime(unnest(generate_series(TIMESTAMP '2025-05-09 23:15:00', TIMESTAMP '2025-05-12 01:00:00', INTERVAL 15 MINUTE)), '%Y%m%d%H%M%S') AS stamp",
    "week_calendar": f"WITH {NOW} SELECT id, strftime({FRIDAY}, '%Y-%m-%d') AS friday, strftime({FRIDAY} - 4, '%Y-%m-%d') AS week_start FROM posts_now",
}
