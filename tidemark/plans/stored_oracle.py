"""DuckDB SQL for the queries of :mod:`tidemark.plans.stored`."""

from __future__ import annotations

from tidemark.operators.read_api import KIND_LABELS
from tidemark.plans.oracle import BARS, FILINGS, NOW, SCORES, SIGNALS, TICKER, TOP, TICKERS, TYPED, WEEKM, _kind, _q, _rounded

_friday = "d + CAST((12 - isodow(d)) % 7 AS INTEGER)"
_rank = lambda side: f"""SELECT '{side}' AS side, CAST(row_number() OVER (ORDER BY composite_{side} DESC NULLS LAST, ticker) AS INTEGER) AS rank, *, composite_{side} AS composite
  FROM signals_now WHERE week_start = DATE '2025-05-12' AND attention_z > 0 AND sentiment {'>' if side == 'bull' else '<'} 0 QUALIFY rank <= 20"""  # noqa: E731
RANKED = f"ranked AS ({_rank('bull')} UNION ALL {_rank('bear')})"
NAMES = f"names AS (SELECT {TICKER} AS ticker, max(company_name) AS company_name FROM ticker_universe GROUP BY 1)"
CANONICAL = f"(SELECT * REPLACE ({TICKER} AS ticker) FROM {{}})"

ORACLE = {
    "upsert_posts_state": """WITH k AS (SELECT *, collected_at < TIMESTAMP '2025-06-01' AS early FROM posts), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id, early ORDER BY collected_at DESC, engagement DESC NULLS LAST) = 1)
        SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.engagement ELSE o.engagement END AS engagement, epoch_us(coalesce(o.collected_at, n.collected_at)) AS collected_us FROM (SELECT * FROM l WHERE early) o FULL JOIN (SELECT * FROM l WHERE NOT early) n ON o.id = n.id""",
    "insert_absent_state": f"""WITH {SCORES}, k AS (SELECT *, model <> 'lextone' AS other FROM scores_now)
        SELECT post_id, ticker, label, round(score, 9) AS score FROM k QUALIFY row_number() OVER (PARTITION BY post_id, ticker ORDER BY other, label DESC NULLS LAST, score DESC NULLS LAST, scored_at DESC NULLS LAST) = 1""",
    "upsert_prices_state": f"""WITH k AS (SELECT * FROM {CANONICAL.format('prices_daily')} WHERE close IS NOT NULL AND NOT isnan(close)),
        a AS (SELECT ticker, date, close, CAST(round_even(volume / 2.0, 0) AS BIGINT) AS volume FROM k QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY CAST(round_even(volume / 2.0, 0) AS BIGINT) DESC NULLS LAST, open DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, close DESC) = 1),
        b AS (SELECT ticker, date, min(close) AS close FROM k WHERE date >= DATE '2025-04-01' GROUP BY ALL)
        SELECT ticker, strftime(date, '%Y-%m-%d') AS date, coalesce(b.close, a.close) AS close, CASE WHEN b.close IS NULL THEN a.volume END AS volume FROM a LEFT JOIN b USING (ticker, date)""",
    "replace_tags_state": f"""WITH {NOW}, {TYPED}, touched AS (SELECT id FROM posts_now WHERE created_at >= TIMESTAMP '2025-06-01'), kept AS (SELECT * FROM typed WHERE match_type = 'source' OR post_id NOT IN (SELECT id FROM touched))
        SELECT * FROM kept UNION ALL SELECT post_id, ticker, 'bare', 0.5 FROM typed WHERE match_type IS DISTINCT FROM 'source' AND confidence > 0.7 AND post_id IN (SELECT id FROM touched)""",
    "source_tags_state": f"""WITH {NOW}, {TICKERS}, m AS (SELECT id, CASE WHEN length(body) % 3 > 0 THEN length(body) % 3 * 2 - 3 END AS mood FROM posts_now WHERE source = 'stocktwits')
        SELECT post_id, ticker, 'source' AS match_type, CAST(0.9 AS DOUBLE) AS confidence, CASE WHEN mood IS NOT NULL THEN 'stocktwits_tag' END AS model, CASE WHEN mood > 0 THEN 'pos' WHEN mood < 0 THEN 'neg' END AS label, CAST(mood AS DOUBLE) AS score
        FROM tickers_now JOIN m ON m.id = post_id WHERE ticker IN (SELECT {TICKER} FROM ticker_universe WHERE exchange = 'NYSE')""",
    "universe_state": f"SELECT ticker, company_name, exchange, market_cap, avg_dollar_volume_30d FROM {CANONICAL.format('ticker_universe')}",
    "write_week_state": f"""WITH {SIGNALS} SELECT strftime(week_start, '%Y-%m-%d') AS week, ticker, mentions, round(composite_bull, 9) AS composite_bull, round(sentiment, 9) AS sentiment, events FROM signals_now WHERE week_start <> DATE '2025-05-12'
        UNION ALL SELECT '2025-05-12', ticker, mentions, round(composite_bull, 9), round(sentiment, 9), NULL FROM signals_now WHERE week_start = DATE '2025-05-05' AND composite_bull > 0""",
    "filings_state": f"WITH {FILINGS} SELECT accession, ticker, form, CASE WHEN form = '8-K/A' THEN 'first' ELSE items END AS items FROM filings_now",
    "insider_cache_state": f"""WITH {FILINGS}, s AS (SELECT ticker, filing_date AS d, length(url) % 3 > 0 AS bought FROM filings_now WHERE url IS NOT NULL AND filing_date IS NOT NULL),
        w AS (SELECT *, {_friday} + 7 * j AS f FROM s, (SELECT CAST(unnest(range(6)) AS INTEGER) AS j))
        SELECT strftime(f - 4, '%Y-%m-%d') AS week, ticker, bool_or(bought) AS insider_buy_flag FROM w WHERE f - d < 30 GROUP BY f, ticker""",
    "ledger_state": """WITH k AS (SELECT strftime(date_trunc('hour', collected_at), '%Y%m%d%H%M%S') AS stamp, CASE WHEN engagement > 20 THEN 'done' ELSE 'error' END AS status, collected_at, coalesce(engagement, -1) AS e FROM posts)
        SELECT stamp, status FROM k QUALIFY row_number() OVER (PARTITION BY stamp ORDER BY e % 2 <> 0 DESC, collected_at DESC, e DESC) = 1""",
    "available_weeks": f"WITH {SIGNALS} SELECT DISTINCT strftime(week_start, '%Y-%m-%d') AS week FROM signals_now",
    "ranked_tables": f"WITH {SIGNALS}, {RANKED}, {NAMES} SELECT side, rank, ranked.ticker, company_name, round(composite, 9) AS composite, mentions, {_rounded('attention_z', 'sentiment', 'momentum', 'breadth', 'ret_5d', 'ret_30d', 'rel_volume')}, events, red_flag FROM ranked LEFT JOIN names ON names.ticker = ranked.ticker",
    "red_flag_panel": f"""WITH {SIGNALS}, ranked AS (SELECT *, 0 AS side, row_number() OVER (PARTITION BY week_start ORDER BY composite_bull DESC NULLS LAST, ticker) AS rank FROM signals_now WHERE attention_z > 0 AND sentiment > 0
          UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY week_start ORDER BY composite_bear DESC NULLS LAST, ticker) FROM signals_now WHERE attention_z > 0 AND sentiment < 0)
        SELECT strftime(week_start, '%Y-%m-%d') AS week, ticker, events FROM ranked WHERE rank <= 20 AND red_flag QUALIFY row_number() OVER (PARTITION BY week_start, ticker ORDER BY side, rank) = 1""",
    "eligible_count": f"WITH {SIGNALS} SELECT count(*) AS n FROM signals_now WHERE week_start = DATE '2025-05-12'",
    "company_name": f"WITH {TICKERS}, {NAMES} SELECT max(company_name) AS company_name FROM names WHERE ticker = {TOP}",
    "weekly_history": f"WITH {SIGNALS}, {TICKERS} SELECT strftime(week_start, '%Y-%m-%d') AS week, mentions, {_rounded('attention_z', 'sentiment', 'momentum', 'composite_bull', 'composite_bear')} FROM signals_now WHERE ticker = {TOP}",
    "week_tape": f"WITH {SIGNALS} SELECT ticker, {_rounded('sentiment', 'momentum')}, mentions FROM signals_now WHERE week_start = DATE '2025-05-12'",
    "ticker_summary": f"""WITH {WEEKM}, {SIGNALS}, t AS (SELECT ticker, count(*) AS mentions, count(DISTINCT id) AS posts, count(DISTINCT author_id) AS authors, count(*) FILTER (WHERE label = 'pos') AS pos, count(*) FILTER (WHERE label = 'neg') AS neg, count(*) FILTER (WHERE label = 'neu') AS neu, avg(score) AS avg_score FROM wm GROUP BY ticker)
        SELECT t.ticker, t.mentions, posts, authors, pos, neg, neu, round(avg_score, 12) AS avg_score, round(s.sentiment, 9) AS ranked_sentiment, {_rounded('momentum', 'ret_5d', 'ret_30d', 'rel_volume', 'updown_vol_ratio')}, early_chatter_flag, insider_buy_flag, events, red_flag
        FROM t LEFT JOIN (SELECT * FROM signals_now WHERE week_start = DATE '2025-05-12') s ON s.ticker = t.ticker""",
    "top_post_kinds": f"""WITH {WEEKM}, kinds AS (SELECT post_id, {TICKER} AS ticker, min(match_type) AS match_type FROM (SELECT * FROM post_tickers QUALIFY row_number() OVER (PARTITION BY post_id, {TICKER} ORDER BY coalesce(confidence, -1) DESC, match_type DESC) = 1) GROUP BY ALL),
        f AS (SELECT * FROM wm WHERE ticker = {TOP} QUALIFY row_number() OVER (PARTITION BY coalesce(content_hash, id) ORDER BY created_at, id) = 1),
        p AS (SELECT *, coalesce(title, body, '') AS t FROM f ORDER BY engagement DESC NULLS LAST, created_at DESC, id LIMIT 25)
        SELECT id AS post_id, kinds.match_type, CASE WHEN source = 'news' THEN map {{{", ".join(f"{_q(k)}: {_q(v)}" for k, v in KIND_LABELS.items())}}}[{_kind}] END AS kind_label FROM p JOIN kinds ON kinds.post_id = p.id AND kinds.ticker = p.ticker""",
    "daily_prices": f"WITH {BARS}, {TICKERS} SELECT strftime(date, '%Y-%m-%d') AS date, close, volume FROM bars WHERE ticker = {TOP} AND date >= DATE '2025-05-17' - 90 AND date < DATE '2025-05-17'",
}
