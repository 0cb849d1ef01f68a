"""DuckDB SQL for the queries of :mod:`tidemark.plans.sourced`."""

from __future__ import annotations

from tidemark.plans.oracle import BARS, FILINGS, NOW, TICKER, TICKERS, _key, _names, _suffix

_equity = lambda n: f"NOT (contains(t, '$') OR regexp_matches({n}, '(?i)warrant|\\brights?\\b|preferred|\\bnotes?\\b|debenture|subordinated|\\d+(\\.\\d+)?%') OR (regexp_matches({n}, '(?i)\\bunits?\\b') AND NOT regexp_matches({n}, '(?i)common units|limited partner')))"
_clean = lambda n: f"trim(regexp_replace(split_part({n}, ' - ', 1), {_suffix}, ''))"
_title = "trim(regexp_replace(title, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'))"
NEWS = f"""{NOW}, {TICKERS}, companies AS (SELECT {TICKER} AS ticker, company_name, avg_dollar_volume_30d AS liquidity, {_key} AS k FROM ticker_universe),
news AS (SELECT p.id, p.created_at, t.ticker, company_name, CASE WHEN length(p.id) % 3 = ascii(right(p.id, 1)) % 3 THEN company_name || ' & ' || {_title} ELSE {_title} END AS title FROM posts_now p JOIN tickers_now t ON t.post_id = p.id JOIN companies c ON c.ticker = t.ticker WHERE source = 'news' AND title IS NOT NULL),
orgs AS (SELECT k AS org, ticker FROM companies WHERE length(k) >= 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN isnan(liquidity) THEN NULL ELSE liquidity END DESC NULLS LAST, ticker) = 1)"""

ORACLE = {
    "parsed_listings": f"""WITH r AS (SELECT {TICKER} AS t, coalesce(company_name, '') AS n, length(coalesce(company_name, '')) % 5 AS k FROM ticker_universe),
        a AS (SELECT t, n || CASE k WHEN 1 THEN ' - Warrant' WHEN 2 THEN ' Class A Common Stock' ELSE ' - Common Stock' END AS n FROM r WHERE length(t) = 5 AND k NOT IN (3, 4)),
        b AS (SELECT t, n || ' Ordinary Shares' AS n, ['NYSE', 'NYSE American', NULL][ascii(t) % 3 + 1] AS exchange FROM r),
        u AS (SELECT 0 AS i, t AS ticker, {_clean('trim(n)')} AS company_name, 'NASDAQ' AS exchange FROM a WHERE {_equity('n')} UNION ALL SELECT 1, t, {_clean('trim(n)')}, exchange FROM b WHERE exchange IS NOT NULL AND {_equity('n')})
        SELECT ticker, company_name, exchange FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY i, company_name) = 1""",
    "liquid_universe": f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), v AS (SELECT ticker, avg(close * volume) AS v FROM k WHERE back <= 30 GROUP BY ticker HAVING avg(close * volume) > 0),
        u AS (SELECT {TICKER} AS ticker, market_cap FROM ticker_universe) SELECT u.ticker, round(v, 2) AS avg_dollar_volume_30d, CASE WHEN v >= 1e7 THEN market_cap END AS market_cap FROM u LEFT JOIN v ON v.ticker = u.ticker""",
    "bulk_news": f"""WITH {NEWS}, keyed AS (SELECT ticker, k, split_part(k, ' ', 1) AS w FROM companies),
        hit AS (SELECT 'u/' || id AS url, title, created_at, news.ticker FROM news JOIN orgs ON orgs.ticker = news.ticker JOIN keyed ON keyed.ticker = news.ticker
          WHERE length(title) >= 20 AND ({_names("title || ' '", "news.ticker")} OR {_names("lower(title) || ' '", "k")} OR (length(w) >= 4 AND {_names("lower(title) || ' '", "w")})))
        SELECT url, min(title) AS title, min(CASE WHEN second(created_at) % 2 = 0 THEN epoch_us(date_trunc('minute', created_at)) ELSE epoch_us(date_trunc('second', created_at)) END) AS created_us, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM hit GROUP BY url""",
    "company_news": f"WITH {NEWS} SELECT id AS url, id AS title, epoch_us(date_trunc('second', min(created_at))) // 1000000 AS created_s, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM news WHERE date_trunc('second', created_at) >= TIMESTAMP '2025-03-01' GROUP BY id",
    "parsed_filings": f"""WITH {FILINGS} SELECT accession, form, strftime(filing_date, '%Y-%m-%d') AS filing_date, epoch_us(accepted_at) // 1000 AS accepted_ms, nullif(items, '') AS items FROM filings_now WHERE form IN ('8-K', '8-K/A') AND filing_date BETWEEN DATE '2025-02-01' AND DATE '2025-05-31'""",
    "message_stream": f"""WITH {NOW}, {TICKERS}, m AS (SELECT *, CAST('0x' || substr(md5(id), 1, 12) AS BIGINT) AS n FROM posts_now WHERE source = 'stocktwits' AND body IS NOT NULL AND date_trunc('second', created_at) >= TIMESTAMP '2025-03-01')
        SELECT 'stocktwits:' || n AS id, body, coalesce(engagement, 0) + 2 AS engagement, CAST(DATE '2025-08-01' - CAST(created_at AS DATE) + 10 AS INTEGER) AS author_age_days, author_karma, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM tickers_now t WHERE t.post_id = m.id) AS tickers,
          CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS mood FROM m""",
    "forum_listing": f"""WITH {NOW} SELECT 'reddit:' || id AS id, title, coalesce(community, 'none') AS community, coalesce(engagement, 0) + 1 AS engagement, CASE WHEN length(author_id) % 4 > 0 THEN length(author_id) + 5 END AS author_karma,
        CASE WHEN length(author_id) % 4 > 0 THEN CAST(floor((epoch(TIMESTAMP '2025-08-01') - 1700000000) / 86400) AS INTEGER) END AS author_age_days, coalesce(body, '') = '' AS bodyless
        FROM posts_now WHERE source = 'reddit' AND title IS NOT NULL AND date_trunc('second', created_at) >= TIMESTAMP '2025-03-01' AND coalesce(lower(author_id), '') NOT IN ('u1', 'automod')""",
    "parsed_reports": f"""WITH {BARS}, b AS (SELECT ticker, day(date) * CASE WHEN volume % 5 = 0 THEN 0 ELSE floor(close) END AS v FROM bars WHERE date < DATE '2025-03-01' AND volume % 6 = 0)
        SELECT u.ticker, CAST(count(v) AS INTEGER) AS purchase_count, CAST(coalesce(sum(v), 0) AS DOUBLE) AS purchase_value FROM (SELECT {TICKER} AS ticker FROM ticker_universe) u LEFT JOIN b ON b.ticker = u.ticker GROUP BY u.ticker""",
    "stream_upserted": f"WITH {NOW} SELECT id, engagement, content_hash FROM posts_now",
    "stream_weekly_counts": """WITH w AS (SELECT CAST(created_at AS DATE) - CAST((isodow(created_at) + 1) % 7 AS INTEGER) AS week, source, engagement FROM posts)
        SELECT strftime(week, '%Y-%m-%d') AS week, source, count(*) AS posts, CAST(sum(engagement) AS BIGINT) AS engagement FROM w WHERE week + 7 <= (SELECT max(created_at) - INTERVAL 36 HOUR FROM posts) GROUP BY ALL""",
    "pending_files": f"""WITH {NOW}, l AS (SELECT strftime(time_bucket(INTERVAL 15 MINUTE, created_at), '%Y%m%d%H%M%S') AS stamp FROM posts_now GROUP BY 1 HAVING max(engagement) > 5),
        g AS (SELECT t, strftime(t, '%Y%m%d%H%M%S') AS stamp FROM (SELECT unnest(generate_series(TIMESTAMP '2025-05-13 07:45:00', TIMESTAMP '2025-05-15 07:15:00', INTERVAL 15 MINUTE)) AS t))
        SELECT stamp FROM g WHERE minute(t) < 45 AND stamp NOT IN (SELECT stamp FROM l)""",
}
