"""DuckDB SQL over the same tables for the queries that SQL can express on whole tables."""

TICKER = "replace(regexp_replace(upper(trim(ticker, ' \t\n\r')), '^\\$', ''), '-', '.')"
POSTS = """posts_now AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY collected_at DESC, engagement DESC) = 1)"""
PAIRS = f"pairs AS (SELECT DISTINCT post_id, {TICKER} AS ticker FROM post_tickers)"
AUTHORED = f"""{POSTS}, {PAIRS}, authored AS (
  SELECT lower(trim(author_id, ' \t\n\r')) AS author, ticker, post_id, engagement,
         CAST(created_at AS DATE) - CAST((isodow(created_at) + 1) % 7 AS INTEGER) AS week
  FROM pairs JOIN posts_now ON id = post_id WHERE author_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY author, ticker, week ORDER BY engagement DESC NULLS LAST, post_id) AS place FROM authored)"""
COMMUNITY = "regexp_replace(lower(trim(community, ' \t\n\r')), '^r/', '')"
FORM = r"regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
LINES = f"""cut AS (SELECT DISTINCT id, {COMMUNITY} AS c, regexp_split_to_array(body, '\\r?\\n') AS parts FROM posts WHERE community IS NOT NULL AND body IS NOT NULL),
lines AS (SELECT id, c, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM cut),
formed AS (SELECT id, c, line_no, {FORM} AS form FROM lines),
frequent AS (SELECT c, form FROM formed WHERE form <> '' GROUP BY c, form HAVING count(DISTINCT id) >= 10)"""

ORACLE = {
    "p1_found": f"WITH {AUTHORED} SELECT post_id, ticker FROM placed WHERE place > 5",
    "p1_kept": f"WITH {AUTHORED} SELECT author, ticker, strftime(week, '%Y-%m-%d') AS week, post_id, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 5",
    "p1_share": f"""WITH {AUTHORED}, n AS (SELECT ticker, count(*) AS n FROM pairs JOIN posts_now ON id = post_id GROUP BY ticker),
        ranked AS (SELECT post_id, ticker, row_number() OVER (PARTITION BY ticker, author ORDER BY engagement DESC NULLS LAST, post_id) AS place FROM authored)
        SELECT post_id, ticker, place FROM ranked JOIN n USING (ticker) WHERE place > greatest(1, floor(n * CAST(0.1 AS DOUBLE)))""",
    "p3_found": f"WITH {LINES} SELECT DISTINCT id AS post_id, CAST(line_no AS INTEGER) AS line_no FROM formed JOIN frequent USING (c, form)",
    "p3_share": f"""WITH {LINES}, every AS (SELECT {COMMUNITY} AS c, count(DISTINCT id) AS n FROM posts WHERE community IS NOT NULL GROUP BY 1),
        shared AS (SELECT c, form FROM formed JOIN every USING (c) WHERE form <> '' GROUP BY c, form, n HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) >= n * CAST(0.05 AS DOUBLE))
        SELECT DISTINCT id AS post_id, CAST(line_no AS INTEGER) AS line_no FROM formed JOIN shared USING (c, form)""",
    "p3_cleaned": f"""WITH {LINES}, hit AS (SELECT id, list(DISTINCT line_no) AS gone FROM formed JOIN frequent USING (c, form) GROUP BY id),
        p AS (SELECT posts.id, collected_at, body, gone, string_split(body, chr(10)) AS parts FROM posts LEFT JOIN hit ON hit.id = posts.id)
        SELECT id, collected_at, CASE WHEN body IS NULL OR gone IS NULL THEN body
          ELSE array_to_string([CASE WHEN i < len(parts) THEN parts[i] || chr(10) ELSE parts[i] END FOR i IN range(1, len(parts) + 1) IF NOT list_contains(gone, i - 1)], '') END AS body FROM p""",
    "p4_found": f"""WITH f AS (SELECT DISTINCT accession, {TICKER} AS ticker, accepted_at FROM sec_filings WHERE accepted_at IS NOT NULL),
        b AS (SELECT DISTINCT {TICKER} AS ticker, date, CAST(date AS TIMESTAMP) + INTERVAL 21 HOUR AS bar_at FROM prices_daily WHERE close IS NOT NULL AND NOT isnan(close) AND close > 0)
        SELECT accession, ticker, strftime(date, '%Y-%m-%d') AS bar_date FROM f JOIN b USING (ticker)
        WHERE abs(epoch_us(accepted_at) - epoch_us(bar_at)) <= 172800000000
        QUALIFY row_number() OVER (PARTITION BY accession, ticker, accepted_at ORDER BY abs(epoch_us(accepted_at) - epoch_us(bar_at)), bar_at) = 1""",
    "p5_found": f"""WITH {POSTS}, t AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM posts_now),
        s AS (SELECT DISTINCT id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS run FROM t WHERE len(w) >= 3), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.id < b.id GROUP BY ALL)
        SELECT id_a, id_b FROM c JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE k * 10 >= 6 * (na.n + nb.n - k)""",
    "p5_classes": f"""WITH RECURSIVE {POSTS}, w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM posts_now),
        t AS (SELECT w, min(id) AS t FROM w GROUP BY w), m AS (SELECT id, t FROM w JOIN t USING (w)),
        s AS (SELECT DISTINCT t, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS run FROM t WHERE len(w) >= 3), n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
        c AS (SELECT a.t AS a, b.t AS b, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.t <> b.t GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.t = a JOIN n nb ON nb.t = b WHERE k * 10 >= 6 * (na.n + nb.n - k)),
        r AS (SELECT t AS a, t AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        g AS (SELECT a AS t, min(b) AS class_id FROM r GROUP BY a), d AS (SELECT a AS t, count(*) AS links FROM e GROUP BY a)
        SELECT id, class_id, CAST(coalesce(links, 0) AS INTEGER) AS links FROM m JOIN g USING (t) LEFT JOIN d USING (t)""",
    "p7_whole": "SELECT doc_id, greatest(1, CAST(ceil(n_chars / 4096.0) AS BIGINT)) AS pieces, n_chars AS tokens, true AS right FROM documents",
    "p6_found": f"""WITH s AS (SELECT CAST(date_trunc('week', week_start) AS DATE) AS week, {TICKER} AS ticker, composite_bull, composite_bear FROM weekly_signals),
        v AS (SELECT week, ticker, 'bull' AS side, composite_bull AS value FROM s UNION ALL SELECT week, ticker, 'bear', composite_bear FROM s),
        m AS (SELECT week, side, ticker, max(value) AS value FROM v WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
        SELECT strftime(week, '%Y-%m-%d') AS week_start, side, ticker FROM m QUALIFY row_number() OVER (PARTITION BY week, side ORDER BY value DESC, ticker) <= 10""",
}
