"""Building blocks of the SQL oracles (DuckDB). Each block is a named query with the names it needs."""
from __future__ import annotations

from patronage.fixed_values import ADMIN_CODE_PATTERN, CATEGORY_WORDS

BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (body, needs)


def with_blocks(body: str, *needs: str) -> str:
    """SELECT with the blocks it needs as common table expressions, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in BLOCKS[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][0]})" for n in order) + "\n" + body


def category_case(text: str, words: dict[str, list[str]] = CATEGORY_WORDS) -> str:
    whens = " ".join(rf"WHEN regexp_matches(upper({text}), '\b(?:{'|'.join(w)})S?\b') THEN '{c}'" for c, w in words.items())
    return f"coalesce(CASE {whens} ELSE 'other' END, 'other')"


def unit_hash(key: str, seed: str | int) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '#{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


CATS = list(CATEGORY_WORDS)

# ------------------------------------------------------------------ invoice lines
block("source_lines", """
  SELECT l_orderkey AS k, l_linenumber AS ln, (l_returnflag = 'R' AND l_linestatus = 'F') AS r,
         CASE WHEN l_partkey % 50 = 0 THEN 'POST' ELSE 'P' || lpad(l_partkey::VARCHAR, 6, '0') END AS stock_code,
         CASE WHEN (l_orderkey + l_linenumber) % 25 = 0 THEN lower(p_name) || '  ' ELSE upper(p_name) END AS description,
         l_quantity AS q, o_orderdate + to_seconds((l_orderkey % 36000 + 28800)::BIGINT) AS invoice_date,
         (CASE WHEN (l_orderkey + l_partkey) % 400 = 0 THEN 0 ELSE floor(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100 END)::DOUBLE AS unit_price,
         CASE WHEN o_custkey % 6 <> 5 THEN o_custkey END AS customer_id,
         CASE WHEN l_orderkey % 11 = 3 THEN 'FRANCE' ELSE n_name END AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
block("raw", """
  SELECT CASE WHEN r THEN 'C' ELSE '' END || k::VARCHAR AS invoice, stock_code, description,
         CASE WHEN r THEN -q ELSE q END AS quantity, invoice_date, unit_price, customer_id, country FROM source_lines
  UNION ALL
  SELECT CASE WHEN r THEN 'C' ELSE '' END || k::VARCHAR, stock_code, description,
         CASE WHEN r THEN -q ELSE q END, invoice_date, unit_price, customer_id, country FROM source_lines WHERE k % 101 = 0
  UNION ALL
  SELECT k::VARCHAR, stock_code, description, 60000.0::DOUBLE, invoice_date, unit_price, customer_id, country
  FROM source_lines WHERE k % 97 = 0 AND ln = 1
  UNION ALL
  SELECT 'C' || k::VARCHAR, stock_code, description, -60000.0::DOUBLE, invoice_date, unit_price, customer_id, country
  FROM source_lines WHERE k % 97 = 0 AND ln = 1""", "source_lines")
block("complete_rows", "SELECT * FROM raw WHERE invoice_date IS NOT NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL", "raw")
block("dist", "SELECT DISTINCT * FROM complete_rows", "complete_rows")


def fence_blocks(k: str, suffix: str = "") -> None:
    block(f"fences{suffix}", f"""
      SELECT q1 - {k} * (q3 - q1) AS q_lo, q3 + {k} * (q3 - q1) AS q_hi, p1 - {k} * (p3 - p1) AS p_lo, p3 + {k} * (p3 - p1) AS p_hi
      FROM (SELECT quantile_cont(abs(quantity), 0.25) AS q1, quantile_cont(abs(quantity), 0.75) AS q3,
                   quantile_cont(unit_price, 0.25) AS p1, quantile_cont(unit_price, 0.75) AS p3
            FROM dist WHERE unit_price > 0)""", "dist")
    block(f"flagged{suffix}", f"""
      SELECT d.*, customer_id IS NOT NULL AS has_customer_id, (invoice ILIKE 'C%' OR quantity < 0) AS is_return,
             unit_price <= 0 AS is_price_adjustment, regexp_matches(stock_code, '(?i){ADMIN_CODE_PATTERN}') AS is_admin_code,
             unit_price > 0 AND abs(quantity) > q_hi AS q_out, unit_price > 0 AND unit_price > p_hi AS p_out
      FROM dist d, fences{suffix}""", f"fences{suffix}")
    block(f"reversed{suffix}", f"""
      SELECT customer_id AS rc, stock_code AS rs, abs(quantity) AS rq FROM flagged{suffix} WHERE q_out AND customer_id IS NOT NULL
      GROUP BY ALL HAVING min(sign(quantity)) < 0 AND max(sign(quantity)) > 0""", f"flagged{suffix}")
    block(f"outliers{suffix}", f"""
      SELECT f.* EXCLUDE (q_out, p_out), q_out OR p_out AS is_outlier,
             (q_out AND rc IS NOT NULL) OR (q_out AND abs(quantity) >= 50000) AS is_entry_error,
             (q_out OR p_out) AND NOT ((q_out AND rc IS NOT NULL) OR (q_out AND abs(quantity) >= 50000)) AS is_bulk_outlier
      FROM flagged{suffix} f LEFT JOIN reversed{suffix} ON customer_id = rc AND stock_code = rs AND abs(quantity) = rq""",
          f"reversed{suffix}")


fence_blocks("3")
fence_blocks("0.1::DOUBLE", "_narrow")

TIDY = r"trim(regexp_replace(upper(description), '\s+', ' ', 'g'))"
block("votes", f"SELECT stock_code, {TIDY} AS txt, count(*) AS n FROM dist WHERE description IS NOT NULL GROUP BY ALL", "dist")
block("products", f"""
  SELECT stock_code, txt AS std_description, {category_case('txt')} AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, txt) AS rn FROM votes) WHERE rn = 1""", "votes")
block("clean", f"""
  SELECT o.* REPLACE (coalesce(std_description, {TIDY.replace('description', 'o.description')}) AS description), coalesce(category, 'other') AS category,
         quantity * unit_price AS line_total,
         has_customer_id AND NOT is_price_adjustment AND NOT is_entry_error AS use_for_customer_model
  FROM outliers o LEFT JOIN products USING (stock_code)""", "outliers", "products")
block("cuts", """
  SELECT date_trunc('day', max(invoice_date))::TIMESTAMP + INTERVAL 1 DAY AS scoring,
         date_trunc('day', max(invoice_date))::TIMESTAMP - INTERVAL 89 DAY AS train FROM clean""", "clean")

# ------------------------------------------------------------------ snapshots: suffix tr = training, sc = scoring


def snapshot_blocks(s: str, moment: str) -> None:
    block(f"cut_{s}", f"SELECT {moment} AS cutoff FROM cuts", "cuts")
    block(f"sub_{s}", f"SELECT c.*, cutoff FROM clean c, cut_{s} WHERE use_for_customer_model AND invoice_date < cutoff", "clean", f"cut_{s}")
    block(f"sales_{s}", f"SELECT * FROM sub_{s} WHERE NOT is_return", f"sub_{s}")
    block(f"prod_{s}", f"SELECT * FROM sales_{s} WHERE NOT is_admin_code", f"sales_{s}")
    block(f"orders_{s}", f"""
      SELECT cutoff, customer_id, invoice, max(invoice_date) AS order_date, sum(line_total) AS order_value, sum(quantity) AS units,
             max(country) AS country FROM sales_{s} GROUP BY ALL""", f"sales_{s}")
    block(f"rfm_{s}", f"""
      SELECT cutoff, customer_id, arg_max(country, (order_date, invoice)) AS country, min(order_date) AS first_purchase,
             max(order_date) AS last_purchase,
             floor(epoch(cutoff - max(order_date)) / 86400)::DOUBLE AS recency_days, count(*)::DOUBLE AS frequency,
             greatest(sum(order_value), 0) AS total_spend, greatest(sum(order_value), 0) / count(*) AS avg_spend,
             avg(units) AS avg_basket_size
      FROM orders_{s} GROUP BY cutoff, customer_id""", f"orders_{s}")
    block(f"net_{s}", f"""
      SELECT customer_id, greatest(sum(line_total), 0) AS historical_clv, avg(is_return::INT) AS return_rate
      FROM sub_{s} GROUP BY ALL""", f"sub_{s}")
    block(f"bins_{s}", f"""
      SELECT customer_id, least(greatest(floor(floor(epoch(cutoff - order_date) / 86400) / 30), 0), 11)::INT AS bin
      FROM orders_{s}""", f"orders_{s}")
    block(f"trend_{s}", f"""
      SELECT customer_id, CASE WHEN count(*) > 1 THEN regr_slope(n, 11 - b) ELSE 0 END AS freq_trend
      FROM (SELECT f.customer_id, b, count(o.bin) AS n
            FROM (SELECT customer_id, max(bin) AS oldest FROM bins_{s} GROUP BY ALL) f JOIN range(12) t(b) ON b <= oldest
                 LEFT JOIN bins_{s} o ON o.customer_id = f.customer_id AND o.bin = b GROUP BY ALL)
      GROUP BY customer_id""", f"bins_{s}")
    block(f"gaps_{s}", f"""
      SELECT customer_id, coalesce(var_pop(gap), 0) AS gap_variance
      FROM (SELECT customer_id, (epoch_us(order_date) - epoch_us(lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, invoice)))
                   / 86400000000.0::DOUBLE AS gap FROM orders_{s}) GROUP BY ALL""", f"orders_{s}")
    block(f"season_{s}", f"""
      SELECT customer_id, sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS seasonal_concentration
      FROM (SELECT customer_id, month(order_date) AS m, count(*) AS n FROM orders_{s} GROUP BY ALL) GROUP BY ALL""", f"orders_{s}")
    block(f"medians_{s}", f"SELECT stock_code, median(unit_price) AS median_price FROM prod_{s} GROUP BY ALL", f"prod_{s}")
    block(f"discount_{s}", f"""
      SELECT customer_id, least(greatest(CASE WHEN sum(line_total) > 0 THEN
             coalesce(sum(line_total) FILTER (unit_price < 0.9::DOUBLE * median_price), 0) / sum(line_total) ELSE 0 END, 0), 1) AS discount_sensitivity
      FROM prod_{s} JOIN medians_{s} USING (stock_code) GROUP BY ALL""", f"medians_{s}")
    block(f"pop_{s}", f"""
      SELECT stock_code, count(DISTINCT customer_id)::DOUBLE / greatest((SELECT count(DISTINCT customer_id) FROM prod_{s}), 1) AS popularity
      FROM prod_{s} GROUP BY ALL""", f"prod_{s}")
    block(f"avgpop_{s}", f"""
      SELECT customer_id, avg(coalesce(popularity, 0)) AS avg_product_popularity
      FROM (SELECT DISTINCT customer_id, stock_code FROM prod_{s}) LEFT JOIN pop_tr USING (stock_code) GROUP BY ALL""",
          f"prod_{s}", "pop_tr")
    shares = ", ".join(
        f"CASE WHEN sum(line_total) > 0 THEN coalesce(sum(line_total) FILTER (category = '{c}'), 0) / sum(line_total) ELSE 0 END AS affinity_{c}"
        for c in CATS)
    block(f"affinity_{s}", f"SELECT customer_id, {shares} FROM prod_{s} GROUP BY ALL", f"prod_{s}")
    aff = ", ".join(f"coalesce(affinity_{c}, 0) AS affinity_{c}" for c in CATS)
    block(f"feats_{s}", f"""
      SELECT r.*, historical_clv, freq_trend, gap_variance, seasonal_concentration, return_rate,
             coalesce(discount_sensitivity, 0) AS discount_sensitivity, coalesce(avg_product_popularity, 0) AS avg_product_popularity, {aff}
      FROM rfm_{s} r LEFT JOIN net_{s} USING (customer_id) LEFT JOIN trend_{s} USING (customer_id) LEFT JOIN gaps_{s} USING (customer_id)
           LEFT JOIN season_{s} USING (customer_id) LEFT JOIN discount_{s} USING (customer_id)
           LEFT JOIN avgpop_{s} USING (customer_id) LEFT JOIN affinity_{s} USING (customer_id)""",
          f"rfm_{s}", f"net_{s}", f"trend_{s}", f"gaps_{s}", f"season_{s}", f"discount_{s}", f"avgpop_{s}", f"affinity_{s}")


snapshot_blocks("tr", "train")
snapshot_blocks("sc", "scoring")

# ------------------------------------------------------------------ labels and engagement
block("win", """SELECT c.*, cutoff FROM clean c, cut_tr WHERE use_for_customer_model AND NOT is_return
                AND invoice_date >= cutoff AND invoice_date < cutoff + INTERVAL 90 DAY""", "clean", "cut_tr")
block("buyers", "SELECT customer_id, sum(line_total) AS spend FROM win GROUP BY ALL", "win")
block("nextcat", """
  SELECT customer_id, category AS next_category FROM (
    SELECT customer_id, category, row_number() OVER (PARTITION BY customer_id ORDER BY sum(line_total) DESC, category) AS rn
    FROM win WHERE NOT is_admin_code GROUP BY customer_id, category) WHERE rn = 1""", "win")
block("labels_tr", """
  SELECT r.customer_id, CASE WHEN b.customer_id IS NULL THEN 1 ELSE 0 END AS churn, coalesce(spend, 0) AS clv_target, next_category
  FROM rfm_tr r LEFT JOIN buyers b USING (customer_id) LEFT JOIN nextcat USING (customer_id)""", "rfm_tr", "buyers", "nextcat")
for _s in ("tr", "sc"):
    block(f"eng_{_s}", f"""
      SELECT f.customer_id,
        (SELECT count(*) FROM feats_tr t WHERE round(t.recency_days, 6) <= round(f.recency_days, 6))::DOUBLE / (SELECT count(*) FROM feats_tr) AS p_rec,
        (SELECT count(*) FROM feats_tr t WHERE round(t.frequency, 6) <= round(f.frequency, 6))::DOUBLE / (SELECT count(*) FROM feats_tr) AS p_freq,
        (SELECT count(*) FROM feats_tr t WHERE round(t.total_spend, 6) <= round(f.total_spend, 6))::DOUBLE / (SELECT count(*) FROM feats_tr) AS p_spend
      FROM feats_{_s} f""", "feats_tr", f"feats_{_s}")
    block(f"snap_{_s}", f"""
      SELECT f.*, 100.0::DOUBLE * ((1 - p_rec) + p_freq + p_spend) / 3 AS engagement_score
      FROM feats_{_s} f JOIN eng_{_s} USING (customer_id)""", f"eng_{_s}")

# ------------------------------------------------------------------ stand-in scores for operators on given scores
block("scored_tr", f"""
  SELECT customer_id, churn AS y, clv_target AS target, next_category, floor({unit_hash('customer_id', 'score')} * 500) / 500 AS p,
         round(greatest(clv_target * (0.5 + {unit_hash('customer_id', 'clv')}), 0) + 10 * {unit_hash('customer_id', 'noise')}, 4) AS prediction
  FROM labels_tr""", "labels_tr")
block("scored_sc", f"""
  SELECT s.*, floor({unit_hash('s.customer_id', 'score')} * 500) / 500 AS churn_probability,
         floor({unit_hash('s.customer_id', 'segment')} * 5)::INT AS segment_id,
         {unit_hash('s.customer_id', 'anomaly')} > 0.95 AS is_anomaly
  FROM snap_sc s""", "snap_sc")
