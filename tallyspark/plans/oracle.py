"""DuckDB oracle SQL for every registered query (tables pre-registered as
views). Written independently of the Spark side: where possible the
expected value is computed arithmetically instead of re-implementing the
parser under test. Money leaves as DOUBLE, dates as ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

from tallyspark.functions.codes import ALT_ALLOWED_CODES, code_rows
from tallyspark.functions.codes import CLASS_CODES
from tallyspark.plans.ledgers import PROTOCOL_OF_PAIR


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _proto(rf: str = "l_returnflag", ls: str = "l_linestatus") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROTOCOL_OF_PAIR.items())
    return f"CASE concat({rf}, {ls}) {whens} END"


def _pcls(proto: str) -> str:
    whens = " ".join(f"WHEN {proto} IN {_in(codes)} THEN '{cls}'" for cls, codes in CLASS_CODES.items())
    return f"CASE {whens} END"


PROTO = _proto()
ALT = _in(ALT_ALLOWED_CODES)
DAY = "'%Y-%m-%d'"

BASE = f"""
WITH a0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) rn FROM lineitem),
a AS (SELECT l_orderkey k, l_linenumber ln, l_shipdate d, l_quantity q, l_returnflag rf, l_linestatus ls,
        l_partkey pk, l_suppkey sk, concat(l_returnflag, l_linestatus) code, {PROTO} proto,
        {_pcls(PROTO)} pcls,
        CASE WHEN l_linestatus = 'F' THEN 'paper' ELSE 'electronic' END cls,
        CAST(CASE WHEN l_returnflag = 'A' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) amt,
        CAST(l_extendedprice AS DECIMAL(18,2)) price,
        round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) w,
        l_tax tax_rate
      FROM a0 WHERE rn = 1),
b AS (SELECT o_orderkey k, o_orderdate d, o_custkey cu, o_orderstatus status,
        CASE WHEN o_orderstatus = 'P' THEN 'paper' ELSE 'electronic' END cls,
        CAST(o_totalprice AS DECIMAL(18,2)) amt FROM orders)
"""

NUMBER_TEXTS = """
WITH t AS (SELECT l_orderkey k, l_linenumber ln, CAST(l_linenumber % 6 AS INTEGER) v,
             CAST(l_extendedprice AS DECIMAL(18,2)) p, CAST(floor(l_extendedprice) AS BIGINT) ip FROM lineitem),
x AS (SELECT *, CAST(p AS VARCHAR) plain, right(CAST(p AS VARCHAR), 2) cents,
        CASE WHEN ip >= 1000 THEN CAST(ip // 1000 AS VARCHAR) || '.' || lpad(CAST(ip % 1000 AS VARCHAR), 3, '0')
             ELSE CAST(ip AS VARCHAR) END g_dot,
        CASE WHEN ip >= 1000 THEN CAST(ip // 1000 AS VARCHAR) || ' ' || lpad(CAST(ip % 1000 AS VARCHAR), 3, '0')
             ELSE CAST(ip AS VARCHAR) END g_sp,
        CASE WHEN ip >= 1000 THEN CAST(ip AS DOUBLE) / 1000 ELSE CAST(ip AS DOUBLE) END dotted_int FROM t),
y AS (SELECT *, CASE v WHEN 0 THEN chr(160) || plain WHEN 1 THEN replace(plain, '.', ',') || chr(9) WHEN 2 THEN g_dot || ',' || cents
                       WHEN 3 THEN g_sp || ',' || cents WHEN 4 THEN g_dot ELSE 'n/d' END txt FROM x)
"""

Q: dict[str, str] = {}

Q["parse_numbers_mixed"] = NUMBER_TEXTS + """
SELECT k, ln, v, txt,
  CASE WHEN v <= 3 THEN CAST(p AS DOUBLE) WHEN v = 4 THEN dotted_int ELSE 0.0 END mixed0,
  CASE WHEN v <= 3 THEN CAST(p AS DOUBLE) WHEN v = 4 THEN dotted_int END mixed
FROM y"""

Q["parse_numbers_it"] = NUMBER_TEXTS + """
SELECT k, ln, v, txt,
  CASE WHEN v = 0 THEN CAST(p * 100 AS DOUBLE) WHEN v <= 3 THEN CAST(p AS DOUBLE)
       WHEN v = 4 THEN CAST(ip AS DOUBLE) END it
FROM y"""

Q["parse_numbers_comma"] = NUMBER_TEXTS + """
SELECT k, ln, v, txt,
  CASE WHEN v = 1 THEN CAST(p AS DOUBLE) WHEN v IN (2, 3) AND ip < 1000 THEN CAST(p AS DOUBLE)
       WHEN v = 4 THEN dotted_int END comma,
  CASE WHEN v = 4 THEN dotted_int END plain
FROM y"""

Q["parse_dates"] = """
WITH t AS (SELECT o_orderkey k, CAST(o_orderkey % 5 AS INTEGER) v, o_orderdate d FROM orders)
SELECT k, v,
  CASE v WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d %H:%M:%S')
         WHEN 2 THEN strftime(d, '%d/%m/%Y') WHEN 3 THEN strftime(d, '%-d/%-m/%Y') ELSE 'n.d.' END txt,
  CASE WHEN v < 4 THEN strftime(d, '%Y-%m-%d') ELSE '' END day_first,
  CASE WHEN v < 2 THEN strftime(d, '%Y-%m-%d')
       WHEN v < 4 AND day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d')
       ELSE '' END month_first,
  CASE WHEN v < 4 THEN strftime(d, '%Y-%m') END "month"
FROM t"""

Q["normalise_keys"] = """
WITH t AS (SELECT o_orderkey k, CAST(o_orderkey % 8 AS INTEGER) v, CAST(o_orderkey AS VARCHAR) s, o_totalprice FROM orders),
r AS (SELECT *, CASE v WHEN 0 THEN s WHEN 1 THEN s || '.0' WHEN 2 THEN s || '.00' WHEN 3 THEN ' ' || s || ' '
                      WHEN 4 THEN 'nan' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE '0' END raw FROM t)
SELECT k, v, raw,
  CASE WHEN v <= 3 THEN s WHEN v = 4 THEN 'nan' WHEN v = 7 THEN '0' ELSE '' END norm_id,
  v IN (5, 6) empty_strict, v IN (4, 5, 6) empty_tokens, (v IN (4, 5, 6, 7) OR (v <= 3 AND k = 0)) empty_tokens_zero,
  v IN (4, 5, 6) empty_dash,
  CASE v WHEN 4 THEN 'NAN' WHEN 5 THEN '' WHEN 6 THEN '' ELSE trim(raw) END text_key,
  CASE WHEN v IN (4, 6) THEN '' ELSE raw END blanked,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) amount_key
FROM r"""

Q["signed_net"] = f"""
WITH t AS (SELECT l_orderkey k, l_linenumber ln, {PROTO} proto, l_returnflag rf,
             CAST(l_extendedprice AS DECIMAL(18,2)) price,
             round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) w
           FROM lineitem),
s AS (SELECT *, CASE WHEN rf = 'A' THEN -price ELSE price END sp, CASE WHEN rf = 'A' THEN -w ELSE w END sw FROM t)
SELECT k, ln, proto, CAST(CASE WHEN rf = 'A' THEN -1 ELSE 1 END AS INTEGER) mult, CAST(sp AS DOUBLE) signed,
  CAST(CASE WHEN proto IN ('EL', '2EL', 'L') THEN sp - sw ELSE sp END AS DOUBLE) net,
  CAST(price AS DOUBLE) taxable
FROM s"""

Q["period_filter"] = f"""
SELECT l_orderkey k, l_linenumber ln, strftime(l_shipdate, {DAY}) d,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) amt
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30'"""

Q["period_filter_ext"] = f"""
SELECT o_orderkey k, strftime(o_orderdate, {DAY}) d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) amt
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2000-10-08'"""

Q["period_fallback"] = f"""
SELECT 'orders' source, o_orderkey k, 0 ln, strftime(o_orderdate, {DAY}) d FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'
UNION ALL
SELECT 'lineitem', l_orderkey, l_linenumber, strftime(l_shipdate, {DAY}) FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'"""

_RANKED = f"""
WITH a0 AS (SELECT *, {PROTO} proto, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) rn FROM lineitem)"""

Q["dedup_before_filter"] = _RANKED + f"""
SELECT l_orderkey k, l_linenumber ln, proto, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) amt
FROM a0 WHERE rn = 1 AND proto IN {ALT}"""

Q["dedup_after_filter"] = f"""
WITH f AS (SELECT *, {PROTO} proto FROM lineitem),
a0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) rn FROM f WHERE proto IN {ALT})
SELECT l_orderkey k, l_linenumber ln, proto, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) amt
FROM a0 WHERE rn = 1"""

Q["dedup_metric"] = _RANKED + f""",
g AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST((SELECT sum(n) FROM g) AS BIGINT) "rows", CAST((SELECT count(*) FROM g) AS BIGINT) groups,
  CAST((SELECT sum(n) - count(*) FROM g) AS BIGINT) duplicates_removed,
  CAST((SELECT count(*) FROM a0 WHERE rn = 1 AND proto IN {ALT}) AS BIGINT) kept_after_filter"""

Q["dedup_sensitivity"] = """
WITH f AS (SELECT CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END ok,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) r1,
 row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_extendedprice) r2,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END
                    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) r3,
 row_number() OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE), floor(l_extendedprice / 100)
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) r4 FROM lineitem)
SELECT CAST(count(*) AS BIGINT) base_rows,
 CAST(sum(CASE WHEN r1 = 1 THEN 1 ELSE 0 END) AS BIGINT) k1, CAST(sum(CASE WHEN r1 = 1 THEN ok ELSE 0 END) AS BIGINT) k1_ok,
 CAST(sum(CASE WHEN r2 = 1 THEN 1 ELSE 0 END) AS BIGINT) k2, CAST(sum(CASE WHEN r2 = 1 THEN ok ELSE 0 END) AS BIGINT) k2_ok,
 CAST(sum(CASE WHEN r3 = 1 THEN ok ELSE 0 END) AS BIGINT) filter_then_k1,
 CAST(sum(CASE WHEN r3 = 1 THEN ok ELSE 0 END) AS BIGINT) filter_then_k1_ok,
 CAST(sum(CASE WHEN r4 = 1 THEN 1 ELSE 0 END) AS BIGINT) k3_norm, CAST(sum(CASE WHEN r4 = 1 THEN ok ELSE 0 END) AS BIGINT) k3_norm_ok
 FROM f"""

Q["step_funnel"] = _RANKED + f"""
SELECT CAST((SELECT count(*) FROM lineitem) AS BIGINT) base_rows, CAST(count(*) AS BIGINT) deduped_rows,
  CAST(sum(CASE WHEN proto IN {ALT} THEN 1 ELSE 0 END) AS BIGINT) filtered_rows,
  CAST(sum(CASE WHEN proto IN {ALT} AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) credit_rows,
  CAST(sum(CASE WHEN proto IN {ALT} AND proto IN ('EL', '2EL', 'L') THEN 1 ELSE 0 END) AS BIGINT) adjusted_rows
FROM a0 WHERE rn = 1"""

Q["class_delta_counts"] = BASE + """
SELECT c.cls, CAST((SELECT count(*) FROM a WHERE a.cls = c.cls) AS BIGINT) a_n,
  CAST((SELECT count(*) FROM b WHERE b.cls = c.cls) AS BIGINT) b_n,
  CAST((SELECT count(*) FROM b WHERE b.cls = c.cls) - (SELECT count(*) FROM a WHERE a.cls = c.cls) AS BIGINT) delta
FROM (VALUES ('paper'), ('electronic')) c(cls)"""

Q["first_per_key"] = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS LAST,
             l_linenumber NULLS LAST, l_partkey, l_suppkey, l_extendedprice) rn FROM lineitem)
SELECT l_orderkey k, l_linenumber ln, strftime(l_shipdate, {DAY}) d,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) amt FROM r WHERE rn = 1"""

Q["class_totals"] = BASE + """
SELECT c.cls, CAST(count(a.k) AS BIGINT) n, CAST(coalesce(sum(a.amt), 0) AS DOUBLE) amount
FROM (VALUES ('paper'), ('electronic'), ('self_invoice')) c(cls) LEFT JOIN a ON a.pcls = c.cls GROUP BY c.cls"""

_DIM = ", ".join(f"({pos}, '{code}', '{descr}', '{cls}')" for pos, code, descr, cls in code_rows())
Q["code_summary"] = BASE + f""",
dim AS (SELECT * FROM (VALUES {_DIM}) v(pos, code, descr, cls)),
g AS (SELECT proto code, pcls, count(*) n, sum(amt) s FROM a GROUP BY proto, pcls),
r AS (SELECT dim.cls sheet, CAST(dim.pos AS BIGINT) pos, dim.code, dim.descr, CAST(coalesce(g.n, 0) AS BIGINT) n,
        coalesce(g.s, 0) amount FROM dim LEFT JOIN g ON dim.code = g.code AND dim.cls = g.pcls)
SELECT sheet, pos, code, descr, n, CAST(amount AS DOUBLE) amount FROM r
UNION ALL SELECT sheet, 99, 'TOTAL', '', CAST(sum(n) AS BIGINT), CAST(sum(amount) AS DOUBLE) FROM r GROUP BY sheet"""

Q["simple_total"] = """
SELECT o_orderstatus = 'P' is_empty, CAST(count(*) AS BIGINT) n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) amount FROM orders GROUP BY 1"""

Q["detail_totals"] = f"""
WITH c AS (SELECT o_orderkey k, '' label, o_orderdate d,
   CASE WHEN o_orderstatus = 'O' THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
        ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END amount_text,
   CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END amount
   FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5000)
SELECT k, label, strftime(d, {DAY}) d, amount_text, CAST(amount AS DOUBLE) amount FROM c
UNION ALL SELECT NULL, 'TOTALE', NULL, NULL, CAST(sum(amount) AS DOUBLE) FROM c"""

Q["code_distribution"] = f"""
SELECT {PROTO} code, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1"""

Q["code_distribution_split"] = f"""
SELECT {PROTO} code, l_returnflag = 'A' credit, CAST(count(*) AS BIGINT) n, 0 top_rank FROM lineitem GROUP BY 1, 2
UNION ALL
SELECT code, NULL, n, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER)
FROM (SELECT {PROTO} code, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1 ORDER BY n DESC, code LIMIT 3)"""

Q["taxcode_net"] = BASE + """,
t AS (SELECT *, CASE WHEN tax_rate < 0.02 THEN 'I9' ELSE 'XX' END tax_code,
        CASE WHEN pcls = 'self_invoice' THEN 'electronic' ELSE pcls END g FROM a),
u AS (SELECT g, amt, w, tax_code FROM t UNION ALL SELECT 'overall', amt, w, tax_code FROM t)
SELECT g scls, CAST(sum(amt) AS DOUBLE) total,
  CAST(sum(CASE WHEN tax_code = 'I9' THEN w ELSE 0 END) AS DOUBLE) i9_withholding,
  CAST(sum(CASE WHEN tax_code = 'I9' THEN 1 ELSE 0 END) AS BIGINT) i9_rows,
  CAST(sum(amt) - sum(CASE WHEN tax_code = 'I9' THEN w ELSE 0 END) AS DOUBLE) net
FROM u GROUP BY g"""

Q["sign_split"] = BASE + """,
u AS (SELECT cls g, rf, price FROM a UNION ALL SELECT 'overall', rf, price FROM a)
SELECT g cls, CAST(coalesce(sum(CASE WHEN rf <> 'A' THEN price END), 0) AS DOUBLE) positive,
  CAST(coalesce(sum(CASE WHEN rf = 'A' THEN price END), 0) AS DOUBLE) negative,
  CAST(sum(CASE WHEN rf <> 'A' THEN 1 ELSE 0 END) AS BIGINT) n_positive,
  CAST(sum(CASE WHEN rf = 'A' THEN 1 ELSE 0 END) AS BIGINT) n_negative,
  CAST(coalesce(sum(CASE WHEN rf <> 'A' THEN price END), 0) - coalesce(sum(CASE WHEN rf = 'A' THEN price END), 0) AS DOUBLE) net
FROM u GROUP BY g"""

Q["withholding_net"] = BASE + """
SELECT CAST(sum(amt) AS DOUBLE) base, CAST(sum(CASE WHEN proto IN ('EL', '2EL') THEN w ELSE 0 END) AS DOUBLE) withholding,
  CAST(sum(amt) - sum(CASE WHEN proto IN ('EL', '2EL') THEN w ELSE 0 END) AS DOUBLE) net FROM a"""

Q["class_amounts"] = BASE + """
SELECT pcls, CAST(count(*) AS BIGINT) "rows", CAST(sum(amt) AS DOUBLE) amount, CAST(sum(price) AS DOUBLE) price,
  CAST(sum(w) AS DOUBLE) withholding FROM a GROUP BY pcls"""

Q["key_months"] = BASE + f"""
SELECT k, array_to_string(list_sort(list_distinct(list(strftime(d, '%Y-%m')))), ', ') "months",
  CAST(count(DISTINCT strftime(d, '%Y-%m')) AS BIGINT) n_months, strftime(min(d), {DAY}) first_date
FROM a WHERE d IS NOT NULL GROUP BY k"""

Q["compare_summary"] = BASE + """,
u AS (SELECT cls, 'a' side, amt FROM a UNION ALL SELECT cls, 'b' side, amt FROM b),
r AS (SELECT coalesce(cls, 'total') category,
  sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) a_n, coalesce(sum(CASE WHEN side = 'a' THEN amt END), 0) a_amt,
  sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) b_n, coalesce(sum(CASE WHEN side = 'b' THEN amt END), 0) b_amt
  FROM u GROUP BY ROLLUP(cls))
SELECT category, CAST(CASE category WHEN 'paper' THEN 0 WHEN 'electronic' THEN 1 ELSE 2 END AS INTEGER) pos,
  CAST(a_n AS BIGINT) a_n, CAST(a_amt AS DOUBLE) a_amt, CAST(b_n AS BIGINT) b_n, CAST(b_amt AS DOUBLE) b_amt,
  CAST(a_n - b_n AS BIGINT) delta_n, CAST(a_amt - b_amt AS DOUBLE) delta_amt FROM r"""

_KEYED = BASE + """,
ga AS (SELECT k, count(*) a_rows, sum(amt) a_sum FROM a GROUP BY k),
gb AS (SELECT k, count(*) b_rows, sum(amt) b_sum FROM b GROUP BY k),
m AS (SELECT coalesce(ga.k, gb.k) k, coalesce(a_rows, 0) a_rows, coalesce(a_sum, 0) a_sum,
        coalesce(b_rows, 0) b_rows, coalesce(b_sum, 0) b_sum FROM ga FULL OUTER JOIN gb ON ga.k = gb.k)"""

Q["reconcile_rows_or_amount"] = _KEYED + """
SELECT CASE WHEN b_rows = 0 THEN 'only_a' WHEN a_rows = 0 THEN 'only_b' ELSE 'both_differ' END outcome, k,
  CAST(a_rows AS BIGINT) a_rows, CAST(a_sum AS DOUBLE) a_sum, CAST(b_rows AS BIGINT) b_rows, CAST(b_sum AS DOUBLE) b_sum,
  CAST(a_rows - b_rows AS BIGINT) delta_rows, CAST(a_sum - b_sum AS DOUBLE) delta_sum
FROM m WHERE a_rows <> b_rows OR abs(a_sum - b_sum) > 0.01"""

Q["reconcile_amount"] = _KEYED + """
SELECT CASE WHEN a_rows > 0 AND b_rows = 0 THEN 'only_a' WHEN b_rows > 0 AND a_rows = 0 THEN 'only_b'
            ELSE 'different_amount' END outcome, k,
  CAST(a_rows AS BIGINT) a_rows, CAST(a_sum AS DOUBLE) a_sum, CAST(b_rows AS BIGINT) b_rows, CAST(b_sum AS DOUBLE) b_sum,
  CAST(a_sum - b_sum AS DOUBLE) delta_sum
FROM m WHERE (a_rows > 0 AND b_rows = 0) OR (b_rows > 0 AND a_rows = 0) OR abs(a_sum - b_sum) > 0.01"""

_ELEC = BASE + """,
ae AS (SELECT CASE WHEN pk % 10 = 0 THEN '' ELSE CAST(k AS VARCHAR) END id, amt FROM a WHERE cls = 'electronic'),
be AS (SELECT CAST(k AS VARCHAR) id, amt FROM b WHERE cls = 'electronic')"""

Q["reconcile_electronic"] = _ELEC + """,
ga AS (SELECT id, count(*) a_rows, sum(amt) a_sum FROM ae WHERE id <> '' GROUP BY id),
gb AS (SELECT id, count(*) b_rows, sum(amt) b_sum FROM be GROUP BY id),
m AS (SELECT coalesce(ga.id, gb.id) k, coalesce(a_rows, 0) a_rows, coalesce(a_sum, 0) a_sum,
        coalesce(b_rows, 0) b_rows, coalesce(b_sum, 0) b_sum FROM ga FULL OUTER JOIN gb ON ga.id = gb.id),
l AS (SELECT CASE WHEN b_rows = 0 THEN 'only_a' WHEN a_rows = 0 THEN 'only_b' ELSE 'both_differ' END outcome, k,
        a_rows, a_sum, b_rows, b_sum, a_rows - b_rows delta_rows, a_sum - b_sum delta_sum
      FROM m WHERE a_rows <> b_rows OR abs(a_sum - b_sum) > 0.01
      UNION ALL SELECT 'only_a_empty_id', '', count(*), sum(amt), 0, 0, count(*), sum(amt) FROM ae WHERE id = ''
      HAVING count(*) > 0)
SELECT outcome, k, CAST(a_rows AS BIGINT) a_rows, CAST(a_sum AS DOUBLE) a_sum, CAST(b_rows AS BIGINT) b_rows,
  CAST(b_sum AS DOUBLE) b_sum, CAST(delta_rows AS BIGINT) delta_rows, CAST(delta_sum AS DOUBLE) delta_sum FROM l
UNION ALL SELECT 'total', NULL, CAST(sum(a_rows) AS BIGINT), CAST(sum(a_sum) AS DOUBLE), CAST(sum(b_rows) AS BIGINT),
  CAST(sum(b_sum) AS DOUBLE), CAST(sum(delta_rows) AS BIGINT), CAST(sum(delta_sum) AS DOUBLE) FROM l"""

Q["multiset_diff"] = BASE + """,
ka AS (SELECT CAST(year(d) * 100 + month(d) AS BIGINT) ym, CASE WHEN k % 31 <> 0 THEN CAST(q AS BIGINT) END bucket, k, ln, d, amt FROM a),
kb AS (SELECT CAST(year(d) * 100 + month(d) AS BIGINT) ym, CASE WHEN k % 31 <> 0 THEN CAST(cu % 50 + 1 AS BIGINT) END bucket, k, d, amt FROM b),
na AS (SELECT ym, bucket, count(*) n FROM ka GROUP BY ym, bucket),
nb AS (SELECT ym, bucket, count(*) n FROM kb GROUP BY ym, bucket),
ra AS (SELECT *, row_number() OVER (PARTITION BY ym, bucket ORDER BY d, k, ln) rn, count(*) OVER (PARTITION BY ym, bucket) n FROM ka),
rb AS (SELECT *, row_number() OVER (PARTITION BY ym, bucket ORDER BY d, k) rn, count(*) OVER (PARTITION BY ym, bucket) n FROM kb)
SELECT 'only_a' outcome, ra.ym, ra.bucket, ra.k, CAST(ra.amt AS DOUBLE) delta FROM ra
  LEFT JOIN nb ON ra.ym = nb.ym AND ra.bucket IS NOT DISTINCT FROM nb.bucket WHERE ra.rn <= ra.n - coalesce(nb.n, 0)
UNION ALL SELECT 'only_b', rb.ym, rb.bucket, rb.k, CAST(-rb.amt AS DOUBLE) FROM rb
  LEFT JOIN na ON rb.ym = na.ym AND rb.bucket IS NOT DISTINCT FROM na.bucket WHERE rb.rn <= rb.n - coalesce(na.n, 0)"""

Q["top_delta_detail"] = BASE + f""",
ga AS (SELECT k, sum(amt) s FROM a GROUP BY k), gb AS (SELECT k, sum(amt) s FROM b GROUP BY k),
m AS (SELECT coalesce(ga.k, gb.k) k, coalesce(ga.s, 0) - coalesce(gb.s, 0) delta FROM ga FULL OUTER JOIN gb ON ga.k = gb.k),
top AS (SELECT k, delta FROM m ORDER BY abs(delta) DESC, k LIMIT 30),
ra AS (SELECT a.*, row_number() OVER (PARTITION BY a.k ORDER BY d, ln) rn FROM a JOIN top ON a.k = top.k),
rb AS (SELECT b.*, row_number() OVER (PARTITION BY b.k ORDER BY d) rn FROM b JOIN top ON b.k = top.k)
SELECT k, 'a' side, CAST(rn AS BIGINT) rn, strftime(d, {DAY}) d, CAST(amt AS DOUBLE) amt FROM ra WHERE rn <= 20
UNION ALL SELECT k, 'b', CAST(rn AS BIGINT), strftime(d, {DAY}), CAST(amt AS DOUBLE) FROM rb WHERE rn <= 20"""

Q["unmatched_both_ways"] = BASE + f""",
ai AS (SELECT CASE WHEN pk % 10 = 0 THEN (CASE WHEN k % 2 = 0 THEN ' ' END) ELSE CAST(k AS VARCHAR) END id, k, ln, d, amt FROM a),
bi AS (SELECT CASE WHEN k % 11 = 0 THEN (CASE WHEN k % 2 = 0 THEN ' ' END) WHEN k % 7 = 0 THEN 'x' || k ELSE CAST(k AS VARCHAR) END id, k, d, amt FROM b),
bo AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) rn FROM bi
       WHERE trim(id) <> '' AND id NOT IN (SELECT id FROM ai WHERE trim(id) <> '')),
ao AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ln) rn FROM ai
       WHERE trim(id) <> '' AND id NOT IN (SELECT id FROM bi WHERE trim(id) <> ''))
SELECT 'only_b' section, id, k, CAST(NULL AS INTEGER) ln, strftime(d, {DAY}) d, CAST(amt AS DOUBLE) amt FROM bo WHERE rn = 1
UNION ALL SELECT 'only_a', id, k, ln, strftime(d, {DAY}), CAST(amt AS DOUBLE) FROM ao WHERE rn = 1
UNION ALL SELECT 'only_a_empty_id', id, k, ln, strftime(d, {DAY}), CAST(amt AS DOUBLE) FROM ai WHERE coalesce(trim(id), '') = ''"""

Q["one_to_one_diff"] = BASE + """,
ga AS (SELECT k, count(*) n, sum(amt) s FROM a GROUP BY k HAVING count(*) = 1),
gb AS (SELECT k, count(*) n, sum(amt) s FROM b GROUP BY k HAVING count(*) = 1)
SELECT ga.k, CAST(ga.s AS DOUBLE) a_amt, CAST(gb.s AS DOUBLE) b_amt, CAST(ga.s - gb.s AS DOUBLE) delta
FROM ga JOIN gb ON ga.k = gb.k WHERE abs(ga.s - gb.s) > 0.01"""

Q["arrival_lookup"] = BASE + f""",
ai AS (SELECT *, CASE WHEN k % 25 = 0 THEN '' ELSE CAST(k // 2 AS VARCHAR) END id FROM a),
bi AS (SELECT *, CASE WHEN k % 25 = 0 THEN '' ELSE CAST(k // 2 AS VARCHAR) END id FROM b),
bo AS (SELECT id, min(d) d FROM bi WHERE id <> '' AND NOT EXISTS (SELECT 1 FROM ai WHERE ai.id = bi.id AND ai.rf = 'A') GROUP BY id),
bf AS (SELECT bi.id, min(bi.k) k, arg_min(bi.amt, bi.k) amt FROM bi JOIN bo ON bi.id = bo.id AND bi.d = bo.d GROUP BY bi.id),
mm AS (SELECT id, min(d) first_reg, count(DISTINCT year(d) * 100 + month(d)) n_months,
         min(year(d) * 100 + month(d)) m0, max(year(d) * 100 + month(d)) m1,
         array_to_string(list_sort(list_distinct(list(strftime(d, '%Y-%m')))), ', ') "months"
       FROM ai WHERE d IS NOT NULL GROUP BY id)
SELECT bf.id, bf.k, CAST(bf.amt AS DOUBLE) amt, CAST(coalesce(n_months, 0) AS BIGINT) n_months, CAST(m0 AS BIGINT) m0,
  CAST(m1 AS BIGINT) m1, coalesce("months", '') "months", strftime(first_reg, {DAY}) first_reg
FROM bf LEFT JOIN mm ON bf.id = mm.id"""

Q["unmatched_composite"] = BASE + """,
ap AS (SELECT ln % 3 nm, k, CASE WHEN k % 3 <> 0 THEN year(d) * 100 + month(d) END ym FROM a WHERE cls = 'paper'),
bp AS (SELECT cu % 3 nm, k, CASE WHEN k % 3 <> 0 THEN year(d) * 100 + month(d) END ym FROM b WHERE cls = 'paper'),
mp AS (SELECT * FROM bp WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.nm = bp.nm AND ap.k = bp.k AND ap.ym IS NOT DISTINCT FROM bp.ym)),
me AS (SELECT k FROM b WHERE cls = 'electronic' AND k NOT IN (SELECT k FROM a WHERE cls = 'electronic')),
s AS (SELECT 'paper' section, k, row_number() OVER (ORDER BY k) rank, (SELECT count(*) FROM mp) n FROM mp
      UNION ALL SELECT 'electronic', k, row_number() OVER (ORDER BY k), (SELECT count(*) FROM me) FROM me)
SELECT section, CAST(rank AS BIGINT) rank, k, CAST(n AS BIGINT) n_unmatched FROM s WHERE rank <= 2"""

Q["delta_by_sum_class"] = _ELEC + """,
ga AS (SELECT id, sum(amt) s FROM ae GROUP BY id), gb AS (SELECT id, sum(amt) s FROM be GROUP BY id),
m AS (SELECT coalesce(ga.id, gb.id) k, coalesce(ga.s, 0) a_sum, coalesce(gb.s, 0) b_sum
      FROM ga FULL OUTER JOIN gb ON ga.id = gb.id),
c AS (SELECT *, CASE WHEN a_sum <> 0 AND b_sum = 0 THEN 'only_a' WHEN b_sum <> 0 AND a_sum = 0 THEN 'only_b'
                     WHEN a_sum <> 0 AND b_sum <> 0 THEN 'both' END section, a_sum - b_sum delta FROM m)
SELECT section, CAST(NULL AS VARCHAR) k, CAST(count(*) AS BIGINT) n_keys, CAST(sum(a_sum) AS DOUBLE) a_sum,
  CAST(sum(b_sum) AS DOUBLE) b_sum, CAST(sum(delta) AS DOUBLE) delta FROM c WHERE section IS NOT NULL GROUP BY section
UNION ALL SELECT 'top_shared', k, 1, CAST(a_sum AS DOUBLE), CAST(b_sum AS DOUBLE), CAST(delta AS DOUBLE)
FROM (SELECT * FROM c WHERE section = 'both' ORDER BY abs(delta) DESC, k LIMIT 10)"""

Q["mismatch_reasons"] = BASE + """,
xa AS (SELECT k num, CASE WHEN k % 13 <> 0 THEN year(d) END dt, ln % 3 nm, length(CAST(CAST(floor(abs(amt)) AS BIGINT) AS VARCHAR)) am,
         CASE WHEN rf = 'A' AND tax_rate < 0.025 THEN 'paper' ELSE 'other' END c FROM a),
xb AS (SELECT k, k num, CASE WHEN k % 13 <> 0 THEN year(d) END dt, cu % 3 nm, length(CAST(CAST(floor(abs(amt)) AS BIGINT) AS VARCHAR)) am FROM b),
na AS (SELECT num, dt, nm, am, count(*) n FROM xa WHERE c = 'paper' GROUP BY num, dt, nm, am),
rb AS (SELECT xb.*, row_number() OVER (PARTITION BY num, dt, nm, am ORDER BY k) rn,
         count(*) OVER (PARTITION BY num, dt, nm, am) n FROM xb),
sur AS (SELECT rb.k, rb.num, rb.dt, rb.nm, rb.am FROM rb LEFT JOIN na ON rb.num = na.num AND rb.dt IS NOT DISTINCT FROM na.dt
          AND rb.nm = na.nm AND rb.am = na.am WHERE rb.rn <= rb.n - coalesce(na.n, 0)),
cut AS (SELECT * FROM (SELECT sur.*, row_number() OVER (ORDER BY k) pos FROM sur) z
        WHERE pos <= (SELECT greatest((SELECT count(*) FROM xb) - (SELECT count(*) FROM xa WHERE c = 'paper'), 0))),
fl AS (SELECT cut.k, max(CASE WHEN xa.c = 'paper' THEN 1 ELSE 0 END) p,
         max(CASE WHEN xa.c = 'paper' AND xa.nm = cut.nm THEN 1 ELSE 0 END) pn,
         max(CASE WHEN xa.c = 'paper' AND xa.nm = cut.nm AND xa.am = cut.am THEN 1 ELSE 0 END) pna,
         max(CASE WHEN xa.c IS NOT NULL THEN 1 ELSE 0 END) anyc
       FROM cut LEFT JOIN xa ON cut.num = xa.num AND cut.dt IS NOT DISTINCT FROM xa.dt GROUP BY cut.k)
SELECT CASE WHEN pna = 1 THEN 'full_match' WHEN pn = 1 THEN 'other_amount' WHEN p = 1 THEN 'other_name'
            WHEN anyc = 1 THEN 'other_class' ELSE 'not_found' END reason, CAST(count(*) AS BIGINT) n FROM fl GROUP BY 1"""

# ------------------------------------------------------------ end to end
_PAPER_CODES = _in(CLASS_CODES["paper"])
_EXPORT = f"""
WITH r AS (SELECT l_shipdate d, l_orderkey k,
             CASE WHEN l_partkey % 10 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END id,
             {PROTO} proto, l_returnflag rf, CAST(l_extendedprice AS DECIMAL(18,2)) price,
             round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) w,
             l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
g AS (SELECT count(*) n FROM r GROUP BY d, k, id),
f AS (SELECT *, row_number() OVER (PARTITION BY d, k, id
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn FROM r),
x AS (SELECT *, CASE WHEN rf = 'A' THEN -price ELSE price END sp, CASE WHEN rf = 'A' THEN -w ELSE w END sw,
        {_pcls('proto')} pcls FROM f WHERE rn = 1),
y AS (SELECT *, CASE WHEN proto IN ('EL', '2EL', 'L') THEN sp - sw ELSE sp END paid FROM x)"""

Q["register_report"] = _EXPORT + """
SELECT CAST(count(*) AS BIGINT) total_records,
  CAST(sum(CASE WHEN pcls = 'paper' THEN 1 ELSE 0 END) AS BIGINT) paper_records,
  CAST(sum(CASE WHEN pcls IN ('electronic', 'self_invoice') THEN 1 ELSE 0 END) AS BIGINT) electronic_records,
  CAST(coalesce(sum(CASE WHEN pcls = 'paper' THEN paid END), 0) AS DOUBLE) paper_amount,
  CAST(coalesce(sum(CASE WHEN pcls IN ('electronic', 'self_invoice') THEN paid END), 0) AS DOUBLE) electronic_amount,
  CAST((SELECT sum(n) - count(*) FROM g) AS BIGINT) duplicates_removed, CAST(0 AS BIGINT) rejected_amounts
FROM y"""

Q["register_code_sheets"] = _EXPORT + f""",
dim AS (SELECT * FROM (VALUES {_DIM}) v(pos, code, descr, cls)),
z AS (SELECT proto code, pcls, count(*) n, sum(paid) s FROM y GROUP BY proto, pcls),
rr AS (SELECT dim.cls sheet, dim.pos, dim.code, dim.descr, coalesce(z.n, 0) n, coalesce(z.s, 0) amount
       FROM dim LEFT JOIN z ON dim.code = z.code AND dim.cls = z.pcls)
SELECT sheet, CAST(pos AS BIGINT) pos, code, descr, CAST(n AS BIGINT) n, CAST(amount AS DOUBLE) amount FROM rr
UNION ALL SELECT sheet, 99, 'TOTALE', '', CAST(sum(n) AS BIGINT), CAST(sum(amount) AS DOUBLE) FROM rr GROUP BY sheet"""

_SPLIT_STATS = """
SELECT CAST(count(*) AS BIGINT) total_records,
  CAST(sum(CASE WHEN paper THEN 1 ELSE 0 END) AS BIGINT) paper_records,
  CAST(sum(CASE WHEN NOT paper THEN 1 ELSE 0 END) AS BIGINT) electronic_records,
  CAST(coalesce(sum(CASE WHEN paper THEN amt END), 0) AS DOUBLE) paper_amount,
  CAST(coalesce(sum(CASE WHEN NOT paper THEN amt END), 0) AS DOUBLE) electronic_amount,
  CAST(0 AS BIGINT) duplicates_removed, CAST(0 AS BIGINT) rejected_amounts FROM t"""

Q["portal_paid_report"] = """
WITH t AS (SELECT o_orderstatus = 'P' paper,
             round_even(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.90 AS DECIMAL(18,2)), 2) amt FROM orders)
""" + _SPLIT_STATS

Q["portal_received_report"] = """
WITH t AS (SELECT o_orderstatus = 'P' paper, CAST(o_totalprice AS DECIMAL(18,2)) amt FROM orders
           WHERE o_orderdate BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30')
""" + _SPLIT_STATS

_PORTAL_EXPORT = """,
b0 AS (SELECT CASE WHEN o_orderstatus = 'P' THEN (CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'nan'
                                                 WHEN 2 THEN '' ELSE 'None' END)
                   WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN '0'
                   ELSE CAST(o_orderkey AS VARCHAR) END id,
         round_even(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.90 AS DECIMAL(18,2)), 2) amt FROM orders),
xa AS (SELECT id, paid amt, CASE WHEN pcls = 'paper' THEN 'paper' ELSE 'electronic' END cls FROM y),
xb AS (SELECT id, amt, CASE WHEN id = '' THEN 'paper' ELSE 'electronic' END cls FROM b0)"""

Q["compare_report"] = _EXPORT + _PORTAL_EXPORT + """,
u AS (SELECT cls, 'a' side, amt FROM xa UNION ALL SELECT cls, 'b' side, amt FROM xb),
rr AS (SELECT coalesce(cls, 'total') category,
  sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) a_n, coalesce(sum(CASE WHEN side = 'a' THEN amt END), 0) a_amt,
  sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) b_n, coalesce(sum(CASE WHEN side = 'b' THEN amt END), 0) b_amt
  FROM u GROUP BY ROLLUP(cls))
SELECT category, CAST(CASE category WHEN 'paper' THEN 0 WHEN 'electronic' THEN 1 ELSE 2 END AS INTEGER) pos,
  CAST(a_n AS BIGINT) a_n, CAST(a_amt AS DOUBLE) a_amt, CAST(b_n AS BIGINT) b_n, CAST(b_amt AS DOUBLE) b_amt,
  CAST(a_n - b_n AS BIGINT) delta_n, CAST(a_amt - b_amt AS DOUBLE) delta_amt
FROM rr"""

Q["compare_report_electronic"] = _EXPORT + _PORTAL_EXPORT + """,
ga AS (SELECT id, count(*) a_rows, sum(amt) a_sum FROM xa WHERE cls = 'electronic' AND id <> '' GROUP BY id),
gb AS (SELECT id, count(*) b_rows, sum(amt) b_sum FROM xb WHERE cls = 'electronic' GROUP BY id),
m AS (SELECT coalesce(ga.id, gb.id) k, coalesce(a_rows, 0) a_rows, coalesce(a_sum, 0) a_sum,
        coalesce(b_rows, 0) b_rows, coalesce(b_sum, 0) b_sum FROM ga FULL OUTER JOIN gb ON ga.id = gb.id),
l AS (SELECT CASE WHEN b_rows = 0 THEN 'only_a' WHEN a_rows = 0 THEN 'only_b' ELSE 'both_differ' END outcome, k,
        a_rows, a_sum, b_rows, b_sum, a_rows - b_rows delta_rows, a_sum - b_sum delta_sum
      FROM m WHERE a_rows <> b_rows OR abs(a_sum - b_sum) > 0.01
      UNION ALL SELECT 'only_a_empty_id', '', count(*), sum(amt), 0, 0, count(*), sum(amt) FROM xa
      WHERE cls = 'electronic' AND id = '' HAVING count(*) > 0)
SELECT outcome, k, CAST(a_rows AS BIGINT) a_rows, CAST(a_sum AS DOUBLE) a_sum, CAST(b_rows AS BIGINT) b_rows,
  CAST(b_sum AS DOUBLE) b_sum, CAST(delta_rows AS BIGINT) delta_rows, CAST(delta_sum AS DOUBLE) delta_sum FROM l
UNION ALL SELECT 'total', NULL, CAST(sum(a_rows) AS BIGINT), CAST(sum(a_sum) AS DOUBLE), CAST(sum(b_rows) AS BIGINT),
  CAST(sum(b_sum) AS DOUBLE), CAST(sum(delta_rows) AS BIGINT), CAST(sum(delta_sum) AS DOUBLE) FROM l"""

Q["csv_roundtrip"] = f"""
SELECT o_orderkey k, 'Città ' || CAST(o_custkey AS VARCHAR) "Creditore",
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) amount, strftime(o_orderdate, {DAY}) d FROM orders"""

Q["period_if_filled"] = f"""
SELECT o_orderkey k, strftime(o_orderdate, {DAY}) d, strftime(o_orderdate + INTERVAL 3 DAY, {DAY}) paid FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o_orderstatus = 'F'
  AND o_orderdate + INTERVAL 3 DAY BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'"""

Q["register_detail"] = _EXPORT + f"""
SELECT 'Supplier#' || l_suppkey party, strftime(d, {DAY}) doc_date, CAST(k AS VARCHAR) doc_no, strftime(d, {DAY}) reg_date,
  proto code, CASE WHEN rf = 'A' THEN 'A' ELSE 'D' END sign, CAST(l_linenumber AS VARCHAR) seq_no, id ext_id, pcls cls,
  CAST(paid AS DOUBLE) amount, 0.0::DOUBLE tax, 0.0::DOUBLE order_total, CAST(sw AS DOUBLE) withholding FROM y"""

Q["register_code_counts"] = _EXPORT + f""",
dim AS (SELECT * FROM (VALUES {_DIM}) v(pos, code, descr, cls))
SELECT dim.code, CAST(count(y.k) AS BIGINT) n FROM dim LEFT JOIN y ON y.proto = dim.code GROUP BY dim.code"""

Q["portal_received_detail"] = f"""
WITH t AS (SELECT o_orderkey k, o_custkey c, o_orderdate d, CAST(o_totalprice AS DECIMAL(18,2)) total,
             CASE WHEN o_orderkey % 7 IN (0, 1) THEN 0
                  ELSE round_even(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(18,2)), 2) END vat FROM orders
           WHERE o_orderdate BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30')
SELECT 'Customer#' || c party, CAST(k AS VARCHAR) doc_no, strftime(d, {DAY}) paid, CAST(vat AS DOUBLE) vat,
  CAST(total - vat AS DOUBLE) taxable, CAST(total AS DOUBLE) total FROM t
UNION ALL SELECT 'TOTALE', NULL, NULL, CAST(sum(vat) AS DOUBLE), CAST(sum(total - vat) AS DOUBLE), CAST(sum(total) AS DOUBLE) FROM t"""

_COMPARED = _EXPORT + """,
xa AS (SELECT id, k, d, CAST(paid AS DECIMAL(18,2)) amt, CASE WHEN pcls = 'paper' THEN 'paper' ELSE 'electronic' END cls FROM y),
b0 AS (SELECT CASE WHEN o_orderstatus = 'P' THEN (CASE o_orderkey % 4 WHEN 1 THEN 'nan' WHEN 3 THEN 'None' ELSE '' END)
                   WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN '0' ELSE CAST(o_orderkey AS VARCHAR) END id,
         o_orderkey k, o_orderdate d,
         CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.90 AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) amt FROM orders),
xb AS (SELECT *, CASE WHEN id = '' THEN 'paper' ELSE 'electronic' END cls FROM b0),
ga AS (SELECT id, count(*) n, sum(amt) s FROM xa WHERE cls = 'electronic' AND id <> '' GROUP BY id),
gb AS (SELECT id, count(*) n, sum(amt) s FROM xb WHERE cls = 'electronic' GROUP BY id),
m AS (SELECT coalesce(ga.id, gb.id) k, coalesce(ga.n, 0) a_rows, coalesce(ga.s, 0) a_sum, coalesce(gb.n, 0) b_rows, coalesce(gb.s, 0) b_sum
      FROM ga FULL OUTER JOIN gb ON ga.id = gb.id)"""

Q["compare_delta"] = _COMPARED + """
SELECT CASE WHEN b_rows = 0 THEN 'only_a' WHEN a_rows = 0 THEN 'only_b' ELSE 'different_amount' END outcome, k,
  CAST(a_rows AS BIGINT) a_rows, CAST(a_sum AS DOUBLE) a_sum, CAST(b_rows AS BIGINT) b_rows, CAST(b_sum AS DOUBLE) b_sum,
  CAST(a_sum - b_sum AS DOUBLE) delta_sum
FROM m WHERE a_rows = 0 OR b_rows = 0 OR abs(a_sum - b_sum) > 0.01"""

Q["compare_drilldown"] = _COMPARED + """,
top AS (SELECT k FROM m ORDER BY abs(a_sum - b_sum) DESC, k LIMIT 30),
ra AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, CAST(k AS VARCHAR)) rn FROM xa
       WHERE cls = 'electronic' AND id IN (SELECT k FROM top)),
rb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, CAST(k AS VARCHAR)) rn FROM xb
       WHERE cls = 'electronic' AND id IN (SELECT k FROM top))
SELECT id k, 'a' side, CAST(amt AS DOUBLE) amt, CAST(k AS VARCHAR) doc_no FROM ra WHERE rn <= 20
UNION ALL SELECT id, 'b', CAST(amt AS DOUBLE), CAST(k AS VARCHAR) FROM rb WHERE rn <= 20"""

Q["compare_paper_detail"] = _COMPARED + """,
pa AS (SELECT CAST(k AS VARCHAR) num, amt, count(*) n FROM xa WHERE cls = 'paper' GROUP BY 1, 2),
pb AS (SELECT CAST(k AS VARCHAR) num, amt, count(*) n FROM xb WHERE cls = 'paper' GROUP BY 1, 2),
pm AS (SELECT coalesce(pa.num, pb.num) num, coalesce(pa.amt, pb.amt) amt, coalesce(pa.n, 0) - coalesce(pb.n, 0) d
       FROM pa FULL OUTER JOIN pb ON pa.num = pb.num AND pa.amt = pb.amt)
SELECT CASE WHEN d > 0 THEN 'only_a' ELSE 'only_b' END outcome, num num_key, CAST(amt AS VARCHAR) amount_key,
  CAST(CASE WHEN d > 0 THEN amt ELSE -amt END AS DOUBLE) delta
FROM (SELECT *, unnest(range(abs(d))) FROM pm WHERE d <> 0)"""

Q["compare_overview"] = _COMPARED + """,
u AS (SELECT 'a' side, cls, amt FROM xa UNION ALL SELECT 'b', cls, amt FROM xb)
SELECT 'Tutto il periodo' period,
  """ + ",\n  ".join(
    f"count(*) FILTER (side = '{side}' AND cls = '{c}') {side}_{c}_count, "
    f"CAST(coalesce(sum(amt) FILTER (side = '{side}' AND cls = '{c}'), 0) AS DOUBLE) {side}_{c}_amount"
    for side in "ab" for c in ("paper", "electronic")) + """
FROM u"""

Q["csv_quoted_lines"] = """
SELECT o_orderkey k, CASE o_orderkey % 5 WHEN 0 THEN 'Customer#' || o_custkey || chr(10) || '"Sons", Ltd' || chr(10) || o_orderkey
    WHEN 1 THEN '5" pipe, Customer#' || o_custkey ELSE 'Customer#' || o_custkey END "Creditore",
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) amount FROM orders"""

Q["register_from_files"] = f"""
WITH r AS (SELECT l_shipdate d, l_orderkey k,
             CASE WHEN l_partkey % 10 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END id,
             {PROTO} proto, l_returnflag rf, CAST(l_extendedprice AS DECIMAL(18,2)) price,
             round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) w,
             l_orderkey % 50 = 0 AND l_linenumber = 1 bad, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
g AS (SELECT count(*) n FROM r WHERE NOT bad GROUP BY d, k, id),
f AS (SELECT *, row_number() OVER (PARTITION BY d, k, id
        ORDER BY l_linenumber % 2 = 0, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn FROM r WHERE NOT bad),
x AS (SELECT *, CASE WHEN rf = 'A' THEN -price ELSE price END sp, CASE WHEN rf = 'A' THEN -w ELSE w END sw,
        {_pcls('proto')} pcls FROM f WHERE rn = 1),
y AS (SELECT *, CASE WHEN proto IN ('EL', '2EL', 'L') THEN sp - sw ELSE sp END paid FROM x)
SELECT CAST(count(*) AS BIGINT) total_records,
  CAST(sum(CASE WHEN pcls = 'paper' THEN 1 ELSE 0 END) AS BIGINT) paper_records,
  CAST(sum(CASE WHEN pcls IN ('electronic', 'self_invoice') THEN 1 ELSE 0 END) AS BIGINT) electronic_records,
  CAST(coalesce(sum(CASE WHEN pcls = 'paper' THEN paid END), 0) AS DOUBLE) paper_amount,
  CAST(coalesce(sum(CASE WHEN pcls IN ('electronic', 'self_invoice') THEN paid END), 0) AS DOUBLE) electronic_amount,
  CAST((SELECT sum(n) - count(*) FROM g) AS BIGINT) duplicates_removed, CAST(0 AS BIGINT) rejected_amounts,
  CAST((SELECT count(*) FROM r WHERE bad) AS BIGINT) skipped_rows
FROM y"""

Q["portal_periods_by_file"] = f"""
SELECT o_orderkey k, strftime(o_orderdate, {DAY}) d,
  CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.90 AS DECIMAL(18,2)), 2) AS DOUBLE) paid,
  CASE o_orderkey % 3 WHEN 1 THEN 'Portale 2° trimestre 2000' ELSE 'Portale III TRIM' END file
FROM orders WHERE (o_orderkey % 3 = 1 AND o_orderdate BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30')
  OR (o_orderkey % 3 = 2 AND o_orderdate BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2000-09-30')"""
