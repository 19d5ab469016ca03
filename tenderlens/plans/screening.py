"""Screening queries over the contract view of the driver tables: context aggregates, windows, joins, checks, reconciliation,
statistics and functions. Each is one declarative SQL plan, written once over the dialect's spellings.

Roles: row = order line, buyer = customer's nation, client = customer, supplier = l_suppkey, category = p_type, amount =
extended price, date = order date, pub = ship date, offers = line number, direct = return flag (A yes, R no, N unknown).
"""

from __future__ import annotations


def contracts(d) -> str:
    return f"""contracts AS (SELECT o_orderkey AS order_id, c_nationkey AS buyer, o_custkey AS client, l_suppkey AS supplier, p_type AS category,
  l_partkey AS part_id, l_extendedprice AS amount, l_quantity AS quantity, l_discount AS discount, l_linenumber AS offers, CAST(o_orderdate AS DATE) AS date, CAST(l_shipdate AS DATE) AS pub,
  year(o_orderdate) AS yr, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS direct, l_linestatus AS status, o_orderpriority AS procedure_name, c_mktsegment AS segment, p_brand AS brand
  FROM {d.lineitem} JOIN {d.orders} ON l_orderkey = o_orderkey JOIN {d.customer} ON o_custkey = c_custkey JOIN {d.part} ON l_partkey = p_partkey)"""


CHECK = "CASE WHEN ({app}) IS NOT TRUE THEN 'not-applicable' WHEN ({known}) IS NOT TRUE THEN 'unknown' WHEN coalesce({hit}, false) THEN 'signal' ELSE 'clear' END"


def check(app: str, known: str, hit: str) -> str:
    """Tri-state status: not-applicable, unknown, signal or clear; a null comparison never signals."""
    return CHECK.format(app=app, known=known, hit=hit)


def graduated(v: str, start: float, end: float, lo: float, hi: float) -> str:
    """Points rising with v from lo at start to hi at end, clamped, to one decimal (halves up)."""
    return f"floor(({lo} + ({hi} - {lo}) * least(1.0, greatest(0.0, ({v} - {start}) / ({end} - {start})))) * 10 + 0.5) / 10"


#: check: family, applicable, known, hit, points; in the order of the letter codes
CHECKS = {
    "single-bid": ("competition", "direct IS NOT TRUE", "offers > 0", "offers = 1", "12.0"),
    "direct-award": ("procedure", "true", "direct IS NOT NULL", "direct AND amount >= 40000", "18.0"),
    "repeated-single-bid": ("competition", "true", "known >= 10", "single_rate >= 0.2", graduated("single_rate", 0.2, 0.3, 12.0, 30.0)),
    "supplier-concentration": ("concentration", "true", "known >= 10", "share >= 0.015", graduated("share", 0.015, 0.03, 12.0, 30.0)),
    "repeated-direct-award": ("procedure", "direct", "true", "directs >= 3", graduated("directs", 3.0, 10.0, 18.0, 30.0)),
    "late-publication": ("publication", "true", "delay >= 0", "delay > 120", graduated("delay", 120.0, 730.0, 8.0, 16.0)),
}


def with_facts(d) -> str:
    """Contracts with their competition, concentration and repetition contexts, and each check's state (s1, ...) and points
    (p1, ...) as columns of one projection."""
    states = ", ".join(f"{check(app, known, hit)} AS s{i}, {points} AS p{i}" for i, (_, app, known, hit, points) in enumerate(CHECKS.values(), 1))
    return f"""WITH {contracts(d)},
grp AS (SELECT buyer, category, count(*) AS total, count(offers) AS known, count(CASE WHEN offers = 1 THEN 1 END) AS single FROM contracts GROUP BY buyer, category),
sup AS (SELECT buyer, category, supplier, count(*) AS wins, count(CASE WHEN direct THEN 1 END) AS directs, count(direct) AS direct_known FROM contracts GROUP BY buyer, category, supplier),
context AS (SELECT c.*, g.total, g.known, g.single * 1.0 / g.known AS single_rate, s.wins, s.directs, s.wins * 1.0 / g.total AS share, {d.days('c.pub', 'c.date')} AS delay
  FROM contracts c JOIN grp g ON c.buyer = g.buyer AND c.category = g.category JOIN sup s ON c.buyer = s.buyer AND c.category = s.category AND c.supplier = s.supplier),
facts AS (SELECT *, {states} FROM context)"""


def with_context(d) -> str:
    """The facts, and the long table of checks, made from them row by row."""
    rows = [{"check_id": f"'{name}'", "family": f"'{c[0]}'", "state": f"s{i}", "weight": f"CAST(p{i} AS DOUBLE)"} for i, (name, c) in enumerate(CHECKS.items(), 1)]
    keys = "order_id, part_id, supplier, offers, quantity, amount, buyer, status, category"
    return f"""{with_facts(d)},
long_facts AS (SELECT {keys}, {d.records(rows)} AS c FROM facts),
checks AS (SELECT {keys}, c.check_id, c.family, c.state, c.weight FROM long_facts)"""


#: name -> query text of a dialect
PLANS: dict = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


def scored(d) -> str:
    """Contracts with the sum over families of the highest points of a signal, not below zero; clear checks with points
    below zero subtract. Null where no check could be evaluated."""
    of = {}
    for i, (family, *_) in enumerate(CHECKS.values(), 1):
        of.setdefault(family, []).append(i)
    best = {f: "greatest(" + ", ".join([f"CASE WHEN s{i} = 'signal' THEN CAST(p{i} AS DOUBLE) END" for i in own] + ["CAST(NULL AS DOUBLE)"] * (len(own) < 2)) + ")" for f, own in of.items()}
    clear = " + ".join(f"CASE WHEN s{i} = 'clear' AND p{i} < 0 THEN p{i} ELSE 0.0 END" for i in range(1, len(CHECKS) + 1))
    total = " + ".join(f"coalesce({x}, 0.0)" for x in best.values())
    evaluated = " OR ".join(f"s{i} IN ('signal', 'clear')" for i in range(1, len(CHECKS) + 1))
    families = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in best.values())
    return f"""{with_facts(d)},
scored AS (SELECT order_id, part_id, supplier, offers, quantity, round(amount, 2) AS amount, CASE WHEN {evaluated} THEN round(greatest(0.0, {total} + {clear}), 1) END AS score, CAST({families} AS BIGINT) AS families FROM facts)"""


@plan
def m0_screening_index(d):
    """The 200 contracts of the highest index."""
    return f"{scored(d)} SELECT * FROM scored ORDER BY score DESC NULLS LAST, families DESC, order_id, part_id, supplier, offers, quantity, amount LIMIT 200"


@plan
def m0_index_of_all(d):
    """The index of every contract."""
    return f"{scored(d)} SELECT * FROM scored"


@plan
def a1_competition_context(d):
    return f"WITH {contracts(d)} SELECT buyer, category, count(*) AS total, count(offers) AS known, count(CASE WHEN offers = 1 THEN 1 END) AS single, round(count(offers) * 1.0 / count(*), 6) AS coverage, round(count(CASE WHEN offers = 1 THEN 1 END) * 1.0 / count(offers), 6) AS rate, count(offers) >= 10 AND count(offers) >= 0.8 * count(*) AS sufficient FROM contracts GROUP BY buyer, category"


@plan
def a2_supplier_context(d):
    return f"WITH {contracts(d)}, s AS (SELECT buyer, category, supplier, count(*) AS wins, count(CASE WHEN direct THEN 1 END) AS direct_count, count(direct) AS direct_known FROM contracts GROUP BY buyer, category, supplier) SELECT *, CAST(sum(wins) OVER (PARTITION BY buyer, category) AS BIGINT) AS known, round(wins * 1.0 / sum(wins) OVER (PARTITION BY buyer, category), 6) AS share FROM s"


@plan
def a4_repeated_direct(d):
    return f"WITH {contracts(d)} SELECT buyer, supplier, count(CASE WHEN direct THEN 1 END) AS directs, count(*) AS contracts FROM contracts GROUP BY buyer, supplier HAVING count(CASE WHEN direct THEN 1 END) >= 3"


@plan
def a5_buyer_year_share(d):
    return f"WITH {contracts(d)}, v AS (SELECT client, yr, supplier, sum(amount) AS value FROM contracts GROUP BY client, yr, supplier) SELECT client, CAST(yr AS BIGINT) AS yr, supplier, round(value, 2) AS value, round(value / sum(value) OVER (PARTITION BY client, yr), 6) AS share FROM v"


@plan
def a7_distinct_process_repetition(d):
    return f"WITH {contracts(d)} SELECT buyer, supplier, count(DISTINCT order_id) AS processes, count(DISTINCT CASE WHEN offers = 1 THEN order_id END) AS single, count(DISTINCT CASE WHEN direct THEN order_id END) AS exceptions FROM contracts GROUP BY buyer, supplier"


@plan
def a8_distinct_concentration(d):
    return f"WITH {contracts(d)}, t AS (SELECT buyer, category, count(DISTINCT order_id) AS total FROM contracts GROUP BY buyer, category), s AS (SELECT buyer, category, supplier, count(DISTINCT order_id) AS wins FROM contracts GROUP BY buyer, category, supplier) SELECT buyer, category, supplier, total, wins, round(wins * 1.0 / total, 6) AS share FROM s JOIN t USING (buyer, category)"


@plan
def a11_leave_one_out_median(d):
    """Median delay of a buyer's other rows. Only three order statistics of a group matter, read off its histogram, so no
    group is gathered in one place."""
    return f"""WITH {contracts(d)}, x AS (SELECT buyer, {d.days('pub', 'date')} AS delay FROM contracts WHERE pub >= date),
h AS (SELECT buyer, delay, count(*) AS k FROM x GROUP BY buyer, delay),
c AS (SELECT buyer, delay, k, CAST(sum(k) OVER (PARTITION BY buyer ORDER BY delay) AS BIGINT) - k AS before, CAST(sum(k) OVER (PARTITION BY buyer) AS BIGINT) AS n FROM h),
r AS (SELECT *, {d.div('(n - 1)', '2')} AS mid, (n - 1) % 2 AS odd FROM c),
e AS (SELECT buyer, max(CASE WHEN before <= mid - 1 AND mid - 1 < before + k THEN delay END) AS e0, max(CASE WHEN before <= mid AND mid < before + k THEN delay END) AS e1, max(CASE WHEN before <= mid + 1 AND mid + 1 < before + k THEN delay END) AS e2 FROM r GROUP BY buyer)
SELECT buyer, delay, k AS contracts, n, CASE WHEN n < 11 THEN NULL WHEN odd = 1 THEN CAST(CASE WHEN before <= mid THEN e2 ELSE e1 END AS DOUBLE)
  ELSE ((CASE WHEN before <= mid - 1 THEN e1 ELSE e0 END) + (CASE WHEN before <= mid THEN e2 ELSE e1 END)) / 2.0 END AS baseline FROM r JOIN e USING (buyer)"""


@plan
def a12_identity_ambiguity(d):
    return f"SELECT l_orderkey AS order_id, l_linenumber AS line, count(*) AS copies FROM {d.lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


@plan
def a14_assessment_counters(d):
    return f"{with_context(d)} SELECT check_id, count(CASE WHEN state <> 'not-applicable' THEN 1 END) AS applicable, count(CASE WHEN state IN ('signal', 'clear') THEN 1 END) AS evaluated, count(CASE WHEN state = 'unknown' THEN 1 END) AS unknown_count, count(CASE WHEN state = 'not-applicable' THEN 1 END) AS not_applicable, count(CASE WHEN state = 'signal' THEN 1 END) AS signals, round(sum(CASE WHEN state = 'signal' THEN weight ELSE 0 END), 1) AS weighted FROM checks GROUP BY check_id"


@plan
def a15_signal_facets(d):
    return f"{with_context(d)} SELECT check_id, family, count(DISTINCT order_id) AS orders FROM checks WHERE state = 'signal' GROUP BY check_id, family"


@plan
def a16_facet_values(d):
    return f"WITH {contracts(d)} SELECT 'category' AS facet, category AS value, count(*) AS n FROM contracts GROUP BY category UNION ALL SELECT 'procedure', procedure_name, count(*) FROM contracts GROUP BY procedure_name UNION ALL SELECT 'segment', segment, count(*) FROM contracts GROUP BY segment"


@plan
def a18_missingness(d):
    return f"WITH {contracts(d)} SELECT count(*) AS contracts, count(CASE WHEN direct IS NULL THEN 1 END) AS direct_missing, count(CASE WHEN pub < date THEN 1 END) AS impossible_dates, count(CASE WHEN amount = 0 THEN 1 END) AS zero_amounts, count(CASE WHEN supplier IS NULL THEN 1 END) AS supplier_missing FROM contracts"


@plan
def a20_profile(d):
    return f"""WITH {contracts(d)}, p AS (SELECT buyer, supplier, count(*) AS n, max(amount) AS largest FROM contracts GROUP BY buyer, supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY n DESC, supplier) AS place FROM p)
SELECT buyer, place, supplier, n, round(largest, 2) AS largest FROM (SELECT buyer, CAST(place AS BIGINT) AS place, supplier, n, largest FROM r WHERE place <= 10) t"""


@plan
def a21_bid_opening_features(d):
    """Of the openings' positive bids, from three on: variation, and the gap of the two lowest over the spread of all but the
    lowest; a spread of zero gives 0 without a gap and else infinity."""
    return f"""WITH s AS (SELECT l_orderkey AS opening, CASE WHEN l_extendedprice > 0 THEN l_extendedprice END AS bid FROM {d.lineitem}),
r AS (SELECT *, CASE WHEN bid IS NOT NULL THEN row_number() OVER (PARTITION BY opening ORDER BY CASE WHEN bid IS NULL THEN 1 ELSE 0 END, bid) END AS place FROM s),
f AS (SELECT opening, count(*) AS bids, count(bid) AS valid, stddev_pop(bid) / avg(bid) AS cv, max(CASE WHEN place = 2 THEN bid END) - max(CASE WHEN place = 1 THEN bid END) AS gap, max(CASE WHEN place > 1 THEN bid END) - min(CASE WHEN place > 1 THEN bid END) AS width, {d.gathered_deviation('CASE WHEN place > 1 THEN bid END')} AS spread FROM r GROUP BY opening)
SELECT opening, bids, valid, round(CASE WHEN valid >= 3 THEN cv END, 6) AS cv, CASE WHEN valid < 3 THEN NULL WHEN width = 0 THEN CASE WHEN gap = 0 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END ELSE round({d.over_deviation('gap', 'spread')}, 4) END AS relative_distance FROM f"""


@plan
def a22_discrete_percentiles(d):
    """p10 and p90 at index int(q n) of the sorted values, by rank instead of a gathered array."""
    return f"""WITH {contracts(d)}, r AS (SELECT category, yr, amount, row_number() OVER (PARTITION BY category, yr ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY category, yr) AS n FROM contracts)
SELECT category, CAST(yr AS BIGINT) AS yr, max(n) AS n, round(max(CASE WHEN i = floor(0.1 * n) THEN amount END), 2) AS p10, round(max(CASE WHEN i = floor(0.9 * n) THEN amount END), 2) AS p90 FROM r GROUP BY category, yr"""


@plan
def a23_version_rollup(d):
    return f"SELECT o_custkey AS contract, count(*) AS versions, CAST(min(o_orderdate) AS DATE) AS first_signed, CAST(max(o_orderdate) AS DATE) AS last_signed, round(max_by(o_totalprice, o_orderkey), 2) AS last_amount, round(min_by(o_totalprice, o_orderkey), 2) AS first_amount, count(DISTINCT o_orderpriority) > 1 AS changed FROM {d.orders} GROUP BY o_custkey"


@plan
def a24_version_steps(d):
    return f"""WITH s AS (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, CAST(o_orderdate AS DATE) AS day, CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS start FROM {d.orders})
SELECT o_custkey AS contract, count(CASE WHEN step > 0 THEN 1 END) AS rises, count(CASE WHEN step < 0 THEN 1 END) AS cuts, count(step) AS changes FROM s WHERE {d.days('day', 'start')} <= 730 GROUP BY o_custkey"""


@plan
def a26_last_value(d):
    return f"WITH {contracts(d)} SELECT client, max_by(supplier, struct_key) FILTER (WHERE direct IS NOT NULL) AS last_supplier FROM (SELECT client, supplier, direct, order_id * 1000000 + supplier AS struct_key FROM contracts) t GROUP BY client"


@plan
def a27_filtered_counts(d):
    return f"WITH {contracts(d)} SELECT count(*) AS n, count(*) FILTER (WHERE amount > 0) AS with_amount, count(*) FILTER (WHERE direct) AS directs, count(*) FILTER (WHERE direct IS NULL) AS unknown_direct, count(*) FILTER (WHERE offers = 1) AS single, count(*) FILTER (WHERE pub < date) AS reversed, count(*) FILTER (WHERE amount >= 40000 AND direct) AS large_direct FROM contracts"


@plan
def a29_activity_rollup(d):
    return f"""WITH {contracts(d)}, c AS (SELECT category, segment, client, count(*) AS n FROM contracts GROUP BY category, segment, client), cs AS (SELECT category, segment, sum(n) AS n FROM c GROUP BY category, segment), ct AS (SELECT category, sum(n) AS n FROM c GROUP BY category), cc AS (SELECT category, client, sum(n) AS n FROM c GROUP BY category, client)
SELECT c.category, c.segment, c.client, round((cs.n - c.n) * 1.0 / nullif(ct.n - cc.n, 0), 6) AS share FROM c JOIN cs ON c.category = cs.category AND c.segment = cs.segment JOIN ct ON c.category = ct.category JOIN cc ON c.category = cc.category AND c.client = cc.client"""


@plan
def a30_equal_split(d):
    return f"WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey, o_totalprice, year(o_orderdate) AS yr FROM {d.lineitem} JOIN {d.orders} ON l_orderkey = o_orderkey), s AS (SELECT *, o_totalprice / count(*) OVER (PARTITION BY l_orderkey) AS part FROM k) SELECT CAST(yr AS BIGINT) AS yr, l_suppkey AS supplier, round(sum(part), 2) AS value FROM s GROUP BY yr, l_suppkey"


@plan
def a31_majority_vote(d):
    return f"""WITH v AS (SELECT l_partkey AS record, l_returnflag AS route, max(l_discount) AS amount FROM {d.lineitem} GROUP BY l_partkey, l_returnflag HAVING count(DISTINCT l_discount) <= 8), a AS (SELECT record, amount, count(DISTINCT route) AS routes FROM v GROUP BY record, amount), r AS (SELECT *, rank() OVER (PARTITION BY record ORDER BY routes DESC) AS place, count(*) OVER (PARTITION BY record, routes) AS same FROM a)
SELECT record, amount, routes FROM r WHERE place = 1 AND same = 1 AND routes >= 2"""


@plan
def a33_exclusion_funnel(d):
    return f"WITH {contracts(d)} SELECT CASE WHEN direct IS NULL THEN 'unknown procedure' WHEN direct THEN 'direct' WHEN pub < date THEN 'impossible dates' WHEN amount < 5000 THEN 'small' ELSE 'kept' END AS reason, count(*) AS n FROM contracts GROUP BY 1"


@plan
def a34_quality_histogram(d):
    return f"WITH {contracts(d)}, u AS (SELECT 'direct' AS field, CASE WHEN direct IS NULL THEN 'missing' ELSE 'present' END AS state FROM contracts UNION ALL SELECT 'dates', CASE WHEN pub < date THEN 'conflict' ELSE 'present' END FROM contracts UNION ALL SELECT 'offers', CASE WHEN offers = 1 THEN 'one' ELSE 'several' END FROM contracts) SELECT field, state, count(*) AS n FROM u GROUP BY field, state"


@plan
def a37_buyer_weighted_rate(d):
    return f"WITH {contracts(d)}, b AS (SELECT buyer, category, max(quantity) AS bw, sum(quantity * CASE WHEN offers = 1 THEN 1 ELSE 0 END) / sum(quantity) AS rate FROM contracts GROUP BY buyer, category) SELECT category, round(sum(bw * rate) / sum(bw), 6) AS weighted_rate, count(*) AS buyers FROM b GROUP BY category"


@plan
def a38_group_concat(d):
    return f"SELECT o_custkey AS client, {d.join('o_orderpriority', '; ', 'o_orderpriority')} AS priorities FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM {d.orders}) t GROUP BY o_custkey"


@plan
def w1_first_row(d):
    return f"SELECT l_orderkey AS uid, l_suppkey AS holder, l_extendedprice AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey ASC NULLS LAST, l_extendedprice, l_shipdate, l_partkey, l_quantity) AS rn FROM {d.lineitem}) t WHERE rn = 1"


@plan
def w2_distinct_over(d):
    return f"WITH k AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS holders FROM {d.lineitem} GROUP BY l_orderkey) SELECT l_orderkey AS uid, l_suppkey AS holder, l_linenumber AS line, l_partkey AS part_id, l_quantity AS quantity, holders FROM {d.lineitem} JOIN k USING (l_orderkey)"


@plan
def w5_direct_share(d):
    return f"WITH {contracts(d)}, s AS (SELECT buyer, category, supplier, count(CASE WHEN direct THEN 1 END) AS directs, count(direct) AS known FROM contracts GROUP BY buyer, category, supplier) SELECT buyer, category, supplier, round(sum(directs) OVER (PARTITION BY buyer, category) * 1.0 / nullif(sum(known) OVER (PARTITION BY buyer, category), 0), 6) AS direct_rate, directs FROM s"


@plan
def w7_prior_three_years(d):
    """Rows of the same client in the three years before the day: a frame over day numbers, up to the day before."""
    return f"SELECT o_orderkey AS id, o_custkey AS client, count(*) OVER (PARTITION BY o_custkey ORDER BY {d.epoch_days('o_orderdate')} RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING) AS prior FROM {d.orders}"


@plan
def w9_leave_one_out_share(d):
    return f"WITH {contracts(d)}, k AS (SELECT buyer, category, supplier, count(*) AS wins FROM contracts GROUP BY buyer, category, supplier), t AS (SELECT *, sum(wins) OVER (PARTITION BY buyer, category) AS known FROM k) SELECT buyer, category, supplier, round(CASE WHEN known - 1 >= 10 THEN (wins - 1) * 1.0 / (known - 1) END, 6) AS share FROM t"


@plan
def w13_new_supplier(d):
    return f"WITH {contracts(d)}, y AS (SELECT DISTINCT client, supplier, CAST(yr AS INT) AS yr FROM contracts) SELECT client, supplier, yr, count(*) OVER (PARTITION BY client, supplier ORDER BY yr RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) = 0 AS is_new FROM y"


@plan
def w14_lower_quartile(d):
    return f"WITH {contracts(d)}, r AS (SELECT category, amount, row_number() OVER (PARTITION BY category ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM contracts) SELECT category, round(max(amount), 2) AS cut FROM r WHERE i = floor(0.25 * (n - 1)) AND n >= 4 GROUP BY category"


@plan
def w15_mid_rank(d):
    """Share of values below, and half of the equal ones. Distinct values are counted, then cumulated in bands; one task
    sees a row a band."""
    return f"""WITH v AS (SELECT c_acctbal AS v, floor(c_acctbal / 10) AS band, count(*) AS k FROM {d.customer} WHERE c_acctbal IS NOT NULL GROUP BY 1, 2),
b AS (SELECT band, sum(k) AS k FROM v GROUP BY band), t AS (SELECT sum(k) AS n FROM b),
c AS (SELECT band, sum(k) OVER (ORDER BY band) - k AS before FROM b),
r AS (SELECT v.v, v.k, c.before + sum(v.k) OVER (PARTITION BY v.band ORDER BY v.v) - v.k AS below FROM v JOIN c ON v.band = c.band)
SELECT c_custkey AS id, round((2 * r.below + r.k) / 2.0 / t.n, 6) AS percentile FROM {d.customer} JOIN r ON c_acctbal = r.v CROSS JOIN t"""


@plan
def w18_coverage_islands(d):
    return f"""WITH x AS (SELECT DISTINCT user_id, {d.epoch_days('ts')} AS day FROM {d.events}), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM x)
SELECT user_id, CAST(min(day) AS BIGINT) AS first_day, CAST(max(day) AS BIGINT) AS last_day, count(*) AS days FROM g GROUP BY user_id, island HAVING count(*) >= 2"""


@plan
def o3_tie_break_chain(d):
    return f"SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS priority FROM {d.orders} ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100"


@plan
def o5_priority_sort(d):
    return f"SELECT o_orderkey AS id, round((power(2, CAST(substr(o_orderpriority, 1, 1) AS INT) / 10.0) - 1) * o_totalprice, 2) AS priority FROM {d.orders} ORDER BY priority DESC NULLS LAST, id LIMIT 250"


@plan
def o8_page(d):
    return f"SELECT id, amount FROM (SELECT o_orderkey AS id, o_totalprice AS amount, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM (SELECT * FROM {d.orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100) t) p WHERE place BETWEEN 51 AND 100"


@plan
def o10_deterministic_sample(d):
    return f"SELECT o_orderkey AS id, {d.sha('CAST(o_orderkey AS STRING)')} AS h FROM {d.orders} ORDER BY h LIMIT 100".replace("AS STRING", "AS VARCHAR(40)")


@plan
def p_filter_conjunction(d):
    return f"WITH {contracts(d)} SELECT order_id, supplier, offers, part_id, quantity, round(amount, 2) AS amount FROM contracts WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND amount > 0 AND amount >= 30000 AND direct AND lower(category) LIKE '%{'a'}%'"


@plan
def p4_search_all_terms(d):
    return f"SELECT doc_id FROM {d.documents} WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%license%'"


@plan
def p14_signal_semi_join(d):
    return f"{with_context(d)} SELECT category, count(*) AS n FROM contracts WHERE order_id IN (SELECT order_id FROM checks WHERE check_id = 'late-publication' AND state = 'signal') GROUP BY category"


@plan
def j6_anti_join(d):
    """Clients without an urgent order."""
    return f"SELECT c_custkey AS client FROM {d.customer} WHERE NOT EXISTS (SELECT 1 FROM {d.orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


@plan
def j7_row_valued_semi(d):
    return f"WITH {contracts(d)} SELECT buyer, category, supplier, count(*) AS n FROM contracts WHERE (buyer, category) IN (SELECT buyer, category FROM contracts WHERE direct GROUP BY buyer, category HAVING count(*) >= 5) GROUP BY buyer, category, supplier"


@plan
def j9_extremal_version(d):
    return f"SELECT o.o_custkey AS client, o.o_orderkey AS first_order, o.o_orderpriority AS priority FROM {d.orders} o JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM {d.orders} GROUP BY o_custkey) m ON o.o_custkey = m.o_custkey AND o.o_orderkey = m.k"


@plan
def j12_rotation(d):
    """Every opening (order) with its winner, the supplier of the lowest line price, and the peers that rotate with it: they bid
    here, met the winner in three or more other openings of the client within a year, and won one of them or more. Without
    a client or a single winner the state is unknown."""
    return f"""WITH s AS (SELECT o_custkey AS demand, o_orderkey AS opening, l_suppkey AS bidder, {d.epoch_days('o_orderdate')} AS day, min(l_extendedprice) AS price FROM {d.lineitem} JOIN {d.orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
b AS (SELECT demand, opening, bidder, day, CASE WHEN price = min(price) OVER (PARTITION BY opening) THEN 1 ELSE 0 END AS won FROM s),
o AS (SELECT opening, demand, day, CASE WHEN sum(won) = 1 THEN max(CASE WHEN won = 1 THEN bidder END) END AS winner FROM b GROUP BY opening, demand, day),
t AS (SELECT o.opening, o.demand, o.day, o.winner, b.bidder AS peer FROM o JOIN b ON o.opening = b.opening AND o.winner <> b.bidder),
p AS (SELECT x.demand, x.opening, x.day, x.bidder AS a, y.bidder AS b, y.won FROM b x JOIN b y ON x.opening = y.opening AND x.bidder <> y.bidder),
r AS (SELECT t.opening, t.peer FROM t JOIN p ON p.demand = t.demand AND p.a = t.winner AND p.b = t.peer AND p.opening <> t.opening AND p.day BETWEEN t.day - 365 AND t.day + 365 GROUP BY t.opening, t.peer HAVING count(*) >= 3 AND sum(p.won) >= 1),
n AS (SELECT opening, count(*) AS peers FROM r GROUP BY opening)
SELECT o.demand, o.opening, o.winner, coalesce(n.peers, 0) AS peers, CASE WHEN o.demand IS NULL OR o.winner IS NULL THEN 'unknown' WHEN n.peers > 0 THEN 'signal' ELSE 'clear' END AS state FROM o LEFT JOIN n ON o.opening = n.opening"""


@plan
def j13_quote_pairs(d):
    """Bidder pairs of each opening of 2 to 20 bids, with the other openings (of any size) within a year of it in which their
    absolute gap recurs: signal from two on, unknown where missing rates could make up two. Pairs of gap 0 are left out, as
    in the reference. A pair's day is the earlier of its two ship dates."""
    return f"""WITH b AS (SELECT l_orderkey AS opening, l_suppkey AS bidder, CAST(round(l_discount * 100) AS INT) AS rate, {d.epoch_days('l_shipdate')} AS day FROM {d.lineitem}), n AS (SELECT opening FROM b GROUP BY opening HAVING count(*) BETWEEN 2 AND 20),
p AS (SELECT x.opening, x.bidder AS a, y.bidder AS b, abs(y.rate - x.rate) AS gap, min(least(x.day, y.day)) AS day FROM b x JOIN b y ON x.opening = y.opening AND x.bidder < y.bidder GROUP BY 1, 2, 3, 4),
t AS (SELECT * FROM p WHERE (gap IS NULL OR gap <> 0) AND opening IN (SELECT opening FROM n)),
c AS (SELECT t.opening, t.a, t.b, t.gap, count(DISTINCT CASE WHEN q.gap = t.gap THEN q.opening END) AS exact, count(DISTINCT CASE WHEN q.gap = t.gap OR q.gap IS NULL THEN q.opening END) AS possible
  FROM t LEFT JOIN p q ON q.a = t.a AND q.b = t.b AND q.opening <> t.opening AND q.day BETWEEN t.day - 365 AND t.day + 365 GROUP BY t.opening, t.a, t.b, t.gap)
SELECT opening, a, b, gap, exact, CASE WHEN gap IS NULL THEN 'unknown' WHEN exact >= 2 THEN 'signal' WHEN possible >= 2 THEN 'unknown' ELSE 'clear' END AS state FROM c"""


@plan
def j15_point_in_interval(d):
    return f"WITH i AS (SELECT user_id, min(ts) AS start, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS stop FROM {d.events} WHERE event_type = (SELECT min(event_type) FROM {d.events}) GROUP BY user_id) SELECT e.event_type, count(*) AS n FROM {d.events} e JOIN i ON e.user_id = i.user_id AND i.start <= e.ts AND (i.stop IS NULL OR e.ts <= i.stop) GROUP BY e.event_type"


@plan
def j16_split_contracts(d):
    return f"WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, {d.epoch_days('o_orderdate')} AS day FROM {d.orders} WHERE o_totalprice < 200000), w AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS near, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS total FROM o) SELECT o_custkey AS client, o_orderkey AS id, near, round(total, 2) AS total FROM w WHERE near >= 2 AND total > 200000"


@plan
def j23_or_semi_join(d):
    return f"WITH {contracts(d)} SELECT order_id, count(*) AS n FROM contracts WHERE order_id IN (SELECT o_orderkey FROM {d.orders} WHERE o_totalprice > 300000 UNION SELECT l_orderkey FROM {d.lineitem} WHERE l_quantity >= 50 UNION SELECT l_orderkey FROM {d.lineitem} WHERE l_suppkey < 3) GROUP BY order_id"


@plan
def x_upsert_latest(d):
    return f"SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {d.events}) t WHERE rn = 1"


@plan
def x10_identical_or_conflicting(d):
    return f"SELECT l_orderkey AS order_id, l_linenumber AS line, count(*) AS copies, CASE WHEN count(DISTINCT l_partkey) = 1 AND count(DISTINCT l_extendedprice) = 1 THEN 'identical' ELSE 'conflicting' END AS kind FROM {d.lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


@plan
def k2_formula_guard(d):
    """Whole texts, with a leading apostrophe where a spreadsheet would take one for a formula."""
    space = r"\x00-\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    formula = f"^[{space}]*[=+@-]|^[\\t\\r\\n]"
    return f"SELECT doc_id, CASE WHEN {d.rx_has('text', formula)} THEN concat(chr(39), text) ELSE text END AS cell FROM {d.documents}"


@plan
def k9_letter_codes(d):
    """One letter a check, at the check's place: signal, clear, unknown or not applicable."""
    letters = ", ".join(f"CASE s{i} WHEN 'signal' THEN 's' WHEN 'clear' THEN 'c' WHEN 'unknown' THEN 'u' ELSE 'n' END" for i in range(1, len(CHECKS) + 1))
    return f"{with_facts(d)} SELECT order_id, part_id, supplier, offers, quantity, round(amount, 2) AS amount, concat({letters}) AS letters FROM facts"


@plan
def k10_snapshot_diff(d):
    """Two full outputs by id, on hashed rows: the orders with their status as recorded (before) and as their lines give it
    (after)."""
    row = "coalesce(CAST({id} AS VARCHAR(20)), ''), '|', coalesce({status}, '')"
    return f"""WITH x AS (SELECT o_orderkey AS id, {d.sha('concat(' + row.format(id='o_orderkey', status='o_orderstatus') + ')')} AS h FROM {d.orders}),
s AS (SELECT l_orderkey AS id, CASE WHEN count(*) = count(CASE WHEN l_linestatus = 'F' THEN 1 END) THEN 'F' WHEN count(*) = count(CASE WHEN l_linestatus = 'O' THEN 1 END) THEN 'O' ELSE 'P' END AS status FROM {d.lineitem} GROUP BY l_orderkey),
y AS (SELECT id, {d.sha('concat(' + row.format(id='id', status='status') + ')')} AS h FROM s)
SELECT coalesce(x.id, y.id) AS id, CASE WHEN y.h IS NULL THEN 'only-before' WHEN x.h IS NULL THEN 'only-after' WHEN x.h = y.h THEN 'common' ELSE 'changed' END AS state FROM x FULL JOIN y ON x.id = y.id"""


@plan
def r4_field_conflicts(d):
    return f"SELECT l_orderkey AS contract, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS supplier, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, count(DISTINCT l_suppkey) > 1 AS supplier_conflict, count(DISTINCT l_returnflag) > 1 AS flag_conflict FROM {d.lineitem} GROUP BY l_orderkey"


@plan
def r6_amount_decision(d):
    """The amount shown of several sources': the buyers' only positive one; of several the only one that the ministry gives
    too; without any the ministry's only one; zero only where no source has a positive amount."""
    return f"""WITH v AS (SELECT l_partkey AS record, CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END AS amount, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS feed, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ministry FROM {d.lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
a AS (SELECT record, count(CASE WHEN feed = 1 AND amount > 0 THEN 1 END) AS feeds, min(CASE WHEN feed = 1 AND amount > 0 THEN amount END) AS feed_amount, count(CASE WHEN ministry = 1 AND amount > 0 THEN 1 END) AS others, min(CASE WHEN ministry = 1 AND amount > 0 THEN amount END) AS other_amount,
  count(CASE WHEN feed = 1 AND ministry = 1 AND amount > 0 THEN 1 END) AS commons, min(CASE WHEN feed = 1 AND ministry = 1 AND amount > 0 THEN amount END) AS common_amount FROM v GROUP BY record)
SELECT record, CASE WHEN feeds = 1 THEN feed_amount WHEN feeds > 1 THEN CASE WHEN commons = 1 THEN common_amount END WHEN others = 1 THEN other_amount WHEN others = 0 THEN 0 END AS amount, feeds, others, commons FROM a"""


@plan
def r12_shared_identifier(d):
    return f"SELECT o_custkey AS grp, {d.join('CAST(o_orderkey AS VARCHAR(20))', ',', 'o_orderkey')} AS members, count(*) AS n FROM {d.orders} GROUP BY o_custkey HAVING count(*) > 1"


@plan
def r13_prefix_completion(d):
    return f"WITH v AS (SELECT DISTINCT p_brand AS full_code, substr(p_brand, 1, 7) AS prefix FROM {d.part}), u AS (SELECT prefix, min(full_code) AS full_code FROM v GROUP BY prefix HAVING count(*) = 1) SELECT p_partkey AS id, coalesce(u.full_code, substr(p_brand, 1, 7)) AS code FROM {d.part} LEFT JOIN u ON substr(p_brand, 1, 7) = u.prefix"


@plan
def m1_shrunk_likelihood(d):
    return f"""{with_context(d)}, b AS (SELECT c.check_id, f.buyer, max(CASE WHEN c.state = 'signal' THEN 1.0 ELSE 0.0 END) AS hit, max(CASE WHEN f.status = 'F' THEN 1 ELSE 0 END) AS bad FROM checks c JOIN (SELECT DISTINCT order_id, client AS buyer, status FROM contracts) f ON c.order_id = f.order_id WHERE c.state IN ('signal', 'clear') GROUP BY c.check_id, f.buyer),
r AS (SELECT check_id, sum(bad) AS nb, sum(1 - bad) AS ng, sum(bad * hit) AS hb, sum((1 - bad) * hit) AS hg FROM b GROUP BY check_id)
SELECT check_id, CAST(nb AS BIGINT) AS bad_buyers, CAST(ng AS BIGINT) AS good_buyers, round(((hb + 10 * (hb + hg) / (nb + ng)) / (nb + 10)) / nullif((hg + 10 * (hb + hg) / (nb + ng)) / (ng + 10), 0), 6) AS likelihood_ratio FROM r"""


@plan
def m12_indirect_standardisation(d):
    return f"WITH {contracts(d)}, s AS (SELECT category, segment, avg(CASE WHEN offers = 1 THEN 1.0 ELSE 0.0 END) AS rate FROM contracts GROUP BY category, segment) SELECT buyer, count(CASE WHEN offers = 1 THEN 1 END) AS observed, round(sum(rate), 4) AS expected, round(count(CASE WHEN offers = 1 THEN 1 END) / nullif(sum(rate), 0), 4) AS ratio FROM contracts JOIN s USING (category, segment) GROUP BY buyer"


@plan
def m14_rank_auc(d):
    return f"WITH x AS (SELECT l.toxic, d.n_chars AS score FROM {d.labels} l JOIN {d.documents} d ON l.doc_id = d.doc_id), h AS (SELECT score, count(CASE WHEN toxic = 1 THEN 1 END) AS p, count(CASE WHEN toxic = 0 THEN 1 END) AS n FROM x GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below FROM h) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM c"


@plan
def m20_benford(d):
    return f"WITH x AS (SELECT CAST(substr(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)), 1, 2) AS INT) AS lead_digits FROM {d.lineitem} WHERE l_extendedprice >= 10), g AS (SELECT lead_digits, count(*) AS n FROM x GROUP BY lead_digits) SELECT lead_digits, n, round(n * 1.0 / sum(n) OVER (), 6) AS share, round(log10(1 + 1.0 / lead_digits), 6) AS expected FROM g"


@plan
def m22_stratified_sample(d):
    return f"SELECT id, segment FROM (SELECT c_custkey AS id, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {d.sha('CAST(c_custkey AS VARCHAR(20))')}) AS place FROM {d.customer}) t WHERE place <= 10"


@plan
def f_graduated_points(d):
    return f"SELECT o_orderkey AS id, {graduated('o_totalprice', 50000.0, 300000.0, 8.0, 30.0)} AS points, round(power(2, {graduated('o_totalprice', 50000.0, 300000.0, 8.0, 30.0)} / 10), 4) AS multiplier FROM {d.orders}"


@plan
def f_bigram_similarity(d):
    return f"WITH n AS (SELECT n_nationkey AS id, lower(n_name) AS name, {d.bigrams('lower(n_name)')} AS b FROM {d.nation}) SELECT x.id AS a, y.id AS b, round({d.size(d.overlap('x.b', 'y.b'))} * 1.0 / least({d.size('x.b')}, {d.size('y.b')}), 6) AS similarity FROM n x JOIN n y ON x.id < y.id AND substr(x.name, 1, 1) = substr(y.name, 1, 1)"


@plan
def f_strict_dates(d):
    return f"WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '2024-6-1' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS s FROM {d.orders}) SELECT id, CASE WHEN {d.rx_has('s', '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} THEN {d.try_date('s')} END AS day FROM t"


@plan
def f_month_difference(d):
    return f"WITH {contracts(d)} SELECT (year(pub) - year(date)) * 12 + month(pub) - month(date) AS months, count(*) AS n FROM contracts GROUP BY 1"


@plan
def st_tumbling_window(d):
    return f"SELECT {d.window_from(86400)} AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {d.events} GROUP BY 1, 2"


@plan
def st_session_window(d):
    return f"""WITH o AS (SELECT user_id, {d.seconds('ts')} AS s, CASE WHEN {d.seconds('ts')} - lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 THEN 0 ELSE 1 END AS fresh, ts, event_id FROM {d.events}),
g AS (SELECT user_id, s, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, min(s) AS start_s, max(s) AS last_s, count(*) AS n FROM g GROUP BY user_id, session"""


@plan
def a3_type_concentration(d):
    """Rows without a direct flag count in the total of a buyer and category, and receive no share."""
    return f"WITH {contracts(d)}, s AS (SELECT buyer, category, CASE WHEN direct IS NOT NULL THEN supplier END AS holder, count(*) AS wins FROM contracts GROUP BY 1, 2, 3), t AS (SELECT *, CAST(sum(wins) OVER (PARTITION BY buyer, category) AS BIGINT) AS total, CAST(sum(CASE WHEN holder IS NOT NULL THEN wins ELSE 0 END) OVER (PARTITION BY buyer, category) AS BIGINT) AS known FROM s) SELECT buyer, category, holder, total, known, wins, round(wins * 1.0 / known, 6) AS share, round(known * 1.0 / total, 6) AS coverage, known >= 10 AND known >= 0.8 * total AS sufficient FROM t WHERE holder IS NOT NULL"


@plan
def a25_buyer_year_totals(d):
    """A buyer's total of a year, each supplier's value and share, and in how many years the supplier served the buyer."""
    return f"WITH {contracts(d)}, v AS (SELECT buyer, yr, supplier, sum(amount) AS value FROM contracts GROUP BY buyer, yr, supplier) SELECT buyer, CAST(yr AS BIGINT) AS yr, supplier, round(value, 2) AS value, round(sum(value) OVER (PARTITION BY buyer, yr), 2) AS total, round(value / sum(value) OVER (PARTITION BY buyer, yr), 6) AS share, count(*) OVER (PARTITION BY buyer, supplier) AS years_with FROM v"


@plan
def w11_first_listing(d):
    """The first listing of each contract by publication date, then id, wins."""
    return f"SELECT order_id, listed, line FROM (SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS listed, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS n FROM {d.lineitem}) t WHERE n = 1"


@plan
def w12_first_supplier_date(d):
    """Each contract with the first date on which its buyer awarded to its supplier, aggregated before the join."""
    return f"WITH {contracts(d)}, f AS (SELECT buyer, supplier, min(date) AS first_date FROM contracts GROUP BY buyer, supplier) SELECT c.order_id, c.supplier, c.offers, c.date, f.first_date, {d.days('c.date', 'f.first_date')} AS days FROM contracts c JOIN f ON c.buyer = f.buyer AND c.supplier = f.supplier"


@plan
def o4_amount_by_currency(d):
    """A page of contracts by amount, amounts of one currency (segment) together: currency first, then amount, missing last."""
    return f"WITH {contracts(d)} SELECT segment AS currency, round(amount, 2) AS amount, order_id, offers FROM contracts ORDER BY currency NULLS LAST, amount DESC NULLS LAST, order_id, offers LIMIT 100"


@plan
def o6_sector_last(d):
    """Sectors in order; what is not specified comes last."""
    return f"SELECT sector, n, row_number() OVER (ORDER BY CASE WHEN sector = 'not specified' THEN 1 ELSE 0 END, sector) AS place FROM (SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'not specified' ELSE p_type END AS sector, count(*) AS n FROM {d.part} GROUP BY 1) t"


@plan
def x3_exact_row_dedup(d):
    """Rows that agree in every field stay once, with their number."""
    return f"SELECT user_id, event_type, value, count(*) AS copies FROM {d.events} GROUP BY user_id, event_type, value"


@plan
def x5_keyed_dedup(d):
    """Repeated exports of one key stay once: the first by line."""
    return f"SELECT part, supplier, line, order_id FROM (SELECT l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, l_orderkey AS order_id, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM {d.lineitem}) t WHERE n = 1"


@plan
def p17_clean_row(d):
    """Why a row is left out of calibration, by the first reason that holds; null for clean rows."""
    return f"WITH {contracts(d)} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN direct IS NULL THEN 'unverified' WHEN pub < date THEN 'conflict' WHEN amount <= 0 THEN 'no amount' WHEN quantity > 49 THEN 'framework' END AS reason FROM contracts) t GROUP BY reason"


@plan
def r3_possible_duplicates(d):
    """Contracts of one buyer for the same object on the same date under different numbers: members and their smallest."""
    return f"WITH {contracts(d)} SELECT buyer, part_id, date, count(DISTINCT order_id) AS members, min(order_id) AS first_id FROM contracts GROUP BY buyer, part_id, date HAVING count(DISTINCT order_id) > 1"


@plan
def m15_average_precision(d):
    """Average precision of a score for the toxic label, and precision among the first twentieth, ties shared. Equal scores
    (text lengths in hundreds) form one step."""
    return f"""WITH x AS (SELECT {d.div('n_chars', '100')} AS score, toxic FROM {d.documents} AS a JOIN {d.labels} AS b ON a.doc_id = b.doc_id WHERE toxic IS NOT NULL),
h AS (SELECT score, count(*) AS k, sum(toxic) AS hits FROM x GROUP BY score), c AS (SELECT score, k, hits, sum(k) OVER (ORDER BY score DESC) AS n, sum(hits) OVER (ORDER BY score DESC) AS found FROM h),
t AS (SELECT sum(k) AS rows_all, sum(hits) AS hits_all FROM h)
SELECT round(sum(c.hits * 1.0 / t.hits_all * c.found / c.n), 6) AS average_precision, round(sum(c.hits * 1.0 * least(1.0, greatest(0.0, (0.05 * t.rows_all - (c.n - c.k)) / c.k))) / max(0.05 * t.rows_all), 6) AS precision_at_5 FROM c CROSS JOIN t"""


@plan
def m21_false_discovery(d):
    """Benjamini-Hochberg: the smallest rejected share of each category's p-value, here 1 / (1 + its number of contracts)."""
    return f"""WITH p AS (SELECT p_type AS category, 1.0 / (1 + count(*)) AS p FROM {d.part} GROUP BY p_type), r AS (SELECT *, rank() OVER (ORDER BY p, category) AS place, count(*) OVER () AS n FROM p)
SELECT category, round(p, 8) AS p, round(min(least(1.0, p * n / place)) OVER (ORDER BY place DESC), 8) AS q FROM r"""


@plan
def a9_national_repetition(d):
    """Distinct procedures of each buyer and supplier, and how many of them have a single bid or a direct award."""
    return f"WITH {contracts(d)}, p AS (SELECT buyer, supplier, order_id, max(CASE WHEN offers = 1 THEN 1 ELSE 0 END) AS single, max(CASE WHEN direct THEN 1 ELSE 0 END) AS straight FROM contracts GROUP BY buyer, supplier, order_id) SELECT buyer, supplier, count(*) AS procedures, CAST(sum(single) AS BIGINT) AS singles, CAST(sum(straight) AS BIGINT) AS directs FROM p GROUP BY buyer, supplier"


@plan
def a28_conditional_modifications(d):
    """Modifications of a contract (lines later than its first) within 730 days; null if any line has no date or the tables
    end before the 730 days do."""
    return f"""WITH l AS (SELECT l_orderkey AS contract, {d.epoch_days('l_shipdate')} AS day FROM {d.lineitem}), e AS (SELECT max(day) AS last_day FROM l),
g AS (SELECT contract, min(day) AS first_day, count(*) - count(day) AS undated FROM l GROUP BY contract),
n AS (SELECT l.contract, count(CASE WHEN l.day > g.first_day AND l.day <= g.first_day + 730 THEN 1 END) AS changes FROM l JOIN g ON l.contract = g.contract GROUP BY l.contract)
SELECT g.contract, CASE WHEN g.undated = 0 AND g.first_day + 730 <= e.last_day THEN n.changes END AS changes FROM g JOIN n ON g.contract = n.contract CROSS JOIN e"""


@plan
def a36_award_summary(d):
    """Transactions of each award key (order and supplier): how many, first and last date, total."""
    return f"SELECT l_orderkey AS award, l_suppkey AS holder, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date, round(sum(l_extendedprice), 2) AS total FROM {d.lineitem} GROUP BY l_orderkey, l_suppkey"


@plan
def j5_multi_aggregate(d):
    """Every client with its nation and with aggregates of two tables, each made before its left join; null keys never match."""
    return f"""WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderkey) AS last_order FROM {d.orders} GROUP BY o_custkey),
l AS (SELECT o_custkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM {d.lineitem} JOIN {d.orders} ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey AS client, n_name AS nation, o.orders, o.last_order, l.lines, l.suppliers FROM {d.customer} LEFT JOIN {d.nation} ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey"""


@plan
def j10_latest_version(d):
    """The lines of each contract's last version, with what is known of their object."""
    return f"SELECT v.l_orderkey AS contract, v.l_linenumber AS version, v.l_suppkey AS holder, p_brand AS brand FROM {d.lineitem} v JOIN (SELECT l_orderkey, max(l_linenumber) AS k FROM {d.lineitem} GROUP BY l_orderkey) m ON v.l_orderkey = m.l_orderkey AND v.l_linenumber = m.k LEFT JOIN {d.part} ON v.l_partkey = p_partkey"


@plan
def w16_disqualified_before(d):
    """For each opening with a single winner (lowest price): the distinct other bidders dated on or before the winner's line."""
    return f"""WITH b AS (SELECT l_orderkey AS opening, l_suppkey AS bidder, {d.epoch_days('l_shipdate')} AS day, CASE WHEN l_extendedprice = min(l_extendedprice) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END AS won FROM {d.lineitem}),
w AS (SELECT opening, max(CASE WHEN won = 1 THEN bidder END) AS winner, max(CASE WHEN won = 1 THEN day END) AS day FROM b GROUP BY opening HAVING sum(won) = 1)
SELECT w.opening, w.winner, count(DISTINCT b.bidder) AS earlier FROM w LEFT JOIN b ON b.opening = w.opening AND b.bidder <> w.winner AND b.day <= w.day GROUP BY w.opening, w.winner"""


@plan
def w17_cobid_windows(d):
    """How often a bidder stands in other openings of the same client within a year of each opening."""
    return f"WITH b AS (SELECT DISTINCT o_custkey AS demand, o_orderkey AS opening, l_suppkey AS bidder, {d.epoch_days('o_orderdate')} AS day FROM {d.lineitem} JOIN {d.orders} ON l_orderkey = o_orderkey) SELECT demand, opening, bidder, count(*) OVER (PARTITION BY demand, bidder ORDER BY day RANGE BETWEEN 365 PRECEDING AND 365 FOLLOWING) - 1 AS others FROM b"


@plan
def st7_completeness_gate(d):
    """Orders by whether the year before and the year after them lie in one unbroken run of covered days (731 with their own);
    unknown otherwise. The window without a key sees one row a day."""
    return f"""WITH x AS (SELECT DISTINCT {d.epoch_days('l_shipdate')} AS day FROM {d.lineitem} WHERE l_shipdate IS NOT NULL), g AS (SELECT day, day - row_number() OVER (ORDER BY day) AS island FROM x),
i AS (SELECT island, min(day) AS first_day, max(day) AS last_day FROM g GROUP BY island), k AS (SELECT g.day, i.first_day, i.last_day FROM g JOIN i ON g.island = i.island)
SELECT CASE WHEN k.first_day <= k.day - 365 AND k.last_day >= k.day + 365 THEN 'complete' ELSE 'unknown' END AS coverage, count(*) AS n FROM {d.orders} LEFT JOIN k ON {d.epoch_days('o_orderdate')} = k.day GROUP BY 1"""


@plan
def o12_nearest_bids(d):
    """The two lowest bids of each opening, and whether the second is within a hundredth of the first."""
    return f"""WITH r AS (SELECT l_orderkey AS opening, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS place FROM {d.lineitem} WHERE l_extendedprice > 0),
t AS (SELECT opening, max(CASE WHEN place = 1 THEN price END) AS lowest, max(CASE WHEN place = 2 THEN price END) AS runner_up FROM r WHERE place <= 2 GROUP BY opening)
SELECT opening, round(lowest, 2) AS lowest, round(runner_up, 2) AS runner_up, runner_up <= lowest * 1.01 AS near FROM t"""


@plan
def o9_top_of_all(d):
    """The five thousand orders of highest amount, ties by id."""
    return f"SELECT o_orderkey AS id, o_totalprice AS amount FROM {d.orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5000"


@plan
def x6_upsert_source_priority(d):
    """One row a user: each field from the first source (event type) that has it, the latest of that source."""
    first = lambda x: f"row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN {x} IS NULL THEN 1 ELSE 0 END, event_type, ts DESC, event_id DESC)"
    return f"SELECT user_id, max(CASE WHEN a = 1 THEN value END) AS value, max(CASE WHEN b = 1 THEN props END) AS props FROM (SELECT user_id, value, props, {first('value')} AS a, {first('props')} AS b FROM {d.events}) t GROUP BY user_id"


@plan
def x7_latest_with_first_date(d):
    """The latest order of each client as it is, with the date of the client's first."""
    return f"SELECT client, order_id, status, first_date FROM (SELECT o_custkey AS client, o_orderkey AS order_id, o_orderstatus AS status, CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS first_date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM {d.orders}) t WHERE n = 1"


@plan
def r1_partition_contracts(d):
    """Rows of one buyer and number that agree in all initial fields are one contract; others are contracts of their own."""
    fields = "concat(" + ", '|', ".join(f"coalesce(CAST({x} AS VARCHAR(40)), '')" for x in ("supplier", "part_id", "CAST(date AS DATE)", "offers", "status")) + ")"
    return f"WITH {contracts(d)}, g AS (SELECT buyer, order_id, {d.sha(fields)} AS h, count(*) AS listed FROM contracts GROUP BY 1, 2, 3) SELECT buyer, order_id, h, listed, count(*) OVER (PARTITION BY buyer, order_id) AS contracts_of_number FROM g"


@plan
def r5_modification_conflicts(d):
    """Modifications listed more than once under one number whose fields differ, with the names of those."""
    differ = lambda x, name: f"CASE WHEN min({x}) <> max({x}) OR count({x}) NOT IN (0, count(*)) THEN '{name};' ELSE '' END"
    return f"SELECT contract, number, copies, fields FROM (SELECT l_orderkey AS contract, l_linenumber AS number, count(*) AS copies, concat({differ('l_extendedprice', 'amount')}, {differ('l_suppkey', 'holder')}, {differ('l_shipdate', 'date')}) AS fields FROM {d.lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) t WHERE fields <> ''"


@plan
def r8_offers_conflict(d):
    """The number of offers on which the sources of a record (order and part) agree; two positive numbers that differ make it unknown."""
    return f"SELECT record, object, CASE WHEN lo = hi THEN lo END AS offers, coalesce(lo <> hi, false) AS conflict FROM (SELECT l_orderkey AS record, l_partkey AS object, min(CASE WHEN l_linenumber > 0 THEN l_linenumber END) AS lo, max(CASE WHEN l_linenumber > 0 THEN l_linenumber END) AS hi FROM {d.lineitem} GROUP BY l_orderkey, l_partkey) t"


@plan
def f7_identifier_digits(d):
    """Digits of an identifier without leading zeros; null if it has none."""
    return f"SELECT c_custkey AS client, nullif({d.rx_sub(d.rx_sub('c_name', '[^0-9]+', ''), '^0+', '')}, '') AS digits FROM {d.customer}"


@plan
def f21_round_amounts(d):
    """Significant digits of whole amounts: digits left without the trailing zeros."""
    whole = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(30))"
    return f"SELECT digits, count(*) AS n FROM (SELECT CAST(length({d.rx_sub(whole, '0+$', '')}) AS BIGINT) AS digits FROM {d.orders} WHERE o_totalprice >= 1) t GROUP BY digits"


@plan
def f2_plain_words(d):
    """Texts in lower case with one blank for every run of other than ASCII word characters, trimmed."""
    return f"SELECT doc_id, trim({d.rx_sub('lower(text)', '[^a-zA-Z0-9_]+', ' ')}) AS words FROM {d.documents}"


@plan
def f20_cents_increase(d):
    """Increase from a contract's first to its last version in per cent, in whole cents; null unless the first is positive.
    Of lines with one number the lowest amount is taken."""
    return f"""WITH v AS (SELECT l_orderkey AS contract, l_linenumber AS version, CAST(floor(min(l_extendedprice) * 100 + 0.5) AS BIGINT) AS cents FROM {d.lineitem} GROUP BY l_orderkey, l_linenumber),
r AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY version) AS n, row_number() OVER (PARTITION BY contract ORDER BY version DESC) AS back FROM v),
e AS (SELECT contract, max(CASE WHEN n = 1 THEN cents END) AS first_cents, max(CASE WHEN back = 1 THEN cents END) AS last_cents FROM r GROUP BY contract)
SELECT contract, first_cents, last_cents, CASE WHEN first_cents > 0 THEN round((last_cents - first_cents) * 100.0 / first_cents, 6) END AS percent FROM e"""
