"""Canonical views as SQL text, for the side-by-side check of each query."""

from __future__ import annotations

import re

VIEWS = {
    "sales": """SELECT o_orderkey AS ent_id, CAST(o_orderkey AS VARCHAR) AS piece_no, o_custkey AS customer,
        CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 AS INTEGER) AS due,
        (CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END) / 1.19 AS ht,
        CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END AS ttc,
        o_orderkey % 20 = 0 AS is_credit, o_orderpriority AS mode, year(o_orderdate) AS year,
        CAST(o_orderkey % 121 AS INTEGER) AS delay_days FROM orders""",
    "customers": """SELECT c_custkey AS customer, concat(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOPITAL '
        WHEN 'MACHINERY' THEN 'CLINIQUE ' WHEN 'FURNITURE' THEN 'LABO ' ELSE '' END, c_name) AS customer_name,
        c_mktsegment AS segment FROM customer""",
    "products": """SELECT p_partkey AS reference, p_name AS label, CASE p_type WHEN 'ECONOMY' THEN 'REACTIF ECONOMY'
        WHEN 'STANDARD' THEN 'REACTIF STANDARD' WHEN 'MEDIUM' THEN 'EQUIPEMENT MEDIUM' WHEN 'LARGE' THEN 'SERVICE LARGE'
        WHEN 'PROMO' THEN 'HUILE PROMO' WHEN 'SMALL' THEN 'SMALL' END AS family, p_retailprice AS list_price FROM part""",
    "lines": """SELECT l_orderkey AS piece_no, l_linenumber AS line_no, o_custkey AS customer, l_partkey AS reference,
        label, family, CAST(o_orderdate AS DATE) AS date,
        (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * l_extendedprice * (1 - l_discount) AS amount,
        (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * l_quantity AS qty,
        (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * l_quantity * list_price * 0.6::DOUBLE AS cost
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN products ON reference = l_partkey""",
    "purchases": """SELECT l_orderkey AS piece_no, l_linenumber AS line_no, l_suppkey AS supplier, l_partkey AS reference,
        CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year,
        (CASE WHEN l_orderkey % 25 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE * l_extendedprice * (1 - l_tax) AS ttc,
        l_orderkey % 25 = 0 AS is_credit, CAST(l_orderkey % 91 AS INTEGER) AS delay_days FROM lineitem""",
    "purchase_lines": """SELECT l_orderkey AS piece_no, l_suppkey AS supplier, l_partkey AS reference,
        l_linestatus AS stock_flag, CAST(l_shipdate AS DATE) AS date, l_quantity AS qty,
        l_extendedprice * (1 - l_tax) AS amount FROM lineitem""",
    "suppliers": """SELECT s_suppkey AS supplier, s_name AS supplier_name, n_name AS country
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "quotes": """SELECT o_orderkey AS quote_no, o_custkey AS customer, CAST(o_orderdate AS DATE) AS date,
        o_totalprice / 1.19 AS ht, o_totalprice AS ttc, o_orderstatus AS state, o_orderstatus = 'F' AS converted
        FROM orders""",
    "tasks": """SELECT event_id AS task_id, user_id AS customer, event_type AS category, value AS stake,
        CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'closed' END AS status,
        CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_type = 'purchase' THEN 'won' ELSE 'lost' END END AS result,
        CAST(event_type = 'purchase' AS INTEGER) AS won, event_id % 7 AS assignee, event_id % 2 = 0 AS automatic,
        CAST(ts AS DATE) AS created,
        CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) + CAST(ceil((event_id % 240) / 24.0) AS INTEGER) END AS closed,
        CASE WHEN event_id % 3 <> 0 THEN (event_id % 240) / 24.0::DOUBLE END AS lead_days FROM events""",
    "imported": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('FV-', o_orderkey) WHEN 1 THEN concat('fv 000', o_orderkey) WHEN 2 THEN concat('X', o_orderkey * 7) END AS number,
        CASE WHEN o_orderkey % 2 = 0 THEN 'sale' ELSE 'purchase' END AS side, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey % 97 END AS party,
        CASE WHEN o_orderkey % 50 <> 9 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) END AS date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 45 END AS due,
        round(o_totalprice + (o_orderkey % 9 - 4) * 250.0::DOUBLE, 2) AS ttc, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice + (o_orderkey % 9 - 4) * 250.0::DOUBLE, 2) - 1 END AS net,
        CASE WHEN o_orderkey % 6 = 0 THEN 'matched' WHEN o_orderkey % 11 = 0 THEN 'probable_duplicate' ELSE 'unmatched' END AS recon_status,
        CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderdate AS DATE) END AS settled,
        sha256(CAST(o_orderkey - CASE WHEN o_orderkey % 30 = 29 THEN 1 ELSE 0 END AS VARCHAR)) AS file_sha256 FROM orders""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the canonical views (and extra named ones) it mentions."""
    defs, body = {**VIEWS, **(extra or {})}, body.strip()
    order: list[str] = []

    def need(text: str, seen=()):
        for name in defs:
            if name not in order and name not in seen and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(defs[name], (*seen, name))
                order.append(name)

    need(body)
    ctes = ", ".join(f"{n} AS ({defs[n]})" for n in order)
    if not ctes:
        return body
    if re.match(r"WITH\s", body):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
