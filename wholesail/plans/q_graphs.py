"""Registered queries: references between rows (causal chains, shared phones and devices)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..sources.logstore import stored_envelopes
from .oracle import cte, sql
from .q_projections import tables_of
from .registry import query

CAUSED = ["OrderCreated", "OrderShipped", "OrderDelivered", "OrderReturned", "OrderCancelled", "InvoiceCreated", "PaymentCaptured",
          "PaymentFailed", "CreditWrittenOff", "CollectionScheduled", "CollectionPromiseMade", "PurchaseOrderCreated", "StockReceived"]

cte("chain_ev", """
SELECT concat('OC-', orderkey) AS id, NULL AS up FROM ord
UNION ALL SELECT concat('OS-', orderkey), concat('OC-', orderkey) FROM ord WHERE orderstatus IN ('O', 'F')
UNION ALL SELECT concat('OD-', orderkey), concat('OC-', orderkey) FROM ord WHERE orderstatus = 'F' AND orderkey % 7 <> 0
UNION ALL SELECT concat('OR-', orderkey), concat('OC-', orderkey) FROM ord WHERE orderstatus = 'F' AND orderkey % 20 = 0
UNION ALL SELECT concat('OX-', orderkey), concat('OC-', orderkey) FROM ord WHERE orderstatus = 'P' AND orderkey % 25 = 0
UNION ALL SELECT concat('IC-', orderkey), concat('OD-', orderkey) FROM delivered
UNION ALL SELECT event_id, concat('IC-', split_part(event_id, '-', 2)) FROM payments_t
UNION ALL SELECT event_id, concat('IC-', split_part(event_id, '-', 2)) FROM writeoffs_t
UNION ALL SELECT concat(p, '-', orderkey, '-1'), concat('IC-', orderkey) FROM delivered, (SELECT unnest(['CS', 'CP']) AS p) WHERE orderkey % 10 >= 7
UNION ALL SELECT concat('PO-', p_partkey), NULL FROM part
UNION ALL SELECT concat('SRC-', p_partkey), concat('PO-', p_partkey) FROM part""", ("ord", "delivered", "payments_t", "writeoffs_t"))
cte("chain_walk", """
SELECT id, up, id AS tip, CAST(0 AS BIGINT) AS depth FROM chain_ev
UNION ALL
SELECT w.id, e.up, e.id, w.depth + 1 FROM chain_walk w JOIN chain_ev e ON e.id = w.up""", ("chain_ev",))


@query("causal_chains", sql("""
SELECT id AS event_id, tip AS root_id, depth, up AS missing_id, false AS cyclic
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS last FROM chain_walk) WHERE last = 1""", "chain_walk", recursive=True), "N")
def q_causal_chains(spark, d):
    """A log in which every seventh delivery was lost: the invoices it caused, and what they caused, hang in the air."""
    log = stored_envelopes(spark, d, CAUSED)
    lost = (F.col("event_type") == "OrderDelivered") & (F.substring_index("event_id", "-", -1).cast("long") % 7 == 0)
    return G.causal_chains(log.filter(~lost))


# a customer's line ends in the number divided by three, one device serves all numbers of a remainder by 97 below 40
cte("share_links", """
SELECT customer_id, 'tel-' || (custkey // 3) AS value FROM cust WHERE custkey % 5 <> 0
UNION SELECT customer_id, 'dev-' || (custkey % 97) || '-' || (custkey // 1000) FROM cust WHERE custkey % 97 < 40 AND custkey % 2 = 0
UNION SELECT customer_id, 'shop' FROM cust WHERE custkey % 10 = 1
UNION SELECT customer_id, NULL FROM cust""", ("cust",))
cte("share_ok", """
SELECT * FROM share_links WHERE value IN (SELECT value FROM share_links GROUP BY value HAVING count(*) <= 12)""", ("share_links",))
cte("share_reach", """
SELECT DISTINCT customer_id, customer_id AS other FROM share_links
UNION
SELECT r.customer_id, b.customer_id FROM share_reach r JOIN share_ok a ON a.customer_id = r.other JOIN share_ok b ON b.value = a.value""", ("share_ok",))


@query("shared_device_risk", sql("""
SELECT customer_id, group_id, count(*) OVER (PARTITION BY group_id) AS members, risk, max(risk) OVER (PARTITION BY group_id) AS group_risk,
       risk + 0.5::DOUBLE * (max(risk) OVER (PARTITION BY group_id) - risk) AS spread_risk
FROM (SELECT customer_id, min(other) AS group_id FROM share_reach GROUP BY customer_id)
JOIN (SELECT customer_id, risk_score AS risk FROM cust) USING (customer_id)""", "share_reach", recursive=True), "N")
def q_shared_risk(spark, d):
    """Phones and devices derived from the customer numbers; a terminal that every tenth customer uses joins nobody."""
    c = tables_of(spark, d)["customers"]
    k = F.substring_index("customer_id", "-", -1).cast("long")
    of = lambda v, on: F.when(on, v)
    values = F.array(
        of(F.concat(F.lit("tel-"), F.expr("k div 3").cast("string")), F.col("k") % 5 != 0),
        of(F.concat(F.lit("dev-"), (F.col("k") % 97).cast("string"), F.lit("-"), F.expr("k div 1000").cast("string")), (F.col("k") % 97 < 40) & (F.col("k") % 2 == 0)),
        of(F.lit("shop"), F.col("k") % 10 == 1), F.lit(None).cast("string"))
    links = c.withColumn("k", k).select("customer_id", F.explode(values).alias("value"))
    return G.shared_risk(G.shared_groups(links, most_members=12), c)
