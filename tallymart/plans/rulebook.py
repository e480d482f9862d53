"""The declarative rule set: checks of the source tables in the order of their numbers."""

from __future__ import annotations

from tallymart.operators.checks import EdgeRule, EmptyRule, KeyRule, RowRule, Rule, sql_list
from tallymart.specs import EDGES, DatasetSpec

DATASETS = ("customers", "geolocation", "orders", "order_items", "payments", "reviews", "products", "sellers", "category_translation")

#: Test ids, columns, dimensions and severities of the rules.
#: (test id, dataset, column, severity)
COMPLETE = (
    ("DQ-CUST-001", "customers", "customer_id", "CRITICAL"), ("DQ-CUST-002", "customers", "customer_state", "MEDIUM"), ("DQ-ORD-001", "orders", "order_id", "CRITICAL"), ("DQ-ITEM-001", "order_items", "order_id", "CRITICAL"),
    ("DQ-ITEM-002", "order_items", "product_id", "HIGH"), ("DQ-ITEM-003", "order_items", "seller_id", "HIGH"), ("DQ-PAY-001", "payments", "order_id", "HIGH"), ("DQ-REV-001", "reviews", "review_id", "HIGH"), ("DQ-REV-002", "reviews", "order_id", "HIGH"),
    ("DQ-PROD-001", "products", "product_id", "CRITICAL"), ("DQ-PROD-002", "products", "product_category_name", "MEDIUM"), ("DQ-SELL-001", "sellers", "seller_id", "CRITICAL"), ("DQ-SELL-002", "sellers", "seller_state", "MEDIUM"),
    ("DQ-TRANS-001", "category_translation", "product_category_name", "HIGH"), ("DQ-TRANS-002", "category_translation", "product_category_name_english", "HIGH"), ("DQ-FK-001", "orders", "customer_id", "HIGH"), ("DQ-FK-002", "order_items", "order_id", "CRITICAL"),
)
UNIQUE = (
    ("DQ-CUST-003", "customers", ("customer_id",), "CRITICAL"), ("DQ-ORD-002", "orders", ("order_id",), "CRITICAL"), ("DQ-ITEM-004", "order_items", ("order_id", "order_item_id"), "CRITICAL"), ("DQ-PAY-002", "payments", ("order_id", "payment_sequential"), "CRITICAL"),
    ("DQ-PROD-003", "products", ("product_id",), "CRITICAL"), ("DQ-SELL-003", "sellers", ("seller_id",), "CRITICAL"), ("DQ-REV-003", "reviews", ("review_id",), "HIGH"), ("DQ-TRANS-003", "category_translation", ("product_category_name",), "HIGH"),
)
IN_DOMAIN = (
    ("DQ-DOM-CUST-001", "customers", "customer_state", "Validity", "MEDIUM"), ("DQ-DOM-ORD-001", "orders", "order_status", "Categorical Conformity", "HIGH"), ("DQ-DOM-PAY-001", "payments", "payment_type", "Categorical Conformity", "HIGH"), ("DQ-DOM-SELL-001", "sellers", "seller_state", "Validity", "MEDIUM"),
    ("DQ-CAT-001", "customers", "customer_state", "Categorical Conformity", "MEDIUM"), ("DQ-CAT-002", "sellers", "seller_state", "Categorical Conformity", "MEDIUM"), ("DQ-CAT-003", "geolocation", "geolocation_state", "Categorical Conformity", "MEDIUM"),
)
IN_RANGE = (
    ("DQ-DOM-REV-001", "reviews", "review_score", "review_score NOT BETWEEN 1 AND 5", "HIGH"), ("DQ-RANGE-ITEM-001", "order_items", "price", "price <= 0", "HIGH"), ("DQ-RANGE-ITEM-002", "order_items", "freight_value", "freight_value < 0", "HIGH"), ("DQ-RANGE-PAY-001", "payments", "payment_value", "payment_value < 0", "HIGH"), ("DQ-RANGE-PAY-002", "payments", "payment_installments", "payment_installments < 0", "MEDIUM"),
    ("DQ-RANGE-PROD-001", "products", "product_weight_g", "product_weight_g < 0", "HIGH"), ("DQ-RANGE-PROD-002", "products", "product_length_cm", "product_length_cm < 0", "HIGH"), ("DQ-RANGE-PROD-003", "products", "product_height_cm", "product_height_cm < 0", "HIGH"), ("DQ-RANGE-PROD-004", "products", "product_width_cm", "product_width_cm < 0", "HIGH"),
)
IN_TIME = (
    ("DQ-DATE-001", "order_approved_at", "order_purchase_timestamp"), ("DQ-DATE-002", "order_delivered_carrier_date", "order_purchase_timestamp"), ("DQ-DATE-003", "order_delivered_customer_date", "order_purchase_timestamp"), ("DQ-DATE-004", "order_delivered_customer_date", "order_delivered_carrier_date"),
)


def rulebook(specs: dict[str, DatasetSpec]) -> list[Rule]:
    """All 64 rules; domains come from the specs."""
    out: list[Rule] = [EmptyRule(f"DQ-ROW-{k:03d}", d, "__DATASET__", "Completeness", "the table has rows", "CRITICAL") for k, d in enumerate(DATASETS, 1)]
    out += [RowRule(i, d, c, "Completeness", "not null", s, f"{c} IS NULL") for i, d, c, s in COMPLETE]
    out += [KeyRule(i, d, ", ".join(k), "Uniqueness", "no repeated key", s, k, "groups") for i, d, k, s in UNIQUE]
    out.append(KeyRule("DQ-GEO-001", "geolocation", "__FULL_ROW__", "Uniqueness", "no repeated rows", "MEDIUM", tuple(specs["geolocation"].columns), "participating"))
    out += [EdgeRule(f"DQ-REF-{k:03d}", e.child, e.column, "Referential Integrity", f"found in {e.parent}", e.severity, e) for k, e in enumerate(EDGES, 1)]
    out += [RowRule(i, d, c, q, "value of the domain", s, f"{c} IS NOT NULL AND {c} NOT IN ({sql_list(specs[d].domains[c])})") for i, d, c, q, s in IN_DOMAIN]
    out += [RowRule(i, d, c, "Validity", "within its range", s, f) for i, d, c, f, s in IN_RANGE]
    out += [RowRule(i, "orders", late, "Consistency", f"not before {early}", "HIGH", f"{late} < {early}") for i, late, early in IN_TIME]
    out += [RowRule(f"DQ-BIZ-00{k}", "orders", c, "Business Rule", "a delivered order has the date", "MEDIUM", f"{c} IS NULL", "order_status = 'delivered'") for k, c in enumerate(("order_delivered_customer_date", "order_delivered_carrier_date"), 1)]
    out.append(RowRule("DQ-BIZ-003", "payments", "payment_installments", "Business Rule", "at least one installment", "MEDIUM", "payment_installments <= 0"))
    return out
