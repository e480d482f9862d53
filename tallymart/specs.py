"""Declarations: what a dataset looks like and what must hold in it. Operators take these instead of fixed names."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Tokens that stand for a missing value in text columns.
NULL_TOKENS = ("", " ", "  ", "null", "NULL", "None", "none", "NaN", "nan", "N/A", "n/a", "NA", "na")
#: Order statuses, payment types and states of the source.
ORDER_STATUSES = ("delivered", "shipped", "canceled", "invoiced", "processing", "unavailable", "approved", "created")
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE")
STATUSES = ("PASS", "FAIL")


@dataclass(frozen=True)
class DatasetSpec:
    """Columns with their logical type (string, integer, numeric, datetime), keys and column roles of one dataset."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    zero_checked: tuple[str, ...] = ()
    negative_checked: tuple[str, ...] = ()
    chronology: tuple[tuple[str, str], ...] = ()

    def of_type(self, kind: str) -> list[str]:
        return [c for c, k in self.columns.items() if k == kind]


@dataclass(frozen=True)
class Edge:
    """A reference from a child column to a parent column; lookups may have gaps."""

    child: str
    column: str
    parent: str
    parent_column: str
    severity: str = "HIGH"
    lookup: bool = False


def _spec(name: str, key: tuple[str, ...] = (), string: tuple[str, ...] = (), integer: tuple[str, ...] = (), numeric: tuple[str, ...] = (), datetime: tuple[str, ...] = (), **more) -> DatasetSpec:
    kinds = {"string": string, "integer": integer, "numeric": numeric, "datetime": datetime}
    return DatasetSpec(name, {c: kind for kind, names in kinds.items() for c in names}, key, **more)


#: The names of the columns of the source, as they are spelt there, with their types, keys and ranges.
PRODUCT_NUMBERS = ("product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")

RETAIL: dict[str, DatasetSpec] = {
    s.name: s
    for s in (
        _spec("customers", ("customer_id",), string=("customer_id", "customer_unique_id", "customer_city", "customer_state"), integer=("customer_zip_code_prefix",), categorical=("customer_city", "customer_state"), domains={"customer_state": STATES}, ranges={"customer_zip_code_prefix": (0, 99999)}),
        _spec("geolocation", string=("geolocation_city", "geolocation_state"), integer=("geolocation_zip_code_prefix",), numeric=("geolocation_lat", "geolocation_lng"), categorical=("geolocation_city", "geolocation_state"), domains={"geolocation_state": STATES}, ranges={"geolocation_lat": (-90, 90), "geolocation_lng": (-180, 180), "geolocation_zip_code_prefix": (0, 99999)}),
        _spec(
            "orders", ("order_id",), string=("order_id", "customer_id", "order_status"), datetime=("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"), categorical=("order_status",), domains={"order_status": ORDER_STATUSES},
            chronology=(("order_purchase_timestamp", "order_approved_at"), ("order_purchase_timestamp", "order_delivered_carrier_date"), ("order_purchase_timestamp", "order_delivered_customer_date"), ("order_delivered_carrier_date", "order_delivered_customer_date")),
        ),
        _spec("order_items", ("order_id", "order_item_id"), string=("order_id", "product_id", "seller_id"), integer=("order_item_id",), numeric=("price", "freight_value"), datetime=("shipping_limit_date",), zero_checked=("price", "freight_value"), negative_checked=("price", "freight_value")),
        _spec("payments", ("order_id", "payment_sequential"), string=("order_id", "payment_type"), integer=("payment_sequential", "payment_installments"), numeric=("payment_value",), categorical=("payment_type",), domains={"payment_type": PAYMENT_TYPES}, zero_checked=("payment_installments", "payment_value"), negative_checked=("payment_installments", "payment_value")),
        _spec("reviews", string=("review_id", "order_id", "review_comment_title", "review_comment_message"), integer=("review_score",), datetime=("review_creation_date", "review_answer_timestamp"), ranges={"review_score": (1, 5)}),
        _spec("products", ("product_id",), string=("product_id", "product_category_name"), integer=PRODUCT_NUMBERS, categorical=("product_category_name",), zero_checked=("product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"), negative_checked=("product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")),
        _spec("sellers", ("seller_id",), string=("seller_id", "seller_city", "seller_state"), integer=("seller_zip_code_prefix",), categorical=("seller_city", "seller_state"), domains={"seller_state": STATES}, ranges={"seller_zip_code_prefix": (0, 99999)}),
        _spec("category_translation", ("product_category_name",), string=("product_category_name", "product_category_name_english"), categorical=("product_category_name", "product_category_name_english")),
    )
}

#: References between the datasets, and lookups.
EDGES = (
    Edge("orders", "customer_id", "customers", "customer_id", "HIGH"),
    Edge("order_items", "order_id", "orders", "order_id", "CRITICAL"),
    Edge("order_items", "product_id", "products", "product_id", "CRITICAL"),
    Edge("order_items", "seller_id", "sellers", "seller_id", "CRITICAL"),
    Edge("payments", "order_id", "orders", "order_id", "HIGH"),
    Edge("reviews", "order_id", "orders", "order_id", "HIGH"),
)
LOOKUPS = (
    Edge("products", "product_category_name", "category_translation", "product_category_name", "MEDIUM", True),
    Edge("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix", "LOW", True),
    Edge("sellers", "seller_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix", "LOW", True),
)
