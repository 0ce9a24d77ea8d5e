"""Declarations of the driver's tables."""

from __future__ import annotations

from rivulet.schema import Catalog, ForeignKey, Index, TableSpec, Ttl, Visibility
from rivulet.schema import Column as C


def _spec(name: str, columns: str, key: str, **more) -> TableSpec:
    """``columns`` are ``name type`` pairs; types are those of rivulet.types."""
    return TableSpec(name, tuple(C(*c.split()) for c in columns.split(", ")), tuple(key.split()), **more)


REGION = _spec("region", "r_regionkey i32, r_name str", "r_regionkey", access="global")
NATION = _spec("nation", "n_nationkey i32, n_name str, n_regionkey i32", "n_nationkey", foreign_keys=(ForeignKey("n_regionkey", "region", "r_regionkey"),))
CUSTOMER = _spec(
    "customer",
    "c_custkey id, c_name str, c_nationkey i32, c_acctbal f64, c_mktsegment str",
    "c_custkey",
    foreign_keys=(ForeignKey("c_nationkey", "nation", "n_nationkey"),),
)
SUPPLIER = _spec(
    "supplier",
    "s_suppkey id, s_name str, s_nationkey i32, s_acctbal f64",
    "s_suppkey",
    visibility=Visibility("member_of", "s_nationkey", "customer", "c_custkey", "c_nationkey"),
)
PART = _spec(
    "part",
    "p_partkey id, p_name str, p_brand str, p_type str, p_size i32, p_retailprice f64",
    "p_partkey",
    indexes=(Index("btree", ("p_brand", "p_size")), Index("btree", ("p_size",))),
)
ORDERS = _spec(
    "orders",
    "o_orderkey id, o_custkey id, o_orderstatus str, o_totalprice f64, o_orderdate timestamp, o_orderpriority str",
    "o_orderkey",
    indexes=(Index("btree", ("o_totalprice",)), Index("btree", ("o_orderstatus", "o_totalprice"))),
    visibility=Visibility("owner_only", "o_custkey"),
    foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey", "cascade"),),
    owner="o_custkey",
)
LINEITEM = _spec(
    "lineitem",
    "l_orderkey id, l_partkey id, l_suppkey id, l_linenumber i32, l_quantity f64, l_extendedprice f64, l_discount f64, l_tax f64, "
    "l_returnflag str, l_linestatus str, l_shipdate timestamp",
    "l_orderkey l_partkey l_suppkey l_linenumber",
    foreign_keys=(ForeignKey("l_orderkey", "orders", "o_orderkey", "cascade"),),
)
EVENTS = _spec("events", "event_id id, ts timestamp, user_id id, event_type str, value f64, props str", "event_id", ttl=Ttl("ts"))
DOCUMENTS = _spec(
    "documents",
    "doc_id id, text str, lang str, source str, n_chars i64",
    "doc_id",
    indexes=(Index("fulltext", ("text",), "simple"),),
)
CONVERSATIONS = _spec("conversations", "conv_id id, turn i64, role str, text str", "conv_id turn")
CATALOG = Catalog(REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, CONVERSATIONS)
