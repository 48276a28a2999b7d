"""Contracts the queries use, on the given tables' vocabulary."""

from __future__ import annotations

from loomfold.spec import SchemaSpec

SEGMENTS = ("Automobile", "Building", "Furniture", "Household", "Machinery")

SEGMENT = SchemaSpec.from_dict({"entity": "segment", "fields": [
    {"name": "segment", "type": "enum", "enum": SEGMENTS, "aliases": {"cars": "Automobile", "homes": "Household"}},
    {"name": "other", "type": "enum", "enum": SEGMENTS},
]})

# what the two customer exports are reconciled into
PARTY = SchemaSpec.from_dict({"entity": "party", "record_identifiers": ["employee_code", "work_email"], "fields": [
    {"name": "employee_code", "identity": "strong", "required": True, "unique": True},
    {"name": "work_email", "identity": "strong"},
    {"name": "full_name", "required": True}, {"name": "segment"}, {"name": "balance"},
]})

DOCUMENT = SchemaSpec.from_dict({"entity": "document", "record_identifiers": ["raw_hash", "norm_hash"], "fields": [
    {"name": "raw_hash", "identity": "strong"}, {"name": "norm_hash", "identity": "strong"}, {"name": "lang"}, {"name": "source"}, {"name": "size"},
]})

PERSON = SchemaSpec.from_dict({"entity": "person", "fields": [
    {"name": "employee_code", "required": True, "max_length": 7}, {"name": "first_name", "required": True}, {"name": "last_name", "required": True},
    {"name": "work_email", "format": "email", "required": True}, {"name": "phone", "format": "phone"},
    {"name": "date_of_birth", "type": "date", "required": True}, {"name": "date_of_joining", "type": "date", "required": True},
    {"name": "date_of_exit", "type": "date"},
    {"name": "department", "type": "enum", "required": True, "enum": ["Engineering", "Sales", "Finance", "Legal"]},
    {"name": "pan", "format": "pan", "pii": True}, {"name": "uan", "format": "uan", "pii": True},
    {"name": "status", "type": "enum", "required": True, "default": "Active", "enum": ["Active", "Inactive"]},
]})

# a catalog of the given tables' columns is matched to this
TRADE = SchemaSpec.from_dict({"entity": "trade", "fields": [
    {"name": "party_key", "required": True, "unique": True, "description": "Key of a party. Also called custkey, suppkey, c custkey, s suppkey."},
    {"name": "party_name", "required": True, "description": "Name of a party. Also called c name, s name."},
    {"name": "market_segment", "type": "enum", "enum": [s.upper() for s in SEGMENTS], "description": "Market. Also called mktsegment, segment."},
    {"name": "nation_key", "description": "Nation. Also called nationkey, c nationkey, s nationkey."},
    {"name": "account_balance", "description": "Balance. Also called acctbal, c acctbal, s acctbal."},
    {"name": "order_date", "type": "date", "required": True, "description": "Day of an order. Also called orderdate, o orderdate."},
    {"name": "order_status", "type": "enum", "enum": ["F", "O", "P"], "description": "State of an order. Also called orderstatus, o orderstatus."},
    {"name": "total_price", "description": "Price of an order. Also called totalprice, o totalprice."},
    {"name": "contact_email", "format": "email", "description": "Address. Also called email."},
]})
