"""Rules that look only at a column's or table's name. They run on the driver, over k names."""

import re

# Names, patterns and word lists that decide a column's role.
ROW_INDEX_NAMES = (
    "id", "index", "row", "no", "num", "number", "sno", "sr", "#", "serial", "seq", "row_id", "record_id",
)
ROW_INDEX_NAMES_CLASSIC = ROW_INDEX_NAMES + ("s.no", "sr.no", "row_num")
ROW_INDEX_PATTERN = r"(id|index|row|num|serial|seq)[\s_\-]?\d*"
KEY_NAME_ALTERNATIVES = (
    "id", "_id", ".*_id$", ".*id$", "shipmentid", "shiptmentid", "spid", "pid", "gid", "cid", "oid", "rid",
    "uid", "sid", "order_?id", "invoice_?id", "customer_?id", "product_?id", "employee_?id", "user_?id",
    "row_?id", "record_?id", "index", "#", r"sr\.?no\.?", "sno", "seq", "serial", "unnamed.*",
)
KEY_CODE_PATTERN = r"^[A-Z]{1,3}\d{1,6}$"
KEY_LONG_CODE_PATTERN = r"^[A-Z]\d{5,}$"
NON_NEGATIVE_WORDS = ("price", "cost", "sales", "revenue", "amount", "count", "qty", "quantity", "age")
NON_NEGATIVE_WORDS_LONG = (
    "price", "cost", "revenue", "sales", "amount", "count", "qty", "quantity", "age", "score", "rate",
    "percent", "pct",
)
PERCENTAGE_WORDS = ("percent", "pct", "rate", "ratio")
DIMENSION_WORDS = (
    "dimension", "dim", "lookup", "product", "location", "person", "people", "calendar", "date", "geo",
)
FACT_WORDS = ("fact", "shipment", "order", "sale", "transaction", "data")
ROLE_NAMES = {
    "amount": ("Amount", "Revenue", "Sales", "Total_Amount"),
    "boxes": ("Boxes", "Units", "Qty", "Quantity"),
    "profit": ("Profit",),
    "profit_pct": ("Profit_Pct", "Profit_Percentage", "Margin_Pct"),
    "product": ("Product", "Product_Name", "Item", "SKU"),
    "category": ("Category", "Product_Category", "Type"),
    "person": ("Sales_person", "Salesperson", "Rep", "Agent", "First_Name", "Name"),
    "team": ("Team", "Department", "Group"),
    "geo": ("Geo", "Country", "Geography", "Location"),
    "region": ("Region", "Area", "Zone"),
    "status": ("Order_Status", "Status", "Order_state"),
    "date": ("Shipdate", "Date", "Order_Date", "Transaction_Date"),
}


def is_row_index_name(name, classic=False):
    plain = name.strip().lower()
    listed = ROW_INDEX_NAMES_CLASSIC if classic else ROW_INDEX_NAMES
    return plain in listed or re.fullmatch(ROW_INDEX_PATTERN, plain) is not None


def is_key_name(name, mode="reference"):
    """``reference`` accepts any name that *starts* like a key name; ``strict`` wants the whole name."""
    pattern = re.compile("|".join(f"(?:{a})" for a in KEY_NAME_ALTERNATIVES), re.IGNORECASE)
    test = pattern.match if mode == "reference" else pattern.fullmatch
    return test(name.strip()) is not None


def has_word(name, words):
    lowered = name.lower()
    return any(word in lowered for word in words)


def default_roles(columns):
    """Role -> column: an exact (case-blind) name wins over a name that merely contains the word."""
    roles = {}
    for role, wanted in ROLE_NAMES.items():
        exact = [c for w in wanted for c in columns if c.lower() == w.lower()]
        partial = [c for w in wanted for c in columns if w.lower() in c.lower()]
        if exact or partial:
            roles[role] = (exact + partial)[0]
    return roles
