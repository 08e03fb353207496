"""Parameters of the registered queries, shared by the Spark builders and
the DuckDB oracle texts so the two can never drift apart."""

# Constants chosen from the driver tables.
DAY = "2000-04-04"
BUSY_DAY = "1998-08-23"
TYPE = "AFRICA"
SUB_TYPE = "NATION_0"
NAME = "Customer#000000103"
MISSING = "Nobody"
EXPAND_PATH = ("1998-08-23", "AMERICA")
BROWSE_TYPE = "ASIA"
RANGE_START = "1996-01-01"
RANGE_END = "1996-03-31"
TEXT_CONDITIONS = (
    ("particulars", "contains", "urgent"),
    ("entity_name", "starts_with", "customer#0000001"),
    ("vch_type", "not_equal", "journal"),
)
NUMBER_CONDITIONS = (("cash_dr", "between", 10000.0, 30000.0), ("bank_cr", "eq", 0.0))
TEXT_CONDITIONS_MORE = (
    ("vch_type", "equals", "receipt"),
    ("particulars", "not_contains", "low"),
    ("entity_name", "ends_with", "7"),
    ("entity_type", "not_blank"),
)
NUMBER_CONDITIONS_MORE = (
    ("cash_dr", "lt", 20000.0),
    ("cash_cr", "le", 30000.0),
    ("bank_dr", "ge", 0.0),
    ("bank_cr", "ne", 0.0),
    ("bank_cr", "gt", 15000.0),
)
LARGE_FACTOR = 9.87654321e9
DUP_KEYS = ("entity_type", "entity_sub_type")
DUP_AFTER = ("AFRICA", "NATION_0")
DUP_SEEN = 3
LEAF_CAP = 1
COARSE_LEVELS = ("entity_type", "entity_sub_type")
COARSE_CAP = 2
PAGE_OFFSET = 1000
PAGE_LIMIT = 500
SEEK_AFTER = ("1998-08-23",)
SEEK_LIMIT = 200
USER_SORT = (("cash_dr", "desc"),)
USER_SORT_LIMIT = 100
NESTED_CHUNK_ROWS = 2
GEN_KEY = "l_orderkey * 8 + l_linenumber"
GEN_SEED = 42
GEN_END = "2024-01-31"
LINE_HEADERS = (10, 11, 9)
FOLDED_BATCHES = 3
INDEX_RANGE_ROWS = 4000
DEEP_FROM_END = 150
DEEP_LIMIT = 300
SORTED_OFFSET = 4990
TREE_NODES = 40
LARGE_LEVELS = ("entity_type",)
LARGE_CAP = 1500
