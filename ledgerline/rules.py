"""Closed sets, patterns and lookup tables the jobs are driven by.

Everything here is data. A job turns a table into a ``CASE`` expression or a
small literal dimension; nothing in this module runs per row.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# File intake
# --------------------------------------------------------------------------

MAX_INPUT_BYTES = 128 * 1024 * 1024
CONTROL_SHARE_LIMIT = 0.05
HEADER_CANDIDATES = 40
SAMPLE_ROWS = 200
PREVIEW_ROWS = 20

ACCEPTED_GLOB = "*.{csv,CSV,txt,TXT,tsv,TSV}"

# Leading bytes (hex) and the name of the format they announce.
SIGNATURES = [
    ("25504446", "PDF"),
    ("504B0304", "ZIP or Office document (.xlsx/.ods/.docx)"),
    ("504B0506", "empty ZIP archive"),
    ("D0CF11E0A1B11AE1", "legacy Office document (.xls/.doc)"),
    ("89504E47", "PNG image"),
    ("FFD8FF", "JPEG image"),
    ("47494638", "GIF image"),
    ("1F8B", "gzip archive"),
    ("425A68", "bzip2 archive"),
    ("377ABCAF271C", "7-Zip archive"),
    ("52617221", "RAR archive"),
    ("53514C697465", "SQLite database"),
    ("7F454C46", "ELF executable"),
    ("CAFEBABE", "Mach-O or Java class file"),
    ("0061736D", "WebAssembly module"),
]

# Byte order marks (hex), longest first, with the Java charset each selects.
# UTF-32 has no supported decoder and falls back.
BYTE_ORDER_MARKS = [
    ("FFFE0000", "utf-32le", None),
    ("0000FEFF", "utf-32be", None),
    ("EFBBBF", "utf-8", "UTF-8"),
    ("FFFE", "utf-16le", "UTF-16LE"),
    ("FEFF", "utf-16be", "UTF-16BE"),
]

FALLBACK_CHARSET = ("windows-1252", "windows-1252")

# Declared charset label -> (canonical name, Java charset).
CHARSETS = {
    "utf-8": ("utf-8", "UTF-8"),
    "utf8": ("utf-8", "UTF-8"),
    "ascii": ("utf-8", "UTF-8"),
    "us-ascii": ("utf-8", "UTF-8"),
    "utf-16le": ("utf-16le", "UTF-16LE"),
    "utf-16be": ("utf-16be", "UTF-16BE"),
    "windows-1252": ("windows-1252", "windows-1252"),
    "iso-8859-1": ("windows-1252", "windows-1252"),
    "iso-8859-2": ("windows-1252", "windows-1252"),
    "latin1": ("windows-1252", "windows-1252"),
    "iso-8859-15": ("iso-8859-15", "ISO-8859-15"),
    "windows-1251": ("windows-1251", "windows-1251"),
    "iso-8859-5": ("windows-1251", "windows-1251"),
    "shift_jis": ("shift_jis", "Shift_JIS"),
    "sjis": ("shift_jis", "Shift_JIS"),
    "gb2312": ("gb18030", "GB18030"),
    "gbk": ("gb18030", "GB18030"),
    "gb18030": ("gb18030", "GB18030"),
    "big5": ("big5", "Big5"),
    "euc-kr": ("euc-kr", "EUC-KR"),
    "koi8-r": ("koi8-r", "KOI8-R"),
    "ibm866": ("ibm866", "IBM866"),
}

DELIMITERS = [",", ";", "\t", "|", "^", "~"]
DEFAULT_DELIMITER = ","

# --------------------------------------------------------------------------
# Header and content rules
# --------------------------------------------------------------------------

# (role, pattern over the normalised header, weight), first match wins.
HEADER_RULES = [
    ("postedDate", r"^(post(ing|ed)?|clear(ed|ing)|settle(ment|d)?|value)\s*date$", 1.0),
    ("date", r"^(transaction|txn|trans|booking|entry|operation)?\s*date$", 1.0),
    ("date", r"^date$", 1.0),
    ("date", r"date", 0.6),
    ("debit", r"^(debit|withdrawal|withdrawals|paid\s*out|money\s*out|outflow|dr)(\s*amount)?$", 1.0),
    ("debit", r"(debit|withdrawal|paid\s*out|money\s*out)", 0.7),
    ("credit", r"^(credit|deposit|deposits|paid\s*in|money\s*in|inflow|cr)(\s*amount)?$", 1.0),
    ("credit", r"(credit|deposit|paid\s*in|money\s*in)", 0.7),
    ("balance", r"^(running\s*|closing\s*|available\s*)?balance$", 1.0),
    ("balance", r"balance", 0.7),
    ("amount", r"^(transaction\s*)?amount$", 1.0),
    ("amount", r"^(amt|value|sum|net)$", 0.9),
    ("amount", r"amount", 0.6),
    ("checkNumber", r"^(che(ck|que)\s*(no|num(ber)?|#)?)$", 1.0),
    ("checkNumber", r"che(ck|que)", 0.6),
    ("referenceNumber", r"^(reference|ref|transaction\s*id|txn\s*id|utr|cheque\s*ref)(\s*(no|num(ber)?|#|id))?$", 1.0),
    ("referenceNumber", r"(reference|\bref\b|transaction\s*id)", 0.6),
    ("payee", r"^(payee|merchant|counterparty|beneficiary|to\s*\/?\s*from)$", 1.0),
    ("description", r"^(description|narration|particulars|details|transaction\s*details|remarks|name)$", 1.0),
    ("description", r"(description|narration|particulars|details)", 0.7),
    ("memo", r"^(memo|note|notes|additional\s*info)$", 1.0),
    ("memo", r"memo", 0.6),
    ("currency", r"^(currency|ccy|curr)$", 1.0),
    ("category", r"^(category|categories|class|tag)$", 1.0),
    ("type", r"^(type|transaction\s*type|txn\s*type|dr\s*\/?\s*cr|debit\s*\/?\s*credit\s*indicator|ind(icator)?)$", 1.0),
]

# Roles one column per file may hold.
SINGLE_SLOT_ROLES = [
    "date", "postedDate", "description", "memo", "payee", "amount", "debit",
    "credit", "balance", "checkNumber", "referenceNumber", "currency", "type",
]

ROLES = SINGLE_SLOT_ROLES + ["category", "ignored"]

# Keywords of a declared bank layout, role by role, most specific first.
LAYOUT_KEYWORDS = [
    ("postedDate", ["post date", "posting date", "posted date", "completed date", "settlement date", "value date"]),
    ("date", ["transaction date", "trans. date", "trans date", "txn date", "started date", "booking date", "date"]),
    ("debit", ["debit amount", "debit", "withdrawals", "withdrawal", "money out", "paid out"]),
    ("credit", ["credit amount", "credit", "deposits", "deposit", "money in", "paid in"]),
    ("balance", ["running bal.", "running balance", "closing balance", "balance (gbp)", "balance"]),
    ("amount", ["transaction amount", "amount (gbp)", "local amount", "amount", "value"]),
    ("checkNumber", ["check or slip #", "check number", "cheque number", "check #"]),
    ("referenceNumber", ["transaction id", "reference no", "reference", "number", "ref"]),
    ("currency", ["local currency", "currency", "ccy"]),
    ("category", ["category split", "subcategory", "category"]),
    ("type", ["transaction type", "type", "details", "status", "state"]),
    ("memo", ["notes and #tags", "memo", "notes", "note"]),
    ("payee", ["counter party", "counterparty", "payee", "card member", "merchant"]),
    ("description", ["transaction description", "description", "narration", "particulars", "name"]),
    ("ignored", ["account number", "account #", "card no.", "card number", "account", "product", "emoji", "address", "receipt", "fee", "time", "sort code", "marker", "blank"]),
]


# --------------------------------------------------------------------------
# Dates, money, types
# --------------------------------------------------------------------------

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Currency marks inside an amount cell, and the debit/credit suffix.
CURRENCY_MARKS = r"(?i)\p{Sc}|(?:^|\s)(?:USD|EUR|GBP|INR|JPY|AUD|CAD|CHF|SGD|AED|Rs\.?)(?=\s|$)"
SIGN_SUFFIX = r"(?i)\b(DR|CR|DB|D|C)\b\.?\s*$"
DEBIT_MARKERS = ["DR", "DB", "D"]
DEBIT_INDICATOR = r"(?i)^\s*(dr|db|d|debit|withdrawal|w)\s*\.?\s*$"
NUMERIC_CELL = r"^[\s(]*[-+]?\p{Sc}?\s*[0-9][0-9\s.,']*\)?\s*$"

# Marks the preview reader drops.
PREVIEW_MARKS = r"(?i)[$£€¥₹¢₽₺₩฿]|(?:^|\s)(?:usd|eur|gbp|inr|jpy|aud|cad|chf|cny)(?=\s|$)"

# Currency token -> ISO codes it may denote. Any other token denotes itself.
CURRENCY_CANDIDATES = {
    "$": ["USD", "CAD", "AUD", "NZD", "SGD", "HKD", "TWD", "MXN", "ARS", "CLP", "COP", "UYU", "BRL", "FJD", "JMD", "NAD", "TTD", "XCD", "BBD", "BMD", "BND", "BSD", "BZD", "GYD", "KYD", "LRD", "SBD", "SRD"],
    "€": ["EUR"],
    "£": ["GBP", "EGP", "LBP", "SYP", "SSP", "SDG"],
    "¥": ["JPY", "CNY"],
    "₹": ["INR"],
    "₩": ["KRW", "KPW"],
    "₽": ["RUB"],
    "₪": ["ILS"],
    "₺": ["TRY"],
    "₫": ["VND"],
    "฿": ["THB"],
    "₱": ["PHP"],
    "₦": ["NGN"],
    "Rs": ["INR", "PKR", "LKR", "NPR", "MUR", "SCR"],
    "Rs.": ["INR", "PKR", "LKR", "NPR", "MUR", "SCR"],
    "R$": ["BRL"],
    "CHF": ["CHF"],
    "kr": ["SEK", "NOK", "DKK", "ISK"],
}

# (pattern over "type description", transaction type), first match wins.
TYPE_RULES = [
    (r"(?i)\batm\b|cash\s*withdrawal", "ATM"),
    (r"(?i)\bche(ck|que)\b", "CHECK"),
    (r"(?i)\b(interest|int\.?\s*(paid|earned))\b", "INT"),
    (r"(?i)\bdividend\b", "DIV"),
    (r"(?i)\b(service\s*charge|maintenance\s*fee|monthly\s*fee)\b", "SRVCHG"),
    (r"(?i)\b(fee|charge|commission|gst|surcharge)\b", "FEE"),
    (r"(?i)\b(salary|payroll|direct\s*dep(osit)?|neft\s*cr|imps\s*cr)\b", "DIRECTDEP"),
    (r"(?i)\b(direct\s*deb(it)?|standing\s*order|auto\s*pay|ach\s*deb)\b", "DIRECTDEBIT"),
    (r"(?i)\b(transfer|xfer|neft|rtgs|imps|upi|wire)\b", "XFER"),
    (r"(?i)\b(pos|card\s*purchase|debit\s*card)\b", "POS"),
    (r"(?i)\bdeposit\b", "DEP"),
    (r"(?i)\bpayment\b", "PAYMENT"),
]

# A text that matches a type rule contains one of its stems.
TYPE_STEMS = {
    "ATM": ["atm", "cash"],
    "CHECK": ["che"],
    "INT": ["int"],
    "DIV": ["dividend"],
    "SRVCHG": ["charge", "fee"],
    "FEE": ["fee", "charge", "commission", "gst"],
    "DIRECTDEP": ["salary", "payroll", "direct", "neft", "imps"],
    "DIRECTDEBIT": ["direct", "standing", "auto", "ach"],
    "XFER": ["fer", "neft", "rtgs", "imps", "upi", "wire"],
    "POS": ["pos", "card"],
    "DEP": ["deposit"],
    "PAYMENT": ["payment"],
}

NAME_PLACEHOLDER = "TRANSACTION"
# Worded here, not fixed.
NO_TRANSACTIONS = "No row of the file could be read as a transaction."

# Account defaults where neither the request nor the file names a value.
ACCOUNT_DEFAULTS = {
    "bank_id": "",
    "account_type": "CHECKING",
    "currency": "USD",
    "scale": 2,
    "institution": "BANK",
    "fid": "0000",
    "language": "ENG",
    "time_zone_suffix": "[0:GMT]",
}

# --------------------------------------------------------------------------
# Statement documents
# --------------------------------------------------------------------------

DIALECTS = ["ofx", "qbo", "qfx"]
DOCUMENT_HEADER = [
    ("OFXHEADER", "100"),
    ("DATA", "OFXSGML"),
    ("VERSION", "102"),
    ("SECURITY", "NONE"),
    ("ENCODING", "USASCII"),
    ("CHARSET", "1252"),
    ("COMPRESSION", "NONE"),
    ("OLDFILEUID", "NONE"),
]
TEXT_CAPS = {"name": 32, "memo": 255, "check_number": 12, "reference_number": 32, "fit_id": 255, "account_id": 22, "bank_id": 9, "institution": 32, "fid": 32, "currency": 3}
FILE_SLUG_CAP = 48
FILE_SLUG_EMPTY = "statement"

# --------------------------------------------------------------------------
# Issue labels
# --------------------------------------------------------------------------

ISSUE_LABELS = {
    "unsupported-content": "Not a CSV file",
    "empty-file": "File is empty",
    "file-too-large": "File too large",
    "no-rows": "No transactions found",
    "no-transactions": "No transactions could be read",
    "no-date-column": "No date column found",
    "no-amount-column": "No amount column found",
    "multi-currency": "More than one currency",
    "system-timeout": "Took too long to process",
    "worker-exception": "Conversion failed",
    "unhandled-rejection": "Conversion failed",
    "bad-request": "Conversion failed",
    "unknown-kind": "Conversion failed",
    "signs-inverted": "Card signs flipped",
    "all-positive": "All amounts are positive: is this a credit card?",
    "ambiguous-date-order": "Date order assumed MM/DD",
    "unparsed-dates": "Some dates couldn't be read",
    "bad-date": "Row skipped: unreadable date",
    "bad-amount": "Row skipped: no amount",
    "ragged-rows": "Some rows have a different column count",
    "no-header": "No header row: columns guessed from content",
    "encoding-fallback": "Text encoding guessed",
    "skipped-unsettled": "Pending rows left out",
}
PER_ROW_CODES = ["bad-date", "bad-amount"]

# --------------------------------------------------------------------------
# Usage events
# --------------------------------------------------------------------------

EVENTS = ["visitor_landed", "file_loaded", "preflight_pass", "conversion_success", "conversion_failed", "user_logged_in"]
SURFACES = ["dashboard", "bank", "other"]
EVENT_DIALECTS = ["ofx", "qbo", "qfx"]
ROW_BANDS = ["1-50", "51-200", "201-1000", "1000+"]
REFERRER_HOSTS = [
    "google.com", "bing.com", "duckduckgo.com", "yahoo.com", "ecosia.org",
    "brave.com", "reddit.com", "news.ycombinator.com", "x.com", "twitter.com",
    "linkedin.com", "facebook.com", "youtube.com",
]
SESSION_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
COUNTRY_PATTERN = r"^[A-Z]{2}$"
COUNTRY_HEADERS = ["x-vercel-ip-country", "cf-ipcountry", "x-country-code"]
IP_HEADERS = ["x-forwarded-for", "x-real-ip", "x-vercel-forwarded-for"]
IPV4_PATTERN = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
IPV6_PATTERN = r"(?i)^[0-9a-f:]+$"

ERROR_CODES = {
    "system-timeout": "TIMEOUT_EXCEEDED",
    "multi-currency": "MULTI_CURRENCY_COLLISION",
    "file-too-large": "FILE_TOO_LARGE",
    "no-date-column": "NO_DATE_COLUMN",
    "no-amount-column": "NO_AMOUNT_COLUMN",
    "no-header": "NO_HEADER",
    "no-rows": "NO_TRANSACTIONS",
    "no-transactions": "NO_TRANSACTIONS",
    "ragged-rows": "RAGGED_ROWS",
    "bad-date": "BAD_DATE",
    "bad-amount": "BAD_AMOUNT",
    "unparsed-dates": "UNPARSED_DATES",
    "bad-request": "MALFORMED_BINARY",
    "unknown-kind": "MALFORMED_BINARY",
    "worker-exception": "MALFORMED_BINARY",
    "unhandled-rejection": "MALFORMED_BINARY",
}
UNKNOWN_ERROR = "UNKNOWN"

BROWSERS = [
    (r"(?i)edg[ea]?\/", "Edge"),
    (r"(?i)opr\/|opera", "Opera"),
    (r"(?i)samsungbrowser", "Samsung"),
    (r"(?i)firefox|fxios", "Firefox"),
    (r"(?i)chrome|crios|chromium", "Chrome"),
    (r"(?i)safari", "Safari"),
    (r"(?i)bot|crawler|spider|slurp|headless", "Bot"),
]
SYSTEMS = [
    (r"(?i)windows nt", "Windows"),
    (r"(?i)iphone|ipad|ipod", "iOS"),
    (r"(?i)mac os x|macintosh", "macOS"),
    (r"(?i)android", "Android"),
    (r"(?i)cros", "ChromeOS"),
    (r"(?i)linux|x11", "Linux"),
]
OTHER_AGENT = "Other"

RANGE_HOURS = [24, 48, 168, 720]
DEFAULT_RANGE_HOURS = 168
FEED_ROWS = 40
RETENTION_DAYS = 90
SEVERE_DROP_PCT = 50
FUNNEL = [
    ("Landed", "visitor_landed"),
    ("Loaded CSV", "file_loaded"),
    ("Passed checks", "preflight_pass"),
    ("Downloaded file", "conversion_success"),
]

# --------------------------------------------------------------------------
# Subscriptions and allowance
# --------------------------------------------------------------------------

HANDLED_CHANGES = [
    "checkout.session.completed",
    "customer.subscription.created",
    "customer.subscription.updated",
    "customer.subscription.deleted",
]
ENTITLED_STATUSES = ["active", "trialing"]
FREE_ROW_LIMIT = 50
ALLOWANCE_LIMIT = 2
ALLOWANCE_WINDOW_MS = 24 * 60 * 60 * 1000

# --------------------------------------------------------------------------
# Bank layouts
# --------------------------------------------------------------------------

ACCOUNT_KINDS = {"checking": "checking account", "credit-card": "credit card", "combined": "account statement"}
LAYOUTS_COMPILED_ON = "2026-09-05"

# slug, bank, product, region, date order, amount mode, confidence, headers.
# No layout has been verified against a live export, so none carries a date.
BANK_LAYOUTS = [
    ("chase-to-quickbooks", "Chase", "credit-card", "US", "MDY", "single_signed", "likely",
     ["Transaction Date", "Post Date", "Description", "Category", "Type", "Amount", "Memo"]),
    ("chase-checking-to-quickbooks", "Chase Checking", "checking", "US", "MDY", "single_signed", "likely",
     ["Details", "Posting Date", "Description", "Amount", "Type", "Balance", "Check or Slip #"]),
    ("bank-of-america-to-quickbooks", "Bank of America", "checking", "US", "MDY", "single_signed", "likely",
     ["Date", "Description", "Amount", "Running Bal."]),
    ("wells-fargo-to-quickbooks", "Wells Fargo", "checking", "US", "MDY", "single_signed", "likely",
     []),
    ("amex-to-quickbooks", "American Express", "credit-card", "US", "MDY", "single_signed", "likely",
     ["Date", "Description", "Card Member", "Account #", "Amount"]),
    ("capital-one-to-quickbooks", "Capital One", "credit-card", "US", "YMD", "debit_credit_pair", "likely",
     ["Transaction Date", "Posted Date", "Card No.", "Description", "Category", "Debit", "Credit"]),
    ("citibank-to-quickbooks", "Citibank", "credit-card", "US", "MDY", "debit_credit_pair", "unverified",
     ["Status", "Date", "Description", "Debit", "Credit"]),
    ("pnc-to-quickbooks", "PNC Bank", "checking", "US", "MDY", "debit_credit_pair", "unverified",
     ["Date", "Description", "Withdrawals", "Deposits", "Balance"]),
    ("us-bank-to-quickbooks", "U.S. Bank", "checking", "US", "MDY", "single_signed", "unverified",
     ["Date", "Transaction", "Name", "Memo", "Amount"]),
    ("discover-to-quickbooks", "Discover", "credit-card", "US", "MDY", "single_signed", "unverified",
     ["Trans. Date", "Post Date", "Description", "Amount", "Category"]),
    ("ally-to-quickbooks", "Ally Bank", "checking", "US", "YMD", "single_signed", "unverified",
     ["Date", "Time", "Amount", "Type", "Description"]),
    ("barclays-to-quickbooks", "Barclays", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Number", "Date", "Account", "Amount", "Subcategory", "Memo"]),
    ("hsbc-to-quickbooks", "HSBC", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Date", "Description", "Amount"]),
    ("natwest-to-quickbooks", "NatWest", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Date", "Type", "Description", "Value", "Balance", "Account Name", "Account Number"]),
    ("lloyds-to-quickbooks", "Lloyds Bank", "checking", "UK", "DMY", "debit_credit_pair", "unverified",
     ["Transaction Date", "Transaction Type", "Sort Code", "Account Number", "Transaction Description", "Debit Amount", "Credit Amount", "Balance"]),
    ("monzo-to-quickbooks", "Monzo", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Transaction ID", "Date", "Time", "Type", "Name", "Emoji", "Category", "Amount", "Currency", "Local amount", "Local currency", "Notes and #tags", "Address", "Receipt", "Description", "Category split"]),
    ("revolut-to-quickbooks", "Revolut", "combined", "EU", "YMD", "single_signed", "unverified",
     ["Type", "Product", "Started Date", "Completed Date", "Description", "Amount", "Fee", "Currency", "State", "Balance"]),
    ("starling-to-quickbooks", "Starling Bank", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Date", "Counter Party", "Reference", "Type", "Amount (GBP)", "Balance (GBP)"]),
    ("td-bank-to-quickbooks", "TD Bank", "checking", "US", "MDY", "debit_credit_pair", "unverified",
     ["Date", "Transaction Description", "Debit", "Credit", "Balance"]),
    ("santander-to-quickbooks", "Santander", "checking", "UK", "DMY", "single_signed", "unverified",
     ["Date", "Description", "Amount", "Balance"]),
]
LAYOUT_SLUG_SUFFIX = "-to-quickbooks"

MARKET_CURRENCY = {"US": "USD", "UK": "GBP", "EU": "EUR"}
