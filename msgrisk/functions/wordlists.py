"""Word, domain and feature lists that detectors must agree on.

Personal names and everyday words for the mailbox check are longer lists and are parameters
(see ``operators.sender.mailbox_randomness``), as are phrase rules and domain registries.
"""

FEATURES = [
    "having_ip_address", "url_length", "shortining_service", "having_at_symbol", "double_slash_redirecting", "prefix_suffix",
    "having_sub_domain", "https_token", "sslfinal_state", "domain_registration_length", "age_of_domain", "dnsrecord",
    "web_traffic", "page_rank", "google_index", "statistical_report", "favicon", "port", "request_url", "url_of_anchor",
    "links_in_tags", "sfh", "submitting_to_email", "abnormal_url", "redirect", "on_mouseover", "rightclick", "popupwindow",
    "iframe", "links_pointing_to_page",
]

KNOWN_PROVIDERS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "protonmail.com", "zoho.com",
    "mail.com", "yandex.com", "live.com", "msn.com", "me.com", "apple.com", "google.com", "microsoft.com", "amazon.com",
    "qq.com", "163.com", "126.com", "sina.com", "sohu.com", "foxmail.com", "paypal.com", "netflix.com", "facebook.com",
    "twitter.com", "instagram.com", "linkedin.com", "github.com", "adobe.com", "dropbox.com", "spotify.com", "uber.com",
    "airbnb.com", "salesforce.com", "slack.com", "zoom.us", "stripe.com", "chase.com", "bankofamerica.com",
    "wellsfargo.com", "citibank.com", "capitalone.com", "americanexpress.com", "discover.com", "fedex.com", "ups.com",
    "dhl.com", "usps.com", "stanford.edu", "mit.edu", "harvard.edu", "berkeley.edu",
]
HIGH_TRAFFIC = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "protonmail.com", "live.com", "qq.com", "163.com",
    "paypal.com", "netflix.com", "microsoft.com", "apple.com", "google.com", "amazon.com", "facebook.com", "linkedin.com",
    "github.com", "spotify.com", "chase.com", "bankofamerica.com",
]
MAILBOX_PROVIDERS = [
    "gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "mac.com", "aol.com",
    "proton.me", "protonmail.com", "zoho.com", "mail.com", "yandex.com", "live.com", "msn.com", "me.com", "qq.com",
    "163.com", "126.com", "sina.com", "sohu.com", "foxmail.com",
]
SUSPICIOUS_KEYWORDS = [
    "verify", "verification", "secure", "security", "bank", "account", "update", "confirm", "login", "signin", "password",
    "credential", "ebay", "service", "admin", "official", "alert", "notice", "suspended", "blocked", "urgent",
    "important", "limited", "claim", "prize", "winner", "free", "bonus", "reward", "recover", "recovery", "restore",
    "reactivate", "unlock", "validate", "authenticate", "protect", "notification", "warning", "billing", "invoice",
    "refund", "payment", "subscri", "renew", "expir", "crypto", "bitcoin", "wallet", "token", "trading", "invest",
    "no-reply", "donotreply", "postmaster", "mailer", "webmaster", "hostmaster", "abuse",
]
BRANDS = [
    "paypal", "google", "microsoft", "amazon", "apple", "netflix", "facebook", "twitter", "instagram", "linkedin", "ebay",
    "alibaba", "dropbox", "adobe", "docusign", "salesforce", "stripe", "shopify", "chase", "citibank", "wellsfargo",
    "bankofamerica", "barclays", "hsbc", "santander", "natwest", "lloyds", "capitalone", "usbank", "schwab", "fidelity",
    "vanguard", "robinhood", "coinbase", "binance", "kraken", "metamask", "irs", "fbi", "dhs", "interpol", "europol",
    "fedex", "ups", "dhl", "usps",
]
FINANCIAL_TERMS = [
    "bank", "banking", "banc", "credit", "debit", "loan", "mortgage", "invest", "investment", "capital", "fund", "finance",
    "financial", "wealth", "trading", "forex", "crypto", "bitcoin", "blockchain", "insurance", "ins", "assurance",
    "revenue", "treasury", "fiscal", "pension", "savings", "wallet", "transfer", "remit", "clearing", "brokerage",
    "exchange", "escrow", "leasing", "billing", "refund", "invoice", "payroll", "accounting", "audit", "taxserv",
    "taxrefund", "federal", "national", "official", "government", "regulatory", "authority", "ministry", "bureau",
]
BUSINESS_SUFFIXES = [
    "group", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "plc", "holdings", "holding",
    "management", "enterprise", "enterprises", "solutions", "service", "services", "associates", "association",
    "partners", "partnership", "international", "global", "agency", "institute", "trust", "ventures", "systems",
    "technologies", "administration", "department", "commission", "organisation", "organization", "centre", "center",
    "network", "networks", "alliance", "union", "foundation", "consultants", "consulting", "advisory",
]
GOVERNMENT_TERMS = [
    "federal", "national", "authority", "ministry", "government", "regulatory", "commission", "bureau", "department",
    "administration",
]
SPAM_TLDS = ["xyz", "top", "click", "loan", "win", "gq", "tk", "ml", "cf", "ga", "pw", "cc"]
COMMON_TLDS = ["com", "org", "net", "edu", "gov", "mil", "io", "co", "cn"]
ABUSED_CCTLDS = ["ru", "cn", "tk", "ml", "ga", "cf", "gq", "pw", "xyz"]
SHORT_MAIL_DOMAINS = ["bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "t.co", "short.io"]
DISPOSABLE_LABELS = [
    r"^(?:temp|temporary)-?(?:mail|email|inbox|box)\d*$",
    r"^(?:trash|discard|throwaway|burner)-?(?:mail|email|inbox|box)\d*$",
    r"^(?:mail)-?(?:temp|trash|drop)\d*$",
    r"^(?:fake)-?(?:mail|email|inbox)\d*$",
    r"^(?:10|20|30|60)(?:minute|min)-?mail(?:box)?\d*$",
]
