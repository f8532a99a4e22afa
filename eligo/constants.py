"""Word lists, thresholds and patterns that results depend on."""

# --- fixed values: synonym maps, tested in this order -----------------------
GENDERS = {
    "female": "Female", "women": "Female", "woman": "Female", "ladies": "Female",
    "male": "Male", "men": "Male", "man": "Male",
    "any": "Any", "all": "Any",
    "transgender": "Transgender", "trans": "Transgender",
}
SOCIAL_CATEGORIES = {
    "sc": "SC", "scheduled caste": "SC",
    "st": "ST", "scheduled tribe": "ST",
    "obc": "OBC", "other backward class": "OBC", "other backward caste": "OBC",
    "ews": "EWS", "economically weaker section": "EWS",
    "minority": "Minority", "minorities": "Minority",
    "general": "General",
}
BUSINESS_TYPES = {
    "manufacturing": "Manufacturing",
    "service": "Service", "services": "Service",
    "trading": "Trading", "retail": "Trading", "trade": "Trading",
    "artisan": "Artisan", "craft": "Artisan", "handicraft": "Artisan",
    "agriculture": "Agriculture", "farming": "Agriculture", "farm": "Agriculture",
    "startup": "Startup",
}
STATUSES = {
    "active": "active", "open": "active", "ongoing": "active", "live": "active",
    "closed": "discontinued", "discontinued": "discontinued", "expired": "discontinued",
    "suspended": "suspended", "paused": "suspended",
    "merged": "merged",
}
# what an API listing may say; "merged" is not among them
API_STATUSES = {
    "active": "active", "open": "active", "ongoing": "active", "live": "active",
    "closed": "discontinued", "discontinued": "discontinued", "expired": "discontinued",
    "suspended": "suspended", "paused": "suspended",
}
FUNDING_TYPES = {
    "central sector": "central_sector",
    "centrally sponsored": "centrally_sponsored",
    "css": "centrally_sponsored",
    "state": "state",
    "local": "local",
}
GOVERNMENT_LEVELS = {
    "central": "central", "national": "central", "union": "central",
    "state": "state",
    "ut": "union_territory", "union territory": "union_territory",
    "district": "district",
}
API_LEVELS = {
    "central": "central", "national": "central", "union": "central",
    "state": "state",
    "ut": "union_territory", "union territory": "union_territory",
}
FEMALE_WORDS = ["women", "female", "ladies"]

# --- fixed values: words that raise a requirement flag ----------------------
FLAG_WORDS = {
    "udyam_required": ["udyam"],
    "startup_requirements": ["startup", "incubat"],
    "farmer_requirements": ["farmer", "kisan", "agriculture"],
    "artisan_requirements": ["artisan", "handicraft", "craft"],
    "student_requirements": ["student", "scholar"],
    "msme_requirements": ["msme", "micro enterprise", "small enterprise"],
}
DISABILITY_WORDS = ["pwd", "differently abled", "divyang", "disability"]
TRUE_WORDS = ["true", "yes", "1", "required"]

# --- fixed values: patterns (no case) ---------------------------------------
AMOUNT = (
    r"(?i)(?:rs\.?|₹|inr)?\s*(\d+(?:\.\d+)?)\s*"
    r"(lakh|lakhs|lac|lacs|crore|crores|cr|thousand|k)?"
)
AGE_MIN = r"(?i)(?:age\s+)?(\d+)\s*(?:years?|yrs?)?\s*(?:and\s+)?(?:above|minimum|min)"
AGE_MAX = r"(?i)(?:age\s+)?(?:below|maximum|max|up\s+to|upto)\s+(\d+)\s*(?:years?|yrs?)?"
INCOME = (
    r"(?i)(?:annual\s+)?(?:family\s+)?income\s+(?:of\s+)?"
    r"(?:not\s+exceeding|up\s+to|below|less\s+than)?\s*"
    r"(?:rs\.?|₹)?\s*(\d+(?:\.\d+)?)\s*(lakh|lakhs|lac|lacs|crore|crores)?"
)
# words of which a text must hold one, in any letter case, for the pattern of that name to match
NUMBER_WORDS = {"age_min": ["above", "min"], "age_max": ["below", "max", "up"], "income": ["income"]}
URL = (
    r"(?i)^https?://(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,}"
    r"(?::\d+)?(?:[/?#]\S*)?$"
)
ACRONYM = r"\(([A-Z]{2,10})\)"

# --- fixed values: validation -----------------------------------------------
VALID_STATUSES = ["active", "suspended", "closed", "merged", "discontinued", "unknown"]
URL_FIELDS = ["application_url", "official_application_url", "source_url", "official_source_url"]
RECOMMENDED_FIELDS = [
    "description", "ministry", "eligibility_text",
    "official_application_url", "official_source_url",
]
MIN_QUALITY = 20
MIN_QUALITY_FOR_EMBEDDING = 40
VERIFIED_API_SOURCES = ["apisetu_myscheme", "data_gov_in"]

# --- fixed values: documents ------------------------------------------------
BASE_DOCUMENTS = [
    "Aadhaar Card / Government Photo ID",
    "Passport-size Photographs",
    "Bank Account Details (Passbook / Cancelled Cheque)",
    "Project Report / Business Plan",
]
CHECKLIST_ESSENTIALS = [
    "Aadhaar Card / Government Photo ID",
    "Bank Account Details (Passbook / Cancelled Cheque)",
    "Detailed Project Report / Business Proposal",
]

# --- fixed values: the source registry --------------------------------------
# id, name, type, authority_level, terms_status, enabled, priority, category_filter
SOURCE_ROWS = [
    ("apisetu_myscheme", "API Setu — myScheme API", "api", "primary", "authorized", True, 1, None),
    ("myscheme_web", "myScheme National Portal", "html", "primary", "check_required", False, 2, None),
    ("india_gov_schemes", "India.gov.in — National Portal Government Schemes", "html", "secondary",
     "authorized", True, 3, None),
    ("data_gov_in", "data.gov.in — Open Government Data Platform", "api", "secondary",
     "authorized", True, 3, None),
    ("national_services_portal", "National Government Services Portal", "html", "secondary",
     "authorized", True, 4, None),
    ("msme_ministry", "Ministry of MSME — Official Portal", "html", "primary",
     "authorized", True, 2, ["MSME", "Artisan", "Startup"]),
    ("mudra_portal", "MUDRA Official Portal", "html", "primary",
     "authorized", True, 2, ["MSME", "Finance"]),
    ("standupmitra", "Stand-Up India — StandUp Mitra Portal", "html", "primary",
     "authorized", True, 2, ["SC/ST", "Women", "Finance"]),
    ("kvic", "KVIC — PMEGP Portal", "html", "primary",
     "authorized", True, 2, ["MSME", "Artisan", "Employment"]),
]

# --- fixed values: matching -------------------------------------------------
CANDIDATE_LIMIT = 50
RANK_LIMIT = 1000  # above it Spark no longer cuts a ranking on the map side
PAGE_LIMIT_DEFAULT = 20
PAGE_LIMIT_MAX = 100
SEARCH_LIMIT = 20
OPEN_CATEGORIES = ["any", "general", "all"]
MARGINALIZED = ["sc", "st", "obc", "minority"]
FEMALE_TARGETS = ["female", "women", "woman"]
