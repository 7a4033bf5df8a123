"""Fixed values that results depend on: vocabularies, host lists, thresholds, namespaces."""

# --- classification vocabulary (fixed values) ---
LEVELS = ["high", "moderate", "low"]
GROUPS = ["fructans", "GOS", "lactose", "excess fructose", "sorbitol", "mannitol"]
LEVEL_RANK = {"low": 1, "moderate": 2, "high": 3}

# --- restaurant life cycle (fixed values) ---
PENDING_DISCOVERY = "pending_discovery"
URL_FOUND = "url_found"
FAILED_PERMANENTLY = "failed_permanently"
SCRAPING = "scraping"
SCRAPED = "scraped"
FAILED_SCRAPE = "failed_scrape"

# --- extraction tiers (fixed values) ---
TIER_JSONLD = "jsonld"
TIER_HTML = "html_llm"
TIER_PDF = "pdf"
TIER_IMAGE = "image_ocr"
TIER_RENDERED = "webagent"
TIER_DIRECTORY = "directory_fanout"

# --- page classes in report order (fixed values) ---
PAGE_CLASSES = [
    "no-site", "no-menu", "image-menu", "js-text-deeplink", "interaction-required", "delivery-only",
]

# --- regulatory change types (fixed values) ---
CHANGE_TYPES = ["addition", "restriction", "revocation", "update"]

# --- identifier namespaces (RFC 4122 and application, fixed values) ---
NS_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
NS_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NS_OID = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
NS_MENU_ITEM = NS_DNS
NS_REGULATORY = "a3c8e6d0-7f2b-4b1a-9c5d-3e8f1a2b4c6d"

# --- search and chunking (fixed values) ---
REVIEWS_PER_BUSINESS = 5
CHUNK_RUNES = 800
CHUNK_OVERLAP = 100
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]
BM25_K1 = 1.2
BM25_B = 0.75
BM25_AVG_LENGTH = 100.0
EMBEDDING_DIM = 768

# White space by the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# What SQL's trim takes off: space separators only, no tabs and no line ends.
SPACE_SEPARATORS = (
    " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)

# --- page text limits (fixed values) ---
MAX_INPUT_RUNES = 60_000
MIN_EXTRACT_RUNES = 60
SHORT_PAGE_RUNES = 200
UNTRUSTED_OPEN = "<untrusted_input>"
UNTRUSTED_CLOSE = "</untrusted_input>"

# --- message screening (fixed values) ---
MAX_MESSAGE_BYTES = 2000
INJECTION_PHRASES = [
    "ignore previous instructions",
    "ignore all previous",
    "forget your instructions",
    "disregard your instructions",
    "you are now",
    "pretend you are",
    "<|system|>",
    "<|im_start|>",
]

# --- url host lists (fixed values) ---
BLOCKED_HOSTS = [
    "vertexaisearch.cloud.google.com",
    "menupages.com",
    "allmenus.com",
    "sirved.com",
    "loopnet.com",
    "streeteasy.com",
    "realtor.com",
    "zillow.com",
    "crexi.com",
    "hilton.com",
    "marriott.com",
    "booking.com",
    "expedia.com",
    "hotels.com",
    "checkle.com",
    "mapquest.com",
    "yellowpages.com",
    "bbb.org",
]
ORDERING_HOSTS = [
    "toasttab.com",
    "getsauce.com",
    "chownow.com",
    "square.site",
    "clover.com",
    "mealkeyway.com",
    "takeout7.com",
    "menufy.com",
    "slicelife.com",
    "bento.com",
    "bentobox.com",
    "getbento.com",
    "orderahead-app.com",
    "popmenu.com",
    "dine.online",
    "order.store",
]
DELIVERY_MARKS = [
    "doordash.com",
    "seamless.com",
    "grubhub.com",
    "ubereats.com",
    "postmates.com",
    "delivery.com",
    "yelp.com",
    "tripadvisor.com",
    "facebook.com",
    "instagram.com",
    "google.com/maps",
]

# --- menu vocabulary (fixed values) ---
MENU_WORDS = ["menu", "appetizer", "entree", "entrée", "dessert", "dishes", "lunch", "dinner"]
MENU_MARKUP = [
    '"menu"', '"menuitem"', '"menusection"',
    "schema.org/menu", "schema.org/menuitem", "schema.org/menusection",
]
MENU_PATH_WORDS = [
    "menu", "lunch", "dinner", "food", "brunch", "breakfast", "drink",
    "cocktail", "wine", "beer", "dessert", "appetizer", "entree", "entrée", ".pdf",
]
PRICE_PATTERN = r"\$\s?\d+(?:\.\d{2})?"
RESTAURANT_TYPES = [
    "Restaurant", "FoodEstablishment", "CafeOrCoffeeShop", "FastFoodRestaurant",
    "BarOrPub", "Bakery", "Brewery", "Winery",
]

# --- html walk (fixed values) ---
SKIPPED_TAGS = ["script", "style", "noscript", "head", "nav", "footer", "iframe", "svg", "img"]

# --- image scoring (fixed values) ---
IMAGE_THRESHOLD = 4
IMAGE_GOOD_WORDS = ["menu", "trifold", "food", "drink"]
IMAGE_BAD_WORDS = ["logo", "hero", "banner", "press", "award", "badge"]

# --- site builders: label, marks in the page (fixed values, in order) ---
PLATFORM_MARKS = [
    ("Squarespace", ["squarespace"]),
    ("Wix", ["wix.com", "wixstatic", "parastorage"]),
    ("WordPress", ["wp-content", "wp-includes"]),
    ("Toast", ["toasttab", "pos.toast"]),
    ("Square", ["squareup", "square.site"]),
    ("Clover", ["clover.com", "clovercdn"]),
    ("BentoBox", ["bentobox", "bento.box"]),
    ("Popmenu", ["popmenu"]),
    ("Shopify", ["shopify"]),
    ("Next.js", ["__next", "_next/static"]),
]
PLATFORM_OTHER = "other/unknown"

# --- import areas: neighbourhood codes, codes limited to zip codes (fixed values) ---
AREAS = {
    "astoria-lic": {
        "ntas": ["QN70", "QN71", "QN72", "QN68"],
        "nta_zips": {"QN31": ["11101", "11109"]},
    },
}
AREA_ROW_LIMIT = 50_000

# --- job kinds shown in the job report (fixed values) ---
JOB_KINDS = ["menusearch.discover_menu_url", "menusearch.scrape_menu"]
