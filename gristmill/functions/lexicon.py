"""Word lists that the rules compare with."""

NON_PRODUCT_NAMES = [
    "affiliate", "affiliates", "contact", "contact us", "faq", "faqs", "faq's", "about", "about us", "privacy", "privacy policy",
    "terms", "terms of service", "terms & conditions", "terms and conditions", "gdpr", "gdpr compliance", "cookie policy", "cookies",
    "careers", "jobs", "press", "blog", "news", "newsletter", "shipping", "shipping policy", "returns", "return policy",
    "refund policy", "warranty", "sitemap", "accessibility", "store locator", "find a store", "gift cards", "gift card",
    "login", "sign in", "register", "my account", "account", "cart", "checkout", "wishlist", "rewards", "loyalty",
    "culinary council", "ambassador", "ambassadors", "sustainability", "our story", "our mission",
]
NON_PRODUCT_PHRASES = ["all rights reserved", "copyright", "terms of", "privacy", "cookie", "gdpr", "compliance", "unsubscribe"]
PROMO_PHRASES = ["gear up", "back to campus", "has this pack", "no one else", "made with durable", "deadstock", "one-of-a-kind", "edition of one", "meet you on", "literally", "styles inside"]
TITLE_OPENERS = ["all ", "shop ", "best ", "top ", "new ", "featured", "collection", "category", "department", "browse", "what is", "about", "how to", "why ", "our ", "science", "technology"]
SITE_ENDINGS = [" cookware", " - home", " - official site"]
MERCH_PHRASES = [
    "shop", "explore", "discover", "browse", "view all", "see all", "collection", "collections", "essentials", "tools", "accessories",
    "cookware", "bakeware", "cutlery", "gadgets", "everyday", "everyday cooking", "performance", "durability", "timeless", "precision",
    "elevate", "style meets", "natural beauty", "smooth cooking", "flexible performance", "make every meal", "dependable tools",
    "bake with", "prep like", "meal prep", "meal count", "grill game", "outdoor tools", "food preparation",
    "nonstick tools", "silicone tools", "stainless steel tools", "wood tools", "textiles", "linens",
]
SENTENCE_OPENERS = [
    "smooth", "flexible", "timeless", "natural", "style", "make", "prep", "elevate", "bake", "dependable", "create", "discover", "unlock",
    "experience", "transform", "achieve", "master", "enjoy", "get", "find", "upgrade", "shop", "introducing",
]
PRODUCT_NOUNS = [
    "pan", "skillet", "saucepan", "sauté pan", "saute pan", "fry pan", "stockpot", "stock pot", "dutch oven", "wok", "pot", "lid",
    "colander", "strainer", "grater", "peeler", "spatula", "tong", "tongs", "ladle", "spoon", "whisk", "bowl", "rack", "roaster", "griddle",
    "sheet pan", "baking sheet", "mold", "steamer", "baking pan", "loaf pan", "cake pan", "roasting pan", "broiler pan",
    "knife", "knives", "shears", "scissors", "cutting board", "casserole", "braiser", "sauteuse", "insert", "basket", "trivet",
    "kettle", "teakettle", "brush", "mitt", "apron", "jacket", "shirt", "pants", "shoes", "sneakers", "boot", "boots",
    "bag", "backpack", "wallet", "belt", "hat", "cap", "bottle", "tumbler", "mug", "cup", "glass",
    "speaker", "headphones", "earbuds", "charger", "cable", "lamp", "light", "bulb", "set", "piece set",
    "cooker", "pressure cooker", "slow cooker",
]
CONNECTORS = r"\b(meets|using|for everyday|like a pro|game with|count with|precision using|beauty meets|function with|made for|built for|designed for)\b"
NON_PRODUCT_SEGMENTS = [
    "faq", "faqs", "about", "about-us", "contact", "contact-us", "privacy", "privacy-policy", "terms", "terms-of-service",
    "terms-and-conditions", "cookie-policy", "gdpr", "accessibility", "careers", "jobs", "press", "blog", "blogs", "news", "newsletter",
    "shipping", "shipping-policy", "returns", "return-policy", "refund-policy", "warranty", "sitemap", "store-locator",
    "gift-cards", "gift-card", "login", "sign-in", "register", "account", "cart", "checkout", "wishlist", "rewards", "loyalty",
    "affiliate", "affiliates", "ambassador", "ambassadors", "sustainability", "our-story", "our-mission", "recipes",
    "culinary-council", "pages",
]
COLORS = [
    "black", "white", "red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "grey", "gray", "navy", "teal", "maroon", "olive",
    "cream", "beige", "tan", "ivory", "coral", "salmon", "burgundy", "charcoal", "silver", "gold", "khaki", "lavender", "mint", "sage",
    "rust", "copper", "bronze", "indigo", "violet", "magenta", "crimson", "slate", "ash", "graphite", "onyx", "pearl", "bone", "oat", "sand",
    "stone", "chalk", "ink", "midnight", "ocean", "forest", "moss", "camel", "espresso", "chocolate", "cognac", "taupe",
    "light blue", "dark blue", "light grey", "dark grey", "light gray", "dark gray", "light green", "dark green", "light pink", "hot pink",
    "royal blue", "baby blue", "sky blue", "ice blue", "dusty rose", "blush pink", "rose gold", "off white", "heather grey",
]
PDP_URL = r"(/products?/|/p/|/item/|/dp/|/sku/|/detail[s]?/|\-[A-Z0-9]{5,15}\.html$|[_\-][0-9]{4,}(?:\.html)?$|/[A-Z0-9]{6,20}$)"
NON_PRODUCT_URL = r"(/category/|/collection[s]?/|/catalog/|/blog/|/article/|/editorial/|/guide/|/inspiration/|/about/|/contact/|/search\?|/tag/|#|/page/\d+|/content/)"
PRODUCT_LINK = r"/products?/|/shop/|/item/|/p/|/dp/|/collections?/.+/.+"
#: Opening tags of the elements whose links count as a card's.
LINK_CARD_CLASS = r"""\s(?i:class)\s*=\s*(?:(["'])(?:(?!\1)[\s\S])*?(?:product|Product|card|item)|(["'])(?:(?:(?!\2)[\s\S])*\s)?(?:grid|collection)(?:\s|\2)|[^\s"'>]*(?:product|Product|card|item)|(?:grid|collection)[\s>])"""
#: Where a site's sitemaps are looked for, and which of their addresses are products.
SITEMAP_PLACES = ["/sitemap.xml", "/sitemap_products_1.xml", "/sitemap_index.xml"]
SITEMAP_PRODUCT = r"/(products?|shop|items?|p|catalog)/[^?#]+"
COLLECTION_LINK = r"/collections?/|/categories?/|/catalog/|/shop/|/department/"
PRICE_MARKED = r"[\$£€]\s?(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
PRICE_BARE = r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d{4,}(?:\.\d{1,2})?)"
PRICE_LABEL = r"(?:Regular\s*Price|MSRP|Price)\s*:?\s*\$?\s?"
SKU_JUNK = r"(regular\s*price|sale\s*price|strikethrough|display|search results|product display|items on|may display|price\$|\.com)"
SIZES = r"^\d+(\.\d+)?\s*(oz|ml|l|g|kg|lb|in|cm|mm|qt|gal)\.?$|^(xs|s|m|l|xl|xxl|xxxl|2xl|3xl|one size)$|^\d+x\d+|^\d+\s*(piece|pc|pack|count|ct|set)s?$|^\d+$"
EXPORT_NAMES = {"product_image": "Product Image", "sku_upc": "UPC/SKU/ASIN", "product_name": "Product Name", "color": "Color", "msrp": "MSRP", "qty": "Qty", "your_cost": "Your Cost", "notes": "Notes"}
IMAGE_WORDS = [
    (["thumb", "tiny", "small", "icon", "50x", "75x", "100x"], -50), (["placeholder", "no-image", "noimage", "blank"], -100),
    (["large", "1024", "1200", "2048", "original", "master"], 30), (["/products/", "/images/", "/media/"], 10), (["spacer", "pixel", "1x1"], -100),
]
IMAGE_ENDINGS = [".jpg", ".jpeg", ".png", ".webp"]
ADD_TO_CART = r"(?:add.to.cart|add.to.bag|buy.now|quick.view|quick.add|addtocart)"
SHOP_MARKS = ["cdn.shopify.com", "Shopify.theme", "myshopify.com"]
DEFAULT_OPTIONS = ["default title", "default", "one size", "os"]
PAGE_NAMES = ["page not found", "404", "home", "homepage", "contact us", "about us", "faq", "shipping", "returns"]

#: Misread colour names and what they stand for.
MISREAD_COLORS = {
    "cotopaxiblack": "Cotopaxi Black", "cotopaxi black": "Cotopaxi Black", "cotopakiblack": "Cotopaxi Black", "cotopam black": "Cotopaxi Black",
    "cotopanm black": "Cotopaxi Black", "cotopaxi blk": "Cotopaxi Black", "cotopax black": "Cotopaxi Black", "cotoran black": "Cotopaxi Black",
    "cotoran blk": "Cotopaxi Black", "cotopan black": "Cotopaxi Black", "ootoran black": "Cotopaxi Black", "cororan black": "Cotopaxi Black",
    "fangue": "Fatigue", "fangue c/o": "Fatigue", "fatigue": "Fatigue", "fanigue": "Fatigue", "terra noo": "Terra", "terra moco": "Terra", "terra": "Terra",
    "menerai": "Mineral", "menerial": "Mineral", "meneral": "Mineral", "mineral": "Mineral", "everglade go": "Everglade", "everglade": "Everglade",
    "cinder": "Cinder", "coto!": "Cotopaxi", "coto! glace": "Cotopaxi Black", "cotopax!": "Cotopaxi", "cotopaxl": "Cotopaxi",
}
KNOWN_COLORS = [
    "black", "white", "red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "grey", "gray", "navy", "cream", "ivory", "beige",
    "tan", "khaki", "olive", "teal", "coral", "maroon", "burgundy", "charcoal", "silver", "gold", "rose", "lavender", "mint", "sage",
    "indigo", "crimson", "scarlet", "cyan", "magenta", "turquoise", "plum", "mauve", "peach", "salmon", "rust", "copper", "bronze",
    "sand", "stone", "slate", "ash", "smoke", "fog", "mist", "midnight", "cobalt", "royal blue", "sky blue", "baby blue", "powder blue",
    "forest", "hunter", "lime", "emerald", "jade", "moss", "wine", "berry", "cherry", "raspberry", "blush", "fuchsia",
    "taupe", "mocha", "espresso", "chocolate", "camel", "cognac", "mustard", "amber", "honey", "lemon", "canary",
    "ocean", "aqua", "sea", "marine", "arctic", "ice", "fatigue", "camo", "camouflage", "heather", "denim",
    "graphite", "iron", "steel", "pewter", "titanium", "oat", "wheat", "flax", "linen", "natural", "bone", "parchment", "eggshell", "pearl", "oyster",
    "spruce", "pine", "fern", "clover", "basil", "clay", "terracotta", "sienna", "adobe", "brick", "storm", "thunder", "cloud", "dusk", "dawn",
    "del dia", "cada dia", "cotopaxi black", "terra", "mineral", "everglade", "cinder", "palmetto", "putty", "cornflower",
    "crust", "kimchy", "gumball", "log cabin", "flame", "sandstone", "butter", "deep sea", "kaleidoscope", "crimson fare", "blue spruce",
]
NOT_COLORS = [
    "fall", "ats", "msrp", "cotopaxi", "wholesale", "retail", "spring", "summer", "winter", "description", "product", "price", "sku", "upc",
    "style", "size", "notes", "moq", "qty", "quantity", "units", "available", "stock", "pack", "packs", "bags", "bag", "travel",
    "daypack", "backpack", "duffel", "tote", "sling", "hip", "fanny", "august", "september", "october", "november", "december",
    "january", "february", "march", "april", "may", "june", "july", "shipping", "ship", "date", "delivery", "page", "total",
    "item", "items", "collection", "category", "new", "sale", "men", "women", "unisex", "kids", "youth", "adult",
    "small", "medium", "large", "xlarge", "one size", "accessories", "gear", "hauler", "organizer", "organizers",
    "pouch", "kit", "mini", "mesh", "convertible", "shoulder", "capsule", "prebook", "template", "3k", "1k", "2k", "5k", "10k",
]
SKU_LINE = r"([A-Z$]\d{4,}\w*)\s+(.+?)(?:\s*\|\s*)?(?:MSRP\s*)?\$\s*(\d+(?:\.\d{2})?)"
NAME_LINE = r"([A-Z][A-Za-z0-9é\s]+(?:[-–]\s*[A-Za-zé\s]+)?)\s*\$\s*(\d+(?:\.\d{2})?)"
CARRY_OVER = r"\s*(?:C/?O|c/?o|C/0|c/0|CD|CiO|CYO|cro|cio|YO)\b"
#: Words that tell what a table's or a block's column holds, in the order in which they are asked.
TABLE_WORDS = [("sku_upc", ["sku", "style", "item", "upc"]), ("product_name", ["name", "product", "description", "title"]), ("your_cost", ["wholesale", "cost"]), ("msrp", ["price", "msrp", "retail"]), ("color", ["color", "colour"]), ("qty", ["qty", "quantity", "ats", "units", "stock", "moq"]), ("notes", ["note"])]
HEADER_CLASSES = [["sku", "style", "item", "upc"], ["name", "product", "description", "title"], ["price", "msrp", "retail", "wholesale", "cost"], ["color", "colour"], ["qty", "quantity", "ats", "units", "stock"]]
BLOCK_WORDS = [("sku_upc", ["sku", "style", "item", "upc", "code"]), ("product_name", ["name", "product", "title"]), ("color", ["color", "colour"]), ("your_cost", ["wholesale", "cost"]), ("msrp", ["price", "msrp", "retail"]), ("qty", ["qty", "quantity", "ats", "units", "moq"])]
#: Names of columns of product sheets, by field, in the order in which they are asked.
COLUMN_ALIASES = {
    "product_image": ["image", "photo", "picture", "img", "product image", "image url", "image_url", "photo_url", "thumbnail", "main image"],
    "sku_upc": ["sku", "upc", "asin", "style", "style number", "style #", "style no", "item number", "item #", "item no", "barcode", "ean", "gtin", "product code", "code", "article", "article number", "model", "upc/sku/asin", "sku/upc", "upc/sku"],
    "product_name": ["name", "product name", "product", "title", "product title", "description", "item name", "item", "style name"],
    "color": ["color", "colour", "colorway", "color name", "color/pattern", "shade", "variant", "color variant"],
    "msrp": ["msrp", "retail", "retail price", "price", "rrp", "srp", "suggested retail", "list price", "selling price"],
    "your_cost": ["your cost", "wholesale", "wholesale price", "cost", "unit cost", "net price", "dealer price", "trade price", "landed cost", "fob"],
    "qty": ["qty", "quantity", "ats", "available", "stock", "inventory", "on hand", "available qty", "available quantity", "moq", "units", "unit", "pcs", "pieces", "ea", "each", "fall ats", "spring ats", "summer ats", "winter ats", "allocation", "alloc"],
    "notes": ["notes", "note", "comments", "comment", "description", "details", "remarks", "memo", "info"],
}
HEADER_WORDS = ["sku", "upc", "name", "product", "color", "price", "msrp", "wholesale", "qty", "quantity", "image", "description", "style"]
#: Fixed file endings that a cached image keeps.
CACHED_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".svg"]
#: Fixed texts of cells that a sheet reader takes as empty.
EMPTY_CELLS = frozenset([None, "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
