"""Word lists, patterns, names and constants that results depend on.

They are published defaults that must be equal for results to match, so they are kept
together, as plain text and in their natural order.
"""

# fixed values: source column name (lower case, letters and digits only) -> canonical name
COLUMN_ALIASES = {
    "invoice": "invoice",
    "invoiceno": "invoice",
    "stockcode": "stock_code",
    "description": "description",
    "quantity": "quantity",
    "invoicedate": "invoice_date",
    "price": "unit_price",
    "unitprice": "unit_price",
    "customerid": "customer_id",
    "country": "country",
}

# fixed values: columns every transaction table must have
REQUIRED_COLUMNS = [
    "invoice", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id", "country",
]

# fixed values: stock codes that are not products
ADMIN_CODE_PATTERN = r"^(POST|DOT|M|BANK CHARGES|ADJUST2?|AMAZONFEE|B|S|D|C2|CRUK|TEST\d+|SP1002|PADS|GIFT_.*)$"

# fixed values: largest share of nulls allowed per column
MAX_NULL_RATE = {
    "customer_id": 0.40, "description": 0.05, "invoice_date": 0.0, "quantity": 0.0, "unit_price": 0.0,
}

# fixed values: category -> key words, first match wins
CATEGORY_WORDS = {
    "lighting": ["LIGHT", "LAMP", "CANDLE", "LANTERN", "TEALIGHT"],
    "kitchen_dining": ["MUG", "CUP", "TEAPOT", "PLATE", "BOWL", "CAKE", "JAR", "TIN", "SPOON", "BOTTLE", "KITCHEN",
                       "APRON", "LUNCH", "TRAY", "COASTER", "EGG"],
    "bags_storage": ["BAG", "BOX", "BASKET", "CASE", "TOTE", "PURSE", "STORAGE", "CRATE", "TRUNK"],
    "christmas_seasonal": ["CHRISTMAS", "XMAS", "SANTA", "ADVENT", "SNOWFLAKE", "EASTER", "REINDEER"],
    "stationery_cards": ["CARD", "PAPER", "NOTEBOOK", "PENCIL", "PEN", "STICKER", "WRAP", "RIBBON", "GIFT", "TAG",
                         "ENVELOPE"],
    "toys_games": ["TOY", "GAME", "PUZZLE", "DOLL", "PLAYING", "DOMINO", "BALLOON", "PARTY", "JIGSAW"],
    "garden_outdoor": ["GARDEN", "BIRD", "FLOWER", "PLANT", "SEED", "WATERING", "WINDMILL"],
    "jewelry_accessories": ["NECKLACE", "BRACELET", "EARRING", "RING", "BEAD", "JEWELL", "HAIR", "SCARF", "UMBRELLA"],
    "bath_beauty": ["SOAP", "BATH", "TOWEL", "SPONGE", "SPA", "MASSAGE"],
    "home_decor": ["FRAME", "CUSHION", "HEART", "SIGN", "CLOCK", "MIRROR", "VASE", "DOORMAT", "WALL", "HOOK",
                   "HANGING"],
}

# fixed values: engineered features in model order (affinity columns follow)
BASE_FEATURES = [
    "recency_days", "frequency", "total_spend", "avg_spend", "historical_clv", "avg_basket_size", "freq_trend",
    "gap_variance", "seasonal_concentration", "return_rate", "discount_sensitivity", "avg_product_popularity",
    "engagement_score",
]

# fixed values: reader-friendly feature names
FRIENDLY_NAMES = {
    "recency_days": "days since last purchase",
    "frequency": "number of orders",
    "total_spend": "total spend",
    "avg_spend": "average order value",
    "historical_clv": "net lifetime revenue",
    "avg_basket_size": "average basket size",
    "freq_trend": "ordering trend",
    "gap_variance": "irregularity of time between orders",
    "seasonal_concentration": "seasonality of purchases",
    "return_rate": "return rate",
    "discount_sensitivity": "reliance on discounted items",
    "avg_product_popularity": "preference for popular products",
    "engagement_score": "overall engagement score",
}

# fixed values: sentences of the plain-language explanation
RISK_SENTENCES = {
    "high": "This customer is flagged as HIGH churn risk: predicted churn probability %s, at or above the %s operating "
            "threshold",
    "medium": "This customer has MEDIUM churn risk: predicted churn probability %s (threshold %s)",
    "low": "This customer is LOW churn risk: predicted churn probability %s (threshold %s)",
}
DRIVERS_LEAD_IN = ". Main drivers (relative to the average customer): "

# fixed values: segmentation and anomaly inputs
SEGMENT_FEATURES = [
    "recency_days", "frequency", "total_spend", "avg_basket_size", "return_rate", "seasonal_concentration",
    "discount_sensitivity",
]
SEGMENT_LOG_FEATURES = ["recency_days", "frequency", "total_spend", "avg_basket_size"]
SEGMENT_PROFILE_COLUMNS = [
    "recency_days", "frequency", "total_spend", "avg_spend", "avg_basket_size", "return_rate",
    "seasonal_concentration", "discount_sensitivity", "engagement_score",
]
ANOMALY_FEATURES = [
    "total_spend", "avg_spend", "avg_basket_size", "frequency", "historical_clv", "return_rate",
    "discount_sensitivity", "gap_variance",
]
VALUE_TIERS = ["Low", "Medium", "High"]

# fixed values: display names of the churn models
MODEL_DISPLAY_NAMES = {
    "logistic_regression": "Logistic Regression", "decision_tree": "Decision Tree",
    "random_forest": "Random Forest", "boosted_trees": "Boosted Trees", "knn": "KNN",
    "ann": "ANN (feed-forward)",
}

# Columns of the published tables.
PUBLISHED_LINE_COLUMNS = [
    "invoice", "stock_code", "description", "category", "quantity", "invoice_date", "unit_price", "line_total",
    "is_return", "customer_id", "country",
]
PUBLISHED_CUSTOMER_COLUMNS = [
    "customer_id", "country", "first_purchase", "last_purchase", "recency_days", "frequency", "total_spend",
    "historical_clv", "engagement_score",
]
