"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as written (spelling, case and order
included) for results to match the item model, the label taxonomy and the
two synthetic-data profiles.
"""

from __future__ import annotations

# FIXED VALUES: ingest defaults for a newly discovered image.
DEFAULT_STATE = "NJ"
DEFAULT_CITY = "Princeton"
PENDING_DESCRIPTION = ""
UNKNOWN_BRAND = ""
OTHER_BRAND = "Other"

# FIXED VALUES: label taxonomy, model -> (category names in ordinal order,
# label -> category). Labels are matched case-sensitively.
TAXONOMY = {
    "trash1": (
        ["RECYCLE", "COMPOST", "TRASH"],
        {
            "Paper": "RECYCLE",
            "Other": "TRASH",
            "Plastic": "RECYCLE",
            "G_M": "RECYCLE",
            "Organic": "COMPOST",
        },
    ),
    "trash2": (
        ["RECYCLE", "METAL", "TRASH"],
        {
            "paper": "RECYCLE",
            "cardboard": "RECYCLE",
            "plastic": "RECYCLE",
            "trash": "TRASH",
            "metal": "METAL",
        },
    ),
    "fruits": (
        ["QUICK_COMPOST", "SLOW_COMPOST", "REUSEABLE"],
        {
            "banana": "QUICK_COMPOST",
            "spinach": "QUICK_COMPOST",
            "lettuce": "QUICK_COMPOST",
            "cabbage": "QUICK_COMPOST",
            "peas": "QUICK_COMPOST",
            "cucumber": "QUICK_COMPOST",
            "tomato": "QUICK_COMPOST",
            "bellpepper": "QUICK_COMPOST",
            "chilipepper": "QUICK_COMPOST",
            "jalepeno": "QUICK_COMPOST",
            "capsicum": "QUICK_COMPOST",
            "paprika": "QUICK_COMPOST",
            "radish": "QUICK_COMPOST",
            "turnip": "QUICK_COMPOST",
            "grapes": "QUICK_COMPOST",
            "kiwi": "QUICK_COMPOST",
            "apple": "QUICK_COMPOST",
            "pear": "QUICK_COMPOST",
            "watermelon": "QUICK_COMPOST",
            "soybean": "QUICK_COMPOST",
            "corn": "SLOW_COMPOST",
            "sweetcorn": "SLOW_COMPOST",
            "cauliflower": "SLOW_COMPOST",
            "eggplant": "SLOW_COMPOST",
            "potato": "SLOW_COMPOST",
            "sweetpotato": "SLOW_COMPOST",
            "onion": "SLOW_COMPOST",
            "garlic": "SLOW_COMPOST",
            "beetroot": "SLOW_COMPOST",
            "carrot": "SLOW_COMPOST",
            "pineapple": "REUSEABLE",
            "mango": "REUSEABLE",
            "ginger": "REUSEABLE",
            "lemon": "REUSEABLE",
            "orange": "REUSEABLE",
            "pomegranate": "REUSEABLE",
        },
    ),
}

# FIXED VALUES: display names of the three composition shares.
CATEGORY_NAMES = {
    "compostable_pct": "Compostable",
    "recyclable_pct": "Recyclable",
    "trash_pct": "Trash",
}

# FIXED VALUES: metadata request sent with every image.
METADATA_PROMPT = (
    "Provide JSON-formatted metadata about the following image. Include 'is_recyclable', "
    "'is_compostable', and 'is_metal' as booleans; 'brand' as a string if applicable, but "
    "otherwise the empty string; and a 'description' field with a 3-8 word description of "
    "the item. Include just the JSON as a single string without extra formatting or explanation."
)
METADATA_MODEL = "gpt-4o-mini"
IMAGE_MIME = "image/jpeg"

# FIXED VALUES: synthetic-data profiles. Weights need not sum to one.
HOUR_COMPOST_WEIGHTS = [
    0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.5, 0.6,
    0.7, 0.6, 0.3, 0.2, 0.2, 0.4, 0.6, 0.6, 0.5, 0.4, 0.3, 0.1,
]
CITIES = [
    ("San Francisco", "CA"), ("New York", "NY"), ("Los Angeles", "CA"),
    ("Austin", "TX"), ("Chicago", "IL"), ("Princeton", "NJ"),
]
DESCRIPTIONS = ["cardboard box", "plastic cup", "aluminum can", "paper bag", "plastic bottle"]
ADJECTIVES = ["tiny", "small", "medium", "large", "ultra large", "gigantic"]
METAL_KEYWORD = "aluminum can"
DEFAULT_RECYCLE_RATE = 0.5
DEFAULT_COMPOST_RATE = 0.1
DEFAULT_HOUR_RATE = 0.1
COMPOST_BOOST = 3
SPINE_DAYS = 7

PROFILES = {
    "python": {
        "end_included": False,
        "brands": ["Amazon", "Walmart", "Apple", "Nike", "Starbucks", "Other"],
        "brand_weights": [0.5, 0.2, 0.1, 0.05, 0.1, 0.05],
        "recycle_rates": {"Amazon": 0.9, "Walmart": 0.25, "Apple": 0.15, "Nike": 0.1, "Starbucks": 0.7, "Other": 0.3},
        "compost_rates": {"Amazon": 0.1, "Walmart": 0.5, "Apple": 0, "Nike": 0.02, "Starbucks": 0.3, "Other": 0.2},
        "hour_weights": HOUR_COMPOST_WEIGHTS,
    },
    "matlab": {
        "end_included": True,
        "brands": ["Amazon", "Walmart", "Coca-Cola", "Nestle", "Starbucks", "Other"],
        "brand_weights": [0.1, 0.2, 0.4, 0.25, 0.1, 0.05],
        "recycle_rates": {"Amazon": 0.9, "Walmart": 0.25, "Coca-Cola": 0.95, "Nestle": 0.95, "Starbucks": 0.7, "Other": 0.3},
        "compost_rates": {"Amazon": 0.1, "Walmart": 0.5, "Coca-Cola": 0, "Nestle": 0.02, "Starbucks": 0.3, "Other": 0.2},
        "hour_weights": HOUR_COMPOST_WEIGHTS,
    },
}
