"""Fixed values shared by the operators.

Everything in this module is a plain value that has to be equal in every engine
for the results to be equal: word lists, patterns, lookup tables, thresholds.
"""

# -- fixed values: business name patterns and niche words -------------------------------
CHAIN_PATTERNS = (
    "target", "walmart", "starbucks", "mcdonald", "burger king",
    "subway", "kfc", "pizza hut", "domino", "taco bell",
    "home depot", "lowes", "best buy", "cvs", "walgreens",
    "nordstrom", "macy", "sears", "jcpenney", "ross dress",
    "costco", "sam's club", "whole foods", "kroger", "safeway",
)
NICHE_WORDS = ("specialty", "artisan", "boutique", "custom", "handmade", "organic")

# -- fixed values: sentiment words counted as substrings of the lower-cased text ---------
POSITIVE_WORDS = (
    "great", "excellent", "amazing", "wonderful", "fantastic",
    "love", "best", "perfect", "awesome", "outstanding",
)
NEGATIVE_WORDS = (
    "terrible", "horrible", "awful", "hate", "worst",
    "bad", "poor", "disappointing", "disgusting", "pathetic",
)

# -- fixed values: stop words -----------------------------------------------------------
CUSTOM_STOP_WORDS = (
    "place", "restaurant", "food", "service", "time", "really",
    "good", "great", "nice", "love", "like", "went", "got",
    "ordered", "came", "back", "would", "definitely", "highly",
)
SHORT_STOP_WORDS = (
    "the", "and", "was", "were", "for", "are", "but", "not", "you", "all", "can", "had",
    "her", "one", "our", "out", "day", "get", "has", "him", "his", "how", "its", "may",
    "new", "now", "old", "see", "two", "way", "who", "boy", "did", "use", "air", "end", "why",
)
TRENDING_STOP_WORDS = ("", "the", "and", "or", "but", "a", "an")

# -- fixed values: place type -> (category, sub-categories) ------------------------------
PLACE_TYPES = {
    "restaurant": ("Restaurant", ("dining",)),
    "food": ("Restaurant", ("dining",)),
    "cafe": ("Cafe", ("coffee", "beverages")),
    "store": ("Retail", ("shopping",)),
    "clothing_store": ("Retail", ("clothing", "fashion")),
    "gym": ("Fitness", ("health", "exercise")),
    "beauty_salon": ("Beauty", ("personal care",)),
    "bakery": ("Food", ("bakery", "pastries")),
    "bar": ("Bar", ("drinks", "nightlife")),
    "gas_station": ("Service", ("automotive",)),
    "bank": ("Finance", ("banking",)),
    "pharmacy": ("Health", ("medical", "pharmacy")),
}
PLACE_TYPE_FALLBACKS = (
    (("restaurant", "food", "meal_takeaway"), ("Restaurant", ("dining",))),
    (("store", "shopping"), ("Retail", ("shopping",))),
)
PLACE_TYPE_DEFAULT = ("Service", ("general",))

LEGACY_PLACE_TYPES = {
    "restaurant": ("Restaurant", ("Dining",)),
    "food": ("Restaurant", ("Food",)),
    "cafe": ("Cafe", ("Coffee",)),
    "store": ("Retail", ("Shopping",)),
    "clothing_store": ("Retail", ("Clothing",)),
    "book_store": ("Retail", ("Books",)),
    "electronics_store": ("Retail", ("Electronics",)),
    "gym": ("Service", ("Fitness",)),
    "spa": ("Service", ("Wellness",)),
    "hair_care": ("Service", ("Beauty",)),
    "dentist": ("Service", ("Healthcare",)),
    "lawyer": ("Service", ("Legal",)),
    "real_estate_agency": ("Service", ("Real Estate",)),
}
LEGACY_PLACE_TYPE_FALLBACKS = (
    (("restaurant", "meal_takeaway", "meal_delivery"), ("Restaurant", ("Food",))),
    (("store", "shopping_mall"), ("Retail", ("Shopping",))),
)
LEGACY_PLACE_TYPE_DEFAULT = ("Service", ("General",))

# -- fixed values: price levels and day names ---------------------------------------------
PRICE_LEVELS = {
    "PRICE_LEVEL_FREE": 1,
    "PRICE_LEVEL_INEXPENSIVE": 1,
    "PRICE_LEVEL_MODERATE": 2,
    "PRICE_LEVEL_EXPENSIVE": 3,
    "PRICE_LEVEL_VERY_EXPENSIVE": 4,
}
SUNDAY_FIRST_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONDAY_FIRST_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# -- fixed values: suffixes cut from a city query before the gazetteer lookup -------------
COUNTRY_SUFFIXES = (
    ", usa", ", us", ", canada", ", uk", ", england", ", france", ", germany", ", japan",
    ", australia",
)

# -- fixed values: gazetteer, (city key, latitude, longitude, label) ----------------------
GAZETTEER = (
    ("new york", 40.7128, -74.0060, "New York, NY, USA"),
    ("los angeles", 34.0522, -118.2437, "Los Angeles, CA, USA"),
    ("chicago", 41.8781, -87.6298, "Chicago, IL, USA"),
    ("houston", 29.7604, -95.3698, "Houston, TX, USA"),
    ("phoenix", 33.4484, -112.0740, "Phoenix, AZ, USA"),
    ("philadelphia", 39.9526, -75.1652, "Philadelphia, PA, USA"),
    ("san antonio", 29.4241, -98.4936, "San Antonio, TX, USA"),
    ("san diego", 32.7157, -117.1611, "San Diego, CA, USA"),
    ("dallas", 32.7767, -96.7970, "Dallas, TX, USA"),
    ("austin", 30.2672, -97.7431, "Austin, TX, USA"),
    ("seattle", 47.6062, -122.3321, "Seattle, WA, USA"),
    ("miami", 25.7617, -80.1918, "Miami, FL, USA"),
    ("atlanta", 33.7490, -84.3880, "Atlanta, GA, USA"),
    ("boston", 42.3601, -71.0589, "Boston, MA, USA"),
    ("denver", 39.7392, -104.9903, "Denver, CO, USA"),
    ("portland", 45.5152, -122.6784, "Portland, OR, USA"),
    ("las vegas", 36.1699, -115.1398, "Las Vegas, NV, USA"),
    ("nashville", 36.1627, -86.7816, "Nashville, TN, USA"),
    ("detroit", 42.3314, -83.0458, "Detroit, MI, USA"),
    ("memphis", 35.1495, -90.0490, "Memphis, TN, USA"),
    ("charlotte", 35.2271, -80.8431, "Charlotte, NC, USA"),
    ("tampa", 27.9506, -82.4572, "Tampa, FL, USA"),
    ("milwaukee", 43.0389, -87.9065, "Milwaukee, WI, USA"),
    ("oklahoma city", 35.4676, -97.5164, "Oklahoma City, OK, USA"),
    ("louisville", 38.2527, -85.7585, "Louisville, KY, USA"),
    ("baltimore", 39.2904, -76.6122, "Baltimore, MD, USA"),
    ("kansas city", 39.0997, -94.5786, "Kansas City, MO, USA"),
    ("virginia beach", 36.8529, -75.9780, "Virginia Beach, VA, USA"),
    ("omaha", 41.2565, -95.9345, "Omaha, NE, USA"),
    ("raleigh", 35.7796, -78.6382, "Raleigh, NC, USA"),
    ("colorado springs", 38.8339, -104.8214, "Colorado Springs, CO, USA"),
    ("tucson", 32.2226, -110.9747, "Tucson, AZ, USA"),
    ("fresno", 36.7378, -119.7871, "Fresno, CA, USA"),
    ("sacramento", 38.5816, -121.4944, "Sacramento, CA, USA"),
    ("mesa", 33.4152, -111.8315, "Mesa, AZ, USA"),
    ("arlington", 32.7357, -97.1081, "Arlington, TX, USA"),
    ("cleveland", 41.4993, -81.6944, "Cleveland, OH, USA"),
    ("minneapolis", 44.9778, -93.2650, "Minneapolis, MN, USA"),
    ("new orleans", 29.9511, -90.0715, "New Orleans, LA, USA"),
    ("pittsburgh", 40.4406, -79.9959, "Pittsburgh, PA, USA"),
    ("salt lake city", 40.7608, -111.8910, "Salt Lake City, UT, USA"),
    ("san francisco", 37.7749, -122.4194, "San Francisco, CA, USA"),
    ("san jose", 37.3382, -121.8863, "San Jose, CA, USA"),
)

# -- fixed values: ordered gazetteer of the older containment lookup ----------------------
LEGACY_GAZETTEER = (
    ("new york", 40.7128, -74.0060, "New York, NY, USA"),
    ("nyc", 40.7128, -74.0060, "New York, NY, USA"),
    ("los angeles", 34.0522, -118.2437, "Los Angeles, CA, USA"),
    ("la", 34.0522, -118.2437, "Los Angeles, CA, USA"),
    ("chicago", 41.8781, -87.6298, "Chicago, IL, USA"),
    ("houston", 29.7604, -95.3698, "Houston, TX, USA"),
    ("phoenix", 33.4484, -112.0740, "Phoenix, AZ, USA"),
    ("philadelphia", 39.9526, -75.1652, "Philadelphia, PA, USA"),
    ("philly", 39.9526, -75.1652, "Philadelphia, PA, USA"),
    ("san antonio", 29.4241, -98.4936, "San Antonio, TX, USA"),
    ("san diego", 32.7157, -117.1611, "San Diego, CA, USA"),
    ("dallas", 32.7767, -96.7970, "Dallas, TX, USA"),
    ("san jose", 37.3382, -121.8863, "San Jose, CA, USA"),
    ("austin", 30.2672, -97.7431, "Austin, TX, USA"),
    ("jacksonville", 30.3322, -81.6557, "Jacksonville, FL, USA"),
    ("san francisco", 37.7749, -122.4194, "San Francisco, CA, USA"),
    ("sf", 37.7749, -122.4194, "San Francisco, CA, USA"),
    ("columbus", 39.9612, -82.9988, "Columbus, OH, USA"),
    ("charlotte", 35.2271, -80.8431, "Charlotte, NC, USA"),
    ("fort worth", 32.7555, -97.3308, "Fort Worth, TX, USA"),
    ("detroit", 42.3314, -83.0458, "Detroit, MI, USA"),
    ("el paso", 31.7619, -106.4850, "El Paso, TX, USA"),
    ("memphis", 35.1495, -90.0490, "Memphis, TN, USA"),
    ("seattle", 47.6062, -122.3321, "Seattle, WA, USA"),
    ("denver", 39.7392, -104.9903, "Denver, CO, USA"),
    ("washington", 38.9072, -77.0369, "Washington, DC, USA"),
    ("dc", 38.9072, -77.0369, "Washington, DC, USA"),
    ("boston", 42.3601, -71.0589, "Boston, MA, USA"),
    ("nashville", 36.1627, -86.7816, "Nashville, TN, USA"),
    ("baltimore", 39.2904, -76.6122, "Baltimore, MD, USA"),
    ("oklahoma city", 35.4676, -97.5164, "Oklahoma City, OK, USA"),
    ("portland", 45.5152, -122.6784, "Portland, OR, USA"),
    ("las vegas", 36.1699, -115.1398, "Las Vegas, NV, USA"),
    ("milwaukee", 43.0389, -87.9065, "Milwaukee, WI, USA"),
    ("albuquerque", 35.0844, -106.6504, "Albuquerque, NM, USA"),
    ("tucson", 32.2226, -110.9747, "Tucson, AZ, USA"),
    ("fresno", 36.7378, -119.7871, "Fresno, CA, USA"),
    ("sacramento", 38.5816, -121.4944, "Sacramento, CA, USA"),
    ("kansas city", 39.0997, -94.5786, "Kansas City, MO, USA"),
    ("mesa", 33.4152, -111.8315, "Mesa, AZ, USA"),
    ("atlanta", 33.7490, -84.3880, "Atlanta, GA, USA"),
    ("colorado springs", 38.8339, -104.8214, "Colorado Springs, CO, USA"),
    ("omaha", 41.2565, -95.9345, "Omaha, NE, USA"),
    ("raleigh", 35.7796, -78.6382, "Raleigh, NC, USA"),
    ("miami", 25.7617, -80.1918, "Miami, FL, USA"),
    ("cleveland", 41.4993, -81.6944, "Cleveland, OH, USA"),
    ("tulsa", 36.1540, -95.9928, "Tulsa, OK, USA"),
    ("oakland", 37.8044, -122.2712, "Oakland, CA, USA"),
    ("minneapolis", 44.9778, -93.2650, "Minneapolis, MN, USA"),
    ("wichita", 37.6872, -97.3301, "Wichita, KS, USA"),
    ("arlington", 32.7357, -97.1081, "Arlington, TX, USA"),
)

# -- fixed values: performance segments -----------------------------------------------------
SEGMENTS = (
    "Market Leaders", "Rising Stars", "Established Players", "Growth Opportunities", "New Entries",
)
EARTH_RADIUS_M = 6378100.0
