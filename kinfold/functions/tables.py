"""Word tables of business names and addresses."""

# Results depend on these exact entries.
LEGAL_WORDS = [
    "private", "pvt", "pvt.", "limited", "ltd", "llp", "llc", "inc", "incorporated",
    "corp", "corporation", "co", "company", "plc", "lp", "pllc", "pc",
    "com", "www", "net", "org",
    "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "cie",
]

# Fixed values.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pkwy": "parkway", "hwy": "highway", "pl": "place", "sq": "square", "cir": "circle",
    "ter": "terrace", "trl": "trail", "fwy": "freeway", "expy": "expressway",
    "n": "north", "s": "south", "e": "east", "w": "west",
    "nr": "near", "opp": "opposite", "bldg": "building", "flr": "floor", "fl": "floor",
    "ste": "suite", "apt": "apartment", "appartments": "apartments",
    "bengaluru": "bangalore", "calicut": "kozhikode",
}

# Fixed values.
ADDRESS_FILLER = [
    "unit", "no", "number", "suite", "apartment", "flat", "shop", "plot",
    "h", "hno", "house", "k", "kh", "null", "the", "of",
]

# States of one word, US then India.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca",
    "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi",
    "wyoming": "wy",
    "maharashtra": "mh", "karnataka": "ka", "telangana": "tg", "ts": "tg", "gujarat": "gj",
    "kerala": "kl", "rajasthan": "rj", "delhi": "dl", "haryana": "hr", "punjab": "pb",
    "bihar": "br", "odisha": "od", "orissa": "od", "assam": "as", "goa": "goa",
    "jharkhand": "jh", "uttarakhand": "uk", "chhattisgarh": "cg",
}

# Phrases of several words, applied in this order.
PHRASES = [
    ("new york", "ny"), ("new jersey", "nj"), ("new mexico", "nm"),
    ("new hampshire", "nh"), ("north carolina", "nc"), ("south carolina", "sc"),
    ("north dakota", "nd"), ("south dakota", "sd"), ("rhode island", "ri"),
    ("west virginia", "wv"), ("andhra pradesh", "ap"), ("uttar pradesh", "up"),
    ("madhya pradesh", "mp"), ("tamil nadu", "tn"), ("west bengal", "wb"),
    ("himachal pradesh", "hp"), ("new delhi", "delhi"),
]

# Patterns.
ALIAS = r"\b[fad]\s*/?\s*[kb]\s*/?\s*a\b"
ORDINAL = r"^\d+(st|nd|rd|th|er|e|eme)$"
LEET_FROM, LEET_TO = "01345", "oieas"

#: Transliteration by Unicode names: what the names of letters don't say themselves.
INDIAN_SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
INDIAN_SIGNS = {"ANUSVARA": "n", "CANDRABINDU": "n", "BINDI": "n", "VISARGA": "h", "TIPPI": "n"}
CYRILLIC_VOWELS = {"a": "a", "ie": "e", "io": "yo", "i": "i", "short i": "y", "o": "o", "u": "u", "yeru": "y", "e": "e", "yu": "yu", "ya": "ya", "yi": "yi", "ukrainian ie": "ye", "byelorussian-ukrainian i": "i"}
GREEK_LETTERS = {"theta": "th", "phi": "ph", "chi": "ch", "psi": "ps", "xi": "x", "eta": "i", "upsilon": "y"}
