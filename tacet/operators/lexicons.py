"""Word lists of the classification rules, matched as parts of normalised text."""

HAZARD = [
    "glof", "glacial lake", "outburst", "flood", "inundat", "submerg", "landslide", "debris flow", "debris", "surge",
    "breach", "burst", "water level", "discharge", "swollen", "overflow", "siren", "warning", "alert", "evacuat",
    "upstream", "downstream", "moraine", "dam", "river rose", "rising river", "cloudburst", "washed away", "swept away",
]
STRONG = [
    "reached", "contacted", "casualt", "injur", "dead", "death", "missing", "rescue", "relief", "shelter", "displaced",
    "damaged", "destroyed", "swept", "washed away", "cut off", "households", "houses", "homes", "search team",
    "helicopter", "security personnel", "health post", "no casualties", "road blocked", "distributed",
]
WEAK = ["residents", "villagers", "families", "bridge", "ward", "confirmed", "police post", "local unit"]
WARNING = [
    "warned", "warning", "alert", "advisory", "forecast", "siren", "issued", "expected to", "may rise", "could rise",
    "on standby", "preparedness",
]
NEGATIVE = [
    "no contact", "not been reached", "yet to be reached", "unreachable", "unaccounted", "no word", "no communication",
    "cannot be reached", "could not be reached", "lost contact", "no information", "still silent", "no response",
]
NOISE = [
    "trekking season", "tourist arrival", "cricket", "election", "stock market", "share market", "film", "cinema",
    "festival lineup", "transfer window", "cabinet reshuffle", "horoscope", "recipe", "gold price", "hotel booking",
    "visit nepal campaign", "match fixture",
]
FEATURES = ["river", "khola", "nadi", "valley", "corridor", "basin", "catchment", "watershed", "gorge", "district"]
EVENTS = [
    "trishuli", "glof", "glacial lake", "outburst", "flood", "inundat", "bagmati province", "nuwakot", "rasuwa", "dhading",
    "landslide", "swept away", "washed away", "displaced",
]
#: Words behind or before a capitalised name that mark it as a place.
PLACE_AFTER = ["village", "bazar", "bazaar", "gaun", "gaon", "tole", "hamlet", "settlement", "basti", "VDC", "ward"]
PLACE_BEFORE = ["village", "settlement", "hamlet", "ward"]
