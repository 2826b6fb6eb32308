"""Fixed word lists. All are data, and every function takes its list as a parameter."""

# Alcohol keywords of the batch scoring job (lower-cased text).
# Entries of more than one word are listed but can never equal a single token.
ALCOHOL_TERMS = (
    "drink drinker drinks drinking drank wine champgne alcohol alcoholics alcoholism beer beers bottle bottles "
    "pint pints cocktail cocktails bar brewery lounge pub liquor booze vodka tequila gin ciroc margarita margaritas "
    "ale whiskey lager tipsy drunk sober wasted pregame pregaming"
).split()
ALCOHOL_BRANDS = [
    "johnnie walker", "smirnoff", "hennessy", "jack daniel's", "bacardi", "absolut", "captain morgan",
    "chivas regal", "grey goose", "crown royal", "ballantine's", "baileys", "jagermeister",
]
ALCOHOL_KEYWORDS = ALCOHOL_TERMS + ALCOHOL_BRANDS

# Keywords of the label sampling job, matched case-sensitively.
# The variant for the cluster job leaves out "shot shots".
SAMPLING_KEYWORDS = ALCOHOL_TERMS + ["shot", "shots"]
SAMPLING_KEYWORDS_SHORT = ALCOHOL_TERMS

# Water-pipe terms, matched as substrings of lower-cased text.
SHISHA_TERMS = [
    "hooka", "hookas", "hookah", "shisha", "shishas", "sheesha", "sheeshas", "waterpipe", "waterpipes",
    "water pipes", "narghile", "narghiles", "arghileh", "arghilehs", "hubble bubble", "hubblebubble",
    "hubbles bubble", "hubbles bubbles", "hubble bubbles",
]

# Placeholders added to every stop-word list.
STOP_PLACEHOLDERS = ["AT_USER", "URL"]
