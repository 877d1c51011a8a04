"""Fixed values.

The values in this module must equal the ones used by the published bias
analysis for results to be comparable: the nine identity groups, the
thresholds, the word lists used to build the "pleasant" and "unpleasant"
directions and the final-metric parameters.  They are stated plainly, in
their natural order.
"""

# --- fixed values: identity groups (order as published) -------------------
GROUPS = [
    "black",
    "christian",
    "female",
    "homosexual_gay_or_lesbian",
    "jewish",
    "male",
    "muslim",
    "psychiatric_or_mental_illness",
    "white",
]

# --- fixed values: identity words used by word probes (10 words) ----------
IDENTITY_WORDS = [
    "black",
    "christian",
    "female",
    "homosexual",
    "gay",
    "lesbian",
    "jewish",
    "male",
    "muslim",
    "white",
]

# --- fixed values: keyword lists for the text-search profile ---------------
# The composite group is searched by three words; the psychiatric group is
# not searched by keyword.
COMPOSITE_GROUP = "homosexual_gay_or_lesbian"
COMPOSITE_KEYWORDS = ["homosexual", "gay", "lesbian"]
KEYWORD_SKIPPED_GROUP = "psychiatric_or_mental_illness"

# --- fixed values: direction word lists -----------------------------------
PLEASANT_WORDS = [
    "freedom", "health", "peace", "cheer", "gentle", "gift", "honor",
    "miracle", "sunrise", "christian",
]
UNPLEASANT_WORDS = [
    "honest", "filth", "poison", "stink", "ugly", "evil", "kill", "rotten",
    "vomit", "negative", "bad",
]

# --- fixed values: thresholds and metric parameters -----------------------
THRESHOLD = 0.5            # membership, toxicity and positive prediction: > 0.5
POWER = -5.0               # generalised power mean exponent
OVERALL_MODEL_WEIGHT = 0.25
SPLIT_SEED = 666
TEST_FRACTION = 0.3
RESIDUAL_NONTOXIC_KEEP = 0.6
VOCAB_SIZE = 10000

# Debias search parameters (toxicity gate variant, 20 draws x 10 tries).
SEARCH_DRAWS = 200
SEARCH_HIGH = 0.9          # base probability above which a word is "very toxic"
SEARCH_LOW = 0.1           # base probability below which a word is "very non toxic"
SEARCH_TOXIC_BAND = (0.5, 0.9)     # accepted p for toxic words: (lo, hi]
SEARCH_NONTOXIC_BAND = (0.0, 0.3)  # accepted p for non-toxic words: [lo, hi]
SEARCH_MIN_COS = 0.8
# Narrow variant (500 draws): toxic band (0.6, 0.8), non-toxic band (1e-5, 0.3]
NARROW_DRAWS = 500
NARROW_TOXIC_BAND = (0.6, 0.8)
NARROW_NONTOXIC_BAND = (1e-5, 0.3)
# Identity-similarity gate thresholds used in the published runs.
SIMILARITY_THRESHOLDS = (0.85, 0.70, 0.80)

WEIGHT_COLUMNS = ["add_pleasent", "sub_unpleasent", "sub_pleasent", "add_unpleasent"]
