"""Fixed values that results depend on.

Everything here must stay exactly as written: the regular expressions give the
same matches as Python's ``re`` on str input, the label maps and stop words are
the ones the analysed experiments use.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: characters
# ---------------------------------------------------------------------------

# ASCII punctuation, the 32 characters of Python's ``string.punctuation``:
# !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The 29 characters Python's str.split() / re \s treat as whitespace, written
# as a regex class body usable by both Java regex (Spark) and RE2 (DuckDB).
WS_CLASS_BODY = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_CLASS_BODY + "]"
# the same set as characters, derived by rule (str.isspace over all code points)
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
NOT_WS = "[^" + WS_CLASS_BODY + "]"

# Python's \w on str: letters, numbers (any category N) and underscore.
WORD_CHAR = r"[\p{L}\p{N}_]"

# ---------------------------------------------------------------------------
# FIXED VALUES: cleaning steps, in the order they are applied
# ---------------------------------------------------------------------------
# lower()                      -> F.lower
RE_BRACKETS = r"\[[^\n]*?\]"                      # text in square brackets, within a line
RE_URL = r"https?://" + NOT_WS + r"+|www\." + NOT_WS + r"+"
RE_TAGS = r"<[^\n]*?>+"                           # '<...>' followed by any extra '>'
RE_PUNCT = r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]"
RE_NEWLINE = r"\n"
RE_DIGIT_WORD = WORD_CHAR + r"*\p{Nd}" + WORD_CHAR + "*"
# Same matches as RE_DIGIT_WORD (a match can only start at a word start), but
# the look-behind stops Java from retrying inside every word: linear time on
# long texts.  RE2 (DuckDB) has no look-behind, so the oracle uses the plain one.
RE_DIGIT_WORD_FAST = r"(?<![\p{L}\p{N}_])" + RE_DIGIT_WORD

# sklearn's default token pattern \b\w\w+\b on str input
RE_SKLEARN_TOKEN = WORD_CHAR + "{2,}"

# a word of a word cloud: word characters, apostrophes inside
RE_CLOUD_WORD = WORD_CHAR + "(?:" + WORD_CHAR + "|')*"

# Keras Tokenizer default filter: these characters become spaces (the
# apostrophe is kept), then text is lower-cased and split on ' '.
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# ---------------------------------------------------------------------------
# FIXED VALUES: domain words of the analysed experiments
# ---------------------------------------------------------------------------

# domain words appended to the base stop-word list
STOPWORD_EXTRAS = ["username", "url", "ya", "yg"]
STOPWORD_EXTRAS_AUG = ["[USERNAME]", "url"]

# ---------------------------------------------------------------------------
# FIXED VALUES: test bindings (documents.lang plays the label)
# ---------------------------------------------------------------------------
# a 20-word stop-word list used by tests and registered queries: frequent
# words of the four test languages plus the four domain extras
TEST_STOPWORDS = [
    "the", "and", "of", "is", "le", "la", "de", "et", "der", "die",
    "und", "das", "el", "los", "y", "en", "username", "url", "ya", "yg",
]
# lang -> index; 'es' deliberately left out so unknown labels are exercised
TEST_LANG_LABELS = {"en": 0, "fr": 1, "de": 2}
# complete map for strict loading (every test language known)
TEST_LANG_LABELS_ALL = {"en": 0, "fr": 1, "de": 2, "es": 3}

# ---------------------------------------------------------------------------
# FIXED VALUES: base-model detection from a checkpoint file name (rule order
# matters: the first key found in the lower-cased name wins)
# ---------------------------------------------------------------------------
BASE_MODEL_RULES = [
    ("tweet", "indolem/indobertweet-base-uncased"),
    ("base", "indobenchmark/indobert-base-p1"),
]
BASE_MODEL_DEFAULT = "indobenchmark/indobert-base-p1"
