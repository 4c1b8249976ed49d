"""Fixed values.

Word lists, labels, thresholds and defaults that results depend on. They are
data, not logic: changing one changes what a score or a match means.
"""

# --- Loaded ("bias") terms, default list (89) -------------------------------
DEFAULT_BIAS_TERMS = (
    "alarming", "allegations", "unfit", "aggressive", "alleged", "apparently",
    "arguably", "claims", "controversial", "disputed", "insists",
    "questionable", "reportedly", "rumored", "suggests", "supposedly",
    "unconfirmed", "suspected", "reckless", "radical", "extremist", "biased",
    "manipulative", "deceptive", "unbelievable", "incredible", "shocking",
    "outrageous", "bizarre", "absurd", "ridiculous", "disgraceful",
    "disgusting", "horrible", "terrible", "unacceptable", "unfair",
    "scandalous", "suspicious", "illegal", "illegitimate", "immoral",
    "corrupt", "criminal", "dangerous", "threatening", "harmful", "menacing",
    "disturbing", "distressing", "troubling", "fearful", "afraid", "panic",
    "terror", "catastrophe", "disaster", "chaos", "crisis", "collapse",
    "failure", "ruin", "devastation", "suffering", "misery", "pain",
    "dreadful", "awful", "nasty", "vile", "vicious", "brutal", "violent",
    "greedy", "selfish", "arrogant", "ignorant", "stupid", "unwise",
    "illogical", "unreasonable", "delusional", "paranoid", "obsessed",
    "fanatical", "zealous", "militant", "dictator", "regime",
)

# --- The extended list puts these 17 in front of the default list ------------
EXTRA_BIAS_TERMS = (
    "always", "never", "obviously", "clearly", "undoubtedly",
    "unquestionably", "everyone knows", "no one believes", "definitely",
    "certainly", "extremely", "inconceivable", "must", "prove", "disprove",
    "true", "false",
)
EXTENDED_BIAS_TERMS = EXTRA_BIAS_TERMS + DEFAULT_BIAS_TERMS

# --- Technique names (22) ----------------------------------------------------
DEFAULT_TECHNIQUES = (
    "Appeal to Authority", "Appeals to Emotion", "Bandwagon",
    "Emotional Language", "Exaggeration", "False Dichotomies", "Fear Appeals",
    "Glittering Generalities", "Loaded Language", "Logical Fallacies",
    "Misleading Statistics", "Name-calling", "Omission of Facts",
    "One-sided Arguments", "Plain Folks Appeal", "Repetitive Phrasing",
    "Scapegoating", "Sensationalism", "Stereotyping", "Testimonials",
    "Transfer", "Unverified Claims",
)
EXCLUDED_TECHNIQUE = "repetitive phrasing"

# --- Sentence labels and score rules -----------------------------------------
STAR_LABELS = ("1 star", "2 stars", "3 stars", "4 stars", "5 stars")
NEUTRAL_STARS = 3
POSITIVE_FROM = 3.5
NEGATIVE_UP_TO = 2.5
SENTIMENT_COLORS = {"Positive": "#28a745", "Negative": "#dc3545"}
OTHER_SENTIMENT_COLOR = "#6c757d"
PROPAGANDA_LABEL = "propaganda"
PROPAGANDA_THRESHOLD = 0.9
MAX_PENALTY = 50.0

# --- Mini-batch sizes of the sentence scorers --------------------------------
STAR_BATCH = 4
PROPAGANDA_BATCH = 8

# --- Comparison and feature limits -------------------------------------------
COMPARE_MIN, COMPARE_MAX = 2, 5
MAX_FEATURES = 5000
SVM_ITERATIONS = 10000
DEFAULT_TOPICS = 5

# --- Record defaults ---------------------------------------------------------
DEFAULT_TITLE = "Article"
DEFAULT_OWNER = "guest"
UNKNOWN = "Unknown"
HISTORY_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
DISPLAY_DEFAULTS = {
    "title": "Untitled Article",
    "date": "N/A",
    "email": "guest",
    "sentiment_label": "Neutral",
    "sentiment_score": 3.0,
    "bias_score": 0,
    "propaganda_score": 0,
    "final_score": 0.0,
}
EXPORT_TITLE = "Untitled"
EXPORT_FILE_TITLE = "untitled"

# --- English stop words (181), fixed values --------------------------------------
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
)

# Folders of the history table; fixed once a table exists.
OWNER_BUCKETS = 64

# --- Report wording ----------------------------------------------------------
REPORT_TITLE = "Corpus annotation at a glance"
NO_TOPICS_TEXT = "The corpus has no topics."
