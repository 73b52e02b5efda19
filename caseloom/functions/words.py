"""Fixed word lists and patterns used by the text functions."""

# The public 179-word English stopword list of the NLTK corpus.
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)

# Negations that must survive stopword removal.
NEGATIONS = ("not", "no", "nor", "never", "none", "neither", "without")

STOPWORDS_KEEPING_NEGATION = tuple(w for w in STOPWORDS if w not in NEGATIONS)

# The transcription codes that carry no content.
CODES = r"\bTL\*|\*TR\b|\*[A-Z]{2}\b"

# Characters Python's str.strip and str.split treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# English contractions, irregular ones first. Pattern groups are
# written $1; patterns are lower case and match whole words.
CONTRACTIONS = (
    (r"\b(w)on't\b", "$1ill not"),
    (r"\b(ca)n't\b", "$1nnot"),
    (r"\b(sha)n't\b", "$1ll not"),
    (r"\b(a)in't\b", "$1re not"),
    (r"\b(let)'s\b", "$1 us"),
    (r"\b(y)'all\b", "$1ou all"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'ve\b", " have"),
    (r"'ll\b", " will"),
    (r"\b(i)'m\b", "$1 am"),
    (r"\b(it|he|she|that|what|where|there|here|who|how|when|why)'s\b", "$1 is"),
    (r"\b(what|where|how|why|when)'d\b", "$1 did"),
    (r"\b(i|you|he|she|it|we|they|that|there|who)'d\b", "$1 would"),
)

# Noun endings and what replaces them, for dictionary-checked lemmas.
NOUN_ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)
