"""Fixed values. Word lists are small and stated in full; larger ones (a complete
stop-word list, a lemma dictionary) and names of people or shows are passed in by
the caller as a table or list."""

OFFENSE = "OFFENSE"
OTHER = "OTHER"
COARSE_LABELS = ("OFFENSE", "OTHER")
FINE_LABELS = ("ABUSE", "INSULT", "OTHER", "PROFANITY")

# 97.5 % quantile of the standard normal distribution.
Z_975 = 1.959963984540054

GERMAN_STOPWORDS = (
    "aber", "als", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "da", "das", "dass",
    "dem", "den", "der", "des", "die", "du", "durch", "ein", "eine", "einem", "einen", "einer",
    "er", "es", "für", "haben", "hat", "ich", "ihr", "im", "in", "ist", "ja", "man", "mit",
    "nach", "nicht", "noch", "nur", "oder", "sein", "sich", "sie", "sind", "so", "über", "um",
    "und", "uns", "vom", "von", "vor", "war", "was", "wenn", "werden", "wie", "wir", "wird",
    "zu", "zum", "zur",
)

# Spoken filler words removed from subtitles on top of the stop list.
SUBTITLE_FILLERS = (
    "musik", "einfach", "sagen", "sehen", "geben", "nämlich", "eigentlich", "wichtig",
    "politik", "fragen", "sozusagen", "sicht", "damen", "herren", "glauben", "finden",
    "interessant", "leute", "schweiz", "",
)

# Link fragments and salutations removed from comments on top of the stop list.
COMMENT_FILLERS = ("www.youtube.com", "https", "youtu.be", "watch", "herr")

# Tokens that disqualify a bigram.
BIGRAM_FILLERS = ("youtu.be", "https", "www.youtube.com", "vimeo.com", "herr", "NA")

# Bigrams marked in the report.
BIGRAM_WATCHLIST = ("bill gates", "great reset", "klaus schwab", "deep state")

EMOTICONS = (
    ":'-(", ":'-)", ">:-(", ":'(", ":')", ">:(", ":-)", ":-(", ":-D", ":-P", ":-p", ":-/",
    ":-|", ":-*", ":-O", ":-o", ";-)", ";-D", ";-P", "8-)", "B-)", "=-)", ":)", ":(", ":D",
    ":P", ":p", ":/", ":|", ":*", ":O", ";)", ";D", ";P", "=)", "=(", "=D", "<3", "^^",
)
