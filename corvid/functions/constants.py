"""Fixed values that results depend on."""

# Text chunks.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
CODE_CHUNK_SIZE, CODE_CHUNK_OVERLAP = 1000, 100

# Retrieval.
TOP_K = 5
RELEVANCE_GATE = 1.8
HYBRID_ALPHA = 0.5
KEYWORD_BOOST = 2.0
PHRASE_BONUS = 0.5
SUPPORT_THRESHOLD = 0.7
TFIDF_FEATURES = 10_000

# Greetings, at most three words.
GREETINGS = ("hello", "hi", "hey", "good morning", "good afternoon", "good evening", "greetings")

# Synonyms by term, in order of application.
SYNONYMS = (
    ("capital", ("city", "center", "headquarters")),
    ("france", ("french", "paris")),
    ("ai", ("artificial intelligence", "machine learning")),
    ("rag", ("retrieval augmented generation", "retrieval generation")),
    ("how", ("what", "explain", "describe")),
    ("what", ("how", "explain", "describe")),
    ("when", ("date", "time", "year")),
)

# Conjunctions that part a question, in order.
CONJUNCTIONS = ("and", "or", "but", "however", "also")

# Words that are no keywords.
STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might can what when where why how which who whom whose".split()
)

# Patterns that tell Python code.
CODE_PATTERNS = (
    r"def\s+\w+\s*\(",
    r"class\s+\w+",
    r"import\s+",
    r"from\s+\w+\s+import",
    r"if\s+__name__\s*==\s*['\"]__main__['\"]",
    r"return\s+",
    r"print\s*\(",
    r"for\s+\w+\s+in\s+",
    r"while\s+",
    r"try:",
    r"except\s+",
    r"finally:",
)

# Human scores.
HUMAN_FIELDS = ("relevance", "accuracy", "completeness", "fluency", "overall")
