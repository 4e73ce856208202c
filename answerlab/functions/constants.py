"""Fixed values that must equal the task definition for results to match.

Everything here is data (label names, their order, fixed phrases and
patterns); the logic that uses them lives in the operator modules.
"""

# --- fixed values: nine fine labels in task order, with their coarse class ---
TAXONOMY = [
    ("Explicit", "Clear Reply"),
    ("Implicit", "Ambivalent"),
    ("General", "Ambivalent"),
    ("Partial/half-answer", "Ambivalent"),
    ("Dodging", "Ambivalent"),
    ("Deflection", "Ambivalent"),
    ("Declining to answer", "Clear Non-Reply"),
    ("Claims ignorance", "Clear Non-Reply"),
    ("Clarification", "Clear Non-Reply"),
]
FINE_LABELS = [fine for fine, _ in TAXONOMY]
# --- fixed values: the three coarse labels in task order ---
COARSE_LABELS = ["Clear Reply", "Ambivalent", "Clear Non-Reply"]
# --- fixed values: annotator vote columns, in tie-break order ---
ANNOTATORS = ["annotator1", "annotator2", "annotator3"]
# --- fixed values: strings that count as "no vote" after stripping ---
NO_VOTE = ["", "None"]

# --- fixed values: the nine fine labels in the order in which a single direct reply is searched for them ---
DIRECT_LABEL_ORDER = ["Explicit", "Declining to answer", "Claims ignorance", "Clarification", "Dodging", "Deflection",
                      "General", "Implicit", "Partial/half-answer"]

PARSE_ERROR = "PARSE_ERROR"
IGNORE_ID = -100

# --- fixed values: reply shortcuts (substring -> label), checked in this order ---
REPLY_SHORTCUTS = [
    ("non-reply", "Clear Non-Reply"),
    ("non reply", "Clear Non-Reply"),
    ("clear non reply", "Clear Non-Reply"),
    ("clear reply", "Clear Reply"),
    ("decline", "Declining to answer"),
    ("declining", "Declining to answer"),
    ("ignorance", "Claims ignorance"),
    ("claims", "Claims ignorance"),
    ("partial", "Partial/half-answer"),
    ("half-answer", "Partial/half-answer"),
]

# --- fixed values: question-type rules, first match wins (type, prefix regex,
# expected length, hint) ---
QUESTION_TYPES = [
    ("yes_no", r"^(will you|would you|are you|do you|did you|have you|can you|could you|is it|was it)",
     "short",
     "This is a YES/NO question. A genuine reply should be concise and direct. "
     "A long answer that never says yes or no is likely evasive."),
    ("factual", r"^(what (is|was|are|were)|which|name|list)",
     "short_to_medium",
     "This is a FACTUAL question expecting a specific piece of information. "
     "A vague or general answer likely fails to provide what was asked."),
    ("why", r"^(why|how come|what (made|caused|led))",
     "medium",
     "This is a WHY question. A genuine reply should explain a reason or cause. "
     "An answer that describes consequences without stating the reason is evasive."),
    ("when", r"^(when|what (date|time|year|month))",
     "very_short",
     "This is a WHEN question expecting a time reference. "
     "Any answer without a date, timeframe, or temporal reference is evasive."),
    ("who", r"^(who|whom)",
     "short",
     "This is a WHO question expecting a person or group to be named. "
     "An answer that discusses actions without naming anyone is evasive."),
    ("quantitative", r"^(how (many|much|often|long))",
     "short",
     "This is a QUANTITATIVE question expecting a number or measurable answer. "
     "A qualitative answer without any figure is likely evasive."),
    ("opinion", r"^(do you think|what do you think|what is your|how do you feel|would you say)",
     "medium",
     "This is an OPINION question. The politician is expected to take a position. "
     "An answer that discusses the topic without taking any stance is evasive."),
]
QUESTION_TYPE_DEFAULT = (
    "open", "medium",
    "Evaluate whether the answer provides the specific information the question is asking for, "
    "regardless of its length.",
)

# --- fixed values: words that open a sub-question ---
STARTER_WORDS = ["do", "does", "did", "is", "are", "was", "were", "can", "could", "will",
                 "would", "should", "how", "why", "what", "when", "where", "if"]

# --- fixed values: prompt fragments ---
CONTEXT_HEADER = "BACKGROUND CONTEXT (from Wikipedia):"
RULE_SPLIT_MARK = "__RULE_BASED_SPLIT__"
SHORT_SPLIT_MARK = "__SKIPPED_SHORT_QUESTION__"

# --- fixed values: candidate tones for the lexicon labeller, tie order ---
TONES = ["Assertive", "Guarded", "Dismissive"]
