"""Word lists, ladders and patterns that results depend on."""

# Text markers.
POLITE_MARKERS = (
    "please", "thank you", "thanks", "appreciate", "kindly",
    "would you mind", "if you could", "i was wondering", "sorry to bother",
)
HEDGE_MARKERS = (
    "maybe", "perhaps", "possibly", "might", "could be", "seems",
    "i think", "i guess", "kind of", "sort of", "probably", "likely",
)
MODALS = ("will", "would", "should", "must", "could", "may", "might", "can", "shall")
IMPERATIVES = (
    "send", "review", "check", "submit", "complete", "approve", "sign",
    "call", "respond", "reply", "forward", "attach", "include", "remove",
    "update", "fix", "schedule", "confirm", "verify", "prepare", "make",
    "do", "go", "stop", "start", "see", "let", "give", "tell", "ask",
)
FIRST_PERSON = ("I", "me", "my", "mine", "we", "us", "our", "ours")
SECOND_PERSON = ("you", "your", "yours")
MISSING_NAMES = ("", "nan", "none", "null")

# Closed vocabularies of the signal stage.
SPEECH_ACTS = ("request", "commit", "deliver", "propose", "amend", "meeting", "refuse", "accept")
AUTHORITY_ORDER = {"passive": 0, "collaborative": 1, "consultative": 2, "delegating": 3, "directive": 4}

# Hierarchy ordinals (5 is skipped in the canonical tiers).
LEVELS = {
    "C-Suite": 6, "Vice Chairman": 5, "SVP": 4, "VP": 3,
    "Director": 2, "Manager": 1, "Employee": 0, "Assistant": 0,
}
TIERS = {"Employee": 0, "Manager": 1, "Director": 2, "VP": 3, "SVP": 4, "C-Suite": 6}
TITLE_TIERS = {
    "CEO": "C-Suite", "President": "C-Suite", "Managing Director": "SVP", "Vice President": "VP",
    "Director": "Director", "Manager": "Manager", "In House Lawyer": "Manager",
    "Trader": "Employee", "Employee": "Employee",
}

# Markers of forwarded mail.
FORWARD_MARKERS = (
    "----- Forwarded by", "-----Forwarded by", "----- Original Message", "-----Original Message",
)
FORWARD_LINE = r"(?i)-{3,}\s*forwarded\s*by\s|---{2,}\s*original\s+message"

# Nickname -> formal given names.
NICKNAMES = {
    "bill": ["william"], "bob": ["robert"], "dick": ["richard"], "dan": ["daniel"], "dave": ["david"],
    "doug": ["douglas"], "ed": ["edward", "edgar", "edmund"], "geoff": ["geoffrey", "geoffery"],
    "jim": ["james"], "joe": ["joseph"], "larry": ["lawrence"],
    "jeff": ["jeffrey", "jeffery", "geoffrey"], "mike": ["michael"], "pat": ["patrick", "patricia"],
    "rick": ["richard"], "rob": ["robert"], "ron": ["ronald"], "sam": ["samuel"],
    "steve": ["steven", "stephen"], "sue": ["susan"], "ted": ["theodore", "edward"], "tom": ["thomas"],
    "tony": ["anthony"], "vince": ["vincent"], "will": ["william"],
    "chris": ["christopher", "christine", "christina"], "greg": ["gregory"], "matt": ["matthew"],
    "phil": ["philip", "phillip"], "liz": ["elizabeth"], "kay": ["katherine", "kathryn"],
    "danny": ["daniel"], "barry": ["barrymore", "barnard"], "scott": ["scott"], "louise": ["louise"],
    "sara": ["sarah", "sara"], "tana": ["tana"], "tracy": ["tracy"], "gerald": ["gerald"],
}

# Role ladder, most senior first; (tier, substrings, patterns).
EXECUTIVE_WORDS = (
    "ceo", "cfo", "coo", "cro", "cao",
    "chief executive officer", "chief financial officer", "chief operating officer",
    "chief risk officer", "chief accounting officer",
    "chairman", "chairwoman", "chairperson", "vice chairman", "vice-chairman",
)
SENIOR_VP_WORDS = (
    "senior vice president", "sr vice president", "sr. vice president", "executive vice president",
    "executive vp", "exec vp", "managing director",
)
MANAGER_WORDS = (
    "manager", "mgr", "head of", "team lead", "team leader", "in house lawyer", "in-house lawyer",
    "senior counsel", "sr. counsel", "sr counsel",
)
EMPLOYEE_WORDS = (
    "analyst", "trader", "specialist", "associate", "assistant",
    "coordinator", "consultant", "engineer", "scheduler", "controller",
)

# Phrase patterns of the question matcher.
PROPER_NOUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
TITLED_NAME = r"\b((?:Mr|Mrs|Ms|Dr)\.\s+[A-Z][a-z]+)\b"
STYLIZED = r"\b(\d+[A-Z]\b|[A-Z][A-Za-z0-9]*[&\d][A-Za-z0-9&]*)\b"
ACRONYM = r"\b([A-Z]{3,})\b"
MONTH_DAY = (
    r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2})\b"
)
WEEKDAY = r"\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b"
TRIGGER_NAME = r"\b(?:by|for|from|to)\s+([A-Z][a-z]{2,})\b"
SENDER_HINT = (
    r"\b(?:from|by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)|\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:'s)?\s+email"
)
PHRASE_STOPWORDS = (
    "The", "On", "This", "For", "In", "At", "An", "A", "Of", "To", "By", "Be", "It", "Is", "And", "Or",
    "But", "As", "With", "From", "That", "Are", "Was", "Has", "Had", "Not", "Can", "Its", "Our",
    "Their", "There", "These", "Those", "Have",
)

# Question and title classes.
WHO_QUESTION = r"(?i)\bwho\b"
WHEN_QUESTION = r"(?i)\b(when|date|in\s+\d{4}|around\s+\w+\s+\d{4})\b"
EXECUTIVE_TITLE = (
    r"(?i)\bCEO\b|\bCOO\b|\bCFO\b|(?<!Vice\s)\bPresident\b|\bVice\s+Chairman\b|\bChairman\b"
    r"|\bChief\s+\w+\s+Officer\b"
)
MANAGER_TITLE = r"(?i)\bSVP\b|\bVP\b|\bVice\s+President\b|\bDirector\b|\bManager\b"

# Pass-rate thresholds per question category.
PASS_THRESHOLDS = {
    "joint": 0.65, "hierarchy": 0.80, "dominance": 0.60, "topics": 0.50,
    "dyadic": 0.50, "identity": 0.65, "escape": 0.50,
}

# Cumulative feature ladder and sweep grids.
LADDER = {
    "A0": ["pagerank", "betweenness", "in_degree", "response_time", "cc_frequency"],
    "A1": ["is_thread_initiator_rate", "mean_to_count", "pct_off_hours", "mean_body_words"],
    "A2": ["pct_request_sent", "pct_commit_sent", "pct_decision_carrying", "pct_action_required"],
    "A3": ["request_commit_ratio", "length_asymmetry", "mean_reply_latency_h"],
    "A4": ["project_one_hot", "topic_embedding"],
    "A5": ["seniority_narrative_numeric", "authority_style_one_hot"],
}
SWEEP_GRID = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
