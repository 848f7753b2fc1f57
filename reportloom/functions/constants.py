"""Fixed values the results depend on."""

# The standard report categories.
STANDARD_CATEGORIES = [
    "Accident at Work and Health and Safety related deaths",
    "Alcohol drug and medication related deaths",
    "Care Home Health related deaths",
    "Child Death from 2015",
    "Community health care and emergency services related deaths",
    "Emergency services related deaths 2019 onwards",
    "Hospital Death Clinical Procedures and medical management related deaths",
    "Mental Health related deaths",
    "Other related deaths",
    "Police related deaths",
    "Product related deaths",
    "Railway related deaths",
    "Road Highways Safety related deaths",
    "Service Personnel related deaths",
    "State Custody related deaths",
    "Suicide from 2015",
    "Wales prevention of future deaths reports 2019 onwards",
]

# Headings that open a concern section, in order of preference.
CONCERN_HEADINGS = [
    "CORONER'S CONCERNS",
    "MATTERS OF CONCERN",
    "The MATTERS OF CONCERN",
    "CORONER'S CONCERNS are",
    "MATTERS OF CONCERN are",
    "The MATTERS OF CONCERN are",
    "HEALTHCARE SAFETY CONCERNS",
    "SAFETY CONCERNS",
    "PATIENT SAFETY ISSUES",
    "HSIB FINDINGS",
    "INVESTIGATION FINDINGS",
    "THE CORONER'S MATTER OF CONCERN",
    "CONCERNS AND RECOMMENDATIONS",
    "CONCERNS IDENTIFIED",
    "TheMATTERS OF CONCERN",
]

# Phrases that close a concern section.
CONCERN_ENDS = [
    "ACTION SHOULD BE TAKEN",
    "CONCLUSIONS",
    "YOUR RESPONSE",
    "COPIES",
    "SIGNED:",
    "DATED THIS",
    "NEXT STEPS",
    "YOU ARE UNDER A DUTY",
]

# The shorter lists of the window form.
WINDOW_HEADINGS = [
    "CORONER'S CONCERNS",
    "MATTERS OF CONCERN",
    "The MATTERS OF CONCERN",
    "HEALTHCARE SAFETY CONCERNS",
    "SAFETY CONCERNS",
    "PATIENT SAFETY ISSUES",
    "HSIB FINDINGS",
    "INVESTIGATION FINDINGS",
    "THE CORONER'S MATTER OF CONCERN",
    "Matters of Concern",
]
WINDOW_ENDS = ["ACTION SHOULD BE TAKEN", "RECOMMENDATION", "CONCLUSIONS", "NEXT STEPS"]

# Where a coroner area ends and the next label begins.
AREA_ENDS = [
    "coroner's concerns",
    "matters of concern",
    "the matters of concern",
    "this report is being sent to:",
    "these reports are being sent to:",
    "the report is being sent to:",
    "this report",
    "these reports",
    "the report",
    "coroner",
    "category",
]

# Where a category value ends.
CATEGORY_ENDS = [
    "these reports are being sent to:",
    "this report is being sent to:",
    "the report is being sent to:",
    "this report",
    "these reports",
    "the report",
    "this is being",
]

# Wrongly decoded sequences and typographic marks, longest first.
CHARACTER_FIXES = [
    ("\u00e2\u20ac\u2122", "'"),
    ("\u00e2\u20ac\u0153", '"'),
    ("\u00e2\u20ac\u00a6", "..."),
    ("\u00e2\u20ac\u00a2", "\u2022"),
    ("\u00e2\u20ac\"", "-"),
    ("\u00e2\u20ac", '"'),
    ("\u00c2", " "),
    ("\u200b", ""),
    ("\uf0b7", ""),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\u2013", "-"),
]

# Words and phrases that mark a response.
RESPONSE_TITLE_WORDS = ["response", "reply", "answered"]
RESPONSE_PHRASES = [
    "in response to",
    "responding to",
    "reply to",
    "response to",
    "following the regulation 28",
    "following receipt of the regulation 28",
]

# Phrases without analytical content.
BOILERPLATE = [
    "i am reporting to prevent future deaths",
    "regulation 28 report to prevent future deaths",
    "this report is being sent to",
    "in my opinion action should be taken",
    "in the circumstances it is my statutory duty",
    "you are under a duty",
    "your response must contain",
    "i have made a report",
    "under paragraph 7",
    "under regulation",
    "in my opinion there is a risk that future deaths will occur",
    "matters of concern are as follows",
    "during the course of the inquest",
    "following an inquest",
    "you must respond by",
    "your organisation has the power",
    "to my office by",
    "under the coroners and justice act",
]

# Stop words of the report domain.
DOMAIN_STOP_WORDS = [
    "report", "regulation", "coroner", "prevention", "future", "deaths",
    "circumstances", "death", "concern", "risk", "paragraph", "action",
    "response", "section", "matters", "inquest",
]

# Default English stop words of this library; every operator takes its own list.
ENGLISH_STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down",
    "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor",
    "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out",
    "over", "own", "same", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "you", "your",
]

# Words that state or imply a failure; tokens keep apostrophes.
EXPLICIT_NEGATIONS = [
    "no", "not", "never", "none", "nothing", "neither", "nowhere", "nobody",
    "cannot", "can't", "won't", "isn't", "aren't", "doesn't", "don't", "didn't",
    "hasn't", "haven't", "hadn't", "wouldn't", "shouldn't", "couldn't",
    "mustn't", "without", "unwell",
]
IMPLICIT_NEGATIONS = [
    "fail", "lack", "deny", "refuse", "avoid", "miss", "omit", "exclude",
    "decline", "prevent", "absent", "missing", "unable", "unavailable",
    "insufficient", "impossible", "devoid", "failures", "failing", "poor",
    "communication", "tiredness", "stressed", "inexperience", "equipment",
    "workload", "multitask", "procedure", "intoxicated", "self-harm", "delay",
    "monitoring", "drugs", "responsibility", "busy", "access", "conditions",
    "environment", "surroundings", "services", "contact", "space",
    "instructions", "training", "experience", "unclear", "unobserved",
    "privacy", "safety", "risk", "escalation", "referral", "emergency", "fear",
    "notes", "document", "report", "wrong", "overlook", "presumed", "staff",
]

# Theme group names by lower-case alias.
THEME_GROUPS = {
    "communication and culture": "Communication",
    "external factor": "External",
    "organisational factors": "Organisation",
    "local working conditions": "Internal",
    "situational": "Jobs/Task",
    "jobs/task": "Jobs/Task",
    "organisation": "Organisation",
    "internal": "Internal",
    "person": "Person",
    "external": "External",
    "human error": "Human Error",
    "communication": "Communication",
    "other": "Other",
}
