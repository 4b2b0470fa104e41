"""Fixed values of the domain: labels, code tables, weights and text patterns.

Everything in this module is data that results depend on, stated in its natural
order. Behaviour lives in the other modules.
"""

# Enumerations (fixed values) ------------------------------------------------
COURT_LEVELS = (
    "supreme", "appellate", "district", "state_supreme",
    "state_appellate", "state_trial", "bankruptcy", "specialized",
)
PRECEDENTIAL_STATUSES = (
    "published", "unpublished", "errata", "separate_opinion",
    "in_chambers", "relating_to", "unknown",
)
DISPOSITIONS = (
    "affirmed", "reversed", "remanded", "vacated",
    "dismissed", "affirmed_in_part", "reversed_in_part",
)
CITATION_TYPES = ("followed", "distinguished", "overruled", "cited")
EXTRACTION_STATUSES = ("pending", "completed", "failed", "needs_review")
JOB_STATUSES = ("queued", "running", "completed", "failed")
PRIORITIES = ("high", "normal", "low")
CONFLICT_STATUSES = ("detected", "confirmed", "dismissed")

# Court type code -> court level (fixed values) -------------------------------
COURT_CODE_LEVEL = {
    "F": "district", "FB": "bankruptcy", "FD": "district", "FS": "specialized",
    "FA": "appellate", "FSC": "supreme", "S": "state_trial", "SA": "state_appellate",
    "SS": "state_supreme", "SAG": "specialized", "C": "specialized",
    "T": "specialized", "I": "specialized",
}

# Source status label -> precedential status (fixed values) -------------------
SOURCE_STATUS = {
    "Published": "published", "Unpublished": "unpublished", "Errata": "errata",
    "Separate": "separate_opinion", "In-chambers": "in_chambers",
    "Relating-to": "relating_to", "Unknown": "unknown",
}

# Public address of an opinion, by id (fixed format)
OPINION_URL = "https://www.courtlistener.com/opinion/{}/"

# Text representations of an opinion, best first (fixed order)
TEXT_FIELDS = ("plain_text", "html_with_citations", "html", "xml_harvard")

# Whitespace as Python's str type understands it: for trimming and for patterns.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_SET = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

# Reporter abbreviations (fixed values; longer names precede their prefixes).
# A blank here stands for optional white space in the text.
FEDERAL_REPORTERS = (
    "F. Supp. 3d", "F. Supp. 2d", "F. Supp.", "F. App'x", "F.4th", "F.3d", "F.2d",
    "L. Ed. 2d", "S. Ct.", "U.S.", "B.R.",
)
STATE_REPORTERS = (
    "N.Y.S.3d", "N.Y.S.2d", "N.Y.3d", "N.Y.2d", "N.Y.",
    "Cal. Rptr. 3d", "Cal. Rptr. 2d", "Cal. Rptr.",
    "Cal.5th", "Cal.4th", "Cal.3d", "Cal.2d", "Cal.",
    "Ill.2d", "Ill. App. 3d", "Ill. App. 2d", "Mass.", "Pa. Super.", "Pa.",
    "Ohio St. 3d", "Ohio St. 2d", "N.J. Super.", "N.J.",
    "A.3d", "A.2d", "N.E.3d", "N.E.2d", "N.W.2d", "S.E.2d", "S.W.3d", "S.W.2d",
    "P.3d", "P.2d", "So. 3d", "So. 2d",
)

# Section headings: label and the line pattern that opens the section (fixed
# values, matched per line; all but the syllabus ignore case). `\s` is white space of any script.
SECTION_HEADINGS = (
    ("syllabus", r"^(?:SYLLABUS|Syllabus)\s*$", False),
    ("background",
     r"^(?:I+\.?\s+)?(?:BACKGROUND|FACTUAL\s+BACKGROUND|PROCEDURAL\s+(?:BACKGROUND|HISTORY))\s*$", True),
    ("standard_of_review", r"^(?:I+\.?\s+)?STANDARD\s+OF\s+REVIEW\s*$", True),
    ("analysis", r"^(?:I+\.?\s+)?(?:ANALYSIS|LEGAL\s+ANALYSIS|DISCUSSION)\s*$", True),
    ("holding", r"^(?:I+\.?\s+)?(?:HOLDING|ORDER|JUDGMENT)\s*$", True),
    ("dissent",
     r"^(?:(?:I+\.?\s+)?DISSENT(?:ING)?(?:\s+OPINION)?|.{0,40},?\s+dissenting[.:]?)\s*$", True),
    ("concurrence",
     r"^(?:(?:I+\.?\s+)?CONCURR(?:ENCE|ING)(?:\s+OPINION)?|.{0,40},?\s+concurring[.:]?)\s*$", True),
    ("conclusion", r"^(?:I+\.?\s+)?CONCLUSION\s*$", True),
)
DEFAULT_SECTION = "majority"

# What cleaning looks for in pages and texts (the first two whatever the case; `\s` as above).
LINE_BREAK = r"<br\s*/?>"
BLOCK_END = r"</(?:p|div|li|tr|blockquote|h[1-6])>"
ANY_TAG = r"<[^>]+>"
BLANK_RUN = r"[ \t]+"
EMPTY_LINES = r"\n{3,}"

# Chunk sizes in characters (fixed defaults)
CHUNK_TARGET = 2000
CHUNK_MAX = 3000
CHUNK_ANCHOR = 80

# Validation and extraction (fixed defaults)
REVIEW_THRESHOLD = 0.3
MAX_RETRIES = 2
SECONDS_PER_OPINION = 5.0
FAILED_HOLDING = "Extraction failed"
FAILED_DISPOSITION = "dismissed"
FAILED_TOPIC = "unknown"

# Conflicts (fixed values)
OPPOSING_DISPOSITIONS = (
    ("affirmed", "reversed"), ("affirmed", "vacated"), ("affirmed", "reversed_in_part"),
)
CONFLICTING_TYPES = (("followed", "distinguished"), ("followed", "overruled"))
LEVEL_WEIGHT = {
    "supreme": 1.0, "appellate": 0.8, "state_supreme": 0.7, "state_appellate": 0.5,
    "district": 0.4, "state_trial": 0.3, "bankruptcy": 0.2, "specialized": 0.3,
}
DEFAULT_LEVEL_WEIGHT = 0.3

# Authority ranking (fixed values)
LEVEL_RANK = {
    "supreme": 100, "appellate": 80, "state_supreme": 70, "state_appellate": 50,
    "district": 40, "state_trial": 30, "bankruptcy": 20, "specialized": 25,
}
DEFAULT_LEVEL_RANK = 25

# Search (fixed values)
MMR_CANDIDATES = 50
NORM_EPSILON = 1e-10

# Latency histogram bounds in use when the caller names none (fixed values)
LATENCY_BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)

# Weight of each kind of evidence for a conflict, and the shared topics and authorities that count in full.
EVIDENCE_WEIGHTS = {"opposing": 0.30, "conflicting": 0.25, "topics": 0.15, "authorities": 0.15, "levels": 0.10, "age": 0.05}
TOPICS_FOR_ALL, AUTHORITIES_FOR_ALL = 5.0, 3.0
# Fixed value: mean age in years from which recency counts nothing.
AGE_WITHOUT_RECENCY = 20.0

# Characters of a search text, and results of a search.
QUERY_LENGTHS = (3, 2000)
RESULT_COUNTS = (1, 100)
