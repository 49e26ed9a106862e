"""Word lists, patterns, thresholds and query texts that define the results."""

# English stopwords (the published list of 179 words), then two left-over markup names.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don don't should should've now
d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn
isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won
won't wouldn wouldn't
""".split()
MARKUP_STOPWORDS = ["nbsp", "amp"]

# Domain stopwords.
DOMAIN_STOPWORDS = """
advisor advisors financial finance wealth firm company client clients also would make always looking years know with
with. anyone scale recommend berkshire lorem ipsum
""".split()

# Platform prompts removed from review text (joined to one alternation, case ignored).
PROMPT_PATTERNS = [
    r"things\s+you\s+value\s+in\s+your\s+advisor[:\s]*",
    r"top\sthings\s+you\s+value\s+in\s+your\s+advisor[:\s]*",
    r"things\s+value\s+advisor[:\s]*",
    r"how\s+well\s+do\s+you\s+feel.*?\?",
    r"how\s+would\s+you\s+describe.*?\?",
    r"how\s+likely.*?\?",
    r"if\s+you\s+have\s+any\s+other\s+feedback\s+for\s+us[:\s]*",
    r"\bwe\s*'?\s*d\s+love\s+to\s+hear\s+from\s+you\b[^\w]*",
    r"on\s+a\s+scale\s+of\s+\d+\s*[-–]\s*\d+[:\s]*",
    r"scale\s+from\s+\d+\s*[-–]\s*\d+",
    r"please\s+rate[:\s]*",
    r"&amp\d+",
    r"client first capital",
]

# Disclaimers cut to the end of the line, case ignored.
BOILERPLATE_PATTERNS = [
    r"this reviewer received no compensation.*",
    r"there are no material conflicts of interest.*",
]

# Credentials deleted from names.
CREDENTIALS = ["cfa", "cfp", "chfc", "aif", "cpa", "mba", "phd", "ms", "jd", "esq"]

# Phrases that betray platform text in reviews.
SUSPECT_PHRASES = [
    "things value advisor",
    "feel first",
    "first capital",
    "addressing planning management",
    "planning management needs",
    "available answer questions",
]

# Words that mark a sentence about the relationship.
RELATIONSHIP_KEYWORDS = [
    "trust", "trustworthy", "honest", "integrity",
    "listen", "listens", "understand", "understands", "generous",
    "care", "caring", "compassion", "empathetic",
    "communicate", "communication", "explains", "explain", "clear",
    "patient", "responsive", "available",
    "peace of mind", "secure", "confidence",
    "values", "best interest",
    "life", "divorce", "death", "widow", "retirement", "family",
    "retire", "future",
]

# Thresholds and constants.
FIRM_MARKER = "/advisory-firms/"
MIN_TEXT_LENGTH = 5
DATE_FLOOR_YEAR = 2014
MIN_TOKENS_TO_ENCODE = 5
MIN_TOTAL_TOKENS = 150
INFORMATIVE_TOKENS = 75
MIN_REVIEWS = 5
PREMIER_REVIEWS = 20
DIRECTIONAL_REVIEWS = 10
MIN_GROUP_MEMBER_REVIEWS = 3
DAYS_PER_YEAR = 365.25
HALF_LIFE_YEARS = 2.0
PENALTY_AT_P75 = 0.7
TOKEN_REF = 80
INFO_CAP = 2.0
INFO_FLOOR = 0.2
ENCODE_BATCH = 64
VECTOR_SIZE = 384
TIERS = ("Very Strong", "Strong", "Moderate", "Foundational")
DEFAULT_BREAKPOINTS = {"p75": 0.4376, "p50": 0.3613, "p25": 0.2827}
METHODS = ("mean", "penalized", "weighted")
COVERAGE_THRESHOLDS = (50, 100, 150, 200, 300)

# Dimension keys and the texts that define them.
DIMENSION_QUERIES = {
    "trust_integrity": (
        "I feel a deep sense of security and peace of mind because my advisor acts as a true fiduciary, always "
        "putting my best interest before their own commissions or conflicts of interest. They have earned my trust "
        "through years of unwavering integrity, honesty, and transparency regarding fees and performance, proving "
        "they are an ethical, principled, and reliable professional with a stand-up character who protects my "
        "family's future and life savings."
    ),
    "listening_personalization": (
        "My advisor takes the time to truly listen, hear my concerns, and understand my unique goals and risk "
        "tolerance. They have built a highly personalized, custom-tailored financial plan and investment strategy "
        "that fits my specific situation, aspirations, and values, making me feel like a valued partner rather than "
        "just another account number or a sales target."
    ),
    "communication_clarity": (
        "Complex financial concepts are made simple and digestible because my advisor is a master communicator who "
        "explains things clearly in plain English without using confusing technical jargon. They provide timely "
        "updates, regular check-ins, and transparent breakdowns of my portfolio, ensuring I am well-educated, fully "
        "informed, and confident in the logic and rationale behind every recommendation or financial decision."
    ),
    "responsiveness_availability": (
        "The level of service is exceptional; they are always accessible, easy to reach, and promptly return calls "
        "or emails within hours, not days. Whether I have a quick question or an urgent concern during market "
        "volatility or a personal crisis, they are responsive, attentive, and reliable, providing the immediate "
        "support and availability I need to feel taken care of and less anxious about my liquidity and financial "
        "health."
    ),
    "life_event_support": (
        "Beyond being a numbers person, they have been a compassionate counselor and supportive partner through "
        "major life transitions, including retirement, career changes, marriages, inheritance, or the loss of a "
        "loved one. They provide empathy, patience, and guidance during emotional times, offering perspective and "
        "hand-holding that goes far beyond a spreadsheet to address the human element and life context of my wealth "
        "management."
    ),
    "investment_expertise": (
        "I have total confidence in their technical proficiency, investment pedigree, and deep market knowledge. "
        "They are a savvy, highly skilled professional with the credentials and expertise to navigate complex asset "
        "allocations, tax strategies, and market cycles. Their competence and strategic insight ensure my portfolio "
        "is well-positioned for long-term growth, wealth preservation, and solid returns that meet or exceed my "
        "financial expectations."
    ),
}
DIMENSIONS = tuple(DIMENSION_QUERIES)

# The n-gram report's default list: the English list without "any", plus the markup names.
REPORT_STOPWORDS = [w for w in ENGLISH_STOPWORDS if w != "any"] + MARKUP_STOPWORDS
