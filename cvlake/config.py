"""Fixed values that the results depend on, as one frozen configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

# Month names, section headings, catalogue of skills, keywords, stop words, weights and thresholds.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

SECTION_ALIASES = {
    "summary": ("summary", "profile", "professional summary", "about", "objective"),
    "skills": ("skills", "technical skills", "core skills", "key skills", "competencies", "expertise"),
    "experience": ("experience", "work experience", "employment", "career history", "work history", "professional experience"),
    "education": ("education", "qualifications", "academic background"),
    "certifications": ("certifications", "certificates", "licences", "licenses", "training", "accreditations"),
    "contact": ("contact", "contact details", "personal details", "personal information"),
}

CANONICAL_SKILLS = (
    "SIA", "SIA Door Supervisor", "SIA CCTV", "CCTV monitoring", "Access control", "Incident reporting",
    "Conflict management", "Crowd management", "ID verification", "Search procedures",
    "Emergency response procedures", "Patrolling", "Radio communication", "Safeguarding", "Customer service",
    "Health and safety compliance", "GDPR and data protection compliance", "Picking and packing", "Order picking",
    "RF scanning", "Stock control", "Inventory management", "Loading and unloading", "Forklift driving",
    "Reach truck", "Manual handling", "PPE compliance", "Housekeeping", "Room attendant", "Front of house",
    "Food hygiene", "Bar service", "Microsoft Excel", "Microsoft Word", "Team leadership", "Communication",
    "Problem solving", "Time management",
)

SKILL_VARIANTS = {
    "SIA Door Supervisor": ("door supervisor", "sia ds", "ds licence", "ds license", "door sup", "sia door super visor"),
    "SIA CCTV": ("cctv licence", "cctv license", "sia cctv"),
    "CCTV monitoring": ("cctv", "monitoring cctv", "cctv operator"),
    "Picking and packing": ("picker", "packer", "picking", "packing", "pick and pack"),
    "RF scanning": ("rf scanner", "rf scan", "scan gun", "handheld scanner"),
    "Forklift driving": ("forklift", "forklift driver", "counterbalance"),
    "Reach truck": ("reach", "reach driver", "reach forklift"),
    "Housekeeping": ("house keeper", "housekeeper", "public area cleaner"),
}

SKILL_ABBREVIATIONS = {
    "DS": ("SIA Door Supervisor",),
    "CCTV": ("CCTV monitoring", "SIA CCTV"),
    "GDPR": ("GDPR and data protection compliance",),
    "DBS": ("DBS check",),
    "HSE": ("Health and safety compliance",),
}

LICENCE_KEYWORDS = ("sia", "door supervisor", "cctv", "first aid", "emergency first aid", "dbs", "cscs", "haccp", "food hygiene", "licence", "license", "certificate", "certification")
NOT_A_NAME = ("curriculum vitae", "cv", "resume", "profile", "summary", "contact", "details", "email", "e-mail", "phone", "mobile", "tel", "address", "postcode", "linkedin", "github", "nationality", "dob", "date of birth")
KEYWORD_STOP = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "this", "that", "these", "those", "i", "we", "they", "he", "she", "you")
STREET_WORDS = ("road", "rd", "street", "st", "lane", "ln", "avenue", "ave", "drive", "dr", "close", "cl", "way", "court", "ct", "flat", "house")
QUERY_STOP = ("years", "yrs", "year", "experience", "exp")

# The English stop words of Spark's own StopWordsRemover, for the TF-IDF score. A parameter: any list can be given.
SEARCH_STOP = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(\+44[ \t\n\x0B\f\r]?[0-9][0-9 \t\n\x0B\f\r]{8,13}|\b0[0-9][0-9 \t\n\x0B\f\r]{8,13})"
POSTCODE = r"(?i)\b([A-Z]{1,2}[0-9]{1,2}[A-Z]?)[ \t\n\x0B\f\r]*([0-9][A-Z]{2})\b"
PROFILE_LINKS = (r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/\S+", r"(?i)(?:https?://)?(?:www\.)?github\.com/\S+")
NAME = r"[A-Za-z][A-Za-z'’-]+(?:[ \t]+[A-Za-z][A-Za-z'’-]+){1,4}"
#: What makes a name of a file name, in order: patterns and what takes their place.
FILE_NAME_STEPS = ((r"(?i)\b(resume|cv)\b", " "), (r"(?i)\b(final|latest|updated)\b", " "), (r"[_.\-]+", " "), ("([a-z])([A-Z])", "$1 $2"), (r"\b[0-9]+\b", " "))
MONTH_NAME = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t)?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MOMENT = MONTH_NAME + r"\s+[0-9]{4}|\b(?:19|20)[0-9]{2}\b"
#: Group 1 is the start, group 2 the end.
DATE_RANGE = rf"(?i)({MOMENT})\s*(?:-+|–|to)\s*({MOMENT}|present|current|now)"
BULLET = r"^\s*(?:[•\-*●○▪·]+|[0-9]+\.)\s+"


@dataclass(frozen=True)
class Config:
    """What a user of the library may set; passed along, never global."""

    extensions: tuple[str, ...] = (".pdf", ".docx")
    ocr_letters: int = 400
    header_footer_share: float = 0.60
    embed_threshold: float = 0.70
    top_keywords: int = 35
    summary_words: int = 160
    weights: dict = field(default_factory=lambda: {"tfidf": 0.45, "embed": 0.35, "overlap": 0.10, "skill_bonus": 0.10})
    max_df: float = 0.98
    top_k: int = 25
    shown_k: int = 20
    min_score: float = 0.25
    sectors: tuple[str, ...] = ("security", "warehouse", "hospitality")
    search_stop: tuple[str, ...] = tuple(SEARCH_STOP)
    listing_items: int = 20_000
    folder_types: tuple[str, ...] = ()  # MIME types that a store gives its folders, besides plain "folder"


CONFIG = Config()
