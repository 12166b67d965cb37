"""The patterns, word lists and numbers that results depend on."""

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_WHOLE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
STANDARD = (
    ("basic", r"(?i)\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", 0.9),
    ("relaxed", r"(?i)([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 0.8),
    ("with_context", r"(?i)(?:email|e-mail|mail|contact)?\s*:?\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})", 0.8),
    ("quoted", r"(?i)[\"'(]([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})[\"')]", 0.8),
)
OBFUSCATED = (
    r"(?i)([a-zA-Z0-9._-]+)\s*@\s*([a-zA-Z0-9.-]+)\s*\.\s*([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)\s*\[at\]\s*([a-zA-Z0-9.-]+)\s*\[dot\]\s*([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)\s*\(at\)\s*([a-zA-Z0-9.-]+)\s*\(dot\)\s*([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)\s+at\s+([a-zA-Z0-9.-]+)\s+dot\s+([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)&#64;([a-zA-Z0-9.-]+)&#46;([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)＠([a-zA-Z0-9.-]+)．([a-zA-Z]{2,})",
    r"(?i)([a-zA-Z0-9._-]+)\s*@\s*([a-zA-Z0-9.-]+)\s*\.\s*([a-zA-Z0-9.-]+)\s*\.\s*([a-zA-Z]{2,})",
)
REPUTABLE = (".edu", ".gov", ".org")
GENERIC = ("info", "contact", "admin", "support", "noreply")
PHONE = r"[\+]?[1-9]?[\d\s\-\(\)\.]{10,15}"
TITLED_NAMES = (
    r"(?:Professor|Prof\.?|Associate Professor|Assistant Professor|Dr\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"(?:Director|Manager|Engineer|Analyst)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
)
NOT_IN_NAMES = ("department", "engineering", "science")
TITLES = (
    r"\b(Professor|Prof\.?)\b",
    r"\b(Associate Professor)\b",
    r"\b(Assistant Professor)\b",
    r"\b(Director)\b",
    r"\b(Manager)\b",
    r"\b(Engineer)\b",
    r"\b(Lecturer)\b",
    r"\b(Research Assistant)\b",
    r"\b(Dr\.?|PhD|Ph\.D\.?)\b",
    r"\b(Senior\s+\w+)\b",
    r"\b(Lead\s+\w+)\b",
)
COMPANIES = (
    r"\b(University|College|School)\s+of\s+\w+\b",
    r"\b\w+\s+(University|College|Institute|Corporation|Corp|Inc|LLC|Ltd)\b",
)
INVALID_EMAILS = (r"\.{2,}", r"^\.|\.$", r"@\.", r"\.@", r"@.*@")
STRICT_INVALID_EMAILS = (r"\.{2,}", r"^\.|\.$", r"@\.", r"\.@", r"^-|^_", r"-$|_$")
NOT_NAMES = (
    r"\b(?:email|contact|info|admin|webmaster|support|sales|marketing)\b",
    r"\b(?:lorem|ipsum|dolor|sit|amet)\b",
    r"\b(?:click|here|more|read|view|download)\b",
)
PHONE_FORMATS = (r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$", r"^\+?[1-9]\d{1,14}$")
SMALL_TITLE_WORDS = ("of", "and", "the", "for", "at", "in", "on", "to", "a", "an")
SMALL_COMPANY_WORDS = ("and", "of", "the", "for")
UPPER_COMPANY_WORDS = ("LLC", "LP", "LLP", "PC")
COMPANY_SUFFIXES = {"inc": "Inc", "corp": "Corp", "ltd": "Ltd", "llc": "LLC", "co": "Co", "company": "Company", "corporation": "Corporation", "limited": "Limited"}
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "sir", "madam", "jr", "sr", "phd", "md", "esq")
SOCIAL = {
    "linkedin": r"(?i)linkedin\.com/in/([a-zA-Z0-9\-_]+)",
    "twitter": r"(?i)twitter\.com/([a-zA-Z0-9_]+)",
    "facebook": r"(?i)facebook\.com/([a-zA-Z0-9.]+)",
    "instagram": r"(?i)instagram\.com/([a-zA-Z0-9_.]+)",
    "github": r"(?i)github\.com/([a-zA-Z0-9\-_]+)",
    "youtube": r"(?i)youtube\.com/(?:c/|channel/|user/)?([a-zA-Z0-9\-_]+)",
    "tiktok": r"(?i)tiktok\.com/@([a-zA-Z0-9_.]+)",
}
CARD_CLASS = r"(?i)(card|profile|member|staff|person|contact)"
EXCLUDED_EXTENSIONS = (".pdf", ".doc", ".docx", ".zip", ".rar")
DISPOSABLE = ("10minutemail.com", "tempmail.org", "guerrillamail.com", "mailinator.com", "yopmail.com", "temp-mail.org")
EXPORT_COLUMNS = ("email", "name", "title", "company", "phone", "source_url", "extraction_method", "confidence", "validation_score", "context")
