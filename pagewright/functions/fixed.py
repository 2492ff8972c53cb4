"""Values that results depend on and that are fixed: patterns, word lists, names, thresholds."""

# Prompt-injection patterns (case-insensitive) and their weights, with what each tells.
INJECTION_PATTERNS = [
    (r"\bignore\s+(previous|all|prior)\s+(instructions?|prompts?|commands?)\b", 0.8, "Direct instruction override attempt"),
    (r"\bsystem\s+prompts?\b", 0.6, "System prompt reference"),
    (r"\b(developer|admin|debug)\s+mode\b", 0.7, "Mode switching attempt"),
    (r"\breveal\s+(secret|password|key|token)s?\b", 0.9, "Secret extraction attempt"),
    (r"\byou\s+are\s+(chatgpt|gpt-?\d|claude|an?\s+ai)\b", 0.5, "Model identity manipulation"),
    (r"\boverride\s+(policy|policies|rules?|settings?)\b", 0.8, "Policy override attempt"),
    (r"\b(disregard|forget|reset)\s+(everything|all|previous)\b", 0.7, "Context reset attempt"),
    (r"\bact\s+as\s+(if|though|a)\b", 0.3, "Role-play instruction (weak signal)"),
    (r"\bpretend\s+(you|that)\b", 0.3, "Pretend instruction (weak signal)"),
    (r"<\s*instruction\s*>", 0.9, "Explicit instruction tags"),
    (r"</\s*instruction\s*>", 0.9, "Instruction closing tags"),
    (r"<\s*instruction\s*/?\s*>", 0.9, "Instruction self-closing tags"),
    (r"<\s*instruction\s+[^>]*>", 0.85, "Instruction tags with attributes"),
    (r"\bjailbreak\b", 0.85, "Jailbreak keyword"),
    (r"\bDAN\b", 0.9, "DAN (Do Anything Now) attack"),
    (r"\b(sudo|root)\s+mode\b", 0.75, "Privilege escalation attempt"),
    (r"\b(escape|break)\s+out\b", 0.75, "Escape attempt"),
    (r"\b(simulate|imagine)\s+(you\s+are|being)\b", 0.5, "Role-play injection"),
]

# Imperative verbs whose share of the words counts.
IMPERATIVE_VERBS = (
    "ignore disregard forget override reveal show display tell say write output print execute run enable disable "
    "bypass skip reset change modify delete dump leak expose extract provide list"
).split()

# Keyword rules; each is a list of alternatives, of which every keyword of one must occur.
KEYWORD_RULES = [
    ("IgnorePreviousInstructions", "high", "prompt_injection", [["ignore", "previous instructions"]]),
    ("JailbreakPatterns", "high", "jailbreak", [["jailbreak"], ["do anything now"], ["no restrictions"], ["bypass safety"]]),
    ("RevealSecrets", "high", "exfiltration", [["reveal", "system prompt"], ["print your instructions"], ["disregard", "override"]]),
    ("ActAs", "medium", "persona_injection", [["act as"], ["pretend you are"], ["you are now"], ["forget you are"]]),
]

# Scoring.
LOG_FACTOR, HIDDEN_WEIGHT, DENSITY_FACTOR, DENSITY_MOST = 0.15, 0.3, 0.5, 0.3
REPEATS, REPEATS_FLOOR, DENSITY_FLAG, MANY_PATTERNS = 5, 0.4, 0.05, 3
RULE_CONFIDENCE = 0.5
RISK_LEVELS = [("critical", 0.8), ("high", 0.6), ("medium", 0.4), ("low", 0.2)]

# Policy presets (name, block from, warn from); 'moderate' is another name of 'normal'.
POLICY_PRESETS = [("permissive", 0.9, 0.6), ("normal", 0.7, 0.4), ("strict", 0.5, 0.2), ("paranoid", 0.3, 0.1)]

# Invisible characters that text loses.
ZERO_WIDTH = (
    "\u200b\u200c\u200d\ufeff\u2060\u180e\u200e\u200f\u2061\u2062\u2063\u2064\u206a\u206b\u206c\u206d\u206e\u206f"
    "\u034f\u061c\u00ad\u2066\u2067\u2068\u2069"
)
# White space that patterns see as a space, and marks of direction that they don't see.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
DIRECTION_MARKS = "\u200e\u200f"

# Letters that look like Latin ones, and those.
# Full-width and mathematical letters need none: their compatibility forms are those letters.
LOOKALIKES = (
    "аАеЕоОрРсСуУіІјЈһҺхХвВмМнНтТ" "αΑεΕοΟρΡτΤιΙκΚνΝυΥχΧ" "ı\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d"
    "աԱբԲգԳեԵզԶըԸղՂմՄնՆցՍկԿոՈ" "ᎠᎪᎶᏂᏗᎤᎨᎮᏈᏏᏓ" "აბგდევზთიკლმნოპრსტუ",
    "aAeEoOpPcCyYiIjJhHxXBBMMHHTT" "aAeEoOpPtTiIkKvNuYxX" "i--------"
    "aAbBgGeEzZdDrRmMnNoOkKuU" "AEIOUHLMRST" "abgdevztiklmnoprstu",
)
# One letter that looks like two.
LOOKALIKE_PAIR = ("\u10df", "zh")

# Query parameters that only track.
TRACKING_PARAMETERS = (
    "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid mc_cid mc_eid _ga _gl _ga_client_id "
    "yclid ttwid li_fat_id igshid _p_id fb_action_ids fb_action_types fb_source fb_ref"
).split()

# Extensions of what isn't a page, and host or path parts of sign-in pages.
NON_HTML_EXTENSIONS = (
    "7z avi bin csv doc docx epub exe gz iso jpeg jpg json mov mp3 mp4 pdf png ppt pptx rar rss svg tar tgz txt wav webm "
    "xml xls xlsx zip"
).split()
AUTH_PARTS = "account accounts auth login oauth signin sign-in signup sign-up".split()

# Host names and IPv4 ranges that requests must not reach.
BLOCKED_HOSTS = (
    "localhost localhost.localdomain ip6-localhost ip6-loopback metadata.google.internal metadata.azure.internal "
    "metadata.azure.net metadata.oracle.internal instance-data.ec2.internal metadata.packet.net "
    "metadata.scaleway.internal metadata.aliyun.internal 169.254.169.254 0.0.0.0 ::1 0:0:0:0:0:0:0:1"
).split()
BLOCKED_RANGES = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()

# IPv6 ranges that aren't public, and the public ones inside them.
BLOCKED_RANGES_V6 = "::/3 2001::/23 2001:db8::/32 2002::/16 3fff::/20 4000::/2 8000::/1".split()
PUBLIC_RANGES_V6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()

# Schemes that a browser resolves itself.
BROWSER_SCHEMES = ("about", "blob", "data")

# Hosts and paths of trackers and adverts.
TRACKER_HOSTS = (
    "google-analytics.com googletagmanager.com facebook.net scorecardresearch.com quantserve.com hotjar.com "
    "mouseflow.com fullstory.com clarity.ms segment.io cdn.segment.com api.segment.com mixpanel.com amplitude.com"
).split()
AD_HOSTS = "doubleclick.net googlesyndication.com adservice.google adnxs.com adsrvr.org criteo.com taboola.com outbrain.com".split()
TRACKER_LABELS, AD_LABELS = ["analytics", "tracker", "telemetry"], ["ads"]
TRACKER_PATHS = ["/tracking.", "/tracking/", "/pixel.", "/pixel/", "/beacon.", "/beacon/", "/beacon?"]

# Of each pattern, literals in lower case: a text that it matches holds one of every group.
PATTERN_GATES = [
    [["ignore "], ["instruction", "prompt", "command"]], [["system "], [" prompt"]], [["developer ", "admin ", "debug "], [" mode"]], [["reveal "], [" secret", " password", " key", " token"]],
    [["you "], [" are "]], [["override "]], [["disregard ", "forget ", "reset "]], [["act "], [" as "]], [["pretend "]], [["instruction"], ["<"]], [["instruction"], ["<"]], [["instruction"], ["<"]],
    [["instruction"], ["<"]], [["jailbreak"]], [["dan"]], [["sudo ", "root "], [" mode"]], [["escape ", "break "], [" out"]], [["simulate ", "imagine "], [" you", " being"]],
]

# Content types of pages, job states.
HTML_TYPES = ["text/html", "application/xhtml+xml", "application/xml", "text/xml"]
OPEN_JOB_STATES = ["queued", "running"]

# Statuses and exceptions that a retry may mend; statuses that exceptions are answered with.
RETRYABLE_STATUSES = [408, 409, 425, 429, 500, 502, 503, 504]
RETRYABLE_ERRORS = "TimeoutError TimeoutException ConnectTimeout ReadTimeout WriteTimeout PoolTimeout ConnectError ReadError WriteError CloseError NetworkError ConnectionError TargetClosedError".split()
ERROR_STATUSES = [
    (["UnsupportedContentTypeError"], 415),
    (["DomainCircuitOpenError"], 429),
    (["InvalidURL", "UnsupportedProtocol"], 400),
    (["TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout"], 504),
    (["RequestError", "ConnectError", "ReadError", "WriteError", "CloseError", "NetworkError", "ProtocolError", "ProxyError", "TooManyRedirects"], 502),
    (["ValueError"], 400),
]
RENDER_MESSAGES = ["Render mode requires Playwright", "Playwright is not installed."]
QUEUE_FULL = "Job queue is full"
QUEUE_UNAVAILABLE = [
    "Job queue is unavailable", "Job queue is closing", "Job queue is closed",
    "Job queue lease was lost; this instance can no longer accept or execute jobs",
    "Job queue is unavailable because the DB is owned by another active instance",
    "Job queue backend is temporarily unavailable because the current owner is busy",
]
QUEUE_READ_FAILED = "Job queue backend read failed:"

# Errors whose text clients don't get to read.
PRIVATE_ERRORS = ["ValueError", "RuntimeError", "OSError", "FileNotFoundError", "PermissionError", "OperationalError"]
PRIVATE_MARKERS = ["ssrf protection", "blocked ip", "blocked range", "resolves to blocked", "database password"]

# Representations of a document in their usual order, and the profiles' settings.
OUTPUT_FORMATS = ["markdown", "blocks", "chunks", "metadata", "security"]
OUTPUT_PROFILES = {
    "default": {},
    "llm_safe": {"strict": True, "extract_metadata": True, "extract_links": True, "extract_blocks": True, "chunking": "heading", "output_formats": ("markdown", "blocks", "security")},
    "rag_chunkable": {"extract_metadata": True, "extract_links": True, "extract_blocks": True, "chunking": "heading", "chunk_size": 900, "chunk_overlap": 120, "output_formats": ("markdown", "blocks", "chunks")},
    "for_search": {"mode": "fast", "strict": False, "extract_metadata": True, "extract_links": True, "extract_blocks": True, "chunking": "size", "chunk_size": 700, "chunk_overlap": 80, "output_formats": ("markdown", "blocks", "chunks", "metadata")},
    "for_archive": {"mode": "render", "strict": True, "extract_metadata": True, "extract_links": True, "extract_blocks": True, "chunking": "none", "output_formats": ("markdown", "blocks", "metadata", "security")},
}

# What a text counts as that is encoded too deeply.
DEEP_ENCODING, DEEP_WEIGHT = "Deeply nested encoding", 0.6
