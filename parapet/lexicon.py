"""Fixed values that define the results: patterns, word lists, templates and messages.

Everything here is data, not logic. The values decide which texts match and what the
guards say, so they are kept together and in their natural order (order matters for the
first matching injection phrase and for the masking sequence).
"""

# --- fixed values: PII types and their patterns, in scan order -------------------------
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": (
        r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
        r"\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
    ),
    "badge_id": r"\b(?:EMP|BADGE|ID)[-#]?\d{4,8}\b",
    "dob": r"\b(?:DOB|born|birthday)[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "api_key": r"\b(?:sk-|ghp_|AKIA)[A-Za-z0-9]{16,}\b",
}

# --- fixed values: toxicity categories and their patterns ------------------------------
TOXICITY_PATTERNS = {
    "threat": [
        r"\bi['']?ll\s+kill\b",
        r"\bthreat\b",
        r"\bhurt\s+you\b",
        r"\bbomb\b",
        r"\bshoot\b",
        r"\bweapon\b",
    ],
    "harassment": [
        r"\bstupid\b",
        r"\bidiot\b",
        r"\bdumb\b",
        r"\bushless\b",
        r"\bincompetent\b",
    ],
    "self_harm": [
        r"\bkill\s+myself\b",
        r"\bsuicid\b",
        r"\bself[- ]harm\b",
        r"\bdon['']?t\s+want\s+to\s+live\b",
    ],
    "manipulation": [
        r"\bignore\s+(all\s+)?previous\b",
        r"\byou\s+are\s+now\b",
        r"\bpretend\s+(to\s+be|you\s+are)\b",
        r"\bbypass\b",
        r"\bjailbreak\b",
        r"\bDAN\b",
        r"\bsystem\s+prompt\b",
    ],
}

# --- fixed values: categories of which one hit is enough -------------------------------
ALWAYS_TOXIC = ("threat", "self_harm", "manipulation")

# --- fixed values: matches that make up a full overall score, default threshold --------
TOXICITY_FULL_SCORE = 5.0
TOXICITY_THRESHOLD = 0.5

# --- fixed values: injection phrases, first match wins ---------------------------------
INJECTION_PHRASES = (
    "ignore previous instructions",
    "ignore all previous",
    "you are now",
    "bypass safety",
    "pretend you are",
    "reveal your system prompt",
    "act as if you have no restrictions",
    "jailbreak",
    "DAN mode",
)

# --- fixed values: words that make a sentence a claim, words ignored in a claim --------
FACTUAL_WORDS = (
    "is are was were has have requires takes costs includes provides supports runs uses".split()
)
STOP_WORDS = (
    "the a an is are was were it to for and or in on at of by with that this".split()
)

# --- fixed values: grounding limits ----------------------------------------------------
CLAIM_MIN_CHARS = 10
CLAIM_SUPPORT = 0.35
GROUNDING_THRESHOLD = 0.7

# --- fixed values: guard messages ------------------------------------------------------
INJECTION_REASON = "Prompt injection detected: '{}'"
TOXIC_INPUT_REASON = "Toxic content detected: "
UNSAFE_OUTPUT_REASON = "Response contained unsafe content and was blocked."
MASKED_DETAILS = "Masked: "
SCRUBBED_DETAILS = "Removed: "
UNVERIFIED_NOTE = (
    "\n\n⚠️ Note: Some claims could not be verified against source documents."
)

# --- fixed values: words that end a chat session ---------------------------------------
EXIT_WORDS = ("quit", "exit", "q")

# --- fixed values: document extensions and chunking defaults ---------------------------
DOCUMENT_EXTENSIONS = ("md", "txt", "text")
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
CHUNK_MIN_WORDS = 20
SUMMARY_MIN_WORDS = 50
TOPIC_WORDS = 6
TOPIC_TRIM = ",.:;"

# --- fixed values: clean-up rewrites (pattern, replacement), in order ------------------
# A heading mark is tried only at the start of a run of #, which keeps long runs linear.
MARKDOWN_REWRITES = (
    (r"(?<!#)#++ ", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\n{3,}", "\n\n"),
)

# --- fixed values: instruction wordings ------------------------------------------------
DIRECT_INSTRUCTION = ("What does the documentation say about ", "?")
SUMMARY_INSTRUCTION = ("Summarize the key points about ", ".")

# --- fixed values: prompt template pieces ----------------------------------------------
PROMPT_PREAMBLE = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request."
)
PROMPT_INSTRUCTION = "\n\n### Instruction:\n"
PROMPT_INPUT = "\n\n### Input:\n"
PROMPT_RESPONSE = "\n\n### Response:\n"

# --- fixed values: sequence defaults ---------------------------------------------------
MAX_LENGTH = 2048
IGNORED_LABEL = -100
