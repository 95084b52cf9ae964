"""Values that must equal the modelled toolkit's for identical results.

FIXED VALUES: everything in this module is data (prompt text, marker strings, lookup
tables, defaults), stated plainly and in natural order. Nothing here is logic.
"""

from __future__ import annotations

import sys

# ---------------------------------------------------------------- FIXED VALUES --
# System prompt, byte for byte. There is deliberately no space between the first and
# the second sentence.
SYSTEM_PROMPT = (
    "You are a helpful assistant."
    "Answer in the language of the user's question. "
    "Reply with ONLY the final answer text. No thinking, no intro, no outro."
)

# Student prompt: newline, "Answer in {language}", newline, "Question:", newline, question.
STUDENT_TEMPLATE = "\nAnswer in {language}\nQuestion:\n{question}"

# Teacher prompt (defined by the toolkit, never used by its entry points).
TEACHER_TEMPLATE = (
    "\nAnswer in {language} as spoken in {country}\nQuestion:\n{question}\n\n"
    "Reference answer (use it to ground your response):\n{golden_answer}"
)

# Country code -> country name.
COUNTRY_NAMES = {
    "Uga": "Uganda",
    "Gha": "Ghana",
    "Eth": "Ethiopia",
    "Ken": "Kenya",
}

# Chat control tokens of the turn-marker template.
BOS_TOKEN = "<BOS_TOKEN>"
START_TURN = "<|START_OF_TURN_TOKEN|>"
END_TURN = "<|END_OF_TURN_TOKEN|>"
SYSTEM_TOKEN = "<|SYSTEM_TOKEN|>"
USER_TOKEN = "<|USER_TOKEN|>"
CHATBOT_TOKEN = "<|CHATBOT_TOKEN|>"
RESPONSE_START = "<|START_RESPONSE|>"
RESPONSE_END = "<|END_RESPONSE|>"

# Default answer marker put in front of assistant answers.
ANSWER_MARKER = "##Answer:"

# Answer used when a generation is blank.
FALLBACK_ANSWER = "I am unable to provide an answer to this question at this time."

# Maximum new tokens per subset (the preset used for submissions).
MAX_NEW_TOKENS_BY_SUBSET = {
    "Aka_Gha": 512,
    "Amh_Eth": 128,
    "Eng_Eth": 64,
    "Eng_Gha": 180,
    "Eng_Ken": 205,
    "Eng_Uga": 312,
    "Lug_Uga": 511,
    "Swa_Ken": 347,
}

# Alternative preset (shipped, not used by default).
MAX_NEW_TOKENS_BY_SUBSET_ALT = {
    "Swa_Ken": 500,
    "Lug_Uga": 650,
    "Aka_Gha": 500,
    "Amh_Eth": 200,
    "Eng_Eth": 80,
    "Eng_Uga": 420,
    "Eng_Gha": 300,
    "Eng_Ken": 312,
}

# Default decoding parameters.
GENERATION_PARAMS = {
    "max_new_tokens": 312,
    "use_cache": True,
    "do_sample": False,
    "num_beams": 5,
}

# Label value that training ignores.
IGNORE_INDEX = -100

# Defaults of the training-data side.
DEFAULT_SAMPLE_SEED = 42
DEFAULT_ALPHA = 0.5
DEFAULT_MAX_SEQ_LEN = 2048
DEFAULT_INFER_BATCH = 8
DEFAULT_MIN_N = 3
DEFAULT_MAX_N = 8
DEFAULT_MAX_PASSES = 10

# Submission target columns (the same answer is written to each).
SUBMISSION_TARGETS = ("TargetRLF1", "TargetR1F1", "TargetLLM")

# Metric columns of an evaluation record, in summary order.
EVAL_METRICS = ("exact_match", "rouge1_f1", "rougeL_f1", "score")
# ------------------------------------------------------------------------------

# Python's ``str.strip()`` / ``str.split()`` whitespace, derived by rule from the
# running interpreter rather than listed by hand.
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def regex_class(chars: str, negate: bool = False) -> str:
    """A regex character class of ``chars`` using ``\\x{..}`` escapes, consecutive code
    points merged into ranges (fewer alternatives to test per character).

    The same text is valid in Java regex (Spark) and RE2 (DuckDB), so both engines
    agree on what a whitespace character is.
    """
    codes = sorted({ord(c) for c in chars})
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        lo, hi = codes[i], codes[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return f"[{'^' if negate else ''}{''.join(parts)}]"


WS_CLASS = regex_class(PY_WHITESPACE)
NON_WS_CLASS = regex_class(PY_WHITESPACE, negate=True)
# A word is a maximal run of non-whitespace; a lossless token keeps the whitespace
# before it, so joining lossless tokens gives back the text minus trailing spaces.
WORD_PATTERN = NON_WS_CLASS + "+"
LOSSLESS_TOKEN_PATTERN = WS_CLASS + "*" + NON_WS_CLASS + "+"
