"""Texts, tables and patterns that results depend on literally.

Nothing here is tunable; every entry has to be exactly this text for scores, prompts and
labels to come out the same on any engine.
"""

# --- Character classes -------------------------------------------------------------------
# Unicode white space as Python's str.strip/str.split/\s see it, for use inside [...].
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same as single characters.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# SPACE without the line breaks of str.splitlines.
INLINE_SPACE = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Word characters (\w) of a Unicode text pattern, for use inside [...].
WORD = r"\p{L}\p{N}_"
# Line breaks of str.splitlines other than a plain \n.
OTHER_LINE_BREAK = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
ARTICLES = ("a", "an", "the")

# --- Datasets ----------------------------------------------------------------------------
DATASETS = ("musique", "quality", "fever", "hardmath", "humaneval_plus")
SOURCE_NAMES = ("MuSiQue", "QuALITY", "FEVER", "HARDMATH", "HumanEvalPlus")
PRIMARY_METRIC = {
    "musique": "token_f1",
    "quality": "token_f1",
    "fever": "label_accuracy",
    "hardmath": "math_exact_match",
    "humaneval_plus": "pass_at_1",
}
COUNCIL_METRIC_NAME = {
    "musique": "musique_token_f1",
    "quality": "token_f1",
    "fever": "label_accuracy",
    "hardmath": "math_exact_match",
    "humaneval_plus": "pass_at_1",
}
METRIC_NAMES = {
    "musique": ("exact_match", "token_f1"),
    "quality": ("exact_match", "token_f1"),
    "fever": ("label_accuracy",),
    "hardmath": ("math_exact_match",),
    "humaneval_plus": ("pass_at_1",),
}
NOT_PRESENT = "NOT PRESENT IN CONTEXT"

# --- Council roles -----------------------------------------------------------------------
ROLES = ("qa", "reasoning", "general")
ROLE_TO_LABEL = {"qa": "A", "reasoning": "B", "general": "C"}
LABELS = ("A", "B", "C")
ROLE_ALIASES = {
    "qa": ("qa",),
    "reasoning": ("reasoning", "math", "code"),
    "general": ("general", "fever"),
}
COUNCIL_MODEL = "p2_council"
REASONING_TAGS = ("think", "scratchpad", "reasoning")

# --- Dataset building --------------------------------------------------------------------
MIN_CLAIM_LENGTH = 20
MIN_QUESTION_LENGTH = 30
HARD_LEVELS = (4, 5)
FLAGGED_PER_SOURCE = {"FEVER": 15, "MuSiQue": 8, "QuALITY": 7}
SKILL_TAGS = {
    "MuSiQue": ("retrieval", "multi-hop"),
    "QuALITY": ("long-context",),
    "FEVER": ("fact-check",),
    "HARDMATH": ("math",),
    "HumanEvalPlus": ("code",),
}

# --- Labels ------------------------------------------------------------------------------
LABEL_ALIASES = {
    "supported": "SUPPORTED",
    "supports": "SUPPORTED",
    "support": "SUPPORTED",
    "true": "SUPPORTED",
    "confirmed": "SUPPORTED",
    "verified": "SUPPORTED",
    "correct": "SUPPORTED",
    "refuted": "REFUTED",
    "refutes": "REFUTED",
    "refute": "REFUTED",
    "false": "REFUTED",
    "contradicted": "REFUTED",
    "incorrect": "REFUTED",
    "not supported": "REFUTED",
    "nei": "NEI",
    "not enough information": "NEI",
    "unknown": "NEI",
    "cannot determine": "NEI",
    "cannot be determined": "NEI",
    "insufficient": "NEI",
    "not enough evidence": "NEI",
}
NEI_WORDS = ("not enough info", "nei", "neutral", "neither", "insufficient")
SUPPORT_WORDS = ("supports", "supported", "true", "yes", "entailment", "correct")
REFUTE_WORDS = ("refutes", "refuted", "false", "no", "contradiction", "incorrect")
# Substring rules of the documented scorer variant, tried in this order.
LOOSE_LABEL_RULES = (
    ("NEI", ("not enough information", "nei", "cannot determine", "insufficient",
             "not enough evidence", "cannot be determined")),
    ("REFUTED", ("refuted", "refutes", "refute", "false", "contradicted", "incorrect",
                 "not supported")),
    ("SUPPORTED", ("supported", "supports", "support", "true", "confirmed", "correct",
                   "verified")),
)

# --- Answer patterns ---------------------------------------------------------------------
ANSWER_MARKER = r"(?:the answer is|answer:|final answer:)"
PREAMBLE = (
    "let me",
    "based on",
    "according to",
    "looking at",
    "from the",
    "to answer",
    "the passage",
    "in the",
    "first,",
    "step",
)
NUMBER = r"[-+]?[\d]*\.?[\d]+(?:[eE][-+]?\d+)?"
BOXED = r"\boxed{"
MATH_MARKERS = (
    r"(?:ANSWER|Final Answer)",
    r"(?:the answer is|equals|result is|approximately)",
)

# --- Test programs -----------------------------------------------------------------------
TEST_PROGRAM_IMPORTS = (
    "import math\n"
    "from typing import *\n"
    "import collections\n"
    "import itertools\n"
    "import re\n"
)

# --- Prompt texts ------------------------------------------------------------------------
# {context}, {question} and the like mark where columns go.
MUSIQUE_PROMPT = (
    "You are a strict reading comprehension assistant. You must analyze the context and think step-by-step out loud before answering.\n\n"
    "RULES:\n"
    "1. You must ONLY use the information provided in the Context. Do NOT use general knowledge.\n"
    "2. The answer is ALWAYS hidden somewhere in the text. You must search carefully.\n\n"
    "Context:\n{context}\n\n"
    "Question: {question}\n\n"
    "Write your step-by-step reasoning inside <scratchpad> tags. "
    "After you are done thinking, conclude your response on a new line with the exact format: 'Final Answer: <exact entity name>'. "
    "If the answer is completely missing, output 'Final Answer: NOT PRESENT IN CONTEXT'."
)
FEVER_PROMPT = (
    "Claim: {question}\n\n"
    "Based on the provided context, verify the claim. "
    "Answer strictly with one of these three labels: SUPPORTS, REFUTES, or NOT ENOUGH INFO."
)
MATH_PROMPT = "{question}\n\nPlease put your final answer enclosed in \\boxed{}."
CODE_PROMPT = "{question}"
QA_PROMPT = "{question}\n\nAnswer the question concisely with just the answer."
VOTE_PROMPT = (
    "You are evaluating three candidate answers to a question. "
    "Pick the most accurate and complete one.\n\n"
    "Question: {question}\n\n"
    "{answers}\n\n"
    "Which answer is best? Reply with only the letter A, B, or C."
)
SYNTHESIS_PROMPTS = {
    "musique": (
        "You are a strict output formatter. Your job is to extract the final answer from the primary response.\n\n"
        "STRICT RULES:\n"
        "1. Output the answer on a new line in the exact format: Final Answer: <answer>\n"
        "2. If the primary answer concludes the information is missing, output exactly: Final Answer: NOT PRESENT IN CONTEXT\n"
        "3. You must DISCARD all reasoning, steps, and explanations.\n\n"
        "Question: {question}\n\n"
        "{context_block}"
        "Primary answer (voted best):\n{winner}\n\n"
        "Other candidate answers:\n{others}\n\n"
        "Normalized final answer:"
    ),
    "fever": (
        "You are a strict output formatter. Your job is to extract the final label from the primary response.\n\n"
        "STRICT RULES:\n"
        "1. Output exactly one label: SUPPORTS, REFUTES, or NOT ENOUGH INFO.\n"
        "2. Do NOT include any explanations, reasoning, or introductory text.\n\n"
        "Claim: {question}\n\n"
        "{context_block}"
        "Primary answer (voted best):\n{winner}\n\n"
        "Other candidate answers:\n{others}\n\n"
        "Normalized final answer:"
    ),
    "math": (
        "You are a strict output formatter. Your job is to extract the final mathematical answer from the primary response.\n\n"
        "STRICT RULES:\n"
        "1. Output ONLY the final answer enclosed in \\boxed{}.\n"
        "2. Do NOT output the step-by-step derivation, prose, or commentary.\n\n"
        "Question: {question}\n\n"
        "Primary answer (voted best):\n{winner}\n\n"
        "Other candidate answers:\n{others}\n\n"
        "Normalized final answer:"
    ),
    "code": (
        "You are a strict output formatter. Your job is to extract the final executable code from the primary response.\n\n"
        "STRICT RULES:\n"
        "1. Output ONLY executable Python code.\n"
        "2. Do NOT include any explanations, prose, or introductory text (e.g. discard 'Here is the code:').\n\n"
        "Question:\n{question}\n\n"
        "Primary answer (voted best):\n{winner}\n\n"
        "Other candidate answers:\n{others}\n\n"
        "Normalized final answer:\n"
    ),
    "qa": (
        "You are a strict output formatter. Your job is to extract the final concise answer from the primary response.\n\n"
        "STRICT RULES:\n"
        "1. Output ONLY a concise direct answer with no explanation.\n"
        "2. DISCARD all reasoning and commentary.\n\n"
        "Question: {question}\n\n"
        "{context_block}"
        "Primary answer (voted best):\n{winner}\n\n"
        "Other candidate answers:\n{others}\n\n"
        "Normalized final answer:"
    ),
}
SHORT_ANSWER_PROMPT = (
    "Question: {question}\nContext: {context}\n\nAnswer the question in under 50 words."
)
FOUR_ANSWER_PROMPT = (
    "\nYou are given one question and 4 model answers.\n\n"
    "Question:\n{question}\n\n"
    "Model 1 answer:\n{model1}\n\n"
    "Model 2 answer:\n{model2}\n\n"
    "Model 3 answer:\n{model3}\n\n"
    "Model 4 answer:\n{router_response}\n\n"
    "Task:\n"
    "1. Give the best final answer to the question.\n"
    "2. Say which model answered best for this question.\n"
    "3. Briefly explain why.\n"
)
