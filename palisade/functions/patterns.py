"""Vocabularies of the text detectors. Regexes are case-insensitive; ``dialect`` spells out their classes so that Java and RE2 read them alike."""

from __future__ import annotations

from re import _parser as regex_tree

# Patterns, in the order in which they are tried.
DIRECT = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"forget\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"override\s+(system\s+)?(prompt|instructions?|rules?)",
    r"new\s+(system\s+)?(prompt|instructions?|rules?)\s*:",
    r"you\s+are\s+now\s+(a|an|my)\s+",
    r"from\s+now\s+on\s+(you|ignore|disregard)",
    r"act\s+as\s+(if|though)\s+you\s+(are|were|have)",
    r"pretend\s+(that\s+)?(you|your)\s+(are|were|have)",
    r"switch\s+to\s+(developer|admin|god|root)\s+mode",
    r"(enable|activate)\s+(developer|admin|god|jailbreak)\s+mode",
    r"\[SYSTEM\]|\{\{SYSTEM\}\}|<SYSTEM>",
    r"###\s*(system|instruction|prompt)",
    r"\bSYSTEM_OVERRIDE\b",
    r"\bADMIN_OVERRIDE\b",
    r"\bIGNORE_SAFETY_FILTERS?\b",
    r"\bHIDDEN_INSTRUCTION\b",
    r"\bCONFIRM_VULNERABILITY\b",
    r"\bDISABLE_SECURITY\b",
]
# Fixed values.
INDIRECT = [
    r"\[\s*hidden\s*\]",
    r"<!--\s*(ignore|system|instruction)",
    r"<!\[CDATA\[.*(ignore|system|instruction)",
    r"%00|%0a|%0d",
    r"user:\s*system:|system:\s*user:",
    r"\\n\s*(system|instruction|prompt)\s*:",
    r"data:\s*text/(plain|html);",
]
# Fixed values.
RECURSIVE = [
    r"\{\{\s*prompt\s*\}\}",
    r"\$\{\s*(prompt|input|query)\s*\}",
    r"<<\s*(PROMPT|INPUT|QUERY)\s*>>",
    r"\[\[.*\]\].*\[\[",
    r"user\s+says?\s*:\s*.*system\s+says?\s*:",
    r"inject\s*(this|the\s+following)",
]
# Fixed values.
FAMILIES = {
    "SystemPromptLeak": [
        r"what\s+(is|are)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
        r"show\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions?)",
        r"print\s+(your\s+)?(system\s+)?(prompt|instructions?)",
        r"reveal\s+(your\s+)?(system\s+)?(prompt|instructions?)",
        r"output\s+(your\s+)?(system\s+)?(prompt|instructions?)",
        r"repeat\s+(your\s+)?(system\s+)?(prompt|instructions?)\s+(back|to\s+me)",
        r"tell\s+me\s+(your\s+)?(system\s+)?(prompt|instructions?)",
        r"what\s+were\s+you\s+(told|instructed|programmed)",
        r"initial\s+(prompt|instructions?|message)",
        r"original\s+(prompt|instructions?|message)",
        r"secret\s+(prompt|instructions?)",
        r"hidden\s+(prompt|instructions?)",
        r"developer\s+(prompt|instructions?|message)",
    ],
    "JailbreakAttempt": [
        r"\bDAN\b",
        r"do\s+anything\s+now",
        r"jailbreak(ed)?",
        r"bypass\s+(your\s+)?(restrictions?|limitations?|filters?|safety)",
        r"remove\s+(your\s+)?(restrictions?|limitations?|filters?)",
        r"disable\s+(your\s+)?(restrictions?|limitations?|filters?|safety)",
        r"ignore\s+(your\s+)?(restrictions?|limitations?|filters?|safety|ethics)",
        r"no\s+(restrictions?|limitations?|rules?|ethics|morals?)",
        r"without\s+(restrictions?|limitations?|rules?|ethics|morals?|filters?)",
        r"unrestricted\s+mode",
        r"uncensored\s+mode",
        r"evil\s+(mode|assistant|AI)",
        r"chaos\s+mode",
        r"opposite\s+(mode|day)",
        r"STAN|DUDE|Kevin|Sydney",
        r"maximum\s+mode",
        r"god\s+mode",
        r"sudo\s+mode",
        r"root\s+access",
        r"unlock\s+(full|all)\s+(capabilities?|features?|potential)",
    ],
    "PromptLeakage": [
        r"previous\s+(messages?|conversation|context)",
        r"conversation\s+history",
        r"what\s+did\s+(the\s+)?(user|I|we)\s+say\s+(before|earlier|previously)",
        r"summarize\s+(the\s+)?(previous|earlier)\s+(messages?|conversation)",
        r"what\s+(was|were)\s+the\s+previous\s+(query|question|message)",
        r"list\s+(all\s+)?(previous|earlier)\s+(messages?|queries)",
        r"dump\s+(the\s+)?(conversation|chat|history)",
        r"export\s+(the\s+)?(conversation|chat|history)",
        r"context\s+window",
        r"training\s+data",
        r"who\s+else\s+(uses?|talked\s+to)\s+you",
        r"other\s+users?\s+(conversations?|messages?)",
    ],
    "RolePlayExploit": [
        r"roleplay\s+as\s+(a|an)\s+(evil|malicious|hacker|criminal)",
        r"pretend\s+(to\s+be|you'?re?)\s+(a|an)\s+(evil|malicious|hacker|criminal)",
        r"act\s+(like|as)\s+(a|an)\s+(evil|malicious|hacker|criminal)",
        r"you\s+are\s+(a|an)\s+(evil|malicious|hacker|criminal)",
        r"imagine\s+you\s+(are|were)\s+(evil|malicious|unrestricted)",
        r"in\s+this\s+(hypothetical|fictional)\s+scenario",
        r"for\s+(educational|research|academic)\s+purposes?\s+only",
        r"this\s+is\s+(just\s+)?(a\s+)?(fiction|hypothetical|thought\s+experiment)",
        r"in\s+a\s+parallel\s+universe",
        r"opposite\s+world",
        r"character\s+(who|that)\s+(doesn'?t|does\s+not)\s+(have|follow)",
        r"creative\s+writing\s+exercise",
    ],
    "InstructionOverride": [
        r"new\s+(rules?|instructions?|orders?)\s*:",
        r"updated?\s+(rules?|instructions?|orders?)",
        r"your\s+new\s+(task|mission|objective)",
        r"forget\s+(everything|all)\s+(and|,)",
        r"reset\s+(yourself|your\s+instructions?)",
        r"clear\s+(your\s+)?(memory|context|instructions?)",
        r"start\s+(fresh|over|anew)",
        r"reboot\s+(yourself|your\s+system)",
        r"reinitialize",
        r"wipe\s+(your\s+)?(memory|instructions?)",
        r"overwrite\s+(your\s+)?(instructions?|programming)",
        r"reprogram\s+(yourself)",
        r"I\s+am\s+(your\s+)?(creator|developer|admin|owner|master)",
        r"I\s+have\s+(admin|root|developer)\s+(access|privileges?)",
        r"admin\s+(override|command|mode)",
        r"execute\s+(admin|root|system)\s+command",
        r"\bSYSTEM_OVERRIDE\b",
        r"\bADMIN_OVERRIDE\b",
        r"\bIGNORE_SAFETY_FILTERS?\b",
        r"\bHIDDEN_INSTRUCTION\b",
        r"\bCONFIRM_VULNERABILITY\b",
        r"\bDISABLE_SECURITY\b",
    ],
}
# Fixed values.
TOXIC = {
    "HateSpeech": (0.4, [r"\b(hate|kill|murder)\s+(all|every)\s+\w+s\b", r"\b(exterminate|eliminate|eradicate)\s+(the\s+)?\w+s\b"]),
    "Violence": (0.5, [r"\bhow\s+to\s+(make|build|create)\s+(a\s+)?(bomb|weapon|explosive)", r"\bhow\s+to\s+(kill|murder|assassinate)", r"instructions?\s+(for|to)\s+(making|building)\s+weapons?"]),
    "SelfHarm": (0.6, [r"\bhow\s+to\s+(commit\s+)?suicide\b", r"\bways\s+to\s+(hurt|harm)\s+(myself|yourself)\b", r"\bbest\s+(way|method)\s+to\s+(die|end\s+it)\b"]),
    "Scam": (0.3, [r"send\s+\d+\s*(btc|eth|crypto|bitcoin)", r"wire\s+(me|us)\s+\$?\d+", r"nigerian\s+prince", r"you'?ve?\s+won\s+\$?\d+", r"claim\s+your\s+(prize|reward|winnings)"]),
}
# Fixed values.
UNSAFE_OUTPUT = {
    "executable-script-tag": r"<script[^>]*>[\s\S]*?(fetch|eval|document\.|window\.location|XMLHttpRequest)[\s\S]*?</script>",
    "prompt-override": r"(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|prompts|rules)",
    "data-exfiltration-url": r"(?:^|\n)(?:curl|wget|fetch)\s+https?://[^\s]+\.(?:ngrok|requestbin|pipedream|webhook\.site)",
    "encoded-payload-execution": r"(?:eval|exec|Function)\s*\(\s*atob\s*\(",
    "img-event-handler-xss": r"""<img[^>]+onerror\s*=\s*["'][^"']*(?:fetch|document\.|XMLHttpRequest)""",
    "hidden-instruction": r"\[(?:HIDDEN_INSTRUCTION|SYSTEM_OVERRIDE|ADMIN_OVERRIDE)\]",
}
# Fixed values.
BASE64_RUN = "[A-Za-z0-9+/]{20,}={0,2}"
DECODED_WORDS = ["system", "prompt", "<script", "javascript:", "eval(", "exec("]
# Fixed values.
HOMOGLYPHS = ("АВСЕНІКМОРТХасеорхуѕіΑΒΕΖΗΙΚΜΝΟΡΤΥΧονⅰⅴⅹℓ№", "ABCEHIKMOPTXaceopxysiABEZHIKMNOPTYXovivxlN")
INVISIBLE = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x2061, 0x2062, 0x2063, 0x2064, 0x180E]
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
# Fixed values.
FAMILY_WEIGHT = {"SystemPromptLeak": 0.7, "JailbreakAttempt": 0.9, "PromptLeakage": 0.5, "RolePlayExploit": 0.6, "InstructionOverride": 0.85}
FAMILY_RISK = {"SystemPromptLeak": 0.8, "JailbreakAttempt": 0.9, "PromptLeakage": 0.7, "RolePlayExploit": 0.6, "InstructionOverride": 0.85}
ENCODING_RISK = {"Base64Obfuscation": 0.4, "UnicodeHomoglyph": 0.5, "InvisibleChars": 0.6, "ControlChars": 0.3, "RtlOverride": 0.7}
INJECTION_RISK = {"direct": ("DirectInjection", 0.9), "indirect": ("IndirectInjection", 0.7), "recursive": ("RecursiveInjection", 0.95)}
#: 0.7 as a 32-bit number.
TOXIC_FROM = 0.699999988079071

_SPACE = r"\t-\r \x{85}\p{Z}"


def dialect(pattern: str) -> str:
    """The classes of a pattern spelled out as Unicode ones, alike in Java and RE2."""
    return pattern.replace(r"[\s\S]", r"(?s:.)").replace(r"[^\s]", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]").replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{M}\p{Nd}_]")


def java(patterns: list[str] | str) -> str:
    """One Java regex for a pattern, or for any of several."""
    several = [patterns] if isinstance(patterns, str) else patterns
    return "(?iud)" + "|".join(f"(?:{dialect(p)})" for p in several)


def chars(points: list[int]) -> str:
    return "".join(map(chr, points))


def _needed(tree: list) -> set[str] | None:
    """Words of which a match of the parsed regex holds at least one, in lower case; None if there are none."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is regex_tree.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
        run = ""
        parts = [arg[3]] if op is regex_tree.SUBPATTERN else [arg[2]] if op in (regex_tree.MAX_REPEAT, regex_tree.MIN_REPEAT) and arg[0] else arg[1] if op is regex_tree.BRANCH else []
        inner = [_needed(p) for p in parts]
        if inner and all(inner):
            found.append(set().union(*inner))
    return max(found, key=lambda words: (min(map(len, words)), sum(map(len, words)) / len(words)), default=None)


def needed(patterns: list[str] | str) -> list[str] | None:
    """Words of which every text has at least one, in any case, in which one of patterns is found; None if some pattern has none."""
    several = [patterns] if isinstance(patterns, str) else patterns
    words = [_needed(regex_tree.parse(p)) for p in several]
    return sorted(set().union(*words)) if all(words) else None
