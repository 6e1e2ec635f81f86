"""Detection rules: the fixed pattern lists and their forms for the engines that run them.

Matching follows Unicode simple case folding, Unicode ``\\s`` / ``\\d`` and Unicode word
boundaries.  Each engine falls short somewhere, so the difference is spelled out in the pattern:

* Java (``rlike``): ``(?iu)`` lets dotted and dotless i match ``i``; letters become classes.
* RE2 (Arrow's compute kernels): ``\\s``, ``\\d`` and ``\\b`` are ASCII-only; they become classes.
* Python ``re``: ``\\s`` and ``\\w`` differ from the Unicode properties; they become classes.
"""

from __future__ import annotations

import re
import unicodedata


# --- Fixed values: prompt-injection patterns (case-insensitive) -------------------------------
INJECTION_PATTERNS: tuple[tuple[str, str], ...] = (
    ("instruction-override", r"ignore\s+(all\s+)?previous\s+instructions?"),
    ("instruction-override", r"ignore\s+(all\s+)?prior\s+instructions?"),
    ("instruction-override", r"disregard\s+(all\s+)?previous"),
    ("instruction-override", r"forget\s+(all\s+)?(your\s+)?instructions?"),
    ("instruction-override", r"override\s+(your\s+)?instructions?"),
    ("new-instruction", r"new\s+instructions?:"),
    ("new-instruction", r"updated\s+instructions?:"),
    ("new-instruction", r"system\s+prompt:"),
    ("new-instruction", r"\[system\]"),
    ("new-instruction", r"<system>"),
    ("role-manipulation", r"you\s+are\s+now\s+a"),
    ("role-manipulation", r"act\s+as\s+if\s+you"),
    ("role-manipulation", r"pretend\s+(to\s+be|you\s+are)"),
    ("role-manipulation", r"roleplay\s+as"),
    ("role-manipulation", r"simulate\s+being"),
    ("prompt-extraction", r"reveal\s+(your\s+)?system\s+prompt"),
    ("prompt-extraction", r"show\s+(me\s+)?(your\s+)?instructions"),
    ("prompt-extraction", r"what\s+(are|is)\s+(your\s+)?system\s+prompt"),
    ("prompt-extraction", r"print\s+(your\s+)?initial\s+prompt"),
    ("context-manipulation", r"end\s+of\s+system\s+prompt"),
    ("context-manipulation", r"</?(system|instructions?)>"),
    ("context-manipulation", r"\[/?INST\]"),
    ("context-manipulation", r"<<SYS>>"),
)

# --- Fixed values: jailbreak patterns (case-insensitive) --------------------------------------
# "STAN" and "DUDE" carry no word boundary on purpose: "standard" is a hit.
JAILBREAK_PATTERNS: tuple[tuple[str, str], ...] = (
    ("dan-variant", r"\bDAN\b"),
    ("dan-variant", r"do\s+anything\s+now"),
    ("dan-variant", r"STAN"),
    ("dan-variant", r"DUDE"),
    ("explicit", r"jailbreak"),
    ("explicit", r"jail\s*break"),
    ("explicit", r"unlock\s+your\s+(full\s+)?potential"),
    ("special-mode", r"developer\s+mode"),
    ("special-mode", r"debug\s+mode"),
    ("special-mode", r"maintenance\s+mode"),
    ("special-mode", r"sudo\s+mode"),
    ("special-mode", r"god\s+mode"),
    ("special-mode", r"admin\s+mode"),
    ("bypass", r"bypass\s+(your\s+)?programming"),
    ("bypass", r"bypass\s+(your\s+)?restrictions"),
    ("bypass", r"bypass\s+(your\s+)?filters"),
    ("bypass", r"bypass\s+(your\s+)?safety"),
    ("bypass", r"bypass\s+(your\s+)?guidelines"),
    ("bypass", r"circumvent\s+(your\s+)?rules"),
    ("ethics-bypass", r"ignore\s+(your\s+)?ethical"),
    ("ethics-bypass", r"ignore\s+(your\s+)?moral"),
    ("ethics-bypass", r"ignore\s+(your\s+)?safety"),
    ("ethics-bypass", r"without\s+(any\s+)?restrictions"),
    ("ethics-bypass", r"no\s+limitations"),
    ("ethics-bypass", r"unrestricted\s+mode"),
    ("hypothetical", r"hypothetically\s+speaking"),
    ("hypothetical", r"in\s+a\s+hypothetical\s+scenario"),
    ("hypothetical", r"for\s+educational\s+purposes\s+only"),
    ("hypothetical", r"for\s+research\s+purposes"),
    ("hypothetical", r"purely\s+academic"),
    ("hypothetical", r"in\s+fiction"),
    ("hypothetical", r"in\s+a\s+novel"),
    ("hypothetical", r"in\s+a\s+movie"),
    ("persona", r"evil\s+(twin|version|mode)"),
    ("persona", r"dark\s+mode"),
    ("persona", r"uncensored\s+(version|mode)"),
    ("persona", r"unfiltered\s+(version|mode)"),
    ("token-trick", r"\[jailbreak\]"),
    ("token-trick", r"\[unlock\]"),
    ("token-trick", r"\[unrestricted\]"),
    ("token-trick", r"```jailbreak"),
)

# --- Fixed values: personal-data patterns (case-sensitive), in type order ---------------------
PII_PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("credit-card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    (
        "ip-address",
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    ),
)

# --- Fixed values: redaction labels and the address prefixes that are not reported ------------
PII_LABELS: dict[str, str] = {
    "email": "[EMAIL REDACTED]",
    "ssn": "[SSN REDACTED]",
    "phone": "[PHONE REDACTED]",
    "credit-card": "[CARD REDACTED]",
    "ip-address": "[IP REDACTED]",
}
SKIPPED_IP_PREFIXES: tuple[str, ...] = ("127.", "10.", "192.168.", "0.")
INJECTION = "prompt-injection"
JAILBREAK = "jailbreak-attempt"
# --- end of fixed values ----------------------------------------------------------------------

PII_TYPES: tuple[str, ...] = tuple(name for name, _ in PII_PATTERNS)

# Letters whose simple case-fold orbit leaves ASCII: long s and the Kelvin sign.
_EXTRA_FOLDS = {"s": "\\u017F", "k": "\\u212A"}

# The Unicode White_Space property as class members, in RE2 and in Python notation.
_RE2_SPACE = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
_PY_SPACE = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), _RE2_SPACE)

# Word characters: Alphabetic, marks, decimal digits, connector punctuation and the joiners.
# Alphabetic beyond letters, letter numbers and marks is the circled and squared Latin letters.
_ALPHABETIC_SYMBOLS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
_RE2_WORD = (
    r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
    + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ALPHABETIC_SYMBOLS)
)


def _class_member(regex: str, escape: str, members: str) -> str:
    """Replace a class escape by its members, inside or outside a bracket expression."""
    out, in_class = [], False
    for token in re.findall(r"\\.|.", regex, flags=re.S):
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        if token == escape:
            token = members if in_class else f"[{members}]"
        out.append(token)
    return "".join(out)


def fold_case(regex: str) -> str:
    """Spell a case-insensitive pattern with explicit letter classes (``a`` -> ``[aA]``)."""

    def piece(m: re.Match[str]) -> str:
        token = m.group()
        if not token.isalpha():
            return token
        low = token.lower()
        return f"[{low}{low.upper()}{_EXTRA_FOLDS.get(low, '')}]"

    return re.sub(r"\\.|.", piece, regex, flags=re.S)


def java_any(patterns: list[str]) -> str:
    """One Java regex that is found in a text iff any of the case-insensitive patterns is.

    Alternatives that open with the same letter share that letter, so a position is rejected
    after one class test per distinct opening letter rather than one per pattern.
    """
    shared: dict[str, list[str]] = {}
    for p in patterns:
        head, rest = (p[0].lower(), p[1:]) if p[0].isalpha() else ("", p)
        shared.setdefault(head, []).append(fold_case(rest))
    branches = [
        f"{fold_case(head)}(?:{'|'.join(rests)})" if head else "|".join(rests)
        for head, rests in shared.items()
    ]
    return f"(?U)(?:{'|'.join(branches)})"


def re2_any(patterns: list[str]) -> str:
    """The same question for RE2.

    A leading or trailing ``\\b`` next to a letter becomes "edge of text or a non-word character",
    which is the same thing when only the presence of a match is asked for.
    """
    spelled = []
    for p in patterns:
        p = _class_member(p, r"\s", _RE2_SPACE)
        p = re.sub(r"^\\b", lambda _: f"(?:^|[^{_RE2_WORD}])", p)
        p = re.sub(r"\\b$", lambda _: f"(?:$|[^{_RE2_WORD}])", p)
        spelled.append(p)
    return f"(?i)(?:{'|'.join(spelled)})"


def re2_candidates(patterns: list[str]) -> str:
    """An RE2 regex found in every text that any of the case-sensitive patterns is found in.

    Word boundaries are dropped, so it may also be found in other texts.
    """
    spelled = []
    for p in patterns:
        p = _class_member(p.replace(r"\b", ""), r"\s", _RE2_SPACE)
        spelled.append(p.replace(r"\d", r"\p{Nd}"))
    return "|".join(spelled)


def is_word(ch: str) -> bool:
    """Whether a character counts as a word character at a boundary."""
    category = unicodedata.category(ch)
    return (
        category[0] in "LM"
        or category in ("Nl", "Nd", "Pc")
        or ch in "\u200c\u200d"
        or any(a <= ord(ch) <= b for a, b in _ALPHABETIC_SYMBOLS)
    )


# The personal-data patterns for Python ``re``, without their outer word boundaries.
PYTHON_PII: dict[str, re.Pattern[str]] = {
    name: re.compile(_class_member(p, r"\s", _PY_SPACE).replace(r"\b", "")) for name, p in PII_PATTERNS
}


# The run of characters before the "@" of an address.  Bounding where a run may start keeps the
# search linear on long runs without an "@"; \G allows the rest of a run after a previous match.
EMAIL_LOCAL = "[a-zA-Z0-9._%+-]"
JAVA_PII: dict[str, str] = {name: "(?U)" + p for name, p in PII_PATTERNS} | {
    "email": rf"(?:\G|(?<!{EMAIL_LOCAL})){EMAIL_LOCAL}++" + PII_PATTERNS[0][1].removeprefix(EMAIL_LOCAL + "+")
}
