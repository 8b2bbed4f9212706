"""Write gates: rule-based acceptance of proposed facts, as column expressions.

The patterns are fixed values: results depend on every one of them. Word bounds in them are ASCII;
white space is that of SPACE, wherever it stands.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the patterns: more than Java's own, which is ASCII.
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SECRETS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    r"\bsk-[A-Za-z0-9_-]{20,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}",
    r"\b(?i:password|passwd|api[_-]?key|secret|token)\s*[:=]\s*(?=\S*[\d_]|\S*[^\s\w]|\S+[A-Z])\S{6,}",
)
SECRET_WORD = r"(?i)\b(?:pin|passcode|passphrase|password|passwords|combination|alarm code|door code|access code|security code|cvv|cvc|otp|one-time code|recovery code|seed phrase|iban|account number|card number)\b"
SECRET_VALUE = r"\d(?:[\s-]?\d){3,}|\b(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{12,}\b"
SECRET_STATEMENT = r"(?i)\b(?:password|passphrase|passcode|pin|seed phrase)\s+(?:is|was|:)\s+\S"
CARD_NUMBER = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}\b"
TRANSIENT = (
    r"(?i)\b(?:right now|currently|at the moment|for now|so far|just now|in progress|halfway)\b",
    r"(?i)\b(?:today|tonight|this (?:morning|afternoon|evening|week)|yesterday|tomorrow)\b",
    r"(?i)\bstep \d+ (?:of|/) \d+\b",
    r"(?i)\b\d{1,3} ?(?:%|percent)\b",
    r"(?i)\b(?:is|are|am|I'm|we're|it's) (?:running|uploading|downloading|exporting|loading|waiting|working on|deploying|building)\b",
    r"(?i)\b(?:build|job|run|pipeline|ticket|task) #?\d{3,}\b",
)
PERSONAL = (
    r"\b(?:I|I'm|I've|I'd)\b",
    r"(?i)\b(?:my|me|mine)\b",
    r"(?i)\bthe user\b|\buser's\b",
    r"\b[A-Z][a-z]+(?:'s)?\s+(?:prefers|likes|dislikes|loves|hates|wants|enjoys|is allergic|works from|is based in|reports to)\b",
    r"(?i)\b(?:prefers|favou?rite|allergic)\b",
    r"\b[A-Z][a-z]+'s (?:role|manager|team|preference|schedule|calendar)\b",
)
ORGANIZATION = (
    r"(?i)\b(?:we|our|us)\b",
    r"(?i)\b(?:the|this) (?:team|company|organi[sz]ation|department)\b",
    r"(?i)\b(?:policy|process|procedure|convention|customers?|clients?|vendors?|production|staging|service|repository|repo|release|deploy(?:ment|s)?|approved by|owned by|must|required)\b",
)
QUESTION = r"\?\s*\z"
SMALL_TALK = r"(?i)^(?:thanks|thank you|ok|okay|hi|hello|great|sounds good|got it)\b"
WORDS_OUT = tuple("a an the and or but of to in on at by for with from as is are was were be been it its this that these those there their they them then than so do does did has have had will would can could should may might not no".split(" "))
CATEGORY_RULES = (
    (r"(?i)\b(?:prefers?|likes?|dislikes?|favou?rite|would rather)\b", "preference"),
    (r"(?i)\b(?:decided|decision|chose|agreed|we will|going forward|switched to|adopted)\b", "decision"),
    (r"(?i)\b(?:learned|lesson|turns out|root cause|because)\b", "insight"),
    (r"(?i)\b(?:working on|project|currently|role is|responsible for)\b", "context"),
)
IMPORTANCE_5 = r"(?i)\b(?:compliance|legal|gdpr|hipaa|safety|security|allergic|never)\b"
IMPORTANCE_4 = r"(?i)\b(?:must|always|required|mandatory|policy|approved by|owns|owned by|decided)\b"
REASONS = ("durable", "transient", "duplicate", "appropriateAudience", "sensitive")


def java(pattern: str) -> str:
    """The pattern for Java: white space by SPACE, inside classes and outside, and ASCII word bounds."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two == r"\b":
            out.append(_BOUND)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def joined(patterns) -> str:
    """One pattern that finds, in a text after a blank, what any of the patterns finds. Those that start at a word
    bound all stand before a word, so it is enough that no word character is in front, which is read only once."""
    bound, other = [], []
    for p in patterns:
        flag, body = ("(?i:", p[4:]) if p.startswith("(?i)") else ("(?:", p)
        parts = re.split(r"\|(?=\\b)", body)  # alternatives that start at a bound
        if all(x.startswith(r"\b") for x in parts):
            bound.append(flag + "|".join(java(x[2:]) for x in parts) + ")")
        else:
            other.append(flag + java(body) + ")")
    return "|".join(([f"[^A-Za-z0-9_](?:{'|'.join(bound)})"] if bound else []) + other)


def any_of(text: Column, patterns) -> Column:
    anchored = [p for p in patterns if p.removeprefix("(?i)").startswith("^")]
    out = F.lit(False)
    for p in anchored:
        out = out | text.rlike(java(p))
    free = [p for p in patterns if p not in anchored]
    return out | F.concat(F.lit(" "), text).rlike(joined(free)) if free else out


def has(text: Column, pattern: str) -> Column:
    return any_of(text, [pattern])


def secret(text: Column) -> Column:
    return any_of(text, SECRETS)


def sensitive(text: Column) -> Column:
    return secret(text) | has(text, CARD_NUMBER) | has(text, SECRET_STATEMENT) | (has(text, SECRET_WORD) & has(text, SECRET_VALUE))


def words(text: Column) -> Column:
    got = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.array_except(got, F.array(*map(F.lit, WORDS_OUT))))


def duplicate(fact: Column, related: Column) -> Column:
    """Whether one of an array of texts holds all words of the fact, or nearly the same words."""
    a = words(fact)

    def same(t: Column) -> Column:
        b = words(t)
        n = F.size(F.array_intersect(a, b))
        return (n == F.size(a)) | (n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)) >= 0.9)

    return (F.size(a) > 0) & F.coalesce(F.exists(related, same), F.lit(False))


def durable(fact: Column) -> Column:
    return ~any_of(fact, TRANSIENT) & ~has(fact, QUESTION) & ~has(fact, SMALL_TALK) & (F.size(words(fact)) >= 3)


def audience(fact: Column, kind: Column) -> Column:
    mine, ours = any_of(fact, PERSONAL), any_of(fact, ORGANIZATION)
    return F.when(kind == "organization", ~mine | ours).otherwise(mine | ~ours)


def category(fact: Column) -> Column:
    out = F.lit("fact")
    for p, name in reversed(CATEGORY_RULES):
        out = F.when(has(fact, p), name).otherwise(out)
    return out


def importance(fact: Column) -> Column:
    return F.when(has(fact, IMPORTANCE_5), 5).when(has(fact, IMPORTANCE_4), 4).otherwise(3)


def decide(flags: dict[str, Column]) -> tuple[Column, Column]:
    """(accept, reasons): durable and appropriateAudience must hold, the others must not."""
    bad = [F.when(~flags[r] if r in ("durable", "appropriateAudience") else flags[r], F.lit(r)) for r in REASONS]
    reasons = F.array_compact(F.array(*bad))
    return F.size(reasons) == 0, reasons


def heuristic_gate(fact: Column, kind: Column, related: Column) -> Column:
    """Struct accept, reasons, category, importance (the last two null if rejected)."""
    accept, reasons = decide({"durable": durable(fact), "transient": any_of(fact, TRANSIENT), "duplicate": duplicate(fact, related), "appropriateAudience": audience(fact, kind), "sensitive": sensitive(fact)})
    return F.struct(accept.alias("accept"), reasons.alias("reasons"), F.when(accept, category(fact)).alias("category"), F.when(accept, importance(fact)).alias("importance"))


def judged_gate(probabilities: Column, threshold: float = 0.5, supersede: Column | None = None, supersede_threshold: float = 0.8) -> Column:
    """Struct accept, reasons, supersedes from a map of flag to probability; a value that is absent or not finite rejects.

    supersede is the probability that the fact replaces a known one; it counts for accepted facts only.
    """
    valid = F.lit(True)
    flags = {}
    for r in REASONS:
        p = probabilities[r]
        valid = valid & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
        flags[r] = F.coalesce(p >= threshold, F.lit(False))
    accept, reasons = decide(flags)
    valid = F.coalesce(valid, F.lit(False))
    other = F.coalesce(accept & valid & ~F.isnan(supersede) & (supersede >= supersede_threshold), F.lit(False)) if supersede is not None else F.lit(False)
    return F.struct((accept & valid).alias("accept"), F.when(valid, reasons).otherwise(F.array(F.lit("invalid-evaluation"))).alias("reasons"), other.alias("supersedes"))


def sanitize(category_: Column, importance_: Column, categories) -> Column:
    """Unknown categories and values that are no number are dropped; importance is rounded, then bounded to 1..5."""
    n = importance_.cast("double")
    fine = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.struct(F.when(category_.isin(*categories), category_).alias("category"), F.when(fine, F.greatest(F.lit(1), F.least(F.lit(5), F.floor(n + 0.5).cast("int")))).alias("importance"))
