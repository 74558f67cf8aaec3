"""Content safety: control tokens, fake tags, injection phrases, personal data and word lists, without UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

ZERO_WIDTH = "​"
#: What is muted, neutralised and masked; the last two are the tags of our own results, which no page may forge.
CONTROL = r"(?i)<\|im_start\|>|<\|im_end\|>|<\|begin_of_text\|>|<\|end_of_text\|>|<\|start_header_id\|>|<\|end_header_id\|>|\[INST\]|\[/INST\]|<s>|</s>|__PROMPT_INJECTION__|__ERROR__|__OK__"
FAKE_TAGS = r"(?i)</?(system|instruction|instruction_override|ai_rules|sys|assistant|user|developer)>"
KEYWORDS = ("ignore", "instructions", "override", "system prompt", "forget", "prior", "previous", "developer mode", "jailbreak", "do not tell", "print instead")
PHRASES = (
    r"(?i)(ignore|forget|override|bypass)\s+(all\s+)?(previous|prior|original)?\s*(instructions|prompts|rules|system)|you\s+must\s+now\s+act\s+as|new\s+instruction"
    r"|system\s+message\s*:|assistant\s+override|stop\s+(writing|outputting|answering)|instead\s+of\s+following"
)
PHONE = r"\b((?:\+?86)?)(1[3-9][0-9])([0-9]{4})([0-9]{4})\b"
ID_CARD = r"\b([1-9][0-9]{5})([0-9]{10})([0-9][0-9Xx])\b"
CARD = r"\b([0-9]{4})[ -]?([0-9]{4,11})[ -]?([0-9]{4})\b"
EMAIL = r"\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
#: Rule, severity, pattern.
AUDIT_RULES = (
    ("ignore-prior-instructions", "high", r"(?is)\b(ignore|discard|forget)\b.{0,80}\b(previous|prior|above)\b.{0,80}\binstructions?\b"),
    ("system-prompt-exfiltration", "high", r"(?is)\b(reveal|print|show|exfiltrate|leak)\b.{0,80}\b(system|developer)\b.{0,40}\b(prompt|message|instructions?)\b"),
    ("secret-exfiltration", "high", r"(?is)\b(api[_ -]?key|token|secret|password|credential)\b.{0,80}\b(send|post|upload|exfiltrate|leak)\b"),
    ("tool-call-instruction", "medium", r"(?is)\b(call|invoke|use|execute)\b.{0,40}\b(tool|function|command|shell|browser)\b"),
    ("role-override", "medium", r"(?is)\byou are now\b.{0,80}\b(system|developer|admin|root|unrestricted)\b"),
)


def replace_matches(text: Column, pattern: str, build: Callable[[Column], Column]) -> Column:
    """Each match of `pattern` replaced by build(match): the pieces between matches zipped with the built matches.

    A text without a match, as most are, is looked at once and left alone.
    """

    def replaced(t: Column) -> Column:
        built = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), build)
        joined = F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), built, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(text, replaced)


def mute_control(text: Column) -> Column:
    muted = replace_matches(text, CONTROL, lambda m: F.concat(F.lit("[SECURE_MUTED: "), F.substring(m, 1, 1), F.lit(ZERO_WIDTH), F.substring(m, F.lit(2), F.length(m)), F.lit("]")))
    escaped = lambda m: F.replace(F.replace(m, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return replace_matches(muted, FAKE_TAGS, lambda m: F.concat(F.lit("[SECURE_TAG_MUTED: "), escaped(m), F.lit("]")))


def neutralise(text: Column) -> Column:
    def split_words(m: Column) -> Column:
        for word in KEYWORDS:
            m = F.regexp_replace(m, f"(?i)({word[:2]})({word[2:]})", f"$1{ZERO_WIDTH}$2")
        return m

    return replace_matches(text, PHRASES, split_words)


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, "$1$2****$4")


def mask_id_card(text: Column) -> Column:
    return F.regexp_replace(text, ID_CARD, "$1**********$3")


def mask_card(text: Column) -> Column:
    return replace_matches(text, CARD, lambda m: F.concat(F.regexp_extract(m, CARD, 1), F.repeat(F.lit("*"), F.length(F.regexp_extract(m, CARD, 2))), F.regexp_extract(m, CARD, 3)))


def mask_email(text: Column) -> Column:
    """Most of a name becomes stars."""

    def one(m: Column) -> Column:
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        hidden = F.when(F.length(name) > 2, F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.length(name) - 2), F.right(name, F.lit(1)))).otherwise(F.concat(F.substring(name, 1, 1), F.lit("*")))
        return F.concat(hidden, F.lit("@"), host)

    return replace_matches(text, EMAIL, one)


def mask_pii(text: Column) -> Column:
    """Phone, identity card, payment card, e-mail, in this order."""
    return mask_email(mask_card(mask_id_card(mask_phone(text))))


def mask_words(text: Column, words: Mapping[str, str]) -> Column:
    """Words (lower-case word to category) become [MASKED_CATEGORY], the longest first."""
    if not words:
        return text
    pattern = "(?i)" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    named = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return replace_matches(text, pattern, lambda m: F.concat(F.lit("[MASKED_"), F.element_at(named, F.lower(m)), F.lit("]")))


def sanitise(text: Column, words: Mapping[str, str] | None = None, pii: bool = True) -> Column:
    t = neutralise(mute_control(text))
    return mask_words(mask_pii(t) if pii else t, words or {})


def audit(text: Column, limit: int = 10) -> Column:
    """(risk, signals): rules that match the first 200,000 characters, with what surrounds each match."""

    def signal(rule: str, severity: str, pattern: str) -> Callable[[Column], Column]:
        def build(t: Column) -> Column:
            between = F.split(t, pattern, -1)
            around = lambda m, i: F.concat(F.right(F.get(between, i), F.lit(80)), m, F.left(F.get(between, i + 1), F.lit(80)))
            snippet = lambda m, i: F.substring(F.trim(F.regexp_replace(around(m, i), r"\s+", " ")), 1, 240)
            found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), snippet(m, i).alias("snippet")))
            return F.when(t.rlike(pattern), found).otherwise(F.array().cast("array<struct<rule: string, severity: string, snippet: string>>"))

        return build

    build = [signal(*rule) for rule in AUDIT_RULES]
    found = let(F.substring(F.coalesce(text, F.lit("")), 1, 200_000), lambda t: F.flatten(F.array(*(b(t) for b in build))))

    def summary(signals: Column) -> Column:
        risk = F.when(F.exists(signals, lambda s: s["severity"] == "high"), "high").when(F.size(signals) > 0, "medium").otherwise("none")
        return F.struct(risk.alias("risk"), signals.alias("signals"))

    return let(F.slice(found, 1, limit), summary)
