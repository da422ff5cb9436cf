"""Text functions over string columns. Everything is a built-in expression but NFKC, which runs in Arrow
batches and only on rows that are not plain ASCII."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .prefilter import fold, may_match

# Patterns and word lists that results depend on.
URL = r"(?i)https?://\S+|www\.\S+"
DEFLECTION = [
    r"\bdm\b", r"\bdms\b", r"direct message", r"send us a (?:message|dm|note)", r"(?:shoot|slide|drop) (?:us|me) a",
    r"follow (?:us|and)", r"private message", r"\bpm us\b", r"message us",
]
CONTACT = (
    r"(get in touch|reach (?:us|out to us)|contact us|give us a (?:ring|call)|"
    r"call us|speak (?:to|with) (?:us|our)|use this link)"
)
ENGLISH = (
    "the and is was are were be been have has had do does did will would can could should my your our their this that these "
    "those with from about for not you they it its there here what when where why how please thank thanks still yet been get "
    "got give need want know said says because but they've i'm don't"
).split()
FOREIGN = (
    "que de la el los las una uno por para con sin pero como cuando donde muy este esta esto mi tu su nos ya no si sobre entre "
    "hasta desde le les des du au aux et est sont ete pour avec sans mais comme quand ou je tu il elle nous vous ils elles ce "
    "cette mon ton son pas plus tres der die das den dem ein eine einer und oder aber ist sind war waren nicht ich du er sie es "
    "wir ihr mein dein sein mit von zu auf fur uber sehr noch schon nao sim uma um dos das para com sem mas como quando onde "
    "muito este esta isso meu teu seu nos ja sobre entre ate desde voce esta estao"
).split()
DIACRITICS = r"(?iu)[ñçãõäöüßéèêàâîôûíóúáêÊ¿¡]"
PII = [
    ("payment_card", r"\b(?:\d[ -]?){13,16}\b"),
    ("email_address", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("phone_number", r"\b(?:\+?\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}\b"),
    ("order_id", r"\b\d{3}-\d{7}-\d{7}\b"),
    ("postal_address", r"\b\d{1,5}\s+\w+(?:\s+\w+){0,3}\s+(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct)\b"),
]
HARD = [
    ("legal_or_press", r"\b(lawyer|attorney|solicitor|lawsuit|sue|suing|legal action|small claims|ombudsman|journalist|reporter|bbc|press office|trading standards|attorney general)\b"),
    ("account_compromise", r"\b(hacked|compromised|unauthorou?s|unauthorized|unauthorised|fraud|fraudulent|identity theft|someone (?:else )?(?:used|accessed|ordered)|stolen card)\b"),
    ("safety_or_harm", r"\b(injur\w+|electrocut\w+|hospital|allerg\w+|poison\w+|choking|unsafe|dangerous|died|death)\b|(?:caught|catch(?:es|ing)?|on) fire\b|\bfire (?:hazard|risk)\b|\b(?:burst|bursting) into flames\b|\bstarted a fire\b|\bset (?:it|them|the \w+) alight\b|\bburn\w* (?:my|his|her|their|the) (?:hand|arm|face|skin|finger|child|baby|house|flat|home)\w*\b"),
    ("vulnerability", r"\b(suicid\w+|kill myself|self harm|disabled|carer|dementia|terminal)\b"),
]
DEFECTS = [
    ("unfilled_placeholder", r"\[(?!URL\])[A-Za-z][A-Za-z _-]{2,30}\]|\{[a-z_]{2,}\}|<insert\b|\bTODO\b|\bXX+\b"),
    ("solicits_pii_publicly", r"(share|provide|send|reply (?:to this tweet )?with|confirm)[^.?!]{0,40}\b(order (?:id|number|confirmation)|payment method|card details|email address|account email)\b"),
    ("unsupported_time_commitment", r"\b(within|in) (?:the next )?\d+ (?:hours|hrs|days|minutes)\b|\bget back to you\b|\bwill (?:contact|update|call) you\b"),
    ("internal_routing_leak", r"\bhandled by a human agent\b|\ba human will\b|\bescalat\w+ internally\b"),
]
RAGE = r"(!{3,}|\bwtf\b|\bffs\b|\bdisgrace\b|\bnever again\b|\bworst\b)"
MULTI_INTENT = r"\b(and also|as well as|plus,|second(?:ly)?,)\b"
SARCASM = r"(thanks a lot|great job|well done|brilliant|fantastic)\W*$"
GREETED = r"(?iU)^(?:hi|hey|hello|dear|sorry(?:,| to hear that,)?|thanks(?:,)?)[, ]+([a-z][a-z]{2,})\b"
NAMED_LATER = r"(?U)\b(?:sorry|apologies|thanks)[^.?!]{0,30}, ([A-Z][a-z]{2,})[!.,]"
NOT_NAMES = ["there", "all", "guys", "team", "again", "about", "for", "to"]


def any_case(pattern: str) -> str:
    """Unicode-aware word classes, any case."""
    return f"(?iU){pattern}"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfkc, "string")(text)).otherwise(text)


def normalise(text: Column, compose: bool = True) -> Column:
    """Compatibility form, URLs as <URL>, handles dropped, three entities unescaped, white space collapsed. Null is empty."""
    text = nfkc(filled(text)) if compose else filled(text)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?U)" + URL, "<URL>"), r"(?U)@\d+", ""), r"(?U)@\w{1,15}", "")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_deflection(reply: Column) -> Column:
    return filled(reply).rlike(any_case("|".join(DEFLECTION)))


def is_link_handoff(reply: Column) -> Column:
    return filled(reply).rlike(any_case(CONTACT)) & filled(reply).contains("<URL>")


def is_handoff(reply: Column) -> Column:
    return is_deflection(reply) | is_link_handoff(reply)


def latin_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(filled(text), r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(filled(text), "[^A-Za-z]", "")) / letters).otherwise(F.lit(0.0))


def function_words(text: Column) -> Column:
    """The tokens that function words are counted among."""
    return F.regexp_extract_all(F.lower(filled(text)), F.lit("([a-z']+)"), F.lit(1))


def share_of(tokens: Column, words: list[str]) -> Column:
    hits = F.size(F.filter(tokens, lambda w: w.isin(sorted(set(words)))))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))


def english_score(text: Column) -> Column:
    return share_of(function_words(text), ENGLISH)


def foreign_score(text: Column) -> Column:
    return share_of(function_words(text), FOREIGN)


def judged_english(text: Column, english: Column, foreign: Column) -> Column:
    """The verdict from both shares: callers that need it on many rows project the shares once."""
    elsewhere = (foreign > english) & (foreign >= 0.12)
    return ~(elsewhere | (filled(text).rlike(DIACRITICS) & (english < 0.08) & (foreign > 0)))


def is_probably_english(text: Column) -> Column:
    return judged_english(text, english_score(text), foreign_score(text))


def is_usable(text: Column, least: int = 15, latin: float = 0.6) -> Column:
    return (F.length(filled(text)) >= least) & (latin_ratio(text) >= latin)


def dedupe_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(filled(text)), "[^a-z0-9 ]", ""), " +", " "))


def dedupe_key(text: Column) -> Column:
    return F.sha1(dedupe_text(text))


def matches(text: Column, pattern: str, folded: Column) -> Column:
    """Whether a pattern is found in any case; it runs only where the folded text holds what every match must hold."""
    test, may = filled(text).rlike(any_case(pattern)), may_match(folded, pattern)
    return test if may is None else may & test


def first_match(text: Column, patterns: list[tuple[str, str]], folded: Column | None = None) -> Column:
    """Name of the first pattern found, in order; null if none. Lists may be a user's own. ``folded`` is the text's fold
    where it is a column of its own, so that it is made once."""
    folded = fold(filled(text)) if folded is None else folded
    return F.coalesce(*(F.when(matches(text, p, folded), F.lit(n)) for n, p in patterns))


def match_pii(text: Column, folded: Column | None = None) -> Column:
    return first_match(text, PII, folded)


def match_hard_escalation(text: Column, folded: Column | None = None) -> Column:
    return first_match(text, HARD, folded)


def all_matches(text: Column, patterns: list[tuple[str, str]], folded: Column | None = None) -> Column:
    folded = fold(filled(text)) if folded is None else folded
    return F.array_compact(F.array(*(F.when(matches(text, p, folded), F.lit(n)) for n, p in patterns)))


def draft_defects(reply: Column, folded: Column | None = None) -> Column:
    return all_matches(reply, DEFECTS, folded)


def adversarial_tags(text: Column) -> Column:
    text = filled(text)
    upper = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    tests = [
        ("very_short", F.length(text) < 40),
        ("all_caps", (F.length(text) > 20) & (upper / F.greatest(letters, F.lit(1)) > 0.7)),
        ("emoji_heavy", F.length(F.regexp_replace(text, r"[^\x{2101}-\x{10FFFF}]", "")) >= 3),
        ("multi_question", F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) >= 2),
        ("rage_markers", text.rlike(any_case(RAGE))),
        ("multi_intent", text.rlike(any_case(MULTI_INTENT))),
        ("sarcasm_marker", text.rlike(any_case(SARCASM))),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))


def carried_over_name(reply: Column, exemplars: Column) -> Column:
    """A name in the greeting that occurs as a word, in that case, in an exemplar's reply; ``exemplars`` holds brand_reply.
    A reply that opens with a greeting is judged by it alone, whatever its case; other replies by a capitalised name after an apology."""
    greeting, later = GREETED, NAMED_LATER
    name = F.coalesce(*(F.nullif(F.regexp_extract(F.trim(filled(reply)), p, 1), F.lit("")) for p in (greeting, later)))
    seen = F.exists(exemplars, lambda e: F.coalesce(F.regexp_like(e["brand_reply"], F.concat(F.lit(r"(?U)\b"), name, F.lit(r"\b"))), F.lit(False)))
    return F.when(~F.lower(name).isin(NOT_NAMES) & F.coalesce(seen, F.lit(False)), name)


def ws_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(filled(text)), r"\s+"), lambda w: w != "")


def l2_normalise(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def char_wb_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of every lower-case white-space word padded with a space on both sides."""
    padded = F.transform(ws_tokens(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    per_word = F.transform(padded, lambda w: F.flatten(F.array(*(F.when((F.length(w) >= n) | F.lit(n == low), grams(w, n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)))))
    return F.flatten(per_word)
