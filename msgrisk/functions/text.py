"""Text column builders. Every function takes and returns ``Column``.

Character classes are written out so that word, digit and space keep their Unicode
meaning in Java regular expressions, which are ASCII-only by default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
# Unicode white space: the plain blank and everything else.
RARE_SPACE = r"\t\n\x0B\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = " " + RARE_SPACE
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
BEFORE_WORD = rf"(?<![{WORD}])"
AFTER_WORD = rf"(?![{WORD}])"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def literals(values) -> Column:
    """A constant array of strings, built in one call."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})") if quoted else F.expr("cast(array() as array<string>)")


def replace_all(column: Column, pairs) -> Column:
    """Literal replacements applied left to right."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def strip(text) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(_col(text), F.lit(SPACE_CHARS))


def squeeze_space(text) -> Column:
    """One blank per run of white space, none at the ends."""
    # Single blanks, by far the most common run, never match.
    return F.trim(F.regexp_replace(_col(text), rf"[{RARE_SPACE}][{SPACE}]*| [{SPACE}]+", " "))


def casefold(text) -> Column:
    """Case folding: the upper/lower round trip also expands sharp s."""
    return F.lower(F.upper(_col(text)))


def nonspace_count(text) -> Column:
    return F.length(F.regexp_replace(_col(text), rf"[{SPACE}]", ""))


def _mask_if(c: Column, possible: Column, pattern: str, mask: str) -> Column:
    """Run a costly pattern only on texts that pass a cheap literal test."""
    return F.when(possible, F.regexp_replace(c, pattern, mask)).otherwise(c)


# --- families, fingerprints ----------------------------------------------------------


def text_family(text) -> Column:
    """Normalized message family: mailboxes, links and whole numbers are masked."""
    c = F.lower(strip(text))
    c = _mask_if(c, c.contains("@"), rf"{EDGE}[{WORD}.+-]+@[{WORD}.-]+\.[a-z]{{2,}}{EDGE}", " <email> ")
    c = _mask_if(c, c.contains("://") | c.contains("www."), rf"{EDGE}(?:https?://|www\.)[^{SPACE}]+", " <url> ")
    # The digit comes before the look-behind: most positions fail on one cheap test.
    c = F.regexp_replace(c, rf"\p{{Nd}}(?<![{WORD}]\p{{Nd}})\p{{Nd}}*+{AFTER_WORD}", " <number> ")
    return squeeze_space(c)


def family_id(text) -> Column:
    return F.concat(F.lit("content:"), F.substring(F.sha2(text_family(text), 256), 1, 20))


def template_text(text) -> Column:
    c = casefold(text)
    c = _mask_if(c, c.contains("://"), rf"https?://[^{SPACE}<>]+", "<url>")
    c = _mask_if(c, c.contains("@"), rf"{EDGE}[{WORD}.+-]+@[{WORD}.-]+\.[a-z]{{2,}}{EDGE}", "<email>")
    c = F.regexp_replace(c, r"\p{Nd}+", "<number>")
    return squeeze_space(c)


def template_fingerprint(text, min_chars: int = 80, min_words: int = 12) -> Column:
    """Template digest, or null for texts too short to identify a template."""
    c = template_text(text)
    long_enough = (F.length(c) >= min_chars) & (F.size(F.split(c, " ")) >= min_words)
    return F.when(long_enough, F.sha2(c, 256))


# --- character statistics ------------------------------------------------------------


def characters(text) -> Column:
    """Code points of the text as an array (empty for an empty text)."""
    return F.filter(F.split(_col(text), ""), lambda ch: ch != "")


def shannon_entropy(text) -> Column:
    """Bits per character."""
    c = _col(text)
    n = F.length(c)
    counts = F.transform(
        F.array_distinct(characters(c)),
        lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))).cast("double") / n,
    )
    total = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def class_count(text, char_class: str) -> Column:
    """How many characters fall in a (literal) regular-expression class."""
    c = _col(text)
    return F.length(c) - F.length(F.regexp_replace(c, char_class, ""))


def digit_ratio(text) -> Column:
    c = _col(text)
    return class_count(c, r"\p{Nd}") / F.greatest(F.length(c), F.lit(1))


def vowel_ratio(text) -> Column:
    """Share of a, e, i, o, u among the letters."""
    c = _col(text)
    return class_count(c, "[aeiou]") / F.greatest(class_count(c, r"\p{L}"), F.lit(1))


def unique_ratio(text) -> Column:
    c = _col(text)
    return F.size(F.array_distinct(characters(c))) / F.greatest(F.length(c), F.lit(1))


def repeat_ratio(text) -> Column:
    """Share of the most frequent character."""
    c = _col(text)
    counts = F.transform(
        F.array_distinct(characters(c)), lambda ch: F.length(c) - F.length(F.replace(c, ch, F.lit("")))
    )
    return F.coalesce(F.array_max(counts), F.lit(0)) / F.greatest(F.length(c), F.lit(1))


def uppercase_ratio(text) -> Column:
    c = _col(text)
    letters = class_count(c, r"\p{L}")
    return F.when(letters > 0, class_count(c, r"\p{Lu}") / letters).otherwise(F.lit(0.0))


# --- look-alike spellings ------------------------------------------------------------

# Substitutions that must agree with the detector definition.
DOUBLE_GLYPHS = [("vv", "w"), ("rn", "m"), ("nn", "m"), ("cl", "d")]
SINGLE_GLYPHS = [("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "g"), ("8", "b"), ("@", "a")]
LINK_DIGITS = ("013457", "oleast")
CONFUSABLES = ("аеіјорсхуӏαεικορτυχ", "aeijopcxylaeikoptyx")
OBFUSCATED_TERMS = [
    (r"p[@4]yp[@4]l", "PayPal"),
    (r"am[@4]z[o0]n", "Amazon"),
    (r"[a4]ppl[e3]", "Apple"),
    (r"m[i1]cr[o0]s[o0]ft", "Microsoft"),
    (r"g[o0][o0]gl[e3]", "Google"),
    (r"n[e3]tfl[i1]x", "Netflix"),
    (r"[i1]nst[@a4]gr[@a4]m", "Instagram"),
    (r"f[@a4]c[e3]b[o0][o0]k", "Facebook"),
    (r"[l1][o0]g[i1]n", "login"),
    (r"v[e3]r[i1]fy", "verify"),
    (r"[a4]cc[o0]unt", "account"),
    (r"p[@a4]ssw[o0]rd", "password"),
    (r"b[a4]nk", "bank"),
]


def normalize_homoglyphs(text) -> Column:
    """Undo common look-alike spellings: doubled glyphs first, then single ones."""
    c = replace_all(F.lower(_col(text)), DOUBLE_GLYPHS)
    return F.translate(c, "".join(a for a, _ in SINGLE_GLYPHS), "".join(b for _, b in SINGLE_GLYPHS))


def digit_lookalike(text) -> Column:
    return F.translate(_col(text), *LINK_DIGITS)


def latin_skeleton(text) -> Column:
    """Confusable skeleton for ASCII, Latin accents and the mapped Greek/Cyrillic letters.

    Spark has no Unicode normalization; ``functions.unicode.confusable_skeleton`` routes
    the remaining characters through an Arrow function.
    """
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(casefold(text), accented + CONFUSABLES[0], plain + CONFUSABLES[1])


def _changed_spelling(plain: str):
    return lambda m: (m != plain) & (normalize_homoglyphs(m) == plain)


def obfuscated_terms(text) -> Column:
    """Protected terms spelled with substitutions; plain spellings never count."""
    c = F.lower(_col(text))
    found = []
    for pattern, term in OBFUSCATED_TERMS:
        hits = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
        plain = term.lower()
        changed = F.exists(hits, _changed_spelling(plain))
        found.append(F.when(changed, F.lit(term)))
    # A changed spelling always has a substitute next to a letter.
    possible = c.rlike("[a-z][0134@]|[0134@][a-z]")
    return F.when(possible, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>"))


# --- phrases -------------------------------------------------------------------------


def escape_regex(phrase: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in phrase)


def phrase_pattern(phrase: str) -> str:
    """Whole-phrase pattern: no word character next to an alphanumeric edge."""
    head = BEFORE_WORD if phrase[:1].isalnum() else ""
    tail = AFTER_WORD if phrase[-1:].isalnum() else ""
    return head + escape_regex(phrase) + tail


def keyword_match(lowered_text, phrase: str) -> Column:
    """Cheap substring test first, boundary test only where it can matter."""
    c = _col(lowered_text)
    phrase = phrase.lower()
    return c.contains(phrase) & c.rlike(phrase_pattern(phrase))


def strip_format_controls(text) -> Column:
    return F.regexp_replace(_col(text), r"\p{Cf}", "")


# Phrases that must agree with the detector definition.
GENERIC_CTA = ["click here", "click now", "click below", "click this link", "press here", "tap here",
               "follow this link", "open this link"]
SALUTATIONS = ["sir", "madam", "sir/madam", "customer", "user", "account holder", "beneficiary", "friend", "winner",
               "client", "member", "valued customer", "valued member", "applicant"]
REGIONAL_PHRASES = [
    "kindly revert", "kindly do", "kindly note", "kindly confirm", "kindly send", "kindly provide",
    "revert back to me", "do the needful", "at the earliest", "i am mr.", "i am mrs.", "i am barrister", "i am dr.",
    "attached herewith", "please do the", "for your kind", "your swift response", "your prompt response",
    "be informed that", "we wish to inform", "we are pleased to inform", "i write to inform", "i write to bring",
    "seeking for", "in need of your",
]
SAFETY_PHRASES = [
    "unsubscribe", "privacy policy", "terms of service", "terms and conditions", "to stop receiving",
    "if you did not request", "if you didn't request", "contact us at", "© ", "all rights reserved", "sent from",
    "view in browser", "manage preferences", "update your preferences", "you are receiving this", "you subscribed",
    "hello [name]", "hi [name]",
]


def count_generic_cta(text) -> Column:
    pattern = BEFORE_WORD + "(?:" + "|".join(GENERIC_CTA) + ")" + AFTER_WORD
    return F.regexp_count(F.lower(_col(text)), F.lit(pattern))


def generic_salutation(text) -> Column:
    names = "|".join(s.replace(" ", rf"[{SPACE}]+") for s in SALUTATIONS)
    return F.lower(_col(text)).rlike(rf"{BEFORE_WORD}dear[{SPACE}]+(?:{names}){AFTER_WORD}")


def contained_phrases(text, phrases) -> Column:
    """The literal phrases (given order) that occur in the lower-cased text."""
    c = F.lower(_col(text))
    return let(c, lambda t: F.filter(literals(phrases), lambda p: t.contains(p)))


def regional_phrases(text) -> Column:
    return contained_phrases(text, REGIONAL_PHRASES)


def large_amounts(text) -> Column:
    """Currency amounts of at least five significant integer digits, at most four."""
    raw = F.regexp_extract_all(
        _col(text), F.lit(rf"(?i)((?:\$|usd|gbp|eur|€|£)[{SPACE}]*\p{{Nd}}[\p{{Nd}},.]*)"), 1
    )

    def integer_part(match: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(match, r"(\p{Nd}[\p{Nd},.]*)$", 1), r"[.,]+$", "")
        # A one- or two-digit tail is a fraction; its separator may not repeat before it.
        integer = F.when(number.rlike(r"[.,]\p{Nd}{1,2}$"), F.regexp_replace(number, r"[.,]\p{Nd}{1,2}$", "")).otherwise(
            number
        )
        tail = F.when(number.rlike(r"[.,]\p{Nd}{1,2}$"), F.regexp_extract(number, r"([.,])\p{Nd}{1,2}$", 1))
        repeated = F.coalesce(F.instr(integer, tail) > 0, F.lit(False))
        grouped = integer.rlike(r"^\p{Nd}{1,3}(?:,\p{Nd}{3})+$") | integer.rlike(r"^\p{Nd}{1,3}(?:\.\p{Nd}{3})+$")
        plain = ~integer.rlike("[.,]")
        return F.when(~repeated & (grouped | plain), F.regexp_replace(integer, "[.,]", ""))

    large = F.filter(raw, lambda m: F.length(F.regexp_replace(integer_part(m), r"^[0٠۰]+", "")) >= 5)
    shown = F.transform(
        F.slice(large, 1, 4), lambda m: F.when(F.length(m) > 80, F.concat(F.substring(m, 1, 80), F.lit("…"))).otherwise(m)
    )
    return shown


# A direct request for something secret, and the words before it that deny it.
_REQUEST = (
    rf"\b(?:enter|provide|send|share|submit)[{SPACE}]+(?:(?:your|the)[{SPACE}]+)?"
    rf"(?:password|passcode|one-time password|otp code|credit card number)\b"
)
_NEGATION = (
    rf"\b(?:never(?:[{SPACE}]+ask(?:[{SPACE}]+you)?[{SPACE}]+to)?|do not|don't|must not|should not|will not|won't|not to)"
    rf"(?:[{SPACE}]+(?:ever|directly))?[{SPACE}]*$"
)


def pressured_credential_request(text, urgency: list[str], threats: list[str]) -> Column:
    """A direct credential request, not negated in its sentence, near urgency and threat."""
    c = F.lower(_col(text))
    hits = F.regexp_extract_all(c, F.lit(f"({_REQUEST})"), 1)
    # Text before each hit is found by walking the hits in order with a cursor.
    spans = F.aggregate(
        hits,
        F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<start:int,len:int>>").alias("found")),
        lambda acc, m: F.struct(
            (F.position(m, c, acc["cursor"]) + F.length(m)).alias("cursor"),
            F.concat(
                acc["found"],
                F.array(F.struct(F.position(m, c, acc["cursor"]).alias("start"), F.length(m).alias("len"))),
            ).alias("found"),
        ),
    )["found"]

    def pressured(span: Column) -> Column:
        start, length = span["start"], span["len"]
        prefix = F.substring(c, F.greatest(start - 100, F.lit(1)), F.least(start - 1, F.lit(100)))
        sentence = F.element_at(F.split(prefix, "[.!?;]"), -1)
        context = F.substring(
            c, F.greatest(start - 240, F.lit(1)), F.least(start - 1, F.lit(240)) + length + 240
        )
        near = lambda words: reduce(lambda a, b: a | b, [keyword_match(context, w) for w in words])
        return ~sentence.rlike(_NEGATION) & near(urgency) & near(threats)

    return F.when(F.size(hits) > 0, F.exists(spans, pressured)).otherwise(F.lit(False))


# --- scripts, masking, urls ----------------------------------------------------------

HAN = r"[\p{IsHan}\x{2EBF0}-\x{2EE5F}\x{323B0}-\x{3347F}&&[^\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}]]"


def han_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(HAN))


def substantial_han(text, minimum: int = 12) -> Column:
    return han_count(text) >= minimum


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(rf"[{WORD}]+"))


def enough_context(text, min_words: int = 5, min_chars: int = 40) -> Column:
    """Model context gate."""
    return (word_count(text) >= min_words) & (nonspace_count(text) >= min_chars)


def redact(text) -> Column:
    """Drop mailbox names and everything of a link but scheme, host, port and path."""
    c = F.regexp_replace(
        _col(text),
        rf"(?i)(https?://)(?:[^{SPACE}<>\"'/?#@]*@)?([^{SPACE}<>\"'/?#]*)([^{SPACE}<>\"'?#]*)(?:[?#][^{SPACE}<>\"']*)?",
        "$1$2$3",
    )
    return F.regexp_replace(c, rf"[{WORD}.!#$%&'*+/=?^`{{|}}~-]+@([{WORD}.-]+)", "[mailbox]@$1")


def extract_urls(text) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(rf"(https?://[^{SPACE}<>\"']+)"), 1)))


def mask_inline_data(text) -> Column:
    """Collapse embedded image payloads so that they are not scanned as text."""
    return F.regexp_replace(_col(text), rf"(?i)data:image/[^{SPACE}'\"<>)]*", "data:image/opaque")


def month_of(date_text) -> Column:
    return F.substring(_col(date_text), 1, 7)


def is_calendar_date(date_text) -> Column:
    c = _col(date_text)
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def case_title(subject, record_kind, report_type) -> Column:
    """Subject, or a label for user feedback, at most 200 characters."""
    given = F.nullif(strip(subject), F.lit(""))
    feedback = F.when(
        _col(record_kind) == "user_feedback",
        F.concat(F.lit("User feedback · "), F.coalesce(_col(report_type), F.lit("other"))),
    )
    return F.substring(F.coalesce(given, feedback, F.lit("Untitled message")), 1, 200)


# Display titles that old reports stored as message subjects.
LEGACY_SUBJECTS = ["User feedback · false_positive", "User feedback · false_negative",
                   "User feedback · incorrect_risk", "User feedback · incorrect_evidence", "User feedback · other"]


def ambiguous_legacy_subject(subject, source_schema) -> Column:
    return ~F.coalesce(_col(source_schema) == 2, F.lit(False)) & F.coalesce(
        _col(subject).isin(LEGACY_SUBJECTS), F.lit(False)
    )


def exact_set(left, right) -> Column:
    """Equality of two arrays as sets."""
    return F.array_sort(F.array_distinct(_col(left))).eqNullSafe(F.array_sort(F.array_distinct(_col(right))))
