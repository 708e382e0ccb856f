"""Detection patterns as data. A pattern is a row: type, regular expression, confidence, priority.

Registering a detector pattern means adding a row; the order of the rows is the priority
that settles ties. ``(?U)`` makes classes Unicode-aware, ``(?i)`` ignores case.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    pii_type: str
    regex: str
    confidence: float
    #: A cheap test that any match implies; texts that fail it skip the pattern.
    guard: str | None = None


# The patterns, their types and confidences.
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_YEAR = r"(?:19|20)\d{2}"
_MONTHS_IT = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
_SHORT_IT = "gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic"
_MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_EN = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_COUNTRIES = "DE|FR|ES|GB|NL|BE|AT|CH|PT|IE|LU|FI|DK|SE|NO|PL|CZ|SK|HR|SI|RO|BG|HU|LT|LV|EE|MT|CY|GR"
_S = r"[\s\-.]"
CODE = r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"
IBAN = rf"\b(?:IT[\s\-]?\d{{2}}[\s\-]?[A-Z](?:[\s\-]?\d){{22}}|(?:{_COUNTRIES})[\s\-]?\d{{2}}[\s\-]?(?:[A-Z0-9][\s\-]?){{10,30}})\b"
EMAIL = r"\b[a-zA-Z0-9][a-zA-Z0-9._%+\-]{0,64}@[a-zA-Z0-9][a-zA-Z0-9.\-]{0,255}\.[a-zA-Z]{2,}\b"
VAT = r"\b0\d{10}\b"
PHONE = (
    rf"(?:(?:\+{_S}?39{_S}?)?3[0-9]{{2}}(?:{_S}?\d){{7}}"
    rf"|\+{_S}?39{_S}?0[0-9]{{1,3}}(?:{_S}?\d){{5,8}}"
    rf"|0[0-9]{{1,3}}{_S}(?:{_S}?\d){{5,8}})"
)
DATE = rf"\b(?:{_DAY}[/.\-](?:0?[1-9]|1[0-2])[/.\-]{_YEAR}|{_YEAR}[/.\-](?:0?[1-9]|1[0-2])[/.\-]{_DAY})\b"
DATE_IT = rf"\b(?:{_DAY}(?:°)?\s+(?:{_MONTHS_IT}|{_SHORT_IT})(?:\s+{_YEAR})?|(?:{_MONTHS_IT})\s+{_YEAR})\b"
DATE_EN = (
    rf"\b(?:{_DAY}(?:st|nd|rd|th)?\s+(?:{_MONTHS_EN}|{_SHORT_EN})(?:\s+{_YEAR})?"
    rf"|(?:{_MONTHS_EN}|{_SHORT_EN})\s+{_DAY}(?:st|nd|rd|th)?(?:,?\s+{_YEAR})?|(?:{_MONTHS_EN})\s+{_YEAR})\b"
)
VAT_OTHER = r"\b[1-9]\d{10}\b"

#: The full detector, most specific first.
PATTERNS = (
    Pattern("cf", f"(?Ui){CODE}", 1.0, r"(?U)\d{3}[A-Za-z]"),
    Pattern("ib", f"(?Ui){IBAN}", 1.0, r"(?U)\d{2}"),
    Pattern("em", f"(?U){EMAIL}", 1.0, "@"),
    Pattern("fin", rf"(?U)(?<!\d){VAT}(?!\d)", 0.80, r"(?U)0\d{10}"),
    Pattern("tel", rf"(?U)(?<![A-Za-z\d]){PHONE}(?![A-Za-z\d])", 0.85, r"(?U)\d{2}"),
    Pattern("dt", f"(?U){DATE}", 0.90, r"\d[/.\-]\d"),
    Pattern("dt", f"(?Ui){DATE_IT}", 0.85, r"\d"),
    Pattern("dt", f"(?Ui){DATE_EN}", 0.85, r"\d"),
    Pattern("fin", rf"(?U)(?<!\d){VAT_OTHER}(?!\d)", 0.65, r"(?U)[1-9]\d{10}"),
)
#: The smaller engine. Its second group, where it has one, is the span.
SIMPLE_PATTERNS = (
    Pattern("cf", r"(?U)\b([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])\b", 1.0),
    Pattern("ib", r"(?U)\b(IT\d{2}[A-Z]\d{22})\b", 1.0),
    Pattern("em", r"(?U)\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b", 1.0),
    Pattern("tel", r"(?U)((?:\+39\s?)?(?:0\d{1,4}[\s\-]?\d{4,8}|3\d{2}[\s\-]?\d{6,7})\b)", 1.0),
    Pattern("piva", r"(?Ui)\b(?:P\.?\s?IVA\s?)(\d{11})\b", 1.0),
    Pattern("pec", r"(?U)\b([a-zA-Z0-9._%+\-]+@pec\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b", 1.0),
    Pattern("sdi", r"(?Ui)\b(?:SDI|codice\s+sdi)\s+([A-Z0-9]{7})\b", 1.0),
)
#: Types a token may have, types only patterns find, and the token's form.
TOKEN_TYPES = ("pe", "org", "loc", "ind", "tel", "em", "cf", "ib", "med", "leg", "rel", "fin", "pro", "dt")
MODEL_TYPES = ("pe", "org", "loc", "ind", "med", "leg", "rel", "fin", "pro", "dt")
REGEX_TYPES = ("cf", "ib", "em", "tel")
TOKEN = r"\[#([a-z]{2,3}):([a-f0-9]{4,8}(?:_\d+)?)\]"
_TAGS = "current_time|security_boundary|system_instruction|intent_analysis|user_context|session_memory"
SYSTEM_TAG = rf"(?s)<(?:{_TAGS})[^>]*>.*?</(?:{_TAGS})>"
#: Letters that look like Latin ones (Cyrillic, then Greek).
LOOK_ALIKE = {
    "А": "A", "а": "a", "В": "B", "в": "b", "С": "C", "с": "c", "Е": "E", "е": "e", "Н": "H", "н": "h", "К": "K", "к": "k",
    "М": "M", "м": "m", "О": "O", "о": "o", "Р": "P", "р": "p", "Т": "T", "т": "t", "Х": "X", "х": "x", "У": "Y", "у": "y",
    "Α": "A", "α": "a", "Β": "B", "β": "b", "Ε": "E", "ε": "e", "Η": "H", "η": "h", "Κ": "K", "κ": "k", "Μ": "M", "μ": "m",
    "Ο": "O", "ο": "o", "Ρ": "P", "ρ": "p", "Τ": "T", "τ": "t", "Χ": "X", "χ": "x",
}
