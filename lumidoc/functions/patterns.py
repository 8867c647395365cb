"""Fixed patterns and word lists of the document model, as plain values.

Classes are written out, so that they mean the same in every engine: a word character is [\\p{L}\\p{N}_], a letter
[\\p{L}], a digit [\\p{Nd}].
"""

# White space, as a class's content; digits are those of all scripts.
BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # the same, one by one
_AMOUNT = rf"{BLANKS},.'\x{{66b}}\x{{66c}}"

# Shapes of field values.
DATE_LITERAL = (
    rf"(\p{{Nd}}{{4}}[{BLANKS}]*[^\p{{L}}\p{{N}}_{BLANKS}]?[{BLANKS}]*\p{{Nd}}{{1,2}}[{BLANKS}]*[^\p{{L}}\p{{N}}_{BLANKS}]?[{BLANKS}]*\p{{Nd}}{{1,2}})"
    rf"|(\p{{Nd}}{{1,2}}[{BLANKS}]*[^\p{{L}}\p{{N}}_{BLANKS}][{BLANKS}]*\p{{Nd}}{{1,2}}[{BLANKS}]*[^\p{{L}}\p{{N}}_{BLANKS}][{BLANKS}]*\p{{Nd}}{{2,4}})"
    rf"|(\p{{Nd}}{{1,2}}[{BLANKS}]+\p{{L}}{{3,12}}\.?[{BLANKS}]+\p{{Nd}}{{2,4}})"
    rf"|(\p{{L}}{{3,12}}\.?[{BLANKS}]+\p{{Nd}}{{1,2}},?[{BLANKS}]+\p{{Nd}}{{4}})"
)
LINK = rf"(?i)(https?://)|(^[{BLANKS}]*/)|([{BLANKS}]/[^{BLANKS}]{{2,}})|((www|ftp)\.)"
EMAIL = rf"[^@{BLANKS}]+@[^@{BLANKS}]+\.\p{{L}}{{2,}}"
CODE_TOKEN = rf"\p{{L}}{{1,6}}[{BLANKS}]*[-_/]?[{BLANKS}]*\p{{Nd}}{{3,}}|\p{{Nd}}{{3,}}[{BLANKS}]*[-_/][{BLANKS}]*\p{{L}}{{1,6}}"
TRACKING = r"(^|[^\p{L}\p{N}_])(\p{L}{2,4}\p{Nd}{6,}|\p{Nd}{9,}|\p{Nd}{4}[- ]\p{Nd}{4}[- ]\p{Nd}{4})($|[^\p{L}\p{N}_])"
PHONE = rf"(\+?\p{{Nd}}{{1,4}}[{BLANKS}\-.()]{{0,3}})?(\p{{Nd}}[{BLANKS}\-.()]{{0,3}}){{6,14}}\p{{Nd}}"
NUMERIC = r"\p{Nd}"
PURE_NUMERIC = rf"^[-+]?[\p{{Nd}}{_AMOUNT}]*\p{{Nd}}[\p{{Nd}}{_AMOUNT}]*[{BLANKS}]*[%‰°]?[{BLANKS}]*\p{{L}}{{0,4}}$"

FORMATS = ["date", "tracking_code", "identifier", "link", "numeric", "enum", "phone", "address", "synthesis", "text"]

# Label and value lines, identifiers.
LABEL_LINE = r"^([\p{L}][\p{L}\p{N}_ /&().\-]{1,48}?)[\s]*[:：][\s]*(.+)$"
UPPER_LABEL = r"^[A-Z][A-Z0-9 /&().\-]{2,48}$"
VALUE_SHAPE = r"[0-9]|[A-Za-z]{2,}"
IDENTIFIER = r"\b([A-Z]{1,6}[-/][A-Z0-9]*[0-9]{3,}[A-Z0-9\-/]*|[A-Z]{2,6}[0-9]{4,}[A-Z0-9]*)\b"
IDENTIFIER_NUMBER = r"\b([0-9]{6,})\b"
IDENTIFIER_HINTS = ["invoicenumber", "invoiceno", "documentnumber", "docno", "referencenumber", "refno", "bookingnumber"]
IDENTIFIER_NEGATIVE = ["vat", "eori", "tax", "phone", "tel", "fax", "zip", "postal", "account", "iban", "swift", "hscode"]
HOMOGLYPHS = ("OQDISBZG", "00015826")

# Characters that cleaning removes.
INVISIBLE = r"[\x{FEFF}\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Weights and limits.
MAX_LABEL_WORDS = 6
SANITIZED_CHARS = 8000
SENTENCE_CHARS = 150
MAX_WINDOWS = 48
MAX_WINDOW_WORDS = 6
WEIGHTS = {"semantic": 1.10, "label": 1.30, "bias": 1.00, "value": 0.70, "prejudice": 1.00, "cross": 0.85, "echo": 0.90, "external_bias": 0.85, "external_prejudice": 0.80}
CHROME = [
    "a printed column header or field label with no value after it",
    "a placeholder such as N A null none undefined or a blank dash",
    "a page number running header or footer decoration",
    "a navigation menu breadcrumb or button caption",
    "a legal boilerplate clause or a signature line",
    "a bare unit symbol or currency sign without any number",
]

# Accents that fold to ASCII letters, pairwise.
FOLD = ("áàâäãåéèêëíìîïóòôöõúùûüçñß", "aaaaaaeeeeiiiiooooouuuucns")

# Words by which Latin-script languages are told apart.
LATIN_WORDS = {
    "eng": "the of and to in is for on with as by at from this that are be or not was have has it an all which shall invoice number date total amount country shipment goods value quantity price weight description address name port terms payment",
    "fra": "le la les de des du et un une est que qui dans pour sur par avec au aux ne pas ce cette sont plus facture numero date montant pays marchandises poids adresse quantite prix total expedition paiement",
    "deu": "der die das und ist von zu den dem mit auf fur als nicht ein eine einer sich auch sind wird werden rechnung nummer datum betrag land waren gewicht anschrift menge preis gesamt versand zahlung",
    "spa": "el la los las de del y en que un una por con para es son no se su como mas factura numero fecha importe pais mercancias peso direccion cantidad precio total envio pago",
    "ita": "il lo la i gli le di del della e in che un una per con non si sono come piu da fattura numero data importo paese merci peso indirizzo quantita prezzo totale spedizione pagamento",
    "por": "o a os as de do da dos das e em que um uma por com para nao se sao mais fatura numero data valor pais mercadorias peso endereco quantidade preco total remessa pagamento",
    "nld": "de het een van en is in op te dat die voor met aan niet zijn worden als door factuur nummer datum bedrag land goederen gewicht adres aantal prijs totaal zending betaling",
}
LATIN_LIMITS = {"tokens": 6, "hits": 2, "margin": 2}
LATIN_LETTERS = r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]"

# Blocks that decide a script, in order of precedence (name, language, ranges).
BLOCKS = [
    ("Hangul", "kor", r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}"),
    ("Kana", "jpn", r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"),
    ("Thai", "tha", r"\x{0E00}-\x{0E7F}"),
    ("Cyrillic", "rus", r"\x{0400}-\x{04FF}\x{0500}-\x{052F}"),
    ("Arabic", "ara", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"),
    ("Devanagari", "hin", r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}"),
    ("Bengali", "ben", r"\x{0980}-\x{09FF}"),
    ("Greek", "ell", r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"),
    ("Hebrew", "heb", r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}"),
    ("Armenian", "hye", r"\x{0530}-\x{058F}"),
    ("Georgian", "kat", r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}"),
    ("Tamil", "tam", r"\x{0B80}-\x{0BFF}"),
    ("Telugu", "tel", r"\x{0C00}-\x{0C7F}"),
    ("Kannada", "kan", r"\x{0C80}-\x{0CFF}"),
    ("Malayalam", "mal", r"\x{0D00}-\x{0D7F}"),
    ("Sinhala", "sin", r"\x{0D80}-\x{0DFF}"),
    ("Gurmukhi", "pan", r"\x{0A00}-\x{0A7F}"),
    ("Gujarati", "guj", r"\x{0A80}-\x{0AFF}"),
    ("Lao", "lao", r"\x{0E80}-\x{0EFF}"),
    ("Khmer", "khm", r"\x{1780}-\x{17FF}"),
    ("Myanmar", "mya", r"\x{1000}-\x{109F}"),
    ("Ethiopic", "amh", r"\x{1200}-\x{137F}"),
    ("Tibetan", "bod", r"\x{0F00}-\x{0FFF}"),
    ("Vietnamese", "vie", r"\x{1EA0}-\x{1EF9}\x{01A0}-\x{01B0}"),
    ("Han", "zho", r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"),
]

# Relay edges and addresses.
RELAY_TARGETS = ["PL", "CINV", "CSI", "CO", "ED", "ID", "FI", "SOA", "PO", "LC"]
ZERO_ADDRESS = "0x" + "0" * 40

# What a model says when it repeats its instructions instead of reading.
SCHEMA_ECHO = ["", "-", "--", "...", "n/a", "na", "null", "none", "undefined", "unknown", "string", "number", "boolean", "array", "object", "schema", "region", "hint", "spec", "format", "example", "placeholder", "todo", "tbd", "value", "val", "field", "text", "key", "item", "raw", "cleaned value", "empty string", "cleaned value or empty string", "copy from ocr text or empty string"]
FIELD_ECHO = r"^(field|value|val|text|key|item|raw)([ _\-]?[0-9]+)?$"
TYPE_MARKER = r"(?i)\{(String|Number|Boolean|Array)\}"
PROMPT_ECHO = ["script rule", "scriptrule", "do not romanize", "do not translate", "do not transliterate", "correct output style", "writing system", "transcribe now", "reproduce every character", "omit it rather than", "is a failure", "separate distinct text blocks", "context:", "region:", "schema:", "hint:"]
REASONING = ["the user wants", "the user is asking", "the user asks", "i need to", "i should", "let me", "okay,", "first,", "looking at the image", "we need to"]
EXPECTED_SCRIPT = {"kor": "Hangul", "jpn": "Kana", "zho": "Han", "rus": "Cyrillic", "ukr": "Cyrillic", "ara": "Arabic", "tha": "Thai", "hin": "Devanagari", "ell": "Greek", "heb": "Hebrew", "tam": "Tamil", "tel": "Telugu"}

# Sentences that a document's vector is held against, and sentences of no language.
LANGUAGE_TEMPLATES = ["a document written in the {name} language", "this printed text is written in {name}", "{name} words sentences and grammar", "an official form filled out in {name}"]
NOISE_SENTENCES = ["random meaningless characters that belong to no language", "machine generated placeholder tokens and markup fragments", "html xml tags attributes and special control tokens", "a shuffled list of unrelated words without grammar", "garbled unreadable optical character recognition output"]
LANGUAGE_NAMES = {"eng": "English", "deu": "German", "fra": "French", "spa": "Spanish", "ita": "Italian", "por": "Portuguese", "nld": "Dutch"}
ISO1 = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ko": "kor", "ja": "jpn", "zh": "zho", "ru": "rus", "ar": "ara"}
LATIN_PRIORS = {"eng": 1.00, "deu": 0.62, "fra": 0.62, "spa": 0.62, "por": 0.58, "ita": 0.56, "nld": 0.52}
