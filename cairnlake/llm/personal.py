"""Personal information inside free text (problem 4).

Patterns propose spans; validators (check letters and digits, mod-97, Luhn) and
the words before a span raise or lower its score; spans of at least ACCEPT are
kept. Of overlapping spans the one of the earlier kind in KINDS stays, so that a
name inside an e-mail or street address is no case of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import messages

# The kinds and their placeholders, strongest kind first.
KINDS = {"email": "[EMAIL]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "name": "[NAME]"}
ACCEPT = 0.5

_I = regex.IGNORECASE
_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+\-]*[\p{L}\p{N}_+\-])?"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
_AT = r"(?:\s?[@＠]\s?|\s*[(\[{<]\s*(?:at|@|arroba|ät)\s*[)\]}>]\s*|%40|&#64;|&#x40;|&commat;)"
_DOT = r"(?:[.．]|\s*[(\[{<]\s*(?:dot|\.|punkt|point|punto)\s*[)\]}>]\s*)"
EMAIL = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+\-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}])", _I),
    # spelled out: name AT host DOT end
    regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+\-]){_LOCAL}\s+at\s+{_LABEL}(?:(?:\s+dot\s+|\.){_LABEL})*\s+dot\s+\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}])", _I),
]
_MAY_MAIL = regex.compile(r"[@＠]|%40|&#64;|&#x40;|&commat;|[(\[{<]\s*(?:at|arroba|ät)\s*[)\]}>]", _I)
_MAY_SPELL = (regex.compile(r"\sat\s", _I), regex.compile(r"\sdot\s", _I))

# street words
_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Way|Close|Crescent|Row|Gardens|Grove|Mews|Walk|Highway|Parkway|Circle|Quay|Alley)"
_WORD = r"\p{Lu}[\p{L}'’\-]+"
_UNIT = r"(?:(?:Flat|Apartment|Apt|Unit|Suite|Ste|Floor|Room|No)\.?\s*#?\s*\w{1,5}|#\s*\w{1,5})"
_GAP = r"\s*,?\s+"
_TOWN = r"\p{Lu}[\p{L}'’\-]{2,}(?:[ \-]\p{Lu}[\p{L}'’\-]+){0,2}"
_ZIP = r"(?:[A-Z]{1,2}-)?\d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}"
_TAIL = rf"(?:{_GAP}{_UNIT})?{_GAP}(?:(?:{_ZIP})\s+{_TOWN}|{_TOWN}(?:{_GAP}(?:\p{{Lu}}{{2}}\s+)?(?:{_ZIP}))?)(?![\p{{L}}\p{{N}}])"
ADDRESS = [
    regex.compile(rf"(?:{_UNIT}{_GAP})?(?<![\p{{L}}\p{{N}}.\-/])\d{{1,5}}[A-Za-z]?\s+{_WORD}(?:\s+{_WORD}){{0,2}}\s+(?i:{_EN})\b\.?{_TAIL}"),
    # lower case all through: only with the post code, for want of capitals
    regex.compile(rf"(?:{_UNIT}{_GAP})?(?<![\p{{L}}\p{{N}}.\-/])\d{{1,5}}[a-z]?\s+[\p{{L}}'’\-]+(?:\s+[\p{{L}}'’\-]+){{0,2}}\s+{_EN}\b\.?(?:{_GAP}{_UNIT})?\s*,\s*[\p{{L}}'’\-]{{3,}}(?:\s[\p{{L}}'’\-]+)?{_GAP}(?:{_ZIP})(?![\p{{L}}\p{{N}}])", _I),
    regex.compile(rf"\p{{L}}[\p{{L}}\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|markt)\s+\d{{1,5}}\s?[a-z]?(?:\s?[/\-]\s?\d+)*(?:{_GAP}(?:{_ZIP})\s+|\s*,\s*(?:(?:{_ZIP})\s+)?)\p{{L}}[\p{{L}}'’\-]{{2,}}(?:{_GAP}(?:{_ZIP}))?", _I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}])\d{{1,5}}\s?(?:bis|ter|[a-c])?\s*,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|passage)\s+(?:(?:de la|de l'|du|des|de|d')\s*)?[\p{{L}}'’\-]+(?:\s[\p{{L}}'’\-]+){{0,3}}{_GAP}(?:{_ZIP})\s+\p{{L}}[\p{{L}}'’\-]{{2,}}", _I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|via|viale|piazza|corso)\s+[\p{{L}}'’\-]+(?:\s[\p{{L}}'’\-]+){{0,3}}\s*,?\s+\d{{1,5}}\s?[a-z]?(?:\s*,\s*\d{{1,2}}\s?[ºª°]\s?\w{{0,3}})?(?:{_GAP}(?:{_ZIP})\s+|\s*,\s*)\p{{L}}[\p{{L}}'’\-]{{2,}}(?:{_GAP}(?:{_ZIP}))?", _I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:P\.?\s?O\.?\s?Box|Post(?:al)?\s?Box|Postfach|Apartado(?: de correos)?|Boîte postale|B\.?P\.?)\s*#?\s*\d{{1,6}}(?:{_GAP}(?:{_ZIP})\s+|{_GAP})\p{{L}}[\p{{L}}'’\-]{{2,}}(?:{_GAP}(?:{_ZIP}))?(?![\p{{L}}\p{{N}}])", _I),
]
_GERMAN = ADDRESS[2]
_MAY_GERMAN = regex.compile(r"(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|markt)\s+\d", _I)
_MAY_ADDRESS = regex.compile(rf"\b{_EN}\b|stra(?:ß|ss)e\s+\d|(?:str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|markt)\s+\d|\d\s*(?:bis|ter|[a-c])?\s*,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|passage)\s|(?<![\p{{L}}\p{{N}}])(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|via|viale|piazza|corso)\s|box\s*#?\s*\d|postfach|apartado|postale|(?<![\p{{L}}\p{{N}}])B\.?P\.?\s*#?\s*\d", _I)

_SEP = r"[\s.\-/‐-―]"
PHONE = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.:/#+\-=@])(?:(?:\+|00)\s?\d{{1,3}}|\(\+?\d{{2,4}}\)|\d{{1,5}})(?:{_SEP}?\(\d{{1,5}}\))?(?:{_SEP}{{0,2}}\d{{1,8}}){{1,6}}(?:\s*(?:ext|extension|durchwahl|x)\.?\s*\d{{1,6}})?(?![\p{{L}}\p{{N}}_@])(?![:.\-/]\p{{N}})", _I)
_CALL = regex.compile(r"\b(?:phone|telephone|tel|tél|téléphone|telefon|teléfono|telefono|fon|mobile|mobil|móvil|cell|handy|portable|fax|call|calls|ring|dial|text|sms|whatsapp|signal|number is|numéro est|nummer ist|número es|ruf|rufe|anrufen|reach|llama|llámame|appelle|appelez|hotline|extension)\b[^\n]{0,28}$", _I)
_NOT_CALL = regex.compile(r"\b(?:order|build|trace|hash|commit|job|ref|run|version|release|ticket|invoice|node|port|line|rows?|code|since|counter|from|to|at|id|no|nr|isbn|sku|ip|timestamp|ts)\b[\s.:#=]*$", _I)

# what an identity number is called
_ID_WORD = regex.compile(
    r"(?<![\p{L}\p{N}])(?:ssn|social[ _]security(?:[ _](?:number|no|nr))?|soc\.? sec\.?|(?:ni|nino|national[ _]insurance)(?:[ _](?:number|no|nr))?|nino"
    r"|national[ _]id(?:entity|entification)?(?:[ _](?:card|number|no|nr))*|id(?:entity)?[ _]card(?:[ _](?:number|no|nr))?|identity[ _](?:number|no)"
    r"|personalausweis(?:nummer)?|ausweis(?:nummer|nr)?|steuer-?(?:id|identifikationsnummer|nummer|nr)|sozialversicherungsnummer|reisepass(?:nummer|nr)?|führerschein(?:nummer|nr)?"
    r"|tax[ _](?:id|number|no|file number|identification number)|tin|itin|dni|nie|nif|cif|passport(?:[ _](?:number|no|nr))?|pasaporte|passeport"
    r"|driv(?:ing|er'?s?)[ _]?licen[cs]e(?:[ _](?:number|no|nr))?|permiso de conducir|permis de conduire|numéro de sécurité sociale|sécurité sociale|nir|carte d'identité|numéro fiscal|número de identidad|seguridad social)"
    r"(?![\p{L}\p{N}])\.?(?:\s+(?:is|ist|est|es|was|war|number|no|nr|nº|n°))?[\s.:#=\"'’”“)\]}>*_`-]{0,8}",
    _I,
)
_ID_VALUE = regex.compile(r"[\"'“(\[]?((?=[\p{L}\d /.\-]{0,30}\d{2})(?:[A-Z]{1,5}[\s\-/.]?)?\d[\dA-Z]*(?:[\s\-/.]\d[\dA-Z]*)*(?:[\s\-/.]?[A-Z]{1,2}(?![\p{L}\p{N}]))?)", 0)
_DNI = regex.compile(r"(?<![\p{L}\p{N}\-])(?:[XYZ]-?)?\d{7,8}-?[A-Z](?![\p{L}\p{N}\-])")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# titles and the words that lead to a name
_TITLE = r"(?:Mrs?|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|Herrn?|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señora?|Señorita|Sra?|Srta|Doña|Don|Signora?|Doktor|Doctor|Docteur)"
_PART = r"[\p{L}][\p{L}'’]+(?:-[\p{L}][\p{L}'’]+)*"
_CAP = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_INITIAL = r"\p{Lu}\."
_FIXED_TITLE = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?i:{_TITLE})\.?\s+(?:(?:{_INITIAL}|{_CAP})\s+)*{_CAP}")
_INITIALS = regex.compile(rf"(?<![\p{{L}}\p{{N}}.&\-])(?:{_CAP}\s+)?(?:{_INITIAL}\s?){{1,3}}{_CAP}|(?<![\p{{L}}\p{{N}}.&\-]){_CAP},\s+(?:{_INITIAL}\s?){{1,2}}(?![\p{{L}}\p{{N}}])")
_INITIAL_LAST = regex.compile(rf"(?:{_INITIAL}\s?){{1,3}}{_CAP}")
_LEAD = regex.compile(
    r"(?<![\p{L}\p{N}])(?:my (?:full )?name is|name is|name:|ich hei(?:ß|ss)e|mein name ist|je m['’]appelle|mon nom est|me llamo|mi nombre es|spoke with|spoke to|talked to|signed(?: off)? by|cc:|regards,|best,|cheers,|sincerely,|attn:?"
    r"|ask|belongs? to|owned by|approved by|grüße,?|cordialement,?|saludos,?|gesprochen mit|unterschrieben von|parlé avec|appartient à|signé par|hablé con|pertenece a|firmado por)\s+",
    _I,
)
_PAIR = regex.compile(rf"({_PART})(,?)\s+({_PART})(?:\s+({_PART}))?")
_NO_NAME = frozenset(
    "a about all an and any are as ask at attn aus back be best but by can cc cheers could das de dear der die do does el en est et every for from fold had has have hello her here hi him his how i if in is it its la le les los me mein my new nicht no not now of off on one or our out please que re regards she signed sincerely so some team thanks that the them then there they this those to un und une und up us was we were what when where which who why will with would y you your brauche own owns wants who".split()
)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    """Luhn check of a string of digits."""
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return len(digits) > 1 and total % 10 == 0


def mod97(digits: str) -> bool:
    """French-style key: the last two digits complete the others modulo 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def check_letter(value: str) -> bool:
    """Spanish DNI and NIE: the letter follows from the number modulo 23."""
    v = value.replace("-", "").upper()
    if v[:1] in "XYZ":
        v = str("XYZ".index(v[0])) + v[1:]
    return v[:-1].isdigit() and v[-1] == _DNI_LETTERS[int(v[:-1]) % 23]


def iso_check(digits: str) -> bool:
    """Eleven digits with an ISO 7064 mod 11,10 check digit (German tax id)."""
    if len(digits) != 11:
        return False
    p = 10
    for c in digits[:10]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[10])


def _emails(t: str) -> Iterator[tuple[int, int, float]]:
    if _MAY_MAIL.search(t) or all(p.search(t) for p in _MAY_SPELL):
        for p in EMAIL:
            for m in p.finditer(t):
                yield m.start(), m.end(), 1.0


def _addresses(t: str) -> Iterator[tuple[int, int, float]]:
    if _MAY_ADDRESS.search(t):
        for p in ADDRESS:
            if p is _GERMAN and not _MAY_GERMAN.search(t):
                continue
            for m in p.finditer(t):
                yield m.start(), m.end(), 0.8


# Digits of the numbers that a word names, and what checks them.
# Numbers named otherwise (passports, licences) have no common form.
_FORMS = (
    (regex.compile(r"ssn|soc|seguridad", _I), (9, 11, 12), None),
    (regex.compile(r"^(?:ni|nino)\b|national[ _]insurance", _I), (6,), None),
    (regex.compile(r"steuer", _I), (10, 11, 12, 13), iso_check),
    (regex.compile(r"\b(?:dni|nie|nif)\b", _I), (7, 8), None),
    (regex.compile(r"sécurité sociale|\bnir\b", _I), (13, 15), mod97),
    (regex.compile(r"\b(?:tin|itin)\b|tax", _I), (8, 9, 10, 11, 12, 13), luhn),
)
_NIR = regex.compile(r"(?<![\p{L}\p{N}\-.])[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?\d[\dAB]\s?\d{3}\s?\d{3}\s?\d{2}(?![\p{L}\p{N}\-])")


def id_score(word: str, value: str) -> float:
    """How sure a number named by an identity word is one.

    The word alone speaks for it; a form that such a number does not have speaks
    against it. A check digit that is right confirms it. One that is wrong lowers
    the score, but not below ACCEPT: people mistype and blur their numbers, and a
    wrong one is still personal.
    """
    digits = _digits(value)
    score = 0.7 if len(digits) >= 5 else 0.2
    for name, lengths, check in _FORMS:
        if name.search(word):
            score -= 0.3 * (len(digits) not in lengths)
            if check is not None:
                score += 0.2 if check(digits) else -0.1
            break
    if _DNI.fullmatch(value):
        score += 0.2 if check_letter(value) else -0.1
    return score


def _id_numbers(t: str) -> Iterator[tuple[int, int, float]]:
    for m in _ID_WORD.finditer(t):
        v = _ID_VALUE.match(t, m.end())
        if v:
            yield v.start(1), v.end(1), id_score(m[0], v[1])
    # without the word before it, only a right check tells it from a code
    for m in _DNI.finditer(t):
        if check_letter(m[0]):
            yield m.start(), m.end(), 0.5
    for m in _NIR.finditer(t):
        if mod97(_digits(m[0])):
            yield m.start(), m.end(), 0.5


def _phones(t: str) -> Iterator[tuple[int, int, float]]:
    for m in PHONE.finditer(t):
        s = m[0]
        body = regex.split(r"(?i)\s*(?:ext|extension|durchwahl|x)\.?\s*(?=\d+$)", s)[0]
        d = _digits(body)
        if not 7 <= len(d) <= 15:
            continue
        before = t[max(0, m.start() - 40) : m.start()]
        score = 0.2
        if body.startswith("+") or (body.startswith("00") and len(d) >= 10):
            score += 0.4
        if regex.match(r"\(\d{3}\)\s?\d{3}-\d{4}$", body):
            score += 0.3
        if not any(c in " .-/() \t" for c in body) and not body.startswith("+"):
            score -= 0.2  # a bare run of digits
        if _CALL.search(before):
            score += 0.4
        if _NOT_CALL.search(before) and not _CALL.search(before):
            score -= 0.4
        if regex.match(r"\d{4}-\d{2}-\d{2}$|\d{1,3}(?:\.\d{1,3}){3}$", body):
            score -= 0.6  # a date, a network node
        yield m.start(), m.end(), score


_ALNUM = re.compile(r"[^\W_]+")
_BREAKS = {i: " " for i in range(128) if not chr(i).isalnum()}


def _runs(low: str) -> set:
    """The runs of letters and digits of a text in lower case."""
    return set(low.translate(_BREAKS).split() if low.isascii() else _ALNUM.findall(low))


@cache
def _known_runs(people: frozenset) -> dict[str, tuple[frozenset, ...]]:
    """The runs of letters and digits of every name, by one of them."""
    out: dict[str, set] = {}
    for pair in people:
        runs = frozenset(_ALNUM.findall(" ".join(pair)))
        if runs:
            out.setdefault(min(runs), set()).add(runs)
    return {w: tuple(names) for w, names in out.items()}


def _may_know(words: set, people: frozenset) -> bool:
    """Whether all runs of some name are among the words."""
    names = _known_runs(people)
    return any(runs <= words for w in words if w in names for runs in names[w])


def _names(t: str, people: frozenset) -> Iterator[tuple[int, int, float]]:
    for m in _FIXED_TITLE.finditer(t):
        if m[0].split()[-1].lower() not in _NO_NAME:
            yield m.start(), m.end(), 0.8
    for m in _INITIALS.finditer(t):
        words = regex.findall(_PART, m[0])
        if "box" in (w.lower() for w in words) or any(w.lower() in _NO_NAME for w in words):
            # a leading common word is not part of the name
            m2 = _INITIAL_LAST.search(t, m.start(), m.end() + 40)
            if not m2 or "box" in m2[0].lower() or regex.findall(_PART, m2[0])[-1].lower() in _NO_NAME:
                continue
            yield m2.start(), m2.end(), 0.6
            continue
        yield m.start(), m.end(), 0.6
    for lead in _LEAD.finditer(t):
        m = _PAIR.match(t, lead.end())
        if not m:
            continue
        one, comma, two, three = m[1], m[2], m[3], m[4]
        if one.lower() in _NO_NAME or two.lower() in _NO_NAME:
            continue
        end, words = m.end(3), [one, two]
        if three and three.lower() not in _NO_NAME and three[0].isupper() == one[0].isupper() and not comma:
            end, words = m.end(4), [one, two, three]
        capital = all(w[0].isupper() for w in words)
        score = 0.6 - 0.3 * (not capital and bool(comma))
        if not capital and not regex.match(r"\s*(?:$|[.,;:()\n!?]|(?:and|und|et|y|now|who|about|for|re|wegen|pour|para|der|die|qui|que)\b)", t[end : end + 12]):
            score -= 0.3  # lower case: the sentence must go on after the name
        yield lead.end(), end, score
    if people and _may_know(_runs(t.lower()), people):
        for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}@._\-])({_PART})(,?)\s+(?={_PART})", t, overlapped=False):
            after = regex.compile(_PART).match(t, m.end())
            pair = (m[1].lower(), after[0].lower()) if after else None
            if pair in people:
                yield m.start(), after.end(), 0.7


def find_personal(t: str, people: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the kept spans of a text, in order, not overlapping."""
    look = worth_a_look(t, people)
    finders = (_emails, _addresses, _id_numbers, _phones, lambda t: _names(t, people))
    found = [(k, s) for k, (find, wanted) in enumerate(zip(finders, look, strict=True)) if wanted for s in find(t) if s[2] >= ACCEPT]
    if not found:
        return []
    taken: list[tuple[int, int, str]] = []
    kinds = list(KINDS)
    for k, (a, b, _) in sorted(found, key=lambda f: (f[0], f[1][0], -f[1][1])):
        if all(b <= c or d <= a for c, d, _ in taken):
            taken.append((a, b, kinds[k]))
    return sorted(taken)


def masked(t: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [t[at:a], KINDS[kind]]
        at = b
    return "".join([*out, t[at:]])


# What a text must have for spans of a kind to be proposed, so that most texts
# meet no pattern at all. It only saves work: each part is implied by the patterns.
_STREET_WORDS = frozenset(
    _EN[3:-1].lower().split("|")
    + "rue avenue boulevard place chemin allée impasse quai cours route passage calle c avenida avda plaza paseo camino carrera ronda via viale piazza corso box postbox postalbox postfach apartado postale bp b".split()
)
_STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "steig", "markt")
_ID_WORDS = frozenset(
    "ssn social soc ni nino national id identity personalausweis personalausweisnummer ausweis ausweisnummer ausweisnr steuer steuerid steueridentifikationsnummer steuernummer steuernr sozialversicherungsnummer"
    " reisepass reisepassnummer reisepassnr führerschein führerscheinnummer führerscheinnr tax tin itin dni nie nif cif passport pasaporte passeport driving driver drivers permiso permis sécurité nir identité fiscal identidad seguridad".split()
)
_CALL_WORDS = frozenset(
    "phone telephone tel tél téléphone telefon teléfono telefono fon mobile mobil móvil cell handy portable fax call calls ring dial text sms whatsapp signal ruf rufe anrufen reach llama llámame appelle appelez hotline extension".split()
)
_NAME_WORDS = frozenset(
    "mr mrs ms miss mx dr prof professor sir madam herr herrn frau monsieur madame mademoiselle mme mlle señor señora señorita sr sra srta doña don signor signora doktor doctor docteur"
    " name heiße heisse appelle nom llamo nombre spoke talked signed cc regards best cheers sincerely attn ask belongs belong owned approved grüße cordialement saludos gesprochen unterschrieben parlé appartient signé hablé pertenece firmado".split()
)
_CALL_PHRASES = ("number is", "numéro est", "nummer ist", "número es")
_MAIL_SIGNS = ("@", "＠", "%40", "&#64;", "&#x40;", "&commat;", "arroba", "dot", "ät")
_MAIL_AT = re.compile(r"[(\[{<]\s*at")
_BOX = re.compile(r"(?:box|bp|postfach|apartado|postale)\s*#?\s*\d")
_DIAL = re.compile(r"\+\s?\d|\(\+?\d{2,4}\)|(?<!\w)00\s?\d")
_CODE = re.compile(r"\d{7}\d?-?[A-Z](?![^\W_])")
_LONG = re.compile(r"[12](?:\s?\d){12}")
_INITIAL_SIGN = re.compile(r"(?<![^\W_])[^\W\d_]\.\s?[^\W\d_]|,\s+[^\W\d_]\.")


def worth_a_look(t: str, people: frozenset) -> tuple[bool, bool, bool, bool, bool]:
    """Whether email, address, id number, phone and name have to be looked for."""
    low = t.lower()
    words = _runs(low)
    mail = any(sign in low for sign in _MAIL_SIGNS) or bool(_MAIL_AT.search(low))
    place = not words.isdisjoint(_STREET_WORDS) or any(w.endswith(_STREET_ENDS) for w in words) or bool(_BOX.search(low))
    number = not words.isdisjoint(_ID_WORDS) or "licen" in low or bool(_CODE.search(t)) or bool(_LONG.search(t))
    call = not words.isdisjoint(_CALL_WORDS) or bool(_DIAL.search(t)) or any(p in low for p in _CALL_PHRASES)
    name = not words.isdisjoint(_NAME_WORDS) or bool(_INITIAL_SIGN.search(t)) or _may_know(words, people)
    return mail, place, number, call, name


def _known_people(contacts: DataFrame | None, given: str, family: str) -> frozenset:
    """Both orders of the listed names, lower case. The list is a table of fixed
    size; beyond 100,000 people it is refused rather than sent to every worker."""
    if contacts is None:
        return frozenset()
    clean = contacts.select(F.lower(F.trim(given)).alias("g"), F.lower(F.trim(family)).alias("f")).filter("length(g) > 1 and length(f) > 1").distinct()
    rows = clean.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 contacts: join them instead")
    return frozenset(p for r in rows for p in ((r["g"], r["f"]), (r["f"], r["g"])))


def personal_spans(rows: DataFrame, id_col: str, text: str, contacts: DataFrame | None = None, given: str = "given_name", family: str = "family_name") -> DataFrame:
    """(id, kinds array<string>, masked): the texts that hold personal information.

    Null and blank texts have none; whole texts are read, however long; rows with
    a null id are left out. A repeated id is one message (see ``messages``).
    """
    people = rows.sparkSession.sparkContext.broadcast(_known_people(contacts, given, family))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    spans = find_personal(t, people.value)
                    if spans:
                        at.append(i)
                        kinds.append(sorted({s[2] for s in spans}))
                        out.append(masked(t, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], names=["id", "kinds", "masked"])

    return rows.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {id_type}, kinds array<string>, masked string")


def personal_kinds(rows: DataFrame, id_col: str, text: str, contacts: DataFrame | None = None) -> DataFrame:
    """(id, kind): one row per message and kind found in it."""
    return personal_spans(rows, id_col, text, contacts).select("id", F.explode("kinds").alias("kind")).distinct()


def redacted_messages(rows: DataFrame, id_col: str, text: str, contacts: DataFrame | None = None) -> DataFrame:
    """(id, text): every message, with typed placeholders where something was found."""
    all_ = messages(rows.select(id_col, text), id_col)
    found = personal_spans(all_, id_col, text, contacts)
    return all_.join(found.select(F.col("id").alias("_id"), "masked"), F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("masked", text).alias(text))
