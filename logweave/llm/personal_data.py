"""Problem 6: personal data in free text, found by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs and their spelled forms, digits, captions of identity and
of other numbers, street words, and the phrases that stand before or after a person's name. From each anchor a small
deterministic parser expands to the boundaries of what stands there and validates it, with check digits where the form has
them. The given and family names that anchored names of all texts show are learnt, and a pair of them is a name wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")

#: How an at-sign is written.
AT_SIGNS = ("@", "(at)", "[at]", "{at}", "<at>")
#: Words that name a street, in six languages; those that begin with a blank stand alone, others end a word.
STREET_WORDS = (" street", " st.", " avenue", " ave", " lane", " ln.", " road", " rd", " drive", " square", " rue ", " boulevard ", " chemin ", " calle ", " avda.", " avenida ", " plaza ", " paseo ", " rua ", " praça ", " travessa ", "straße ", "strasse ", "str. ", "weg ", "ring ", "platz ", "gasse ", "allee ", "straat ", "laan ", "plein ")
#: Captions of identity, passport, tax and insurance numbers, in six languages.
ID_CUES = ("id=", "id:", " id ", "tax id", "national id", "passport", "passeport", "reisepass", "pasaporte", "passaporte", "paspoort", "ausweis", "ssn", "social insurance", "social security", "insurance no", "sozialversicherung", "steuernummer", "steuer-id", "dni", "nif", "nie ", "bsn", "burgerservicenummer", "contribuinte", "documento", "document ", "identité", "identidad", "identiteit", "identität", "identity", "sécurité sociale", "seguridad social", "numéro fiscal", " card ")
#: Captions of numbers that are no personal data.
NUMBER_CUES = ("part no", "order n", "parcel", "build", "counter", "ticket", "ref ", "req-", "invoice no", "serial", "version", "listener", " port ", "offset")
#: What stands before a person's name and hardly before anything else, in six languages.
NAME_BEFORE = ("owner=", "from:", "cc:", "contact:", "contact :", "contacto:", "responsable:", "responsável:", "kontakt:", "hi,", "hello,", "thank you,", "thanks to", "regards,", "gruß,", "grüße,", "firmado,", "atentamente,", "obrigado,", "obrigada,", "signé", "signé,", "groet,", "groeten,", "ask for", "issued to", "signed off by", "signed by", "ansprechpartner ist", "ansprechpartnerin ist", "dank aan", "rückfragen an", "vorgelegt von", "presented by", "entregado por", "remis par", "merci à", "gracias a", "danke an", "dank an", "herr", "frau", "mr.", "mrs.", "ms.", "dr.", "señor", "señora", "senhor", "senhora", "mevrouw", "meneer", "madame", "monsieur")
#: What also stands before other words, so that what follows decides.
NAME_PERHAPS = ("as", "ask", "thanks", "dear", "laut", "selon", "según", "volgens", "segundo", "goes to", "- ", "| ", "(")
#: What stands after a person's name, in six languages.
NAME_AFTER = ("asked us", "asks us", "moved to", "pidió", "pide que", "pediu", "pede que", "demande", "a demandé", "vraagt", "vroeg", "bittet", "bat um", "put it", "gilt:")

_W = r"[^\W\d_]"
_S = r"[ \u00a0\u2009]{1,3}"
_TOKEN = rf"{_W}+(?:['’\-]{_W}+)*"
_ANY_NAME = rf"(?:(?:{_W}\.[ \u00a0\u2009]{{0,3}})+{_TOKEN}|{_TOKEN},{_S}{_TOKEN}(?:{_S}{_W}\.)?(?![\w\-]|{_S}{_TOKEN},)|{_TOKEN}(?:{_S}{_W}\.)*{_S}{_TOKEN})"
_NAME = re.compile(rf"{_ANY_NAME}(?![\w@+]|\.\w)")
_ENDING = re.compile(rf"(?<![\w@.+\-]){_ANY_NAME}$")
#: Lower-case beginnings of a line that stands behind a signature.
_FOLLOWS = re.compile(r"(?:\w+[=:]|tel\.|tél\.|cc |hi,|pls |reach me|domicil)")
_LOCAL = re.compile(r"[\w.%+\-]+$")
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point|ponto|punt)\s?[)\]}]\s?)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*?{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9\-]|\.[A-Za-z0-9])")
_NUMBER = re.compile(r"(?<!\w)(?:[+(]{0,2}\d[\d .\-/()\u00a0\u2009]{5,}\d|[A-Za-z]{1,2}\d{2,7}(?:[A-Za-z]|[ \u00a0]))")
_PHONE = re.compile(r"(?<![\w.+/\-])(?:\+\d{1,3}|00\d{1,3})(?:(?:[.\-/]|[ \u00a0\u2009]{1,2})?\(0\))?(?:(?:[.\-/]|[ \u00a0\u2009]{1,2})?\(?\d{2,9}\)?){2,6}(?![\w])|(?<![\w.+/\-])\(0?\d{2,5}\)(?:[.\-/]|[ \u00a0\u2009]{1,2})?\d{2,4}(?:(?:[.\-]|[ \u00a0\u2009]{1,2})\d{2,5}){1,3}(?![\w])|(?<![\w.+/\-])0\d{1,5}(?:[/\-]|[ \u00a0\u2009]{1,2})\d{3,8}(?:(?:-|[ \u00a0\u2009]{1,2})\d{2,5}){0,3}(?![\w])|(?<![\w.+/\-])[2-9]\d{2}([.\-]|[ \u00a0\u2009]{1,2})[2-9]\d{2}\1\d{4}(?![\w])")
_ID = re.compile(r"(?<![\w\-])(?:\d{3}(-|[ \u00a0\u2009]{1,2})\d{2}\1\d{4}|\d{2}(?:[ \u00a0\u2009]{1,2}\d{3}){3}|[A-Za-z]\d{7}[A-Za-z]|[A-Za-z]\d{3}[A-Za-z]\d{4}[A-Za-z]|[A-Za-z]{2}\d{2}(?:[ \u00a0\u2009]{0,2}\d{4}){3,6}|\d{8}[A-Za-z]|[A-Za-z]{2}\d{6}[A-Za-z]?)(?![\w\-]|[.,]\d)")
_TOWN = rf"(?:(?:Sankt|St\.|Bad|San|Santa|New|Los|Las|La|Le|Den|De)\s)?{_W}+(?:-{_W}+)*"
_NAMED = rf"{_TOKEN}(?:\s{_TOKEN}){{0,2}}"
_ADDRESS = re.compile(
    rf"(?<![\w\-])(?:"
    rf"(?:(?:Flat|Apt\.?|Unit|Suite)\s\d+,\s)?\d{{1,5}}[A-Za-z]?\s{_NAMED}?\s(?:Street|St\.|Avenue|Ave\.?|Lane|Ln\.|Road|Rd\.?|Drive|Square)(?:,\s(?:Apt\.?|Flat|Unit|Suite)\s\d+)?,\s{_TOWN}(?:,?{_S}\d{{4,6}}(?!\w|[ ]?[()]))?"
    rf"|(?:(?:Am|An\sder|Im|In\sder|Zum|Zur)\s)?{_TOKEN}(?:straße|strasse|str\.|weg|ring|platz|gasse|allee|straat|laan|plein)\s\d{{1,4}}\s?[A-Za-z]?(?:,|\sin)\s\d{{4,5}}(?:\s?[A-Z]{{2}})?\s{_TOWN}"
    rf"|\d{{1,5}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|chemin|place)\s{_NAMED}?,\s\d{{4,5}}\s{_TOWN}"
    rf"|(?:Avda\.|Avenida|Calle|C/|Plaza|Paseo|Rua|Praça|Travessa)\s{_NAMED}?,?\s(?:n\.º\s)?\d{{1,4}},\s(?:\d{{4,5}}(?:-\d{{3}})?\s)?{_TOWN}"
    rf")",
    re.IGNORECASE,
)
#: Words before and after a street word that the address parser can take in, and before a phrase that the name parser can.
_REACH = (9, 14, 8)
#: Bare digits that stand for an identity number directly behind its caption.
_BARE = re.compile(r"[A-Z]{0,2}\d(?:[ \u00a0./\-]?\d){7,14}[A-Z]?(?![\w\-]|[.,]\d)", re.IGNORECASE)
_IBAN = re.compile(r"(?<![\w\-])[A-Za-z]{2}\d{2}(?:[ \u00a0\u2009]{0,2}(?=[A-Za-z]*\d)[\dA-Za-z]{4}){3,7}(?:[ \u00a0\u2009]{0,2}\d{1,3})?(?![\w\-]|[.,]\d)")
#: A date behind a number is no part of it.
_DATE = re.compile(r"[ \u00a0\u2009]+\d{4}-\d\d-\d\d")
#: Where a sentence ends; an abbreviated "number" and a digit behind the point do not end one.
_STOP = re.compile(r"(?<!\bno)(?<!\bnr)(?<!\bnum)(?<!\bn)[.!?]\s(?!\d)|\n", re.IGNORECASE)
_JUST_BEFORE = re.compile(r"(?:\W|\b(?:no|nr|num|number|nummer|número|numéro|is|ist|es|est|é|reads)\b){0,12}$", re.IGNORECASE)

#: Names seen at least so often behind or before a phrase are learnt.
SEEN = 3


_NAME_KINDS = frozenset(("before", "perhaps", "after"))
_GIVEN_BEFORE = re.compile(rf"(?<![\w@.+\-'’])({_TOKEN})(?:{_S}{_W}\.)*{_S}$")
_INITIALS_BEFORE = re.compile(rf"(?<![\w@.+\-'’])(?:{_W}\.[ \u00a0\u2009]{{0,3}})+$")
_GIVEN_AFTER = re.compile(rf",{_S}({_TOKEN})(?:{_S}{_W}\.)?(?![\w@+\-]|\.\w)")


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def _words_back(t: str, a: int, n: int) -> int:
    """The place n blanks before a."""
    for _ in range(n):
        a = t.rfind(" ", 0, a)
        if a < 0:
            return 0
    return a


def _words_on(t: str, b: int, n: int) -> int:
    """The place n blanks behind b."""
    for _ in range(n):
        b = t.find(" ", b + 1)
        if b < 0:
            return len(t)
    return b


def _mod97(s: str) -> bool:
    """Whether the check digits of an international account number hold."""
    s = "".join(c for c in s.upper() if c.isalnum())
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def name_parts(said: str) -> tuple[str, str] | None:
    """Given and family name of a name as written, in lower case; None if one is only an initial."""
    w = [x.lower() for x in re.findall(_TOKEN, said) if len(x) > 1]
    return None if len(w) != 2 else (w[1], w[0]) if "," in said else (w[0], w[1])


class Finder:
    """Finds the personal data of a text. One automaton serves all texts of a task."""

    def __init__(self, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> None:
        import ahocorasick

        self.given = given
        self.auto = ahocorasick.Automaton()
        cues: dict[str, set[str]] = {}
        for kind, group in (("at", AT_SIGNS), ("street", STREET_WORDS), ("before", NAME_BEFORE), ("perhaps", NAME_PERHAPS), ("after", NAME_AFTER), ("good", ID_CUES), ("bad", NUMBER_CUES), ("digit", "0123456789"), ("family", family)):
            for c in group:
                # What begins with a letter begins a word, and what ends with one ends a word.
                word = kind in ("before", "perhaps", "after")
                key = " " * (word and c[0].isalpha()) + c + " " * (word and kind != "after" and c[-1].isalpha())
                cues.setdefault(key, set()).add(kind)
        for key, kinds in cues.items():
            lead = key[0] == " "
            self.auto.add_word(key, (len(key) - lead, key[-1] == " " and key[-2:-1].isalpha(), key.strip(), frozenset(kinds)))
        self.auto.make_automaton()

    def email(self, t: str, a: int, b: int) -> tuple[int, int] | None:
        end = a - (t[a - 1 : a] == " ")
        i = end
        while i > 0 and (t[i - 1].isalnum() or t[i - 1] in "_.%+-"):
            i -= 1
        while i < end and t[i] in ".-+%":
            i += 1
        if i >= end:
            return None
        d = _DOMAIN.match(t, b + (t[b : b + 1] == " "))
        return (i, d.end()) if d else None

    def address(self, t: str, a: int, b: int) -> tuple[int, int] | None:
        lo, hi = _words_back(t, a, _REACH[0]), _words_on(t, b, _REACH[1])
        for m in _ADDRESS.finditer(t, lo, hi):
            if m.start() <= a + 1 < m.end():
                return m.span()
            if m.start() > a:
                break
        return None

    @staticmethod
    def number(t: str, a: int, good: int, bad: int) -> tuple[str, int, int] | None:
        """The identity or phone number whose first digit is at a. good and bad are the ends of the last caption of such a number, and
        of another number, in the same sentence; -1 without one."""
        starts = [i for i in (a - 2, a - 1, a) if i >= 0 and (i == a or t[i:a].isalpha() or all(c in "+(" for c in t[i:a])) and not (i and (t[i - 1].isalnum() or t[i - 1] == "_"))]
        for i in starts:
            if t[i].isalpha() and (m := _IBAN.match(t, i)) and _mod97(m.group()):
                return "id_number", *m.span()
            if (m := _ID.match(t, i)) and (good > bad or bad < 0 and m.group()[0].isalpha()):
                return "id_number", *m.span()
            if good > bad and (m := _BARE.match(t, i)) and (x := _JUST_BEFORE.search(t, good, i)) and x.start() == good:
                return "id_number", *m.span()
        for i in starts:
            if not t[i].isalpha() and (m := _PHONE.match(t, i)):
                if (x := _DATE.search(t, i, m.end() + 6)) and not (m := _PHONE.match(t, i, x.start())):
                    continue
                j = m.end()
                while j > i and t[j - 1] == ")" and t.count("(", i, j) < t.count(")", i, j):
                    j -= 1
                groups = re.findall(r"\d+", t[i:j])
                if 10 <= sum(map(len, groups)) <= 16 and len(set(groups)) > 1 and (bad < 0 or i - bad > 4):
                    return "phone", i, j
        return None

    @staticmethod
    def _person(t: str, i: int, j: int, sure: bool) -> tuple[int, int] | None:
        """The name at i..j without a leading phrase; lower case is a name only where the place is sure."""
        said = re.findall(_TOKEN, t[i:j])
        while said and said[0].lower() in _LEADING:
            i += t[i:j].index(said[0]) + len(said.pop(0))
            while i < j and not t[i].isalpha():
                i += 1
        if len(said) < 2:
            return None
        if all(x[0].isupper() for x in said):
            return None if _COMMON.intersection(x.lower() for x in said) else (i, j)
        long = [x for x in said if len(x) > 1]
        return (i, j) if sure and all(x.islower() for x in said) and len(long) > 1 - (len(said) > len(long)) and all(len(x) > 2 for x in long) and not _COMMON.intersection(said) else None

    def names(self, t: str, hits: list[tuple[int, int, str, frozenset[str]]]) -> Iterator[tuple[int, int]]:
        after = [a for a, _, _, k in hits if "after" in k]
        starts = set(after)
        for a, b, cue, kinds in hits:
            if "before" in kinds or "perhaps" in kinds:
                i = b
                while i < len(t) and t[i] in " \r\n\u00a0\u2009" and i - b < 4:
                    i += 1
                m = _NAME.match(t, i)
                if m and ("before" in kinds or self._closed(t, cue, a, m.end(), m.end() in starts)) and (p := self._person(t, m.start(), m.end(), True)):
                    yield p
        for a in after:
            end = a
            while end > 0 and t[end - 1] in " ,\u00a0":
                end -= 1
            lo = max(t.rfind("\n", 0, end) + 1, _words_back(t, end, _REACH[2]))
            if m := _ENDING.search(t[lo:end]):
                if p := self._person(t, lo + m.start(), end, True):
                    yield p

    def known(self, t: str, a: int, b: int) -> tuple[int, int] | None:
        """The name whose learnt family name stands at a..b: a learnt given name or an initial before it, or a learnt given name behind a comma."""
        if a and (t[a - 1].isalnum() or t[a - 1] in "@._+-'’") or b < len(t) and (t[b].isalnum() or t[b] in "@_+-" or t[b] == "." and t[b + 1 : b + 2].isalnum()):
            return None
        upper = t[a].isupper()
        lo = _words_back(t, a, 5)
        if (m := _GIVEN_BEFORE.search(t, lo, a)) and m[1].lower() in self.given and m[1][0].isupper() == upper and (upper or b - a > 3 < len(m[1])):
            return m.start(), b
        if upper and (m := _INITIALS_BEFORE.search(t, lo, a)) and m.group()[0].isupper():
            return m.start(), b
        if (m := _GIVEN_AFTER.match(t, b)) and m[1].lower() in self.given and m[1][0].isupper() == upper:
            return a, m.end()
        return None

    @staticmethod
    def _closed(t: str, cue: str, a: int, j: int, followed: bool) -> bool:
        """Whether a phrase that also stands before other words is before a name here; the name ends at j."""
        if followed:
            return True
        rest = t[j : j + 60].lstrip(" \u00a0")
        if cue == "|":
            return rest[:1] == "|"
        if cue == "(":
            return rest[:1] == "," and bool(re.match(r",\s*(?:[+(\d]|[\w.+\-]+\s?[@(\[])", rest))
        if cue == "-":
            before = t[:a].rstrip(" ")[-1:]
            free = not rest or rest[0] in "\r\n\"([" or rest[0].isupper() and not rest[:3].isupper() or bool(_FOLLOWS.match(rest))
            return before in ("", "\n", ".", "!", "?", ")", "]", '"', "”", "»") and free
        if cue in ("thanks", "dear"):
            return rest[:1] in ("!", ",", ".")
        if cue == "ask":
            return rest[:1] == "."
        return cue == "goes to" and rest[:1] == ","

    def find(self, t: str | None) -> list[tuple[str, int, int]]:
        """``(pii_type, start, end)`` by position, in code points, end exclusive; findings do not overlap."""
        if not t:
            return []
        low = _lower(t)
        # A blank is put in front and behind, so that a phrase may begin or end the text.
        hits, known, out, read, good, bad = [], [], [], 0, -1, -1
        for e, (n, open_, c, k) in self.auto.iter(" " + low.replace("\n", " ") + " "):
            a, b = e - n, e - open_
            if "digit" in k:
                if a < read or a and t[a - 1].isdigit():
                    continue
                # Captions count within their sentence only.
                if good >= 0 and _STOP.search(t, good, a):
                    good = -1
                if bad >= 0 and _STOP.search(t, bad, a):
                    bad = -1
                if x := self.number(t, a, good, bad):
                    out.append(x)
                    read = x[2]
                continue
            if "good" in k:
                good = b
            if "bad" in k:
                bad = b
            if "at" in k and (x := self.email(t, a, b)):
                out.append(("email", *x))
            elif "street" in k and (x := self.address(t, a, b)):
                out.append(("address", *x))
            if "family" in k and (x := self.known(t, a, b)):
                known.append(x)
            if k & _NAME_KINDS:
                hits.append((a, b, c, k))
        taken = sorted({(i, j) for _, i, j in out})
        if hits or known:
            for i, j in [*self.names(t, hits), *known]:
                if not any(x < j and i < y for x, y in taken):
                    out.append(("name", i, j))
        done, end = [], -1
        for kind, i, j in sorted(set(out), key=lambda x: (x[1], -x[2], TYPES.index(x[0]))):
            if i >= end:
                done.append((kind, i, j))
                end = j
        return done


_COMMON = frozenset("the this that these those and but for with from what when where which who why how all any our your their his her its not now here there then than into over under after before le la les des une der die das ein eine dem und oder aber mit zum zur que qui por con sin los las una uno het een van voor met dat deze or so we if agreed".split())
_LEADING = frozenset("as ask thanks dear laut selon según volgens segundo signé and herr frau mr mrs ms dr".split())


Lexicon = tuple[frozenset[str], frozenset[str]]


def _finder(lexicon_b) -> Finder:
    return Finder(*lexicon_b.value) if lexicon_b else Finder()


def _run(lexicon_b=None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(lexicon_b)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for tbl, i, t in zip(b.column("tbl").to_pylist(), b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                for kind, s, e in finder.find(t):
                    for c, v in zip(cols, (tbl, i, kind, s, e)):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tbl", "row_id", "pii_type", "start_pos", "end_pos"])

    return go


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    for b in batches:
        parts = [x for t in b.column("text").to_pylist() for k, s, e in finder.find(t) if k == "name" and (x := name_parts(t[s:e]))]
        flat = [(kind, w) for g, f in parts for kind, w in (("given", g), ("family", f))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat], pa.string()), pa.array([w for _, w in flat], pa.string())], ["kind", "word"])


def learn_names(texts: DataFrame) -> Lexicon:
    """The given and the family names that stand at least SEEN times in the anchored names of all texts. Only those come to the driver."""
    parts = texts.filter("text is not null").select("text").mapInArrow(_learn, "kind string, word string")
    seen = parts.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).select("kind", "word").collect()
    of = lambda kind: frozenset(r["word"] for r in seen if r["kind"] == kind)
    return of("given"), of("family")


def _broadcast(texts: DataFrame, lexicon: Lexicon | None):
    return texts.sparkSession.sparkContext.broadcast(lexicon) if lexicon else None


def find_personal_data(texts: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``(tbl, row_id, pii_type, start_pos, end_pos)`` of texts ``(tbl, row_id, text)``; other columns are never read.

    Positions are code points from 0, end exclusive; findings of a row do not overlap. Whole texts are read,
    each row on its own: copies count in each row, and no row moves to another task. Null and empty texts and empty
    tables give no rows. lexicon is what learn_names gives; without one only anchored names are found.
    """
    return texts.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").filter("text is not null").mapInArrow(_run(_broadcast(texts, lexicon)), "tbl string, row_id long, pii_type string, start_pos int, end_pos int")


def _rewrite(lexicon_b=None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(lexicon_b)
        for b in batches:
            texts, counts = [], []
            for t in b.column("text").to_pylist():
                found = finder.find(t)
                parts, at = [], 0
                for kind, s, e in found:
                    parts += [t[at:s], f"[{kind.upper()}]"]
                    at = e
                texts.append(t if not found else "".join(parts) + t[at:])
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("row_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["tbl", "row_id", "text", "findings"])

    return go


def replace_personal_data(texts: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``(tbl, row_id, text, findings)``: the texts with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and
    ``[NAME]`` in place of what is found, and their number. Null texts stay null; every row comes out once."""
    return texts.select("tbl", F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rewrite(_broadcast(texts, lexicon)), "tbl string, row_id long, text string, findings int")


def texts_of(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The message contents and document texts as ``(tbl, row_id, text)``."""
    a = lines.select(F.lit("capture_lines").alias("tbl"), F.col("line_id").alias("row_id"), F.col("message.content").alias("text"))
    return a.unionByName(docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text"))
