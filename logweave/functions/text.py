"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
EN_STOP = (
    "the a an and or but is are was were be been being has have had do does did will would can could should may might must "
    "i you he she it we they this that these not no to of in on at for with from by as if so than then too very just only"
).split()
#: German stop words.
DE_STOP = (
    "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden wurde wurden hat haben "
    "hatte hatten sein seine ich du er sie es wir ihr nicht kein keine mit von zu zum zur auf in im an am fuer für bei aus nach "
    "ueber über als wie wenn dass da so auch noch nur schon"
).split()
#: English endings, in the order in which they are tried.
EN_SUFFIXES = "ization iveness fulness ousness ational tional ations ingly edly ation ement ments ness able ible ings ment ies ing ers est ed er ly s".split()
#: German endings, in the order in which they are tried.
DE_SUFFIXES = "ungen lichen ischen heiten keiten ung lich isch heit keit chen lein ern end est ete en er es em st te e n s".split()


def _plain_letters() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the same without; marks of their own are dropped."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x530), *range(0x1E00, 0x2000))):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.combining(m) for m in marks):
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


#: Letters with marks, then marks; and what stands for the former, the latter have nothing.
MARKED, UNMARKED = _plain_letters()
#: Share by which the leading language must lead, else the language is uncertain.
LANGUAGE_MARGIN = 0.34
#: Bidirectional control characters.
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
WORD_SPLIT = r"[^\p{L}\p{N}_-]+"


def raw_words(c: Column) -> Column:
    """Lower-case words of at least two characters; hyphens and underscores belong to words."""
    return F.filter(F.split(F.lower(c), WORD_SPLIT), lambda w: F.length(w) >= 2)


def hyphen_forms(w: Column, stop=EN_STOP) -> Column:
    """The word and, if it has hyphens, its parts of at least two characters that are no stop words."""
    parts = F.filter(F.split(w, "-"), lambda p: (F.length(p) >= 2) & ~p.isin(*stop))
    return F.when(F.instr(w, "-") > 0, F.concat(F.array(w), parts)).otherwise(F.array(w))


def strip_accents(c: Column) -> Column:
    """Letters without their marks."""
    return F.translate(c, MARKED, UNMARKED)


def fold_german(c: Column) -> Column:
    """Umlauts as two letters, ß as ss."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def en_stem(w: Column) -> Column:
    """English word without its ending; at least four characters stay, a doubled last consonant becomes one."""
    out = w
    for s in reversed(EN_SUFFIXES):
        cut = F.left(w, F.length(w) - len(s))
        double = (F.right(cut, F.lit(1)) == F.substring(F.right(cut, F.lit(2)), 1, 1)) & ~F.right(cut, F.lit(2)).isin("ss", "ll", "ee", "oo")
        once = F.when(double, F.left(cut, F.length(cut) - 1)).otherwise(cut)
        out = F.when((F.length(w) >= len(s) + 4) & F.endswith(w, F.lit(s)), once).otherwise(out)
    plural = F.concat(F.left(w, F.length(w) - 3), F.lit("y"))
    return F.when(F.length(w) <= 4, w).when(F.endswith(w, F.lit("ies")) & (F.length(w) >= 6), plural).otherwise(out)


def de_stem(w: Column) -> Column:
    """German word without its ending; at least four characters stay."""
    out = w
    for s in reversed(DE_SUFFIXES):
        out = F.when((F.length(w) >= len(s) + 4) & F.endswith(w, F.lit(s)), F.left(w, F.length(w) - len(s))).otherwise(out)
    return F.when(F.length(w) <= 4, w).otherwise(out)


def spellings(w: Column) -> Column:
    """The word without accents and, where that differs, as written; both are stemmed and indexed."""
    return F.array_distinct(F.array(strip_accents(w), w))


def language_of(en: Column, de: Column) -> Column:
    """``en``, ``de`` or ``uncertain`` from the two weighted counts of stop words."""
    top, second = F.greatest(en, de), F.least(en, de)
    clear = (top > 0) & ((top - second) / F.nullif(top, F.lit(0)) >= LANGUAGE_MARGIN)
    return F.when(clear & (en > de), "en").when(clear, "de").otherwise("uncertain")


def content_words(c: Column, stop=EN_STOP) -> Column:
    """Distinct words of at least four ASCII-folded characters that are no stop words, in order."""
    folded = F.split(strip_accents(F.lower(c)), r"[^a-z0-9_-]+")
    return F.array_distinct(F.filter(folded, lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))


def quoted_phrases(c: Column) -> Column:
    """What stands in straight or typographic double quotes, 2 to 200 characters."""
    return F.transform(F.regexp_extract_all(c, F.lit('(["“„][^"“”„\\n]{2,200}["”“])'), F.lit(1)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


#: Shapes of machine identifiers: paths, versions, hyphenated names, numbers, environment names; and dotted names, of
#: which those that begin with a number are none. The longest run without a blank that is read.
IDENTIFIERS = (
    r"\b[\w.-]+(?:/[\w.-]+)+\b", r"\b\d+\.\d+\.\d+\b", r"(?i)\b[a-z]{2,}[a-z0-9]*(?:-[a-z0-9]{2,}[a-z0-9]*)+\b", r"\b\d{4,8}\b", r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
)
DOTTED, NO_DOTTED, LONGEST_RUN = r"\b\w{2,}(?:\.\w{2,})+\b", r"^\d+\.", 512


def identifiers(c: Column) -> Column:
    """Distinct machine identifiers, in lower case."""
    c = F.regexp_replace(c, rf"(\S{{{LONGEST_RUN}}})\S+", "$1")
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    found = F.concat(*map(every, IDENTIFIERS), F.filter(every(DOTTED), lambda x: ~x.rlike(NO_DOTTED)))
    return F.array_distinct(F.transform(found, F.lower))


def identifiers_sql(table: str, key: str, text: str) -> str:
    """The same in DuckDB's SQL, as rows ``(key, i)`` in the case of the text; runs that long are the caller's to exclude."""
    one = f"SELECT {key}, unnest(regexp_extract_all({text}, '{{}}')) AS i FROM {table}"
    return " UNION ALL ".join([*map(one.format, IDENTIFIERS), f"SELECT * FROM ({one.format(DOTTED)}) WHERE NOT regexp_matches(i, '{NO_DOTTED}')"])


#: Secrets and the markers put in their place, in order.
SECRETS = (
    (r"\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}\b", "[secret:key]"), (r"(?i)\bbearer\s+[A-Za-z0-9._-]{16,}", "[secret:bearer]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[secret:mail]"), (r"\b[0-9a-f]{32,64}\b", "[secret:hash]"), (r"\+\d{2}[ \d-]{8,14}\d", "[secret:phone]"),
)


def redact(c: Column) -> Column:
    """c with typed markers in place of secrets, pass after pass."""
    for pattern, marker in SECRETS:
        c = F.regexp_replace(c, pattern, marker)
    return c


def redactions(c: Column) -> Column:
    """Number of markers in a redacted text."""
    return F.regexp_count(c, F.lit(r"\[secret:[a-z]+\]"))


def redact_values(c: Column, secrets: list[str]) -> Column:
    """c without the given literal values, longest first."""
    for s in sorted(secrets, key=lambda x: (-len(x), x)):
        c = F.replace(c, F.lit(s), F.lit("[secret:env]"))
    return c


def canonical(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def body_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(F.encode(canonical(c), "UTF-8"), 256), 1, 16)


def cut_masked(c: Column, width: int) -> Column:
    """c cut to width, never within a marker: an open one at the end is dropped as a whole."""
    return F.regexp_replace(F.left(c, F.lit(width)), r"\[[a-z:]*$", "")


def snippet(c: Column, needle: str, width: int) -> Column:
    """width characters around the first place of needle, any case, in the first line that has it; null without one."""
    has = lambda x: F.instr(F.lower(x), needle.lower())
    lines = F.transform(F.filter(F.split(c, r"\r?\n"), lambda x: has(x) > 0), lambda x: F.substring(x, F.greatest(F.lit(1), has(x) - width // 2), F.lit(width)))
    return F.get(lines, F.lit(0))


def name_key(c: Column) -> Column:
    """A name in lower case with hyphens for blanks and underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")


#: Letters that may differ between names of at least so many.
NEAR_NAMES = ((5, 2), (3, 1))
#: What no topic holds, and the most words it has.
TOPIC_MARKS, TOPIC_WORDS = r"[.!?,;:]|\s\(", 4


def first_that_holds(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(holds, name) for name, holds in rules))


def similar_reason(a: Column, b: Column) -> Column:
    """Why two names are alike: same, compact (but for case and separators), part (the words of one begin or end the other), letters
    (few differ); null if they are not, or one is empty."""
    keys = [name_key(a), name_key(b)]
    words, flat = [F.split(k, "-") for k in keys], [F.replace(k, F.lit("-"), F.lit("")) for k in keys]
    ends = lambda x, y: (F.slice(x, 1, F.size(y)) == y) | (F.slice(F.reverse(x), 1, F.size(y)) == F.reverse(y))
    part = F.when(F.size(words[0]) > F.size(words[1]), ends(*words)).when(F.size(words[0]) < F.size(words[1]), ends(*reversed(words)))
    apart, shorter = F.levenshtein(*flat), F.least(*map(F.length, flat))
    near = F.exists(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in NEAR_NAMES)), lambda x: (shorter >= x["n"]) & (apart <= x["d"]))
    return F.when(F.least(*map(F.length, keys)) > 0, first_that_holds(("same", keys[0] == keys[1]), ("compact", flat[0] == flat[1]), ("part", part), ("letters", near)))


def topic_warnings(t: Column, project: Column, longest: int = 40) -> Column:
    """What is wrong with a topic name: long, punctuation, words, prefix; nothing for a blank one."""
    c = F.trim(t)
    rules = {"long": F.length(c) > longest, "punctuation": c.rlike(TOPIC_MARKS), "words": F.size(F.split(c, r"\s+")) > TOPIC_WORDS, "prefix": F.startswith(c, F.concat(project, F.lit("/")))}
    found = F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules.items())))
    return F.when(F.coalesce(c, F.lit("")) != "", found).otherwise(F.array().cast("array<string>"))


#: Polite beginnings of a question.
FRAMES = r"(?i)^(?:please|could you|can you|would you|tell me|i would like to know|bitte|kannst du|können sie|sag mir)[ ,:]+"


def drop_frame(c: Column) -> Column:
    """A question without its polite beginning."""
    return F.trim(F.regexp_replace(F.trim(c), FRAMES, ""))


#: Shapes of lines that report a failure.
FAILURES = r"^\s*(?:not ok\b|(?:#|ℹ)\s*fail\s+0*[1-9]\d*\s*$|(?:Uncaught\s+)?[A-Za-z]*Error:|FAIL\b|fatal:)"


def error_signature(c: Column, most: int = 8, width: int = 300) -> Column:
    """The first lines that report a failure, each cut to width, joined by line breaks; null without one."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(FAILURES))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.left(F.trim(x), F.lit(width))), "\n"))


def file_mentions(c: Column, most: int = 3) -> Column:
    """The first distinct file paths named in a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\w./-]+\.(?:mjs|js|py|json|jsonl|md|ts))\b"), F.lit(1))), 1, most)


#: What programs do, told by the first word of a command, or the first two of those of git; any other does neither.
PROGRAMS = {
    "write": "npm node mkdir rm mv cp touch tee chmod git+commit git+push git+add".split(),
    "read": "cat bat sed head tail less more zcat zless jq wc nl column".split(),
    "search": "grep rg ag ack find fd ls tree locate".split(),
}
#: What writes into a file, once quoted stretches are gone: a here-document, or > before a name that is no other stream and not nowhere.
_REDIRECTS = r"<<-?\s*\w|(?<![=-])>(?!\s*(?:[&>(]|/dev/(?:null|stdout|stderr|tty)\b))\s*\S"


def command_kind(c: Column) -> Column:
    """write, read, search or other: the first of them that one of the line's commands does; a redirection writes."""
    bare = F.regexp_replace(c, r"'[^']*'|\"(?:[^\"\\\\]|\\\\.)*\"", "Q")
    starts = F.transform(F.split(bare, r"[|;&\n]+"), lambda x: F.regexp_replace(F.regexp_extract(F.trim(x), r"^(?:git\s+)?[\w.-]+", 0), r"\s+", "+"))
    does = {kind: F.arrays_overlap(starts, F.array(*map(F.lit, names))) for kind, names in PROGRAMS.items()}
    does["write"] = does["write"] | bare.rlike(_REDIRECTS)
    return F.coalesce(first_that_holds(*does.items()), F.lit("other"))


def short_form(c: Column) -> Column:
    """Sorted distinct words of at least three letters without digits and stop words, joined by commas."""
    w = F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*EN_STOP))
    return F.array_join(F.array_sort(F.array_distinct(w)), ",")


def placeholders(c: Column) -> Column:
    """Distinct names in double braces, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([A-Za-z_][\w-]*)\s*\}\}"), F.lit(1)))


def slug(c: Column, most: int = 40) -> Column:
    """ASCII letters, digits and single hyphens, in lower case, marks dropped and ß as ss; cut to most characters and there at a hyphen past
    the twelfth."""
    plain = strip_accents(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))
    s = F.btrim(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.regexp_replace(F.left(s, F.lit(most)), r"^(.{12,})-[^-]*$", "$1")
    return F.when(F.length(s) <= most, s).otherwise(F.rtrim(cut, F.lit("-")))
