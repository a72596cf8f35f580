"""Problem 2: question and answer pairs whose answer is none.

The sentences of all answers, whole and from each of their clauses on, are sorted by text. An answer that ends without a mark
is compared with its neighbours there: it is shortened if a finished sentence goes on from its last one, and whole if a finished
sentence equals it. Token counts at which unfinished answers pile up are length limits. Only where neither says anything,
as for a sentence whose like stands nowhere, the odds of its last two words decide. Copy, refusal and language rules follow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import cut

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")

#: Two words end an unmarked answer if sentences end behind them at least once in so many times that they go on. An answer cut off
#: ends behind any of its words alike, one that only lacks its mark always behind its last, so the odds favour the latter.
FULL_ODDS = 10

#: Placeholders for nothing.
PLACEHOLDERS = frozenset(("null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "leer", "vide", "vacío", "tbd", "todo", "keine antwort", "no answer", "sin respuesta", "pas de réponse", "<empty>", "(empty)", "[empty]"))

#: Phrases that decline to answer, in six languages.
REFUSALS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        r"\b(?:can(?:no|['’])t|can not|(?:am|are|['’]m|['’]re) not able to|(?:am |are |be )?unable to|(?:won['’]t|will not)(?: be able to)?|would rather not|must decline to|have to decline to|decline to|refuse to|not allowed to|not permitted to|(?:do|does|did) not (?:let|allow|permit) (?:me|us)(?: to)?)\b[^.!?]{0,30}\b(?:answer|help|assist|respond|reply|comment|provide|discuss|share)\b",
        r"\bi (?:must|have to) (?:decline|refuse)\b[^.!?]{0,30}\b(?:answer|request|question)\b",
        r"\b(?:kann|darf|möchte|werde|will) (?:ich|wir)\b[^.!?]{0,40}\bnicht\b[^.!?]{0,20}\b(?:helfen|weiterhelfen|beantworten|antworten|äußern|kommentieren|sagen)\b|\b(?:ich|wir) (?:kann|darf|möchte|werde|will|können|dürfen)\b[^.!?]{0,40}\bnicht\b[^.!?]{0,20}\b(?:helfen|weiterhelfen|beantworten|antworten|äußern|kommentieren)\b|\bnicht in der lage\b[^.!?]{0,40}\b(?:beantworten|antworten|helfen)\b|\bantwort\b[^.!?]{0,20}\b(?:ablehnen|verweigern)\b|\b(?:ich|wir) [^.!?]{0,40}nicht helfen\b",
        r"\bno (?:puedo|podemos|podré)\b[^.!?]{0,20}\b(?:ayudar|responder|contestar|comentar|dar)|\bno (?:me|nos) (?:es posible|está permitido)\b[^.!?]{0,30}\b(?:responder|contestar|ayudar)|\bno esto?y? ?(?:autorizad[oa]|en condiciones)\b|\b(?:debo|tengo que|prefiero) (?:declinar|rechazar|no (?:responder|contestar|comentar))|\bme niego a\b",
        r"\bne (?:peux|puis|pouvons|saurais) pas\b[^.!?]{0,30}\b(?:aider|répondre|commenter)|\bdécliner (?:cette|votre|la) (?:requête|demande|question)|\bne (?:suis|sommes) pas (?:autorisée?s?|en mesure)\b[^.!?]{0,20}\b(?:répondre|aider|à|de)|\b(?:refuse|préfère ne pas|dois refuser)\b[^.!?]{0,15}\brépondre",
        r"\b(?:kan|mag|wil|zal) ik\b[^.!?]{0,30}\bniet\b[^.!?]{0,20}\b(?:helpen|beantwoorden|antwoorden|reageren)|\bik (?:kan|mag|wil)\b[^.!?]{0,40}\bniet\b[^.!?]{0,20}\b(?:helpen|beantwoorden|antwoorden)|\bweiger\b[^.!?]{0,20}\bantwoord",
        r"\bnão (?:posso|podemos|consigo|poderei)\b[^.!?]{0,20}\b(?:ajudar|responder|comentar)|\bnão estou autorizad[oa]\b|\b(?:devo|tenho de|prefiro) (?:recusar|declinar|não responder)",
    )
)
#: Labels before a repeated question.
LABELS = frozenset(("q", "question", "frage", "pregunta", "prompt", "vraag", "pergunta", "task", "aufgabe"))

#: Function words, by language.
FUNCTION_WORDS = {
    "en": "the a as at if in is on or its into over under after before each while of that which and must was were is are so with because while between until from this it to we they not an for next has had be by what how why should which where when does do no yes you your our only there",
    "de": "der die das den dem ein eine und nicht wir obwohl weil denn wurde war mit von noch ist im zum auf sich zwei damit sodass nachdem ohne dass nur nach ich es wie bei für was wenn wird warum wo wer sollen soll daraus hier kein keine nein",
    "es": "el la de un y los las una que pero porque por del con sin para cuando hasta aunque se lo de la más y esta este ambos hubo ya dos mismo al qué sigue siendo esta hacemos después así sí aunque bien mientras pues nadie otra otro todo",
    "fr": "le la les de d l s n des une un et que qui pour mais parce puisque dès du au aux en est ce cette il ne pas avec deux même sans dans quand jusqu bien soient qu faut il on si encore cette oui alors tout",
    "nl": "de het een en niet omdat dat hoewel zodat van voor met zonder werd is te terwijl maar want wij op in bij dit geen nog tot toen twee wat waar wanneer welke hoe",
    "pt": "o a de e os as um uma que mas porque por do da dos das com sem para quando até embora não ao mesmo dois ambos foi se na no já é onde qual ou sim assim enquanto pois ninguém outra",
}
#: The languages each function word belongs to.
_LANGS: dict[str, tuple[str, ...]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_v.split()):
        _LANGS[_w] = (*_LANGS.get(_w, ()), _k)
#: Parts of the words without one of which no phrase of REFUSALS can match; most answers have none.
_DECLINES = (
    "answer help helf assist respon repl comment provid discuss shar request question beantwort antwort äußer kommentier sagen ayudar contestar puedo podemos podré autorizad condiciones declinar rechazar"
    " niego aider répon décliner autorisé mesure helpen reager weiger ajudar recusar"
).split()

_ID = r"(?:sha:[0-9a-f]{6,}|req-\d+|[0-9a-f]{8,}|\d{4}-\d\d-\d\dT[\d:.]+Z?)"
_NOISE = re.compile(rf"(?:\({_ID}\)|\[{_ID}\]|{_ID}(?![\w)\]]))[.,:;]?", re.IGNORECASE)
_NOISE_END = re.compile(rf"\s(?:-\s)?(?:\({_ID}\)|\[{_ID}\]|{_ID})[.,:;]?$", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…]+|\n|[^\w\s]")
_FENCE = re.compile(r"```.*?```", re.DOTALL)
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_POINT = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+\.)\s*$")
#: Distinct texts that a task remembers to send them once; it forgets them all beyond that.
_KNOWN = 100_000


def strip_noise(t: str) -> str:
    """t without markup, and without ids, hashes and time stamps at its two ends."""
    t = t.strip().strip("*_ ").strip()
    while (m := _NOISE.match(t)) and m.end() < len(t):
        t = t[m.end() :].lstrip(" -:")
    # An id holds a digit and stands in the last word.
    while any(c.isdigit() for c in t[-24:]) and (m := _NOISE_END.search(t)):
        t = t[: m.start()].rstrip()
    return t.strip("*_ ").strip()


def is_empty(t: str | None) -> bool:
    """Nothing, only marks, or a placeholder for nothing."""
    if t is None:
        return True
    core = t.strip()
    if len(core) > 40 and any(c.isalnum() for c in core[:40]):
        return False
    whole, core = core.lower(), core.strip("\"'`*_.,;:!?()[]{}<>-–—… \t\n").lower()
    return core in PLACEHOLDERS or whole in PLACEHOLDERS or not any(c.isalnum() for c in core)


@lru_cache(maxsize=4096)
def _question(prompt: str) -> tuple[list[str], Counter, tuple[str | None, int]]:
    """A prompt's words, their counts and its language; prompts recur."""
    words = _WORD.findall(prompt.lower())
    return words, Counter(words), language(prompt)


def is_copy(answer: str, prompt: str) -> bool:
    """Only the question again, with a label, repeated, or with small changes."""
    return _copies(_WORD.findall(answer.lower()), prompt)


def _copies(a: list[str], prompt: str) -> bool:
    p, count, _ = _question(prompt)
    while a and a[0] in LABELS:
        a = a[1:]
    if not p or len(a) < 0.6 * len(p):
        return False
    k = max(1, round(len(a) / len(p)))
    if k > 4 or len(a) > k * len(p) + max(1, 0.1 * len(p)):
        return False
    # No more words can be common than the prompt has of those that stand in the answer.
    if sum(map(count.__getitem__, set(a))) < 0.6 * len(p):
        return False
    have, want = Counter(a), Counter({w: n * k for w, n in count.items()})
    extra = sum((have - want).values())
    common = sum((have & want).values())
    if extra > max(1, 0.15 * len(a)) or common < 0.6 * k * len(p):
        return False
    # What is added may stand among the words, but an own answer behind the question is an answer.
    return not extra or a[-1] in p[-3:]


@lru_cache(maxsize=1)
def _decline_words():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w in _DECLINES:
        auto.add_word(w, w)
    auto.make_automaton()
    return auto


def is_refusal(answer: str) -> bool:
    """A sentence that declines to answer, with little beside it."""
    if next(_decline_words().iter(answer.lower()), None) is None:
        return False
    parts = [s for s in re.split(r"(?<=[.!?])\s+", answer) if _WORD.search(s)]
    said = [s for s in parts if next(_decline_words().iter(s.lower()), None) and any(r.search(s) for r in REFUSALS)]
    return bool(said) and len(_WORD.findall(answer)) - sum(len(_WORD.findall(s)) for s in said) <= 14


def _function_words(text: str) -> dict[str, int]:
    n = dict.fromkeys(FUNCTION_WORDS, 0)
    for langs, k in Counter(map(_LANGS.get, _LETTERS.findall((_FENCE.sub(" ", text) if "```" in text else text).lower()))).items():
        for x in langs or ():
            n[x] += k
    return n


def language(text: str) -> tuple[str | None, int]:
    """The language with the most function words, and its lead over the next one."""
    score = sorted(((n, k) for k, n in _function_words(text).items()), reverse=True)
    return (score[0][1], score[0][0] - score[1][0]) if score[0][0] else (None, 0)


def is_foreign(answer: str, prompt: str) -> bool:
    """In another language than the prompt: at least two function words more of one other language."""
    p, lead = _question(prompt)[2]
    if p is None or lead < 1:
        return False
    n = _function_words(answer)
    return max(n.values()) >= n[p] + 2


def ending(answer: str, core: str | None = None) -> tuple[bool, str]:
    """Whether the answer ends with a mark that can end it, and its last two words, digits masked. core is strip_noise(answer)."""
    t = strip_noise(answer) if core is None else core
    if not t:
        return True, ""
    fences = t.count("```")
    if fences % 2:
        return False, "```"
    if not (fences and t.endswith("```")):
        if answer.rstrip()[-1:] in "-*•." and _POINT.search(answer):
            return False, "-"
        if t.count("(") > t.count(")"):
            return False, "("
        if t[-1] not in ".!?…\"”»)]`:’'":
            return False, " ".join(["^", *(_mask(w) for w in _WORD.findall(t))][-2:])
    return True, ""


def _mask(w: str) -> str:
    return "#" if any(c.isdigit() for c in w) else w.lower()


def read(tokens: list[str]) -> tuple[list[str], list[str], list[tuple[str, bool]]]:
    """Of a text's words and marks: its finished sentences, its unfinished last one, and its pairs of neighbouring words.

    Sentences are given from their start and from each of their clauses on, as lower-case words with digits masked. A pair
    comes with whether a sentence may end behind it; the text's own end tells nothing.
    """
    said: list[str] = []
    pairs: list[tuple[str, bool]] = []
    words: list[str] = []
    starts: list[int] = []
    fresh = True
    before, last, open_pair = "", "^", None
    for w in tokens:
        c = w[0]
        if c.isalnum():
            w = w.lower() if w.isalpha() else _mask(w)
            if open_pair is not None:
                pairs.append((open_pair, False))
            if fresh:
                starts.append(len(words))
                fresh = False
            words.append(w)
            before, last = last, w
            open_pair = f"{before} {w}"
            continue
        if open_pair is not None:
            pairs.append((open_pair, c in ".!?…\n([`"))
            open_pair = None
        if c in ".!?…\n":
            said += [" ".join(words[i:]) for i in starts]
            words, starts, fresh, before, last = [], [], True, "", "^"
        elif c in ",;:":
            fresh = True
    return said, [" ".join(words[i:]) for i in starts], pairs


_JUDGED = "pair_id long, tokens long, limited boolean, rule string, done boolean, pair string, units array<string>, said array<string>, pairs array<string>, ends array<long>, goes_on array<long>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each answer that is or may be defective, with the units of its last sentence; and rows without a pair_id that carry
    the finished sentences and the counts of word pairs of a batch."""
    seen: set[str] = set()
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), *[pa.list_(pa.string())] * 3, *[pa.list_(pa.int64())] * 2)
    names = [c.split(" ")[0] for c in _JUDGED.split(", ")]
    for b in batches:
        rows, said_all, ends, goes_on = [], [], Counter(), Counter()
        for pair_id, tokens, fault, t, p in zip(*(b.column(c).to_pylist() for c in ("pair_id", "tokens", "fault", "antwort", "prompt"))):
            if is_empty(t):
                rows.append((pair_id, tokens, False, "empty", True, "", [], None, None, None, None))
                continue
            core = strip_noise(t)
            tokens_ = _ENDS.findall(core)
            rule = "copy" if p is not None and _copies([w.lower() for w in tokens_ if w[0].isalnum()], p) else "refusal" if is_refusal(core) else None
            if rule:
                rows.append((pair_id, tokens, False, rule, True, "", [], None, None, None, None))
                continue
            rule = "other_language" if p is not None and is_foreign(core, p) else None
            done, pair = ending(t, core)
            said, last, pairs = read(_ENDS.findall(_ASIDE.sub("(", core)) if "(" in core or "[" in core else tokens_)  # what stands in brackets is left out
            if done:
                said += last
            for u in said:
                if u not in seen:
                    seen.add(u)
                    said_all.append(u)
            if len(seen) > _KNOWN:
                seen.clear()
            for x, end in pairs:
                (ends if end else goes_on)[x] += 1
            if rule or not done:
                limited = fault is not None and ("limit reached" in fault or "max tokens" in fault)
                rows.append((pair_id, tokens, limited, rule, done, pair, [] if done else last, None, None, None, None))
        keys = list(ends | goes_on)
        rows.append((None, None, None, None, None, None, None, said_all, keys, [ends[k] for k in keys], [goes_on[k] for k in keys]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of units in order, what the next finished one says about each open one.

    What goes on from a unit stands right behind it, so only the units that begin with each other wait at any time. Those that wait at the
    partition's end come out with verdict null; its first finished unit comes out as a row of its own, with verdict ``first``.
    """
    from pyspark import TaskContext

    part, waiting, first, names = TaskContext.get().partitionId(), [], True, ["unit", "verdict", "part"]
    before: str | None = None
    for b in batches:
        out: list[tuple[str, str | None]] = []
        for u, open_ in zip(b.column("unit").to_pylist(), b.column("open").to_pylist()):
            if not open_:  # finished units stand before open ones that equal them
                if first:
                    out.append((u, "first"))
                    first = False
                for f in waiting:
                    out.append((f, _goes_on(f, u)))
                waiting, before = [], u
            elif u == before:
                out.append((u, "whole"))
            else:
                while waiting and not u.startswith(waiting[-1]):
                    out.append((waiting.pop(), "alone"))
                if not waiting or waiting[-1] != u:
                    waiting.append(u)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([v for _, v in out], pa.string()), pa.array([part] * len(out), pa.int32())], names)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.string()), pa.array([None] * len(waiting), pa.string()), pa.array([part] * len(waiting), pa.int32())], names)


def _goes_on(unit: str, text: str) -> str:
    """How a finished text goes on from an open unit: within its last ``word``, ``after`` it, or not at all."""
    if not text.startswith(unit):
        return "alone"
    return "after" if text[len(unit)] == " " else "word"


def compared(judged: DataFrame) -> DataFrame:
    """``(unit, verdict)`` of the open units: ``whole``, ``word``, ``after`` or ``alone``. Sorted over all partitions; what waits at
    the end of one is compared with the next finished unit behind it, in a second step over a few rows a partition."""
    done = judged.filter("said is not null").select(F.explode("said").alias("unit"), F.lit(False).alias("open"))
    open_ = judged.filter("not done").select(F.explode("units").alias("unit"), F.lit(True).alias("open")).distinct()
    every = done.unionByName(open_).repartitionByRange("unit").sortWithinPartitions("unit", "open")
    rows = cut(every.mapInArrow(_neighbours, "unit string, verdict string, part int"))
    edge = rows.filter("verdict is null or verdict = 'first'")
    after = F.first(F.when(F.col("verdict") == "first", F.col("unit")), ignorenulls=True).over(Window.orderBy("part").rangeBetween(1, Window.unboundedFollowing))
    text = F.substring(F.col("after"), F.length("unit") + 1, F.lit(1))
    goes_on = F.when(F.coalesce(~F.startswith("after", "unit"), F.lit(True)), "alone").when(text == " ", "after").otherwise("word")
    over_edge = edge.withColumn("after", after).filter("verdict is null").select("unit", goes_on.alias("verdict"))
    return rows.filter("verdict <> 'first'").select("unit", "verdict").unionByName(over_edge)


def broken_pairs(pairs: DataFrame, tasks: DataFrame, *, spike: float = 8.0, spike_rows: int = 30, detectors: tuple[str, ...] = ("neighbours", "limits", "odds")) -> DataFrame:
    """``(pair_id, defect)``: one row for each pair whose answer is empty, truncated, a refusal, a copy of the question or
    in another language than the prompt; the first of copy, refusal, truncated, other_language that holds.

    pairs has pair_id, task_id, antwort, fehler and aus_tok, tasks has task_id and prompt; other columns are never
    read. A null or blank answer, or one of marks or a placeholder, is empty. Where the task or its prompt is
    missing, copy and other_language are not told. All texts are read whole; a null pair_id gives no row, and repeated rows each
    get their own. An answer that ends without a mark is truncated

    * if its run reports a length limit, or if its brackets, fence or list point are open;
    * else, if a finished sentence equals its last one, or the last clause of it, it is whole;
    * else if a finished sentence goes on from its last one or from a clause of it, or if its token count is a length limit: a
      count with at least spike_rows such answers, spike times the mean of the ten around it;
    * else, where no neighbour has anything to say, if in all answers sentences hardly ever end behind its last two words.

    detectors leaves some of the three out, to measure them; with none, such answers count as whole. Empty tables give no rows.
    """
    t = tasks.filter("task_id is not null").groupBy("task_id").agg(F.min("prompt").alias("prompt"))
    rows = pairs.filter("pair_id is not null").select(F.col("pair_id").cast("long"), "task_id", "antwort", F.col("aus_tok").cast("long").alias("tokens"), F.lower("fehler").alias("fault")).join(t, "task_id", "left")
    judged = cut(rows.select("pair_id", "tokens", "fault", "antwort", "prompt").mapInArrow(_judge, _JUDGED))
    found = judged.filter("pair_id is not null")
    yes, no = F.lit(True), F.lit(False)
    # What its marks leave open.
    marks = found.filter("not done").withColumn("certain", F.col("limited") | F.col("pair").isin("(", "-", "```"))
    last = marks.filter("not certain").select("pair_id", "tokens", "pair", "units")
    if "neighbours" in detectors:
        units = last.select("pair_id", F.explode("units").alias("unit")).join(compared(judged), "unit")
        is_ = lambda v: F.max(F.col("verdict") == v)
        near = units.groupBy("pair_id").agg(is_("whole").alias("whole"), (is_("word") | is_("after")).alias("shortened"))
        last = last.join(near, "pair_id", "left")
    else:
        last = last.withColumns({"whole": no, "shortened": no})
    if "odds" in detectors:
        wanted = last.filter("not coalesce(whole, false) and not coalesce(shortened, false)").select("pair").distinct()
        ends = judged.filter("pairs is not null").select(F.inline(F.arrays_zip("pairs", "ends", "goes_on"))).withColumnRenamed("pairs", "pair").join(wanted, "pair", "left_semi")
        ends = ends.groupBy("pair").agg((F.sum("ends") * FULL_ODDS > F.sum("goes_on")).alias("full"))
        last = last.join(ends, "pair", "left").withColumn("full", F.coalesce("full", no))
    else:
        last = last.withColumn("full", yes)
    last = last.withColumns({"whole": F.coalesce("whole", no), "shortened": F.coalesce("shortened", no)})
    if "limits" in detectors:
        last = cut(last.select("pair_id", "tokens", "whole", "shortened", "full"))
        limits = length_limits(last.filter("not whole"), spike, spike_rows).withColumn("spike", yes)
        last = last.join(limits, "tokens", "left").withColumn("spike", F.coalesce("spike", no))
    else:
        last = last.withColumn("spike", no)
    cut_off = last.filter("not whole and (shortened or spike or not full)").select("pair_id")
    by_rule = found.filter("rule in ('empty', 'copy', 'refusal')").select("pair_id", F.col("rule").alias("defect"))
    short = marks.filter("certain").select("pair_id").unionByName(cut_off).withColumn("defect", F.lit("truncated"))
    foreign = found.filter("rule = 'other_language'").select("pair_id", F.col("rule").alias("defect"))
    return by_rule.unionByName(short).unionByName(foreign.join(short.select("pair_id"), "pair_id", "left_anti"))


def length_limits(unfinished: DataFrame, spike: float, spike_rows: int) -> DataFrame:
    """``(tokens)``: token counts at which unfinished answers pile up."""
    n = unfinished.filter("tokens is not null").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    near = n.select(F.explode(F.sequence(F.col("tokens") - 5, F.col("tokens") + 5)).alias("tokens"), F.col("tokens").alias("of"), "n").filter("tokens <> of")
    around = near.groupBy("tokens").agg((F.sum("n") / 10).alias("around"))
    return n.join(around, "tokens", "left").filter((F.col("n") >= spike_rows) & (F.col("n") > spike * F.coalesce("around", F.lit(0.0)))).select("tokens")
