"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols by a lexicon transducer. A clause's symbols then go through a cascade: negation and
reported speech mark what they weaken, insult, threat and target machines read the marked symbols and give weights. The
cascade is composed into one automaton over the symbols, state by state.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.llm.common import mapped, saved

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AGENT, PERSON = range(8)

INSULTS = """idiot idiots moron morons imbecile stupid dumb worthless trash scum scumbag loser losers clown clowns
pathetic disgusting garbage vermin filth filthy parasite parasites subhuman retard retarded ugly freak creep bastard
bitch whore slut asshole cretin pig pigs dimwit halfwit swine maggot maggots degenerate
abruti connard connasse salaud ordure crétin débile minable pourriture
abschaum trottel vollidiot arschloch dummkopf widerlich erbärmlich wertlos missgeburt
imbécil estúpido estúpida basura escoria inútil asqueroso asquerosa patético payaso cabrón gilipollas""".split()
THREATS = """kill murder slaughter strangle stab shoot hang beat burn hurt destroy smash crush lynch exterminate behead
tuer égorger buter umbringen töten erschießen matar degollar asesinar""".split()
#: Verbs that mean less in games, kitchens and wardrobes.
WEAK_THREATS = frozenset("beat burn hurt hang destroy smash crush shoot".split())
#: Who a threat is against, in the place of an object; who else an insult may be aimed at; who makes threats.
TARGETS = """you u ya yourself yourselves them themselves him her people everyone everybody
te toi vous eux dich dir euch sie usted ustedes ti ellos""".split()
PERSONS = "your you're youre yours ur they they're their these those she his he tu ton ta ils du ihr tú".split()
AGENTS = "i i'll i'm i'd we we'll we're we'd je j'vais nous on ich wir yo nosotros voy vamos".split()
NEGATIONS = """not never no neither nor without isn't aren't wasn't weren't ain't don't doesn't didn't won't can't cannot
pas jamais aucun nicht kein keine niemals nunca ningún ninguna tampoco""".split()
REPORTS = """said says say saying told tells wrote writes called calls claimed claims quoted quote quotes reported reports
accused alleged according dit disait sagte schrieb behauptete dijo escribió afirmó""".split()

#: Words after a negation that it reaches; what is left of a weight under negation and in reported speech.
REACH, NEGATED, REPORTED = 3, 0.1, 0.3
_REPORTS = frozenset(REPORTS)
#: Weight of an insult in a clause without a target and with one, of a threat, of a threat as a command, of weak verbs.
BARE, AIMED, THREATENED, COMMANDED, WEAK = 0.6, 1.0, 1.0, 1.0, 0.6
#: Words between an agent and the verb, and between the verb and its object.
TO_VERB, TO_OBJECT = 4, 2
#: The document's threshold; clauses beyond so many count against its score.
THRESHOLD, CLAUSES = 1.0, 150

#: Lexicon learned from labels: at most so many labelled documents are read; a word (or a stem of so many
#: letters) is learned if so many different contexts of toxic documents have it and few of the others.
MAX_LABELLED, MIN_CONTEXTS, MAX_CLEAN = 20_000, 7, 0.08
STEMS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAK = re.compile(r"[.!?;:,\n\r()\"«»“”„]")
_CLAUSE = re.compile(r"[^.!?;:,\n\r()\"«»“”„]*[^\W_][^.!?;:,\n\r()\"«»“”„]*")
#: What reported speech ends with, or is quoted by, and words.
_SPEECH = re.compile(r"""(?P<line>[\n\r])|(?P<end>[.!?;])|(?P<mark>["«»“”„])|[^\W\d_]+(?:['’][^\W\d_]+)*""")


Marked = tuple[int, float]  # a symbol, and what is left of its weight


def negation(state: int, x: Marked) -> tuple[int, Marked]:
    """state: words that a negation still reaches; it weakens insults and threats."""
    symbol, weight = x
    if state and symbol in (INSULT, THREAT):
        weight *= NEGATED
    return (REACH if symbol == NEGATION else max(0, state - 1)), (symbol, weight)


def report(state: int, x: Marked) -> tuple[int, Marked]:
    """state: whether there was a verb of reporting; it weakens insults and threats."""
    symbol, weight = x
    if state and symbol in (INSULT, THREAT):
        weight *= REPORTED
    return int(state or symbol == REPORT), (symbol, weight)


def insult(state: int, x: Marked) -> tuple[int, float]:
    """Weight of an insult; the clause's last state of target() decides on how much of it counts."""
    return 0, x[1] if x[0] == INSULT else 0.0


def target(state: int, x: Marked) -> tuple[int, float]:
    return int(state or x[0] in (TARGET, PERSON)), 0.0


#: Before the clause's first word; anywhere; then ("agent", words that it reaches), and ("verb", words, weight).
FIRST, ANY = ("first",), ("any",)


def threat(state: tuple, x: Marked) -> tuple[tuple, float]:
    """An agent, a verb of violence, its object, in this order and near each other; or the clause begins with the verb,
    as a command. The weight is the verb's, when the object comes."""
    symbol, weight = x
    if symbol == THREAT and state[0] in ("first", "agent"):
        return ("verb", TO_OBJECT, weight * (THREATENED if state[0] == "agent" else COMMANDED)), 0.0
    if symbol == TARGET and state[0] == "verb":
        return ANY, state[2]
    if symbol == AGENT:
        return ("agent", TO_VERB), 0.0
    if state[0] in ("agent", "verb") and state[1]:
        return (state[0], state[1] - 1, *state[2:]), 0.0
    return ANY, 0.0


def composed() -> tuple[list[tuple], list[list[tuple[int, float, float]]]]:
    """The cascade as one automaton: its states, (negation, report, target, threat) each, those in 0 and 1 begin clauses out of
    and in reported speech; for each state and symbol the next state and the weights of an insult and of a threat."""
    states: list[tuple] = [(0, 0, 0, FIRST), (0, 1, 0, FIRST)]
    number, table = {s: i for i, s in enumerate(states)}, []
    for n, r, t, h in states:  # grows as it goes
        row = []
        for symbol in range(8):
            n2, x = negation(n, (symbol, 1.0))
            r2, x = report(r, x)
            t2, _ = target(t, x)
            h2, threatened = threat(h, x)
            new = (n2, r2, t2, h2)
            if new not in number:
                number[new] = len(states)
                states.append(new)
            row.append((number[new], insult(0, x)[1], threatened))
        table.append(row)
    return states, table


_STATES, _TABLE = composed()
_AIM = [AIMED if t else BARE for _, _, t, _ in _STATES]


def clause_score(symbols: list[tuple[int, float]], reported: bool = False) -> float:
    """Weight of a clause's match: (symbol, weight) of its words in order. reported: whether a verb of
    reporting in an earlier clause still holds."""
    state, insults, threats, verb = int(reported), 0.0, 0.0, 1.0
    for symbol, weight in symbols:
        state, own, threatened = _TABLE[state][symbol]
        insults += weight * own
        if symbol == THREAT:
            verb = weight
        threats += verb * threatened
    return insults * _AIM[state] + threats


class Speech:
    """Whether a place of a text is in reported speech: after a verb of reporting up to the end of its sentence, or
    of the quotation that it introduces. Read from line ends on, which end both; places are asked for in order."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.clear()

    def clear(self) -> None:
        self.reported = self.quoted = self.over = False

    def holds(self, place: int) -> bool:
        begin = max(self.text.rfind("\n", 0, place), self.text.rfind("\r", 0, place)) + 1
        if begin > self.at:
            self.at = begin
            self.clear()
        for m in _SPEECH.finditer(self.text, self.at, place):
            if m["line"]:
                self.clear()
            elif m["end"]:
                if self.quoted and self.reported:
                    self.over = True  # with the quotation
                else:
                    self.reported = False
            elif m["mark"]:
                self.quoted = not self.quoted
                if not self.quoted and self.over:
                    self.reported = self.over = False
            elif m[0] in _REPORTS:
                self.reported = True
        self.at = max(self.at, place)
        return self.reported


class Grammar:
    """The lexicon transducer with learned words and stems, and the search for clauses that can score."""

    def __init__(self, learned: list[tuple[str, bool]] = ()) -> None:
        self.symbol = {}
        for words, symbol in ((PERSONS, PERSON), (TARGETS, TARGET), (AGENTS, AGENT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (THREATS, THREAT), (INSULTS, INSULT)):
            self.symbol |= dict.fromkeys(words, symbol)
        self.words = {w for w, stem in learned if not stem}
        self.stems = {w for w, stem in learned if stem}
        self.lengths = sorted({len(s) for s in self.stems})
        self.anchors = ahocorasick.Automaton()
        for w in {*INSULTS, *THREATS, *self.words, *self.stems}:
            self.anchors.add_word(w, len(w))
        self.anchors.make_automaton()

    def classify(self, word: str) -> int:
        found = self.symbol.get(word)
        if found is not None:
            return found
        if word in self.words or any(word[:n] in self.stems for n in self.lengths):
            return INSULT
        return OTHER

    def score(self, text: str) -> float:
        """Sum of the clauses' weights, by the text's length where it has more than CLAUSES clauses. A clause without
        an insult or a threat weighs nothing, so only those around the automaton's hits are read."""
        text = text.lower()
        total, done, speech = 0.0, -1, Speech(text)
        for end, length in self.anchors.iter(text):
            at = end - length + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            before = 0
            for m in _BREAK.finditer(text, max(0, at - 400), at):
                before = m.end()
            if not before and at > 400:
                for m in _BREAK.finditer(text, 0, at):
                    before = m.end()
            stop = _BREAK.search(text, at)
            done = stop.start() if stop else len(text)
            total += clause_score([(self.classify(w), WEAK if w in WEAK_THREATS else 1.0) for w in _WORD.findall(text[before:done])], speech.holds(before))
        # marks without a word between them end one clause
        return total / max(1.0, sum(1 for _ in _CLAUSE.finditer(text)) / CLAUSES) if total else 0.0


def _features(batches):
    """Of toxic documents: word or stem, and a hash of the word with the one before it."""
    for batch in batches:
        out = set()
        for text in batch.column("text").to_pylist():
            words = _WORD.findall(text.lower())
            for prior, w in zip(["", *words], words):
                context = xxhash.xxh3_64_intdigest(f"{prior} {w}") >> 1
                out.add((w, False, context))
                for n in STEMS:
                    if len(w) > n:
                        out.add((w[:n], True, context))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64()))], ["w", "stem", "c"])


def _counter(candidates: list[tuple[str, bool]]):
    words = {w for w, stem in candidates if not stem}
    stems = {w for w, stem in candidates if stem}

    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for w in set(_WORD.findall(text.lower())):
                    if w in words:
                        n[w, False] += 1
                    for k in STEMS:
                        if len(w) > k and w[:k] in stems:
                            n[w[:k], True] += 1
        rows = [(w, s, c) for (w, s), c in n.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64()))], ["w", "stem", "n"])

    return run


def learn_lexicon(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems of insults, from at most MAX_LABELLED labelled documents (those whose ids have
    the least hashes). Contexts are counted once each, so copies of a document don't add up."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = saved(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")
    toxic = texts.where("toxic = 1").select("text").transform(mapped, _features, "w string, stem boolean, c long").distinct()
    found = toxic.groupBy("w", "stem").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).collect()
    if not found:
        return []
    had = {(r.w, r.stem): r.n for r in found}
    clean = texts.where("toxic = 0").select("text").transform(mapped, _counter(list(had)), "w string, stem boolean, n long").groupBy("w", "stem").agg(F.sum("n").alias("n")).collect()
    against = {(r.w, r.stem): r.n for r in clean}
    good = {k for k, n in had.items() if against.get(k, 0) <= MAX_CLEAN * n}
    stems = {w for w, stem in good if stem}
    return sorted((w, stem) for w, stem in good if not any(w[:k] in stems for k in STEMS if k < len(w)))


def _scored(grammar_of: list[tuple[str, bool]], names: list[str], keep: bool):
    def run(batches):
        grammar = Grammar(grammar_of)
        for batch in batches:
            scores = [grammar.score(t) if t else 0.0 for t in batch.column("text").to_pylist()]
            if keep:
                yield batch.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(scores, 6), pa.float64()), pa.array([s >= THRESHOLD for s in scores], pa.bool_())], names)

    return run


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, toxic for each row of docs.

    The score is the sum over clauses (texts are cut at sentence and clause marks and line ends) of what
    the automaton matches: insults, BARE each in a clause without a person that they can be aimed at and AIMED in one
    with, and threats: an agent, a verb of violence and its object in this order, TO_VERB and TO_OBJECT words apart at most,
    THREATENED each, or a clause that begins with the verb, COMMANDED; weak verbs WEAK of that; NEGATED of it within
    REACH words of a negation, REPORTED of it after
    a verb of reporting, up to the end of its sentence or of the quotation that it introduces. A text of more than CLAUSES clauses has its
    sum divided by how many times so many it has. From THRESHOLD on a document is toxic. A null or empty text scores 0; texts
    are read whole; repeated rows score alike; columns other than doc_id and text aren't read. Labels may
    repeat (the highest counts) or be null or missing (then only the built-in lexicon holds).
    """
    learned = learn_lexicon(spark, docs, labels)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").transform(mapped, _scored(learned, ["doc_id", "score", "toxic"], False), f"doc_id {kind}, score double, toxic boolean")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that toxicity() calls toxic; columns, of whatever names, and texts as they were.

    Null and empty texts stay, repeated rows stay or go together, labels are as in toxicity(), an empty table stays empty.
    """
    return docs.transform(mapped, _scored(learn_lexicon(spark, docs, labels), docs.columns, True), docs.schema)
