"""Toxicity by a weighted finite-state pattern grammar.

Tokens are first mapped to classes (insult, harm, intent, target, copula, article, negation, report, quote,
other; a clause ends with ``end``).  Six small transducers are composed in a cascade, each reading the class
and the label that the one before it gave to the token, and the product states are built lazily:

    insult    labels an insult ``bare``; ``pile`` if its clause has one already, ``recur`` if an earlier clause had
    frame     an insult soon after a copula becomes ``predicate``, a first one after an article ``nominal``
    target    an insult soon after a target becomes ``address``; a target soon after an insult is one itself
    threat    intent, harm and a target in one clause become ``threat``
    negation  lowers the factor of a label soon after a negation
    report    lowers the factor of labels after a report or within quotes, to the end of the clause

A path that ends in any label but ``bare`` is an accepting pattern.  A document's evidence for a pattern is the
sum of factor times lexical weight over its matched clauses; the score is a logistic curve of the patterns'
weights times log(1 + evidence).  An insult outside every pattern (``bare``) has at most ``BARE`` of the mean
pattern's weight, so single words do not decide.  Pattern weights are fitted on labels, towards ``PRIOR``.

The insult lexicon starts from the words below and is extended from labelled documents: words and word
beginnings of ``STEMS`` letters that occur (once, or in two different words) in toxic documents almost only,
chosen greedily by the toxic documents that they newly cover.  Labels come from ``TRAIN_ROWS`` documents at most
(a documented bound; one document for each labelled id); near copies (equal minimum hash of word shingles)
count once.  Everything collected to the driver comes from these documents.

Null and empty texts have no clauses, hence the curve's lowest score.  Without usable labels the word
lists and the prior weights are used.  Repeated rows and rows with null ids are scored like any other, an
empty table gives an empty result, texts are read whole whatever their length, and columns other than id and
text are never read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_rows, cut, labelled_sample, slices

#: Bound on labelled documents that the lexicon and the pattern weights are fitted on.
TRAIN_ROWS = 12_000
LEAST_SUPPORT = 4
LEAST_PRECISION = 0.95
STEMS = (3, 4, 5, 6, 7)
#: Share of its weight that a beginning has which tells toxic documents only if two words have it.
WEAK = 0.35

#: Word lists of the grammar by class, in four languages.
CLASSES = {
    "insult": "idiot idiots moron morons imbecile scum loser losers trash filth vermin stupid pathetic worthless disgusting dumbass bastard clown idioten abschaum dummkopf versager connard salaud débile abruti imbécil estúpido basura escoria",
    "harm": "kill hurt beat murder destroy shoot stab strangle burn attack töten umbringen schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar",
    "intent": "will gonna shall should must ll going want werde werden soll muss vais va vas veux doit voy vamos quiero debe",
    "target": "you your yours u yourself he him his she her they them their these those this vous votre tu toi te ton du dich dir ihr euch usted ustedes tú ti él ella ellos sie ihnen ils elles",
    "copula": "is are am was were be been re bist ist sind seid war est sont êtes était es son eres está están era",
    "article": "a an the such what of ein eine einen der die das den dem und un une le la les de des et una el los las y",
    "negation": "not no never neither without isn aren wasn don doesn nicht kein keine nie niemals pas jamais aucun nunca jamás ni",
    "report": "said says say told wrote writes quoted quotes claimed reported reportedly called according sagte schrieb behauptete zitierte dit écrit déclaré selon dijo escribió según",
}
CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;:\n]+")
QUOTES = frozenset("\"“”«»„")

#: Labels that a path can end in, and the weight of each before any label is seen.
PATTERNS = ("address", "predicate", "nominal", "pile", "recur", "threat", "bare")
PRIOR = {"address": 3.5, "predicate": 3.0, "nominal": 2.5, "pile": 3.0, "recur": 2.5, "threat": 3.5, "bare": 0.6}
BIAS = -3.0
#: Most of the mean pattern weight that an insult outside every pattern can have.
BARE = 0.3
#: Lexical weight of a threat and of an address that follows its insult; factors of the modifiers.
THREAT_WEIGHT, AFTER_WEIGHT = 3.0, 2.0
MODIFIERS = {"negated": 0.1, "reported": 0.15}
#: Tokens over which a frame, a target and a negation reach.
REACH = {"frame": 4, "target": 4, "negation": 3}


class Transducer:
    """States with a rule ``(state, class, label) -> (state, label, factor)``."""

    start: object = 0

    def step(self, state, symbol: str, label: str | None):
        raise NotImplementedError


class Insult(Transducer):
    start = ""

    def step(self, state, symbol, label):
        if symbol == "insult":
            return "clause", {"": "bare", "clause": "pile", "past": "recur"}[state], 1.0
        if symbol == "end" and state == "clause":
            return "past", label, 1.0
        return state, label, 1.0


class Frame(Transducer):
    """State: (tokens left of a copula's reach, of an article's)."""

    start = (0, 0)

    def step(self, state, symbol, label):
        if symbol == "end":
            return self.start, label, 1.0
        copula, article = state
        if symbol == "insult":
            label = "predicate" if copula else "nominal" if article and label == "bare" else label
        left = lambda name, k: REACH["frame"] if symbol == name else max(0, k - 1)
        return (left("copula", copula), left("article", article)), label, 1.0


class Target(Transducer):
    """State: (tokens left of a target's reach, of an insult's)."""

    start = (0, 0)

    def step(self, state, symbol, label):
        if symbol == "end":
            return self.start, label, 1.0
        target, insult = state
        if symbol == "insult" and target:
            label = "address"
        elif symbol == "target" and insult:
            return (REACH["target"], 0), "address", 1.0
        left = lambda name, k: REACH["target"] if symbol == name else max(0, k - 1)
        # An insult that is an address already doesn't make one of the target after it.
        return (left("target", target), 0 if label == "address" else left("insult", insult)), label, 1.0


class Threat(Transducer):
    """Intent, harm, target; or target, intent, harm, target: the last arc alone accepts."""

    start = ""

    def step(self, state, symbol, label):
        if symbol == "end":
            return "", label, 1.0
        if symbol == "intent" and state == "":
            return "intent", label, 1.0
        if symbol == "harm" and state == "intent":
            return "harm", label, 1.0
        if symbol == "target" and state == "harm":
            return "", "threat", 1.0
        return state, label, 1.0


class Negation(Transducer):
    """A negated harm keeps its factor for the threat that it is part of.  State: (tokens left, threat negated)."""

    start = (0, False)

    def step(self, state, symbol, label):
        if symbol == "end":
            return self.start, label, 1.0
        left, threat = state
        hit = threat if label == "threat" else bool(left) and label is not None
        if symbol == "harm":
            threat = bool(left)
        return (REACH["negation"] if symbol == "negation" else max(0, left - 1), threat), label, MODIFIERS["negated"] if hit else 1.0


class Report(Transducer):
    """State: (reported, within quotes)."""

    start = (False, False)

    def step(self, state, symbol, label):
        if symbol == "end":
            return self.start, label, 1.0
        said, quoted = state
        factor = MODIFIERS["reported"] if label is not None and (said or quoted) else 1.0
        return (said or symbol == "report", quoted != (symbol == "quote")), label, factor


class Grammar:
    """Lazy composition of the transducers: the label of each is the next one's input, factors multiply."""

    def __init__(self):
        self.parts = (Insult(), Frame(), Target(), Threat(), Negation(), Report())
        self.start = tuple(t.start for t in self.parts)
        self.arcs: dict = {}

    def step(self, state, symbol):
        key = state, symbol
        if key not in self.arcs:
            nxt, label, factor = [], None, 1.0
            for t, s in zip(self.parts, state, strict=True):
                to, label, f = t.step(s, symbol, label)
                nxt.append(to)
                factor *= f
            self.arcs[key] = tuple(nxt), label, factor
        return self.arcs[key]

    def read(self, symbols: list[tuple[str, float]], state=None) -> tuple[list[tuple[str, float]], object]:
        """(label, weight) of each match in one clause, and the state after its end."""
        state, found = state or self.start, []
        for symbol, weight in symbols:
            state, label, factor = self.step(state, symbol)
            if label is not None:
                lexical = weight if symbol == "insult" else THREAT_WEIGHT if label == "threat" else AFTER_WEIGHT
                found.append((label, lexical * factor))
        return found, self.step(state, "end")[0]


class Lexicon:
    """Weighted words and word beginnings, found in a text by one automaton pass."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words = {w: 2.0 for w, c in CLASS_OF.items() if c == "insult"} | words
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems})
        self.grammar = Grammar()
        self.automaton = ahocorasick.Automaton()
        for w in {*self.words, *stems, *CLASSES["harm"].split()}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def symbol(self, token: str) -> tuple[str, float]:
        if (w := self.words.get(token)) is not None:
            return "insult", w
        known = [self.stems[token[:n]] for n in self.lengths if token[:n] in self.stems and len(token) > n]
        if known:
            return "insult", max(known)
        return ("quote" if token in QUOTES else CLASS_OF.get(token, "other")), 0.0

    def clauses(self, text: str | None) -> list[tuple[int, int, list[tuple[str, float]]]]:
        """(begin, end, matches) of the clauses that hold a match; other clauses leave no trace in the state."""
        if not text:
            return []
        low = text.lower()
        hits = sorted(end + 1 - n for end, n in self.automaton.iter(low) if end == n - 1 or not low[end - n].isalpha())
        if not hits:
            return []
        found, begin, k, state = [], 0, 0, self.grammar.start
        for stop, after in [*(m.span() for m in CLAUSE.finditer(low)), (len(low), len(low))]:
            if hits[k] < stop:
                marks, state = self.grammar.read([self.symbol(t) for t in TOKEN.findall(low, begin, stop)], state)
                if marks:
                    found.append((begin, stop, marks))
            begin = after
            while hits[k] < begin:
                k += 1
                if k == len(hits):
                    return found
        return found

    def evidence(self, text: str | None) -> list[float]:
        """Evidence of each of ``PATTERNS``."""
        total = dict.fromkeys(PATTERNS, 0.0)
        for _, _, marks in self.clauses(text):
            for label, weight in marks:
                total[label] += weight
        return list(total.values())


def pattern_scores(evidence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores from rows of pattern evidence; ``weights`` is the bias, then one for each of ``PATTERNS``."""
    return 1 / (1 + np.exp(-np.clip(weights[0] + np.log1p(evidence) @ weights[1:], -30, 30)))


def prior_weights() -> np.ndarray:
    return np.array([BIAS, *(PRIOR[p] for p in PATTERNS)])


def fit_patterns(evidence: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Bias and pattern weights of a logistic curve, drawn towards the prior, by cyclic Newton steps.

    Weights are not negative, and that of ``bare`` is at most ``BARE`` of the mean of the others.
    """
    prior = prior_weights()
    beta = prior.copy()
    z = np.concatenate([np.ones((len(evidence), 1)), np.log1p(evidence)], 1)
    pull = np.array([1e-6, *[ridge] * len(PATTERNS)])
    bare = 1 + PATTERNS.index("bare")
    f = z @ beta
    for _ in range(300):
        before = beta.copy()
        for k in range(len(beta)):
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            g = z[:, k] @ (p - y) + pull[k] * (beta[k] - prior[k])
            h = (z[:, k] ** 2) @ (p * (1 - p)) + pull[k]
            to = beta[k] - np.clip(g / h, -1, 1)
            if k:
                to = max(to, 0.0)
            if k == bare:
                to = min(to, BARE * np.delete(beta, [0, bare]).mean())
            f += z[:, k] * (to - beta[k])
            beta[k] = to
        if np.abs(beta - before).max() < 1e-6:
            break
    return beta


def features(text: str | None) -> set[str]:
    """Distinct words ("=" before), word beginnings ("^") and beginnings of two or more distinct words ("2") of a text."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    out = {"=" + w for w in words}
    for n in STEMS:
        stems = Counter(w[:n] for w in words if len(w) > n)
        out.update("^" + s for s in stems)
        out.update("2" + s for s, c in stems.items() if c > 1)
    return out


def _copy_key(text: str | None) -> int:
    """Minimum hash of five-word shingles: near copies mostly share it."""
    import xxhash

    w = (text or "").encode().lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1


def _with_copy_key(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_copy_key(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "text", "y", "copy"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, sample.select("doc_id", "text", "y").schema.simpleString()[7:-1] + ",copy:bigint")


def fit_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """Learned words and beginnings with weights, and the pattern weights, from (doc_id, text, y)."""
    keyed = _with_copy_key(sample)
    first = keyed.groupBy("copy").agg(F.min_by(F.struct("text", "y"), "doc_id").alias("x")).select("x.text", "x.y")
    first = cut(first, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y > 0)].update(features(t))
            f = list({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([seen[1][x] for x in f], pa.int64()), pa.array([seen[0][x] for x in f], pa.int64())], names=["f", "toxic", "clean"])

    totals = {r["y"] > 0: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    if not totals.get(True) or not totals.get(False):
        return words, stems, prior_weights()
    counted = first.mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counted.filter((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    candidates = {r["f"]: (r["toxic"], r["clean"]) for r in good.collect()}  # words of at most TRAIN_ROWS documents

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t) & candidates.keys()) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["f"])

    toxic = [set(r["f"]) for r in first.filter("y > 0").mapInArrow(which, "f array<string>").toLocalIterator()]  # at most TRAIN_ROWS short lists
    open_docs = set(range(len(toxic)))
    members: dict[str, set[int]] = {}
    for k, fs in enumerate(toxic):
        for f in fs:
            members.setdefault(f, set()).add(k)
    while open_docs and members:
        # Most newly covered first; among equals whole words before beginnings, and the longest, most specific one.
        best = max(members, key=lambda f: (len(members[f] & open_docs) * (1 - 2 * candidates[f][1] / sum(candidates[f])), f[0] == "=", len(f), f))
        if len(members[best] & open_docs) < LEAST_SUPPORT:
            break
        t, c = candidates[best]
        weight = float(np.clip(np.log((t + 0.5) / (c + 0.5) * (totals[False] + 1) / (totals[True] + 1)) / 2, 1.0, 4.0))
        if best[0] == "=":
            words[best[1:]] = weight
        else:
            stems[best[1:]] = max(stems.get(best[1:], 0.0), weight * (WEAK if best[0] == "2" else 1.0))
        open_docs -= members.pop(best)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(words, stems)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lex.evidence(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["e", "y"])

    got = first.select("text", "y").mapInArrow(evidence, "e array<double>, y int").toPandas()  # a few numbers for each of at most TRAIN_ROWS documents
    return words, stems, fit_patterns(np.array(got["e"].tolist(), float).reshape(-1, len(PATTERNS)), (got["y"].to_numpy() > 0).astype(float))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int, folds: int, carry: list[str] | None = None) -> DataFrame:
    """(_row, score, evidence, n_clauses) of every row of ``docs``; one map pass."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, stems, weights = fit_lexicon(labelled_sample(named, labels, "toxic", train_rows, folds))

    def judge():
        lex = Lexicon(words, stems)

        def run(texts: list[str | None]) -> list[pa.Array]:
            found = [lex.clauses(t) for t in texts]
            e = np.zeros((len(found), len(PATTERNS)))
            for k, clauses in enumerate(found):
                for _, _, marks in clauses:
                    for label, weight in marks:
                        e[k, PATTERNS.index(label)] += weight
            return [pa.array(pattern_scores(e, weights)), pa.array(e.tolist(), pa.list_(pa.float64())), pa.array([len(c) for c in found], pa.int32())]

        return run

    return beside_rows(docs, text_col, "score double, evidence array<double>, n_clauses int", judge, carry)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """(doc_id, score, evidence by pattern, n_clauses) of every row, the grammar fitted on ``labels.toxic`` outside fold 0."""
    return _scored(docs, labels, id_col, text_col, train_rows, folds, [id_col]).select(F.col("_row")[id_col].alias("doc_id"), "score", "evidence", "n_clauses")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more.

    Every row is judged by its own text, rows that share an id too, and no text is shuffled.
    """
    return _scored(docs, labels, id_col, text_col, train_rows, folds).filter(F.col("score") < least).select("_row.*")
