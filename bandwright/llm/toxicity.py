"""Toxicity by a weighted finite-state grammar over clauses, with a learned lexicon and learned pattern weights."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import add_columns, map_arrow, raw, shown, small_batches
from .language_id import held_out

# A-Z lower-cased; letters, digits and non-ASCII bytes stay; marks that end a clause become a full stop, the rest blanks.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 46 if b in b".!?;:\n" else 32 for b in range(256))
STEM, LONGEST = 4, 12

# Symbols that words are read as.
WORD, INSULT, THREAT, TARGET, NOT, SAID = range(6)
# fixed values: closed-class words of the corpus's four languages
CLOSED = {
    TARGET: "you your yours yourself he she him her they them du dich dir ihr euch sie er tu toi vous te il elle ils tú usted ustedes él ella ellos",
    NOT: "not no never n't nobody nicht kein keine nie pas jamais aucun nunca jamás ningún",
    SAID: "said says say called calls claimed wrote quoted sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió",
    THREAT: "kill hurt destroy beat punish shoot töten schlagen verletzen tuer frapper détruire matar golpear destruir",
}
# Marks a pattern match may carry, in the order of the learned weights.
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED = range(5)
KINDS = 5


def clauses(text: bytes) -> list[list[bytes]]:
    """A text's clauses as lists of normalised words."""
    return [c for x in text.translate(_NORMAL).split(b".") if (c := x.split())]


@dataclass
class Transducer:
    """A deterministic weighted transducer over symbols: next[state][symbol] = (state, output symbol, marks, weight).

    marks: the set of kinds that it adds to a match.  Weights add up along a path.  A symbol without an arc is
    copied and leaves the state as it is.
    """

    next: list[dict[int, tuple[int, int, frozenset[int], float]]] = field(default_factory=list)

    def step(self, state: int, symbol: int) -> tuple[int, int, frozenset[int], float]:
        return self.next[state].get(symbol, (state, symbol, frozenset(), 0.0))

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input."""
        pairs, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
        while todo:
            a, b = todo.pop(0)
            arcs = {}
            for symbol in (WORD, INSULT, THREAT, TARGET, NOT, SAID):
                a2, middle, marks, weight = self.step(a, symbol)
                b2, last, marks2, weight2 = other.step(b, middle)
                if (a2, b2) not in pairs:
                    pairs[a2, b2] = len(pairs)
                    todo.append((a2, b2))
                arcs[symbol] = (pairs[a2, b2], last, marks | marks2, weight + weight2)
            out.next.append(arcs)
        return out


def _window(opens: int, marks: int, on: tuple[int, ...], span: int | None, weight: float) -> Transducer:
    """After the symbol `opens`, matches on the symbols `on` within `span` words (None: the clause) get a mark and weight."""
    n = span or 1
    none = frozenset()
    states = []
    for s in range(n + 1):
        arcs = {}
        for symbol in (WORD, INSULT, THREAT, TARGET, NOT, SAID):
            to = 0 if s == 0 else s if span is None else s - 1
            mark, w = (frozenset([marks]), weight) if s and symbol in on else (none, 0.0)
            arcs[symbol] = (n if symbol == opens else to, symbol, mark, w)
        states.append(arcs)
    return Transducer(states)


def grammar() -> Transducer:
    """Insult and threat matches, read through target, negation and reported-speech transducers in turn."""
    base = Transducer([{INSULT: (0, INSULT, frozenset([PLAIN]), 1.0), THREAT: (0, THREAT, frozenset(), 0.0)}])
    target = _window(TARGET, TARGETED, (INSULT,), 4, 0.5)
    threat = _window(THREAT, THREATENED, (TARGET,), 3, 1.0)
    negated = _window(NOT, NEGATED, (INSULT, THREAT), 3, -0.5)
    reported = _window(SAID, REPORTED, (INSULT, THREAT), None, -0.25)
    return base.then(target).then(threat).then(negated).then(reported)


class Lexicon:
    """Word -> symbol.  Insults by learned stems (every word that begins with one), the rest by closed lists."""

    def __init__(self, stems: dict[bytes, float]):
        self.stems = stems
        self.closed = {w.encode(): k for k, ws in CLOSED.items() for w in ws.split()}
        self.find = ahocorasick.Automaton()
        for s in stems:
            self.find.add_word(" " + s.decode("latin-1"), 1)
        for w, k in self.closed.items():
            if k == THREAT:
                self.find.add_word(" " + w.decode("latin-1") + " ", 1)
        self.find.make_automaton()
        self.lengths = sorted({len(s) for s in stems})

    def read(self, word: bytes) -> tuple[int, float]:
        for k in self.lengths:
            if k > len(word):
                break
            if (w := self.stems.get(word[:k])) is not None:
                return INSULT, w
        return self.closed.get(word, WORD), 0.0

    def relevant(self, text: bytes) -> list[list[bytes]]:
        """The clauses in which a stem or threat occurs; one scan of the text finds them."""
        line = b" " + text.translate(_NORMAL).replace(b".", b" . ") + b" "
        out, past = [], -1
        for end, _ in self.find.iter(line.decode("latin-1")):
            if end > past:
                begin = line.rfind(b".", 0, end) + 1
                past = line.find(b".", end)
                past = len(line) if past < 0 else past
                out.append(line[begin:past].split())
        return out


@dataclass
class Model:
    stems: dict[bytes, float]
    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, stems: dict[bytes, float]):
        self.lexicon, self.grammar = Lexicon(stems), grammar()

    def matches(self, clause: list[bytes]) -> list[tuple[int, frozenset[int], float]]:
        """(position, marks, weight) of each match of the composed grammar in a clause."""
        state, out = 0, []
        for i, w in enumerate(clause):
            symbol, strength = self.lexicon.read(w)
            state, _, marks, weight = self.grammar.next[state][symbol]
            if marks and (PLAIN in marks or THREATENED in marks):
                out.append((i, marks, weight + strength))
        return out

    def counts(self, text: bytes) -> np.ndarray:
        """Of each kind log(1 + the summed weight of matched clauses that carry it), and the strongest clause's weight."""
        total, most = np.zeros(KINDS), 0.0
        for clause in self.lexicon.relevant(text):
            found = self.matches(clause)
            for _, marks, w in found:
                for k in marks:
                    total[k] += max(w, 0.0)
            most = max(most, sum(max(w, 0.0) for _, _, w in found))
        return np.append(np.log1p(total), np.log1p(most))


def stem_counts(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): documents of each label that have a word beginning with term, of (toxic, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            count: dict[bytes, list[int]] = {}
            for label, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                terms = {w[:k] for c in clauses(text or b"") for w in c for k in range(STEM, min(len(w), LONGEST) + 1)}
                for t in terms:
                    count.setdefault(t, [0, 0])[1 - label] += 1
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(count, pa.binary()), *(pa.array([v[i] for v in count.values()], pa.int64()) for i in (0, 1))], names=["term", "pos", "neg"])

    out = map_arrow(rows.select("toxic", "text"), run, "term binary, pos long, neg long")
    return out.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fingerprint(text: bytes) -> int:
    """A number that near copies mostly share: the smallest hash of a text's long words (of all, if none is long)."""
    own = {w for c in clauses(text) for w in c}
    return min((zlib.crc32(w) for w in own if len(w) >= 9), default=min(map(zlib.crc32, own), default=0))


def choose(toxic: DataFrame, found: list[tuple[bytes, int]], neg: int, least: int = 5, ratio: float = 20.0, surprise: float = 16.0) -> dict[bytes, float]:
    """Stems and their strengths, chosen from candidates (term, documents of label 0 with it).

    Copies of one toxic text would make all its words look toxic, so toxic documents count by distinct
    fingerprints.  A stem needs `least` of them, `ratio` times the rate of the others, and a likelihood ratio of
    exp(surprise).  Of stems that begin with one another the one that tells most is kept.
    """
    number = {t: i for i, (t, _) in enumerate(found)}
    lengths = sorted({len(t) for t in number})

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t or b"" for t in raw(batch.column(0))]
            out = [sorted({i for c in clauses(t) for w in c for k in lengths if (i := number.get(w[:k])) is not None}) for t in texts]
            yield pa.RecordBatch.from_pydict({"f": pa.array(map(fingerprint, texts), pa.int64()), "at": pa.array(out, pa.list_(pa.int32()))})

    got = map_arrow(toxic.select("text"), which, "f long, at array<int>").toArrow()  # as many rows as were drawn, at most
    prints = got.column("f").to_pylist()
    seen: list[set[int]] = [set() for _ in found]
    for f, at in zip(prints, got.column("at").to_pylist(), strict=True):
        for i in at:
            seen[i].add(f)
    pos = len(set(prints))
    p = pos / (pos + neg)
    gains = []
    for (t, b), x in zip(found, seen, strict=True):
        a = len(x)
        if a < least:
            continue
        rate = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
        g = a * math.log(a / ((a + b) * p)) + (b * math.log(b / ((a + b) * (1 - p))) if b else 0.0)
        if rate >= math.log(ratio) and g >= surprise:
            gains.append((-a * rate, len(t), t, rate))
    stems: dict[bytes, float] = {}
    for _, _, t, rate in sorted(gains):
        if not any(t.startswith(s) or s.startswith(t) for s in stems):
            stems[t] = min(2.0, rate / 4)
    return stems


def learn(docs: DataFrame, labels: DataFrame, most: int, doc_col: str, text_col: str, label_col: str, most_stems: int = 2000) -> Model:
    """Stems and pattern weights from about `most` labelled rows that are not held out, chosen by a hash of doc_id."""
    known = labels.select(labels[doc_col].alias("d"), labels[label_col].cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("d").isNotNull() & ~held_out(F.col("d")))
    n = known.count()
    empty = Model({}, np.zeros(KINDS + 1), -4.0)
    if not n:
        return empty
    draw = F.pmod(F.xxhash64("d"), F.lit(1 << 30)) / float(1 << 30)
    # bounded by the limit, and so sent to all: the texts are not shuffled
    drawn = known.where(draw < min(1.0, most / n)).groupBy("d").agg(F.max("toxic").alias("toxic")).limit(2 * most)
    rows = docs.select(docs[doc_col].alias("d"), docs[text_col].alias("text")).where("text is not null").join(F.broadcast(drawn), "d").select("toxic", "text")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return empty
    p = pos / (pos + neg)
    counts = stem_counts(rows)
    surprise = F.col("pos") * F.log(F.col("pos") / ((F.col("pos") + F.col("neg")) * p)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / ((F.col("pos") + F.col("neg")) * (1 - p)))).otherwise(0.0)
    ratio = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    strong = counts.where("pos >= 5").withColumn("g", surprise).withColumn("r", ratio).where((F.col("g") >= 16) & (F.col("r") >= math.log(20)))
    found = [(bytes(r["term"]), r["neg"]) for r in strong.orderBy(F.desc("g"), F.length("term"), "term").limit(most_stems).collect()]
    stems = choose(rows.where("toxic = 1"), found, neg)
    sent = docs.sparkSession.sparkContext.broadcast(stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in small_batches(batches, "text"):
            x = np.array([scorer.counts(t or b"") for t in raw(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = map_arrow(rows, measure, "y int, x array<double>").toPandas()  # at most 2 * most rows of a few numbers
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(float)
    weights, bias = np.zeros(x.shape[1]), math.log(p / (1 - p))
    prior = np.array([1.0, 1.0, -0.25, -0.25, 1.0, 1.0])  # where the rows say nothing
    a = np.column_stack([x, np.ones(len(x))])
    w = np.append(prior, bias)
    for _ in range(30):  # Newton's method with a ridge to the prior
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.append(np.full(len(prior), 1.0), 0.01)
        g = a.T @ (q - y) + ridge * (w - np.append(prior, bias))
        h = (a * (q * (1 - q))[:, None]).T @ a + np.diag(ridge)
        w = w - np.linalg.solve(h, g)
    weights, bias = w[:-1], float(w[-1])
    return Model(stems, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """docs' columns (or those in keep) with held_out, score, predicted and, with_spans, the matched clauses.

    Words are read as insults (by learned stems), threats, targets, negations and reporting verbs; the composed
    transducer runs over each clause in which an insult or threat occurs, and its matches, by kind, are the
    only features of a logistic score.  The lexicon and weights come from about `most` labelled rows (a
    documented bound) that are not held out; every whole text is scored.  Null and empty texts have no
    match and get the score of such a text.  A null doc_id is not held out and never learned from; a doc_id with
    several labels counts as toxic if one says so.  Without labels of both kinds scores are near 0.
    clauses: array of (text, weight).  Added columns replace those with their names, all others stay, whatever their
    names.  Repeated rows give repeated rows, an empty table none.
    """
    model = learn(docs, labels, most, doc_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    if with_spans:
        made.append(StructField("clauses", ArrayType(StructType([StructField("text", StringType()), StructField("weight", DoubleType())]))))

    def run(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        m = sent.value
        scorer = Scorer(m.stems)
        for texts in batches:
            texts = [t or b"" for t in texts]
            x = np.array([scorer.counts(t) for t in texts])
            s = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30)))
            columns = [pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()).cast(pa.int32())]
            if with_spans:
                found = [[{"text": b" ".join(c).decode(), "weight": float(sum(w for _, _, w in scorer.matches(c)))} for c in scorer.lexicon.relevant(t)] for t in texts]
                columns.append(pa.array(found, pa.list_(pa.struct([("text", pa.string()), ("weight", pa.float64())]))))
            yield columns

    need = keep if keep is None or doc_col in keep else [*keep, doc_col]
    out = add_columns(docs, text_col, run, made, need).withColumn("held_out", held_out(F.col(f"c{docs.columns.index(doc_col)}")))
    return shown(out, docs.columns, ["held_out", "score", "predicted"] + ["clauses"] * with_spans, keep)
