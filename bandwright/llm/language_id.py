"""Language identification by a linear-chain conditional random field over the words of each line."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import LOWER, Spans, add_columns, shown

TABLE_BITS = 17
UNKNOWN = "und"
# letters: ASCII letters and every byte of a non-ASCII character
_WORD = np.zeros(256, bool)
_WORD[97:123] = True
_WORD[128:] = True


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mark = np.zeros(len(data) + 2, bool)
    mark[1:-1] = _WORD[data]
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    return edge[0::2], edge[1::2]


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(spans: Spans, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owner): hashed features of the words at start:end: the word itself (its lexicon entry), prefixes and
    suffixes of 1 to 4 bytes, and all runs of 2 and 3 bytes."""
    n = len(start)
    own = np.arange(n)
    slots, owner = [_slots(spans(start, end), 1)], [own]
    for k in range(1, 5):
        slots += [_slots(spans(start, np.minimum(start + k, end)), 10 + k), _slots(spans(np.maximum(start, end - k), end), 20 + k)]
        owner += [own, own]
    for k in (2, 3):
        count = np.maximum(end - start - k + 1, 0)
        of = np.repeat(own, count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
        slots.append(_slots(spans(at, at + k), 30 + k))
        owner.append(of)
    return np.concatenate(slots), np.concatenate(owner)


@dataclass
class Crf:
    """Labels, hashed emission weights (slots x labels), transition and start weights."""

    labels: list[str]
    weight: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Emission scores of words; each distinct word of the batch is computed once."""
        spans = Spans(data)
        _, at, back = np.unique(spans(start, end), return_index=True, return_inverse=True)
        slots, owner = features(spans, start[at], end[at])
        out = np.stack([np.bincount(owner, self.weight[slots, j], len(at)) for j in range(len(self.labels))], 1)
        return out[back]

    def marginals(self, score: np.ndarray, begin: np.ndarray, size: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
        """Posterior label probabilities of each word, by forward-backward over chains score[begin:begin+size].

        moves, if given, gets the expected number of each transition added.
        """
        e = np.exp(score - score.max(1, keepdims=True))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")  # chains longer than t
        move = np.exp(self.move)
        forward = np.empty_like(e)
        now = None
        for t in range(steps):
            at = begin[: active[t]] + t
            now = e[at] * (np.exp(self.first) if now is None else now[: active[t]] @ move)
            now /= now.sum(1, keepdims=True)
            forward[at] = now
        back = np.ones((len(begin), len(self.labels)))
        for t in range(steps - 2, -1, -1):
            k = active[t + 1]
            at = begin[:k] + t
            ahead = e[at + 1] * back[:k]
            if moves is not None:
                pair = forward[at][:, :, None] * move * ahead[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b = ahead @ move.T
            b /= b.sum(1, keepdims=True)
            back[:k] = b
            forward[at] *= b
        forward /= forward.sum(1, keepdims=True)
        return forward


def learn(texts: list[tuple[str, bytes]], seed: int = 5, chain: int = 48, epochs: int = 4, words: int = 60_000) -> Crf:
    """Fit on (language, text) pairs.

    Training chains are put together from stretches of one to three texts, so that labels change inside a chain
    as in code-switched text and the transitions can be learned.  `words` bounds the words a language gives.
    """
    labels = sorted({k for k, _ in texts})
    rng = np.random.default_rng(seed)
    by: list[tuple[Spans, np.ndarray, np.ndarray]] = []
    for k in labels:
        data = LOWER[np.frombuffer(b"\n".join(t for j, t in texts if j == k), np.uint8)]
        by.append((Spans(data), *_spans(data)))
    n_lab = len(labels)
    model = Crf(labels, np.zeros((1 << TABLE_BITS, n_lab)), np.zeros((n_lab, n_lab)), np.zeros(n_lab))
    total = [min(words, len(s)) for _, s, _ in by]
    n_chains = max(1, sum(total) // chain)
    square = np.full_like(model.weight, 1e-6)
    square_move, square_first = np.full_like(model.move, 1e-6), np.full_like(model.first, 1e-6)
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for _ in range(max(1, n_chains // 64)):
            # 64 chains of stretches
            label = np.empty((64, chain), np.int64)
            for row in label:
                cuts = np.sort(rng.integers(1, chain, rng.integers(0, 3)))
                for a, b in zip([0, *cuts], [*cuts, chain], strict=True):
                    row[a:b] = rng.integers(n_lab)
            flat = label.ravel()
            slots, owner = [], []
            for j, (spans, start, end) in enumerate(by):
                at = np.flatnonzero(flat == j)
                if not len(start):
                    continue
                # neighbours in a stretch are neighbours in the text
                run = np.concatenate([[True], np.diff(at) != 1])
                base = rng.integers(0, len(start), run.sum())[np.cumsum(run) - 1]
                word = (base + np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % len(start)
                s, o = features(spans, start[word], end[word])
                slots.append(s)
                owner.append(at[o])
            slots, owner = np.concatenate(slots), np.concatenate(owner)
            score = np.stack([np.bincount(owner, model.weight[slots, j], len(flat)) for j in range(n_lab)], 1)
            moved = np.zeros((n_lab, n_lab))
            p = model.marginals(score, np.arange(64) * chain, np.full(64, chain), moved)
            p[np.arange(len(flat)), flat] -= 1
            for j in range(n_lab):
                g = np.bincount(slots, p[owner, j], len(model.weight)) / 64
                square[:, j] += g * g
                model.weight[:, j] -= rate * g / np.sqrt(square[:, j])
            np.subtract.at(moved, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
            g = moved / (64 * chain)
            square_move += g * g
            model.move -= rate * g / np.sqrt(square_move)
            g = p[::chain].sum(0) / 64  # what the chains' first words are off by
            square_first += g * g
            model.first -= rate * g / np.sqrt(square_first)
    model.weight = model.weight.astype(np.float32)
    return model


def sample(docs: DataFrame, doc_col: str, text_col: str, lang_col: str, most: int, most_labels: int) -> list[tuple[str, bytes]]:
    """About `most` labelled texts a language from the rows that are not held out, chosen by a hash of doc_id."""
    known = docs.select(docs[doc_col].alias("d"), docs[text_col].alias("t"), docs[lang_col].alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("d").isNotNull() & ~held_out(F.col("d")))
    count = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(most_labels + 1).collect()}
    if len(count) > most_labels:
        raise ValueError(f"over {most_labels} languages; raise most_labels, of which the model's size is a multiple")
    if not count:
        return []
    share = F.create_map(*(x for k, n in count.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))))
    draw = F.pmod(F.xxhash64("d"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(draw < F.coalesce(share[F.col("l")], F.lit(0.0))).select("l", "t").limit(2 * most * len(count))
    return sorted((r["l"], r["t"].encode()) for r in rows.toLocalIterator())


ADDED = ["held_out", "lang_pred", "score"]


def labelled(docs: DataFrame, most: int = 60, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_runs: bool = False, keep: list[str] | None = None, most_labels: int = 256) -> tuple[DataFrame, list[str]]:
    """identify()'s rows with docs' columns as c0, c1, ..., whatever their names; and the learned languages."""
    texts = sample(docs, doc_col, text_col, lang_col, most, most_labels)
    model = learn(texts) if texts else None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.columns.index(doc_col)
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    if with_runs:
        made.append(StructField("runs", ArrayType(StructType([StructField("first_word", IntegerType()), StructField("words", IntegerType()), StructField("lang", StringType())]))))

    def run(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for texts in batches:
            pred, score, runs = label_texts(sent.value, [t or b"" for t in texts], with_runs)
            yield [pa.array(pred, pa.string()), pa.array(score, pa.float64()), *([pa.array(runs, kind)] if with_runs else [])]

    need = keep if keep is None or doc_col in keep else [*keep, doc_col]
    out = add_columns(docs, text_col, run, made, need, 1 << 19)
    return out.withColumn("held_out", held_out(F.col(f"c{d}"))), model.labels if model else []


def identify(docs: DataFrame, most: int = 60, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_runs: bool = False, keep: list[str] | None = None, most_labels: int = 256) -> DataFrame:
    """docs' columns (or those in keep) with held_out, lang_pred, score and, with_runs, the runs of words of one language.

    The field is learned from about `most` whole texts a language (a documented bound: this many labelled rows),
    of rows that are not held out; more than most_labels languages raise an error, none is left out.  Every whole
    text is then labelled word by word, a line being a chain.
    lang_pred has the largest sum of word posteriors, and score is their mean; ties go to the first language in
    alphabetical order.  `und` with score 0: null or empty text, no letter, or nothing to learn from.  A null
    doc_id is not held out and never learned from.  runs: array of (first_word, words, lang) in order.
    Repeated rows give repeated rows, an empty table none; added columns replace those with their names, and all
    others stay, whatever their names.
    """
    out, _ = labelled(docs, most, doc_col, text_col, lang_col, with_runs, keep, most_labels)
    return shown(out, docs.columns, ADDED + ["runs"] * with_runs, keep)


def label_texts(model: Crf | None, texts: list[bytes], with_runs: bool = False) -> tuple[list[str], np.ndarray, list]:
    """(language, score, runs) of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    start, end = _spans(data)
    n = len(texts)
    pred, score, runs = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    if model is None or not len(start):
        return pred, score, runs
    edge = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(edge, start, "right")
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(head, len(start)))
    p = model.marginals(model.emissions(data, start, end), head, size)
    total = np.stack([np.bincount(owner, p[:, j], n) for j in range(p.shape[1])], 1)
    count = np.bincount(owner, minlength=n)
    best = total.argmax(1)
    letters = np.bincount(owner, (data[start] < 128) | (data[end - 1] < 128), n) > 0
    for i in np.flatnonzero(count).tolist():
        if letters[i] or any(c.isalpha() for c in texts[i].decode()):
            pred[i] = model.labels[best[i]]
            score[i] = min(1.0, total[i, best[i]] / count[i])
    if with_runs:
        top = p.argmax(1)
        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (top[1:] != top[:-1])]))
        base = np.searchsorted(owner, np.arange(n))
        for a, k in zip(cut.tolist(), np.diff(np.append(cut, len(start))).tolist(), strict=True):
            i = int(owner[a])
            if pred[i] != UNKNOWN:
                runs[i].append({"first_word": int(a - base[i]), "words": int(k), "lang": model.labels[top[a]]})
    return pred, score, runs
