"""Toxicity by weak supervision: voters, a generative label model of them, and a linear classifier on its posteriors.

Voters are word lists, patterns, and stems that a grouped aggregate over labelled training rows finds to be typical of
toxic texts; all look at the text alone. How often each combination of votes occurs is counted
by a grouped aggregate; the label model is fitted to these counts (at most two to the number of voters). It holds each
voter's accuracy and, as a tree of dependencies found from conditional mutual information, the correlations between
them. Its posteriors label a bounded sample of training documents, on which a linear classifier over words and votes
is trained; the classifier then scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import drop_path, written

# Words that abuse people, by kind and language.
STUPIDITY = "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles cretin dimwit halfwit fool fools retard retarded clown clowns".split()
WORTH = "worthless pathetic useless loser losers failure nobody pitiful hopeless coward cowards".split()
DISGUST = "disgusting disgrace vile filthy filth trash garbage scum vermin pig pigs creep creeps repulsive revolting".split()
VULGAR = "bastard bastards bitch bitches asshole assholes shit shitty crap fuck fucking fucker whore slut damn prick jerk jerks".split()
HATE = "hate hated hates hateful despise despised exterminate lynch subhuman".split()
OTHER_LANGUAGES = (
    "idiota idiotas estúpido estúpida imbécil basura escoria asqueroso asquerosa patético patética inútil puta mierda cabrón pendejo "
    "stupide imbécile ordure ordures dégoûtant dégoûtante pathétique crétin connard salope merde putain racaille "
    "dummkopf blöd blödmann idioten müll abschaum widerlich erbärmlich nutzlos arschloch scheiße scheiss schwein verlierer"
).split()
LISTS = (STUPIDITY, WORTH, DISGUST, VULGAR, HATE, OTHER_LANGUAGES)

WORD = re.compile(r"[^\W\d_]+")
ADDRESSED = re.compile(r"\b(?:you|your|you're|u r|du bist|eres|tu es)\b", re.I)
SHOUT = re.compile(r"[^\W\d_]!{2,}")
VOTERS = (*[f"list_{k}" for k in range(len(LISTS))], "two_abusive", "three_abusive", "addressed", "shouted", "any_list", "stem", "stems_2", "stems_4", "stems_8", "stem_share")

#: Training documents that the classifier is fitted to at most, and the words it may know.
SAMPLE_DOCS = 10_000
MAX_WORDS = 1 << 15
MIN_WORD_DOCS = 3
THRESHOLD = 0.7

_SETS = tuple(frozenset(x) for x in LISTS)
_ABUSIVE = frozenset().union(*_SETS)


#: A word's stems are its first letters; a learned stem occurs in so many toxic training texts, so much oftener.
STEM_CHARS = (4, 5)
MIN_STEM_DOCS = 4
MIN_LOG_ODDS = 1.7
MAX_STEMS = 4000


def terms(text: str | None) -> set[str]:
    """The text's distinct lower-cased words and their stems, which end in a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for k in STEM_CHARS for w in words if len(w) >= k}


class Words:
    """What each word brings: whether a learned stem is in it, and which of the model's terms it has; kept for the words met last."""

    KEPT = 1 << 17

    def __init__(self, learned: frozenset[str], known: dict[str, float] | None = None):
        self.learned, self.known, self.held = learned, known or {}, {}

    def __getitem__(self, word: str) -> tuple[bool, tuple[str, ...]]:
        got = self.held.get(word)
        if got is None:
            if len(self.held) >= self.KEPT:
                self.held.clear()
            stems = [word[:k] + "*" for k in STEM_CHARS if len(word) >= k]
            got = self.held[word] = (any(s in self.learned for s in stems), tuple(t for t in (word, *stems) if t in self.known))
        return got


def votes(text: str | None, words: set[str], stems: int) -> int:
    """The voters that call the text toxic, as bits; ``stems`` of its words have a learned stem."""
    bits = bool(SHOUT.search(text or "")) << 9
    if hit := words & _ABUSIVE:
        lists = [bool(hit & s) for s in _SETS]
        bits |= sum(1 << k for k, x in enumerate(lists) if x)
        bits |= (len(hit) >= 2) << 6 | (len(hit) >= 3) << 7 | bool(ADDRESSED.search(text)) << 8 | 1 << 10
    n = stems
    return bits | (n >= 1) << 11 | (n >= 2) << 12 | (n >= 4) << 13 | (n >= 8) << 14 | (n >= 2 and n >= 0.03 * len(words)) << 15


def looked_at(text: str | None, about: Words) -> tuple[int, set[str]]:
    """A text's votes, and those of the model's terms that it has."""
    words = set(WORD.findall((text or "").lower()))
    stems, found = 0, set()
    for w in words:
        hit, own = about[w]
        stems += hit
        if own:
            found.update(own)
    return votes(text, words, stems), found


class LabelModel:
    """P(toxic), P(vote | class, vote of the parent) and the labels' accuracy: a tree-augmented naive Bayes model.

    Fitted by expectation-maximisation to the counts of vote patterns with each label (-1 where there is none). A label
    is one more voter, which speaks for either class; it starts the model, where there are any.
    """

    def __init__(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 25):
        self.x = _bits(patterns)
        self.label_accuracy = 0.95
        n = counts.astype(float)
        post = np.where(labels < 0, np.clip(self.x.mean(1), 0.01, 0.99), np.where(labels == 1, 0.9, 0.02))
        if (known := labels >= 0).any():  # patterns without a label start from those with one
            t, m = np.zeros(1 << len(VOTERS)), np.zeros(1 << len(VOTERS))
            np.add.at(t, patterns[known], n[known] * (labels[known] == 1))
            np.add.at(m, patterns[known], n[known])
            post = np.where(known, post, (t[patterns] + 0.1 * post) / (m[patterns] + 0.1))
        for _ in range(rounds):
            self._maximise(n, post)
            post = self.posterior(self.x, labels)
            if known.any():
                right = (n * np.where(labels == 1, post, 1 - post))[known].sum() / n[known].sum()
                self.label_accuracy = float(np.clip(right, 0.8, 0.99))
        self.accuracy = (post * n) @ self.x / np.maximum(n @ self.x, 1e-9)

    def _maximise(self, n: np.ndarray, post: np.ndarray) -> None:
        v = self.x.shape[1]
        weight = np.stack([n * (1 - post), n * post])
        self.prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        x = np.stack([1 - self.x, self.x])  # value, pattern, voter
        joint = np.einsum("cp,apj,bpk->cabjk", weight, x, x) + 0.05
        total = joint.sum((1, 2), keepdims=True)
        p = joint / total
        pj, pk = p.sum(2, keepdims=True), p.sum(1, keepdims=True)
        share = total[:, 0, 0] / total[:, 0, 0].sum(0)
        self.correlation = (share * (p * np.log(p / (pj * pk))).sum((1, 2))).sum(0)
        # The heaviest tree over the voters' correlations given the class.
        self.parent = np.full(v, -1)
        inside, best, via = np.zeros(v, bool), self.correlation[0].copy(), np.zeros(v, int)
        inside[0] = True
        for _ in range(v - 1):
            j = int(np.where(inside, -1, best).argmax())
            self.parent[j], inside[j] = via[j], True
            better = self.correlation[j] > best
            best, via = np.where(better, self.correlation[j], best), np.where(better, j, via)
        self.table = np.zeros((2, v, 2, 2))  # class, voter, parent's vote, own vote
        for j in range(v):
            k = self.parent[j]
            own = joint[:, :, :, k, j] if k >= 0 else np.repeat(joint[:, :, :, j, j].sum(1, keepdims=True), 2, 1)
            self.table[:, j] = own / own.sum(2, keepdims=True)

    def posterior(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        score = np.log(self.prior)[:, None] + np.zeros((2, len(x)))
        for j in range(x.shape[1]):
            up = x[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(x), int)
            score += np.log(self.table[:, j, up, x[:, j]])
        right, wrong = np.log(self.label_accuracy), np.log(1 - self.label_accuracy)
        score[0] += np.where(labels == 0, right, np.where(labels == 1, wrong, 0))
        score[1] += np.where(labels == 1, right, np.where(labels == 0, wrong, 0))
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))

    def posterior_of(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return self.posterior(_bits(patterns), labels)


def _bits(patterns: np.ndarray) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.int64)


def fit_linear(cols: np.ndarray, ends: np.ndarray, width: int, target: np.ndarray, l2: np.ndarray, steps: int = 500, block: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets; row k has features ``cols[ends[k]:ends[k + 1]]``, each once.

    Adam, one step a block of rows with about so many features, in turn; steps shrink to a tenth. Rows are in no order that
    tells of their targets.
    """
    n = len(target)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) + 1, block)).clip(0, n), [0, n]))
    blocks = [(low, high, np.repeat(np.arange(high - low, dtype=np.int32), np.diff(ends[low : high + 1]))) for low, high in zip(cuts, cuts[1:], strict=False)]
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    vw, vb, sw, sb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(1, steps + 1):
        low, high, row = blocks[t % len(blocks)]
        part = cols[ends[low] : ends[high]]
        z = np.bincount(row, w[part], high - low) + b
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[low:high]
        gw, gb = np.bincount(part, g[row], width) / (high - low) + l2 * w, g.mean()
        vw, sw = 0.9 * vw + 0.1 * gw, 0.999 * sw + 0.001 * gw**2
        vb, sb = 0.9 * vb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        a, c = 1 - 0.9**t, 1 - 0.999**t
        rate = 0.1 * (1 - 0.9 * t / steps)
        w -= rate * (vw / a) / (np.sqrt(sw / c) + 1e-8)
        b -= rate * (vb / a) / (np.sqrt(sb / c) + 1e-8)
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD, max_words: int = MAX_WORDS, max_stems: int = MAX_STEMS, label_voter: bool = True) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted, votes (the voters that spoke up, as bits).

    Training uses rows that are not held out: crc32 of the id as text, mod 3, other than 1. The classifier is fitted to at
    most ``sample_docs`` labelled documents and the ``max_words`` terms that most of them have; stems that vote are the
    ``max_stems`` that most toxic ones have. With ``label_voter`` a known label is one more voter of the label model; without
    it labels choose the stems that vote and nothing else, and the classifier learns from the other voters' posteriors. A null or empty text has no words and no votes and gets the classifier's
    bias. A null id is held out. Without labels the label model starts from the votes alone; an empty table gives an
    empty result. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))

    # The sample: labelled training documents in the order of a hash, at most sample_docs of them.
    held_label = F.crc32(F.col("label_id").cast("string").cast("binary")) % 3 == 1
    ids = known.filter(~held_label).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)  # ids and labels only
    sample, _ = written(texts.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic"), "toxicity-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = [sorted(terms(t)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(got, pa.list_(pa.string()))], ["toxic", "terms"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    by_term = sample.select("toxic", "text").mapInArrow(split, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    by_term, terms_path = written(by_term.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= MIN_WORD_DOCS), "toxicity-terms")
    odds = F.log((F.col("t") + 0.5) / (totals["t"] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (totals["n"] - totals["t"] + 1))
    stems = by_term.filter(F.col("term").endswith("*") & (F.col("t") >= MIN_STEM_DOCS) & (odds >= MIN_LOG_ODDS))
    learned = frozenset(r["term"] for r in stems.orderBy(F.desc("t"), "term").limit(max_stems).collect())

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = Words(learned)
        for b in batches:
            bits = pa.array([looked_at(t, about)[0] for t in b.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), bits], ["doc_id", "bits"])

    marked = texts.filter("NOT held_out").mapInArrow(vote, "doc_id long, bits int").join(known, F.col("doc_id") == F.col("label_id"), "left")
    label = (F.coalesce("toxic", F.lit(-1)) if label_voter else F.lit(-1)).alias("label")
    patterns = marked.groupBy("bits", label).agg(F.count("*").alias("n")).toPandas().sort_values(["bits", "label"])  # at most 3 * 2 ** len(VOTERS) rows
    model = LabelModel(*(patterns[c].to_numpy(int) for c in ("bits", "label", "n"))) if len(patterns) else None
    vocabulary: dict[str, float] = {}
    bias, voter_weights = -3.0, np.zeros(len(VOTERS))
    if model is not None:
        words = [r["term"] for r in by_term.orderBy(F.desc("n"), "term").limit(max_words).collect()]
        place = {w: k + len(VOTERS) for k, w in enumerate(words)}
        sent_place = spark.sparkContext.broadcast(place)  # at most max_words terms

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = sent_place.value
            about = Words(learned, where)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    got = [looked_at(t, about) for t in b.column("text").to_pylist()]
                    bits = pa.array([x for x, _ in got], pa.int32())
                    columns = [np.sort(np.array([*(j for j in range(len(VOTERS)) if x >> j & 1), *(where[t] for t in own)], np.int32)) for x, own in got]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), bits, b.column("toxic"), pa.array([c.tobytes() for c in columns], pa.binary())], ["doc_id", "bits", "toxic", "at"])

        seen = sample.mapInArrow(number, "doc_id long, bits int, toxic int, at binary").toPandas()  # sample_docs rows
        seen = seen.sort_values(["doc_id", "at"])
        if len(seen):
            own = seen["toxic"].to_numpy(int) if label_voter else np.full(len(seen), -1)
            target = model.posterior_of(seen["bits"].to_numpy(int), own)
            ends = np.append(0, seen["at"].map(len).to_numpy(np.int64).cumsum() // 4)
            cols = np.frombuffer(b"".join(seen["at"]), np.int32)
            del seen
            l2 = np.concatenate([np.full(len(VOTERS), 1e-6), np.full(len(words), 1e-3)])
            w, bias = fit_linear(cols, ends, len(VOTERS) + len(words), target, l2)
            voter_weights = w[: len(VOTERS)]
            vocabulary = {x: float(w[k]) for x, k in place.items() if abs(w[k]) > 1e-3}
        sent_place.destroy()
    drop_path(spark, terms_path)
    sent = spark.sparkContext.broadcast((vocabulary, bias, voter_weights))  # at most max_words weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b0, by_vote = sent.value
        about = Words(learned, weights)
        for b in batches:
            z, bits = [], []
            for text in b.column("text").to_pylist():
                got, own = looked_at(text, about)
                bits.append(got)
                # The exact sum, which doesn't depend on the order of a set.
                z.append(math.fsum([b0, *(by_vote[j] for j in range(len(VOTERS)) if got >> j & 1), *(weights[t] for t in own)]))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(bits, pa.int32())], ["doc_id", "held_out", "score", "predicted", "votes"])

    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, votes int")
