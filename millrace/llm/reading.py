"""Reading level of each document.

Every prose sentence is classified by a multinomial logistic model over hashed character 4-grams and words with an
L2 penalty that held-out sentences choose; the sentences' class distributions, weighted by their words, are averaged over the document, and a
second small logistic model, fitted on documents the first one has not seen, calibrates the average.

What is English prose is told by a character model fitted on the documents' language labels, in which labels that the model
itself contradicts are dropped once; without labels by function words. Licence texts and notices have no list of their own: they
are boilerplate. Boilerplate is counted over all documents: a sentence that many different texts hold beside sentences of their own.
Exact copies count as one text, and a near copy has next to nothing of its own, so copies make nothing boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.prose import english, paragraphs, split_sentences
from millrace.session import cut
from millrace.sources.tables import only

LEVELS = 4
#: Bounds of the labelled sample: documents, and sentences taken (evenly) from each.
MAX_LABELLED, MAX_SENTENCES = 1_600, 40
CHAR_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 16
SHAPES = 24
#: Steps of the fit, their size, the penalties tried, and the sentences of a document on which they are tried.
ROUNDS, RATE, PENALTIES, TRIED = 60, 0.3, (1e-5, 1e-4, 1e-3), 8
#: Documents whose language label is used, paragraphs taken (evenly) from each, and the fewest documents that make a language.
MAX_LANGUAGE, MAX_PARAGRAPHS, LEAST_LANGUAGE = 2_000, 20, 5
#: Labelled documents from which on a third is held out for the choice of the penalty and the calibration.
LEAST_HELD_OUT = 24
#: A sentence found in this share of the different texts (3 at least) beside sentences of their own is boilerplate.
BOILERPLATE_SHARE = 0.01
#: Spaces that a boilerplate sentence has at least.
BOILERPLATE_SPACES = 5
#: A text of so many different sentences is running prose, though other texts hold all of them; fewer are notices.
RUNNING = 3


@dataclass
class ReadingModel:
    """Weights of characters, words and sentence shapes, the calibration, and sentences that don't count."""

    weights: np.ndarray
    calibration: np.ndarray
    boilerplate: frozenset[str]
    penalty: float = 0.0


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, where each sentence begins in them, number of words of each sentence)."""
    raw = [s.encode() for s in batch]
    text = np.frombuffer(b" " + b"   ".join(raw) + b"    ", np.uint8)
    lengths = np.array([len(r) for r in raw])
    begins = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]]) + 1
    b = text.astype(np.uint32)
    grams = ((b[:-3] * np.uint32(2654435761) + b[1:-2] * np.uint32(40503)) ^ (b[2:-1] * np.uint32(2246822519) + b[3:] * np.uint32(3266489917))) >> np.uint32(16)
    letters = ((text >= 97) & (text <= 122)) | (text >= 128)
    edge = np.diff(letters.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = np.where(letters, text, 0).astype(np.uint64)
    none = np.zeros(1, np.uint64)
    sums = np.concatenate([none, np.cumsum(value)])
    squares = np.concatenate([none, np.cumsum(value * np.arange(len(text), dtype=np.uint64))])
    total = sums[last] - sums[first]
    moment = squares[last] - squares[first] - total * first.astype(np.uint64)
    size = (last - first).astype(np.uint64)
    word_hash = ((total * np.uint64(0x9E3779B97F4A7C15) ^ moment * np.uint64(0xC2B2AE3D27D4EB4F) ^ size * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    owner = np.searchsorted(begins, first, "right") - 1
    n_words = np.bincount(owner, minlength=len(batch))
    mean = np.bincount(owner, weights=(last - first).astype(float), minlength=len(batch)) / np.maximum(n_words, 1)
    shape_a = np.minimum(n_words // 4, 11)
    shape_b = 12 + np.minimum(np.maximum(mean - 2, 0).astype(np.int64), 11)
    per = lengths + n_words + 2
    starts = np.concatenate([[0], np.cumsum(per)[:-1]])
    out = np.empty(int(per.sum()), np.int64)
    at = np.repeat(starts - begins, lengths) + (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins, lengths))
    source = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins, lengths) - 1
    out[at] = grams[source]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    out[starts[owner] + lengths[owner] + rank] = CHAR_BUCKETS + word_hash
    out[starts + per - 2] = CHAR_BUCKETS + WORD_BUCKETS + shape_a
    out[starts + per - 1] = CHAR_BUCKETS + WORD_BUCKETS + shape_b
    return out, starts, n_words


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _scores(weights: np.ndarray, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean weight of each sentence's features, scaled to the square root of their number."""
    count = np.diff(np.append(starts, len(number)))
    return np.add.reduceat(weights[number], starts, axis=0) / np.sqrt(count)[:, None].astype(np.float32)


def _chunks(batch: list[str], size: int = 400_000) -> Iterator[list[str]]:
    """The sentences in order, in lists of bounded length, so that what is computed of them stays small."""
    lo = 0
    while lo < len(batch):
        hi, room = lo, size
        while hi < len(batch) and room > 0:
            room -= len(batch[hi])
            hi += 1
        yield batch[lo:hi]
        lo = hi


def distributions(weights: np.ndarray, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class distribution, words) of each sentence."""
    dists, words = [], []
    for chunk in _chunks(batch):
        number, starts, n_words = features(chunk)
        dists.append(_softmax(_scores(weights, number, starts)))
        words.append(n_words)
    return (np.concatenate(dists), np.concatenate(words)) if dists else (np.zeros((0, LEVELS)), np.zeros(0))


def fit_sentences(batch: list[str], targets: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of the sentence model: batch gradient steps of AdaGrad on mean cross-entropy plus ``penalty / 2`` times the squared weights."""
    number, starts, _ = features(batch)
    count = np.diff(np.append(starts, len(number)))
    width = CHAR_BUCKETS + WORD_BUCKETS + SHAPES
    used, number = np.unique(number, return_inverse=True)
    weights = np.zeros((len(used), LEVELS), np.float32)
    past = np.full((len(used), LEVELS), 1e-6, np.float32)
    scale = np.repeat(1 / np.sqrt(count), count)
    owner = np.repeat(np.arange(len(batch)), count)
    for _ in range(ROUNDS):
        error = (_softmax(_scores(weights, number, starts)) - targets) / len(batch)
        grad = np.stack([np.bincount(number, weights=error[owner, c] * scale, minlength=len(used)) for c in range(LEVELS)], 1).astype(np.float32) + penalty * weights
        past += grad * grad
        weights -= RATE * grad / np.sqrt(past)
    out = np.zeros((width, LEVELS), np.float32)
    out[used] = weights
    return out


Sample = list[tuple[list[str], np.ndarray]]


def _flat(samples: Sample, most: int | None = None) -> tuple[list[str], np.ndarray]:
    """(sentences, targets) of documents, ``most`` sentences of each, evenly."""
    parts = [(own if most is None or len(own) <= most else [own[i * len(own) // most] for i in range(most)], t) for own, t in samples]
    return [s for own, _ in parts for s in own], np.concatenate([np.repeat(t[None], len(own), 0) for own, t in parts])


def cross_entropy(weights: np.ndarray, samples: Sample) -> float:
    """Mean cross-entropy of the sentences of documents."""
    batch, targets = _flat(samples)
    return float(-(targets * np.log(distributions(weights, batch)[0] + 1e-9)).sum() / len(batch))


def choose_penalty(first: Sample, held: Sample, penalties: tuple[float, ...] = PENALTIES) -> float:
    """The penalty under which a model of ``first`` tells the sentences of ``held`` best."""
    batch, targets = _flat(first, TRIED)
    return min(penalties, key=lambda p: cross_entropy(fit_sentences(batch, targets, p), held))


def summary(dist: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document: its sentences' mean distribution, by words and by sentences, and a constant."""
    by_words = (dist * words[:, None]).sum(0) / max(words.sum(), 1)
    return np.concatenate([np.log(by_words + 1e-3), np.log(dist.mean(0) + 1e-3), by_words, [1.0]])


def fit_calibration(inputs: np.ndarray, targets: np.ndarray, rounds: int = 1500) -> np.ndarray:
    weights = np.zeros((inputs.shape[1], LEVELS))
    past = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        grad = inputs.T @ (_softmax(inputs @ weights) - targets) / len(inputs) + 1e-3 * weights
        past += grad * grad
        weights -= 0.3 * grad / np.sqrt(past)
    return weights


def filtered(own: list[str], boilerplate: frozenset[str]) -> list[str]:
    """The sentences that aren't boilerplate, nor run into boilerplate without a stop before it; all of them where that would leave nothing of a running text."""
    kept = [s for s in own if s not in boilerplate]
    if boilerplate:
        tails = tuple(" " + s for s in boilerplate)
        kept = [s for s in kept if not s.endswith(tails)]
    return kept or (own if len(set(own)) >= RUNNING else [])


def fit(samples: Sample, boilerplate: frozenset[str] = frozenset()) -> ReadingModel | None:
    """The model for ``(sentences, level distribution of the raters)`` of labelled documents, in a fixed order; None where they
    don't know two levels. Few documents are fitted and calibrated on the same ones."""
    samples = [(kept, t) for own, t in samples if (kept := filtered(own, boilerplate))]
    if len({int(t.argmax()) for _, t in samples}) < 2:
        return None
    enough = len(samples) >= LEAST_HELD_OUT
    first = [x for i, x in enumerate(samples) if i % 3] if enough else samples
    held = [x for i, x in enumerate(samples) if not i % 3] if enough else samples
    penalty = choose_penalty(first, held) if enough else PENALTIES[len(PENALTIES) // 2]
    weights = fit_sentences(*_flat(first), penalty)
    inputs = np.stack([summary(*distributions(weights, own)) for own, _ in held])
    return ReadingModel(weights, fit_calibration(inputs, np.stack([t for _, t in held])), boilerplate, penalty)


def levels_of(model: ReadingModel, documents: list[list[str]]) -> list[tuple[int, float, np.ndarray, int, float] | None]:
    """(level, expected level, distribution, sentences, words a sentence) of each document, None without English prose."""
    documents = [filtered(own, model.boilerplate) for own in documents]
    dist, words = distributions(model.weights, [s for own in documents for s in own])
    n = np.array([len(own) for own in documents])
    filled = np.flatnonzero(n)
    if not len(filled):
        return [None] * len(documents)
    starts = (np.cumsum(n) - n)[filled]
    total = np.add.reduceat(words, starts)
    by_words = np.add.reduceat(dist * words[:, None], starts, axis=0) / np.maximum(total, 1)[:, None]
    by_sentences = np.add.reduceat(dist, starts, axis=0) / n[filled][:, None]
    p = _softmax(np.hstack([np.log(by_words + 1e-3), np.log(by_sentences + 1e-3), by_words, np.ones((len(filled), 1))]) @ model.calibration)
    out: list[tuple[int, float, np.ndarray, int, float] | None] = [None] * len(documents)
    for i, row, t in zip(filled, p, total):
        out[i] = (int(row.argmax()), float(row @ np.arange(LEVELS)), row, int(n[i]), float(t / n[i]))
    return out


class LanguageModel:
    """Log-probabilities of hashed character 4-grams and words in each language, English first."""

    def __init__(self, texts: list[list[str]], languages: list[str]) -> None:
        self.names = ["en", *sorted(set(languages) - {"en"})]
        self.logs = self._fitted(texts, languages)
        # Wrong labels are few and show: a text that its own label's model does not prefer is left out of the second fit.
        own = [self.names[int(s.sum(0).argmax())] for s in map(self.scores, texts)]
        clean = [(t, a) for t, a, b in zip(texts, languages, own) if a == b]
        if {a for _, a in clean} == set(self.names):
            self.logs = self._fitted(*map(list, zip(*clean)))

    def _fitted(self, texts: list[list[str]], languages: list[str]) -> np.ndarray:
        counts = np.full((CHAR_BUCKETS + WORD_BUCKETS + SHAPES, len(self.names)), 0.1)
        for own, language in zip(texts, languages):
            for chunk in _chunks(own):
                np.add.at(counts, (features(chunk)[0], self.names.index(language)), 1.0)
        counts[CHAR_BUCKETS + WORD_BUCKETS :] = 1.0  # sentence shapes say nothing of a language
        return np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def scores(self, batch: list[str]) -> np.ndarray:
        out = [np.add.reduceat(self.logs[number], starts, axis=0) for number, starts, _ in map(features, _chunks(batch))]
        return np.concatenate(out) if out else np.zeros((0, len(self.names)), np.float32)

    def english(self, batch: list[str]) -> np.ndarray:
        """Whether English is the likeliest language of each paragraph in lower case."""
        return self.scores(batch).argmax(axis=1) == 0


def language_model(documents: DataFrame, most: int = MAX_LANGUAGE) -> LanguageModel | None:
    """Fitted on at most ``most`` documents with a language label, chosen by the hash of their id; None where the labels don't tell English from another language."""
    if "lang" not in (c.lower() for c in documents.columns):
        return None
    known = only(documents, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    language = F.lower(F.substring(F.trim("lang"), 1, 2))
    known = known.select("doc_id", "text", language.alias("language")).where(F.col("language").rlike("^[a-z]{2}$") & (F.lower(F.trim("lang")) != "und"))
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # `most` rows at most
    rows = known.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("language", "text").distinct().collect()
    rows.sort(key=lambda r: (r.language, r.text))
    read = [(r.language, [x[i * len(x) // MAX_PARAGRAPHS] for i in range(MAX_PARAGRAPHS)] if len(x) > MAX_PARAGRAPHS else x) for r in rows if (x := [p.lower() for p in paragraphs(r.text)])]
    often = {a for a in {a for a, _ in read} if sum(a == b for b, _ in read) >= LEAST_LANGUAGE}
    if "en" not in often or len(often) < 2:
        return None
    return LanguageModel([x for a, x in read if a in often], [a for a, _ in read if a in often])


def parsed(documents: DataFrame) -> DataFrame:
    """``doc_id, sentences`` of each row with an id and a text: its English prose, read once for all uses."""
    model = documents.sparkSession.sparkContext.broadcast(language_model(documents))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = model.value
        for batch in batches:
            found = [paragraphs(t) for t in batch.column(1).to_pylist()]
            flat = [p for own in found for p in own]
            low = [p.lower() for p in flat]
            keep = iter(language.english(low) if language else [english(p.split()) for p in low])
            out = [[s for p in own if next(keep) for s in split_sentences(p)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "sentences"])

    documents = only(documents, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, sentences array<string>"))


def boilerplate_of(prose: DataFrame, share: float = BOILERPLATE_SHARE) -> frozenset[str]:
    """Sentences that at least ``share`` of the different texts (3 at least) hold beside sentences of their own.

    Texts with the same sentences are one. A text speaks for a sentence only if at least half of its longer sentences,
    by characters, are its own, that is found in less than a quarter of the texts that make boilerplate: where a
    sentence is frequent by near copies, the others of the text are too. What is collected are sentences in at least
    1/400 of the texts (in 2 at least), at most 400 times the mean number of sentences of a text.
    """
    long = F.filter(F.array_distinct("sentences"), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) >= BOILERPLATE_SPACES)
    hashed = prose.where(F.size("sentences") > 0).select(F.xxhash64("sentences").alias("text_key"), F.transform(long, lambda s: F.xxhash64(s)).alias("keys"), F.transform(long, lambda s: F.length(s)).alias("lengths"))
    texts = cut(hashed.dropDuplicates(["text_key"]))
    least = max(3, share * texts.count())
    several = max(2, least / 4)
    counted = texts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= several).toArrow()
    shared, n = counted["key"].to_numpy(), counted["n"].to_numpy()
    order = np.argsort(shared)
    shared, frequent = shared[order], np.sort(shared[n >= least])
    if not len(frequent):
        return frozenset()
    known = prose.sparkSession.sparkContext.broadcast((shared, frequent))

    def speaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, frequent = known.value
        for batch in batches:
            keys, lengths = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            sizes = np.array([len(x) for x in batch.column(0)], np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(owner, weights=lengths, minlength=len(sizes))
            own = np.bincount(owner, weights=lengths * ~np.isin(keys, shared), minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.isin(keys, frequent) & (2 * own >= total)[owner]])], ["key"])

    keys = texts.select("keys", "lengths").mapInArrow(speaks, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")
    keys = [r.key for r in keys.collect()]  # at most 1 / share times the mean number of sentences
    if not keys:
        return frozenset()
    wanted = F.broadcast(prose.sparkSession.createDataFrame([(k,) for k in keys], "key long"))
    said = prose.select(F.explode("sentences").alias("sentence")).withColumn("key", F.xxhash64("sentence")).join(wanted, "key").select("sentence").distinct()
    return frozenset(r.sentence for r in said.collect())


def labelled_sample(prose: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_sentences: int = MAX_SENTENCES) -> list[tuple[list[str], np.ndarray]]:
    """Sentences and raters' level distribution of at most ``most`` labelled documents of :func:`parsed`, chosen by the hash of their id."""
    labels = only(labels, "doc_id", "level_no", "rater", "labelled_at")
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("level_no").between(0, LEVELS - 1)).distinct()
    by_doc = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.avg((F.col("level_no") == k).cast("double")).alias(f"l{k}") for k in range(LEVELS)))
    chosen = F.broadcast(by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # `most` rows at most
    size = F.size("sentences")
    some = F.transform(F.sequence(F.lit(0), F.lit(most_sentences - 1)), lambda i: F.get("sentences", F.floor(i * size / most_sentences).cast("int")))
    texts = prose.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", F.when(size <= most_sentences, F.col("sentences")).otherwise(some).alias("sentences"))
    rows = texts.groupBy("doc_id").agg(F.min("sentences").alias("sentences")).join(chosen, "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(list(r.sentences), np.array([r[f"l{k}"] for k in range(LEVELS)])) for r in rows if r.sentences]


READ = "doc_id long, level_no int, expected_level double, p0 double, p1 double, p2 double, p3 double, sentences int, words_per_sentence double"


def reading_levels(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Level, calibrated distribution and counts of every document with English prose; others have a null level.

    Null ids and null texts give nothing; of rows with the same id and different texts, each gives a row; repeated
    rows count once. Where the labelled documents of prose don't know two levels no level is given.
    The models are fitted on bounded samples of the labels, texts are read whole.
    """
    prose = parsed(documents)
    model = prose.sparkSession.sparkContext.broadcast(fit(labelled_sample(prose, labels, most), boilerplate_of(prose)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for key, got in zip(batch.column(0).to_pylist(), levels_of(own, texts) if own else [None] * len(texts)):
                rows.append((key, got[0], got[1], *map(float, got[2]), got[3], got[4]) if got else (key, None, None, None, None, None, None, 0, None))
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in READ.split(", ")])

    return prose.mapInArrow(read, READ).distinct()
