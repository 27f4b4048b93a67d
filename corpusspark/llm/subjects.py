"""Problem 3: the subject areas of each document.

Method: one interpolated bigram language model for each subject and one of the background for each language, trained on all hand-labelled
documents: Spark adds up the counts of words and bigrams, and the driver has these sums only. The first models are trained on whole labelled documents; each further round trains on the sentences that
the models before gave to a subject, so that passages on other matters and wrong labels lose their weight. A sentence deals with a
subject when the background's cross-entropy per token exceeds the subject's by a margin that shrinks with the sentence's length, as a long
sentence needs less evidence per token; the margins are calibrated for each subject on held-out labels. A document gets every
subject that a given share of its sentences with a subject deals with.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch
from . import residue
from .hashing import CACHE_WORDS, WordHasher, sliced

_JOIN = re.compile(r"[-­][ \t\r]*\n[ \t]*(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?…][\"'”’)\]]*(?=\s+[^\Wa-z_]|\s*\Z)|\n[ \t\r]*\n|\n(?=[ \t]*(?:#|[-*•·–] |\d+[.)] |\|))")
_COMMA = re.compile(r",(?=\s+[^\Wa-z_])")
_HEADING = re.compile(r"(?m)^[ \t]*#.*$")
#: The same for texts of ASCII characters, where words are found by splitting at spaces: only the ends of sentences are searched.
_ENDS = re.compile(r"[.!?\n](?:(?<=[.!?])[\"')\]]*(?=\s+[A-Z0-9]|\s*\Z)|(?<=\n)[ \t\r]*\n|(?<=\n)(?=[ \t]*(?:#|[-*] |[0-9]+[.)] |\|)))")
_KEPT = "".join(c.lower() if c.isalpha() or c in "-'\0" else " " for c in map(chr, range(128)))
#: Hyphens and apostrophes that join no two letters.
_LOOSE = ("--", "-'", "'-", "''", " -", "- ", " '", "' ")
_BEFORE_END = ("-\n", "- ", "-\t", "-\r", "\u00ad")  # without any of these ``_JOIN`` finds nothing
BREAK, UNKNOWN = 0, 1
#: The token at each sentence's end.
STOP = "\0"
_END = WordHasher()([STOP])[0]
#: Nats by which a sentence must favour a subject: the candidates of the calibration, and the one that holds without labels.
MARGINS = (1.0, 1.5, 2.0, 2.5, 3.0)
DEFAULT_MARGIN = 2.0
#: Nats of a token below which most differences between subjects are chance; smaller gains are shrunk in proportion to their square.
NOISE = 0.6


def _found(plain: str) -> list[str]:
    if not plain.isascii() or STOP in plain:
        return [t.lower() if t[0].isalpha() else STOP for t in _TOKEN.findall(plain)]
    plain = f" {_ENDS.sub(STOP, plain).translate(_KEPT).replace(STOP, f' {STOP} ')} "
    for loose in _LOOSE:
        if loose in plain:
            plain = plain.replace(loose, "  ")
    return plain.split()


def _tokens(text: str) -> list[str]:
    """The lower-cased words of a text, with ``STOP`` at each sentence's end."""
    plain = _HEADING.sub("\n", text) if "#" in text else text
    if any(map(plain.__contains__, _BEFORE_END)):
        plain = _JOIN.sub("", plain)
    found = _found(plain)
    if len(found) > 60 * (found.count(STOP) + 1):  # a text that runs on: commas before capitals end its sentences
        found = _found(_COMMA.sub(".", plain))
    return found


#: Frequent function words of the languages that are told apart (fixed values); texts with none of them count as the first.
FUNCTION_WORDS = {
    "en": "the and of to is that it in for with this are be each from",
    "de": "der die das und ist nicht mit für auf ein eine zur von wieder auch",
    "fr": "le les des et est une dans pour que avec sur il plus après ce",
    "es": "el los las y es una en para que con por se del más muy",
}


class _Models:
    """Gains in nats of each known token and bigram for each subject, apart for each language.

    A token's id is its language's offset plus its place in the vocabulary, so that a language with few labels of a subject doesn't
    make the subject improbable, or its function words telling.
    """

    def __init__(self, topics: list[str], vocabulary: np.ndarray, weights: tuple[float, float, float]) -> None:
        self.topics, self.weights = topics, weights
        self.prior = (12.0, 30.0)
        self.vocabulary = vocabulary  # sorted hashes of tokens; a token's id is its place + 2
        self.size = len(vocabulary) + 2
        self.languages = len(FUNCTION_WORDS)
        hasher = WordHasher()
        self.tells = np.zeros((self.size, self.languages))
        for k, words in enumerate(FUNCTION_WORDS.values()):
            ids = self._ids(hasher(words.split()))
            self.tells[ids[ids > UNKNOWN], k] = 1
        self.margins = np.full(len(topics), DEFAULT_MARGIN)
        self.known = np.ones(self.size, bool)
        self.pairs = np.empty(0, np.int64)
        self.rows = np.zeros((self.size * self.languages, len(topics)), np.float32)

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.full(len(hashes), UNKNOWN, np.int64)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashes
            ids[known] = at[known] + 2
        ids[hashes == _END] = BREAK
        return ids

    def encode(self, flat: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, from their tokens' hashes, and each token's text; each text ends with a break."""
        return self.placed(self._ids(flat), lengths)

    def placed(self, ids: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same from the ids that tokens have without a language."""
        if not len(ids):
            return ids, ids
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        language = np.add.reduceat(self.tells[ids], starts, axis=0).argmax(axis=1)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return ids + language[owner] * self.size, owner

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        """Each token after the one before it; a text's first token follows a break of its own language, whatever text is before it."""
        before = np.concatenate((ids[:1] // self.size * self.size, ids[:-1]))
        before = np.where(before % self.size == BREAK, ids // self.size * self.size, before)
        return before * (self.size * self.languages) + ids

    def train(self, keys: np.ndarray, sums: np.ndarray) -> None:
        """``sums`` has for each key, as ``counted`` makes them, the number of tokens and how much of them counts for each subject.

        A subject's probabilities are the background's times the subject's share of the word (or bigram) over its share of the context;
        ``prior`` occurrences at the next lower order's share are added, so that rare words and bigrams back off.
        """
        l2, l1, l0 = self.weights
        total = self.size * self.languages
        floor = l0 / self.size
        order = np.argsort(keys)
        order = order[(keys[order] < 0) | (sums[order, 0] > 1)]  # a bigram seen once says no more than its word
        keys = keys[order]
        follows, token, pair = (-2 * total <= keys) & (keys < -total), (-total <= keys) & (keys < 0), keys >= 0
        self.pairs, of_pair = keys[pair], sums[order[pair]]
        seen = of_pair[:, 0]
        before, after = self.pairs // total, self.pairs % total
        of_token, context = np.zeros((total, sums.shape[1])), np.zeros(total)
        of_token[-1 - keys[token]] = sums[order[token]]
        context[-1 - total - keys[follows]] = sums[order[follows], 0]
        one = of_token[:, 0]
        language = np.arange(total) // self.size
        each = np.bincount(language, weights=one, minlength=self.languages)  # tokens of each language
        p_one = one / np.repeat(np.maximum(each, 1), self.size)
        p_two = seen / np.maximum(context[before], 1)
        base_one, base_two = l1 * p_one + floor, l2 * p_two + l1 * p_one[after] + floor
        gains = np.zeros((total + len(self.pairs), len(self.topics)), np.float32)
        special = np.arange(total) % self.size <= UNKNOWN
        for k in range(len(self.topics)):
            weight = of_token[:, k + 1]
            mean = weight.sum() / max(one.sum(), 1)
            of_language = (np.bincount(language, weights=weight, minlength=self.languages) + 200 * mean) / (each + 200)
            overall = np.repeat(np.maximum(of_language, 1e-6), self.size)
            of_one = (weight + self.prior[0] * overall) / (one + self.prior[0])
            of_one[special] = overall[special]
            of_two = (of_pair[:, k + 1] + self.prior[1] * of_one[after]) / (seen + self.prior[1])
            single = l1 * p_one * of_one / overall
            gains[:total, k] = np.log((single + floor) / base_one)
            gains[total:, k] = np.log((l2 * p_two * of_two / of_one[before] + single[after] + floor) / base_two)
        gains[:total][special] = 0.0
        gains *= gains**2 / (gains**2 + np.float32(NOISE**2))
        self.rows = gains

    def counted(self, ids: np.ndarray, share: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``(keys, sums)`` of some texts: of each bigram, of each token (-1 less its id) and of each token that one follows (lower by the number of ids).

        ``share`` of a subject: how much of each token counts for it, in whole ``UNIT``th parts.
        """
        total = self.size * self.languages
        used = ids % self.size > UNKNOWN
        pairs, at, seen = np.unique(self._pairs(ids)[used], return_inverse=True, return_counts=True)
        sums = np.zeros((len(pairs), len(self.topics) + 1), np.int64)
        sums[:, 0] = seen
        for k in range(len(self.topics)):
            weight = share(k)[used]
            if weight.any():
                sums[:, k + 1] = np.bincount(at, weights=weight, minlength=len(pairs))
        after, context = _merged([(-1 - pairs % total, sums)]), _merged([(-1 - total - pairs // total, sums)])
        context[1][:, 1:] = 0
        return np.concatenate((pairs, after[0], context[0])), np.concatenate((sums, after[1], context[1]))

    def sentences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The start of each sentence, its number of words, and for each subject the background's cross-entropy per word less the subject's."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0), np.empty((0, len(self.topics)), np.float32)
        row = ids.copy()
        if len(self.pairs):
            pair = self._pairs(ids)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = self.pairs[at] == pair
            row[known] = self.size * self.languages + at[known]
        starts = np.concatenate(([0], np.flatnonzero(ids[:-1] % self.size == BREAK) + 1))
        words = np.maximum(np.diff(np.append(starts, len(ids))) - 1, 1).astype(float)
        return starts, words, np.add.reduceat(self.rows[row], starts, axis=0) / words[:, None]


class _WordIds(dict):
    """Each token's id without a language; like that of ``WordHasher`` its memory only saves time and is emptied when it is full."""

    def __init__(self, models: _Models) -> None:
        super().__init__()
        self.models = models

    def __missing__(self, token: str) -> int:
        value, words = WordHasher()([token])[0], self.models.vocabulary
        at = words.searchsorted(value)
        self[token] = found = BREAK if value == _END else int(at) + 2 if at < len(words) and words[at] == value else UNKNOWN
        return found

    def __call__(self, lists: list[list[str]]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its rows."""
    keys, rows = np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])
    if not len(keys):
        return keys, rows
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0)


def _assigned(difference: np.ndarray, words: np.ndarray, owner: np.ndarray, documents: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's subject and by how many nats it exceeds that subject's margin; in doubt a sentence deals with what the rest of its document deals with."""
    gain = difference * words[:, None] - margins
    best, most = gain.argmax(axis=1), gain.max(axis=1)
    for _ in range(2):
        sure = most >= 0
        count = np.bincount(owner[sure] * gain.shape[1] + best[sure], minlength=documents * gain.shape[1]).reshape(documents, -1) + 0.3
        best = (gain + np.log(count / count.max(axis=1, keepdims=True))[owner]).argmax(axis=1)
        most = gain[np.arange(len(gain)), best]
    return best, most


def _shares(models: _Models, ids: np.ndarray, owner: np.ndarray, documents: int, margins: list[np.ndarray]) -> list[np.ndarray]:
    """For each of ``margins`` the number of sentences of each text that deal with each subject; ``ids`` and ``owner`` are what ``encode`` gives."""
    n = len(models.topics)
    starts, words, difference = models.sentences(ids)
    tables = []
    for margin in margins:
        best, most = _assigned(difference, words, owner[starts], documents, margin)
        sure = most >= 0
        tables.append(np.bincount(owner[starts][sure] * n + best[sure], minlength=n * documents).reshape(documents, n))
    return tables


def accepted(table: np.ndarray, share: float) -> np.ndarray:
    """Which subjects each text gets: those of at least ``share`` of its sentences with a subject."""
    return (table > 0) & (table >= share * table.sum(axis=1, keepdims=True))


def _judged(table: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """For each subject the numbers of labels found, of subjects found without a label, and of labels missed."""
    got = accepted(table, share)
    return np.stack(((got & labels).sum(0), (got & ~labels).sum(0), (~got & labels).sum(0)))


def _calibrated(held: list[tuple[np.ndarray, np.ndarray]], share: float) -> np.ndarray:
    """The margin of each subject with the best F1 on held-out labels; ``held`` has, for each candidate, the counts of sentences and the labels."""
    return _margins([_judged(table, labels, share) for table, labels in held])


def _margins(judged: list[np.ndarray]) -> np.ndarray:
    """The margin of each subject with the best F1; ``judged`` has, for each candidate, the sums that ``_judged`` gives.

    Each subject's counts are joined by those of all subjects at the weight of twenty labels, so that subjects with few labels back off to the common margin.
    """
    scores = []
    for hits, wrong, missed in judged:
        total = max((hits + missed).sum(), 1)
        smooth = lambda x: x + 20 * x.sum() / total
        scores.append(2 * smooth(hits) / np.maximum(2 * smooth(hits) + smooth(wrong) + smooth(missed), 1e-9))
    table = np.round(np.array(scores), 4)
    # of equal candidates the one next to the default
    closeness = -np.abs(np.array(MARGINS) - DEFAULT_MARGIN)[:, None]
    return np.array(MARGINS)[(table + 1e-6 * closeness).argmax(axis=0)]


def _vocabulary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, in order, of all words in more than one labelled text, and in how many texts of each half they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, bodies = (batch.column(k).to_pylist() for k in range(2))
            words = [np.unique(np.frombuffer(b, np.int64)) for b in bodies]
            seen, at = np.unique(np.concatenate(words), return_inverse=True)
            second = np.bincount(at, weights=np.repeat([k & 1 for k in keys], [len(w) for w in words]), minlength=len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.bincount(at) - second), pa.array(second)], ["hash", "n0", "n1"])

    found = _tasks(rows.select("_id", "values")).mapInArrow(read, "hash long, n0 long, n1 long").groupBy("hash").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 > 1").toArrow()
    words, texts = found["hash"].to_numpy().view(np.uint64), np.stack((found["n0"].to_numpy(), found["n1"].to_numpy()), axis=1)
    order = np.argsort(words)
    order = order[words[order] != _END]
    return words[order], texts[order]


#: One label of one subject, as a whole number that the shares of up to twelve subjects divide.
UNIT = 27_720
#: The models: two that each train on a half of the labelled documents and judge the other, and the one of all.
HALVES, WHOLE = (0, 1), 2
#: Rows of counts that a task holds for a model before it passes them on.
HELD = 300_000


class _Labelled:
    """Some labelled texts: their token ids, each token's text, each text's half and its subjects."""

    def __init__(self, models: _Models, batch: pa.RecordBatch) -> None:
        keys, bodies, topics = (batch.column(k).to_pylist() for k in range(3))
        self.ids, self.owner = models.encode(np.frombuffer(b"".join(bodies), np.uint64), [len(b) // 8 for b in bodies])
        self.half = np.array([k & 1 for k in keys])
        self.labels = np.zeros((len(keys), len(models.topics)), bool)
        for row, found in enumerate(topics):
            self.labels[row, found] = True

    def of(self, model: _Models, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The token ids of the chosen texts as a model knows them, each token's text among them, and their subjects."""
        mine = chosen[self.owner]
        ids = self.ids[mine]
        word = ids % model.size
        return np.where(model.known[word], ids, ids - word + UNKNOWN), (np.cumsum(chosen) - 1)[self.owner[mine]], self.labels[chosen]


def _tasks(rows: DataFrame) -> DataFrame:
    """A few tasks for each core, whatever there is to read, as each sends counts of most of the words."""
    return rows.coalesce(3 * rows.sparkSession.sparkContext.defaultParallelism)


def _counts(rows: DataFrame, models: list[_Models], first: bool, least_gain: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys and sums that each model trains on, over all labelled texts; at ``first`` texts count by their labels, later sentences by what the models say."""
    names = [f"c{k}" for k in range(len(models[WHOLE].topics) + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def counted(model: _Models, ids: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if first:
            marked = np.rint(UNIT * labels / np.maximum(labels.sum(axis=1, keepdims=True), 1))
            return model.counted(ids, lambda k: marked[owner, k])
        starts, words, difference = model.sentences(ids)
        best, most = _assigned(difference, words, owner[starts], len(labels), np.full(len(model.topics), least_gain))
        # a sentence trains the subject that the models give it, against the document's label only where they are sure
        own = labels[owner[starts], best]
        sure = (most >= 0) & (own | (most >= least_gain))
        subject = np.repeat(np.where(sure, best, -1), np.diff(np.append(starts, len(ids))))
        return model.counted(ids, lambda k: UNIT * (subject == k))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in models]

        def passed(m: int, least: int = 0) -> Iterator[pa.RecordBatch]:
            """A model's counts so far, if they have more than ``least`` rows when they are added up."""
            keys, sums = _merged(held[m])
            held[m] = [(keys, sums)]
            if len(keys) > least:
                held[m] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, np.int32)), pa.array(keys), *map(pa.array, np.ascontiguousarray(sums.T))], ["model", "key", *names])

        for batch in sliced(batches, 512):
            texts = _Labelled(shared.value[WHOLE], batch)
            for m, model in enumerate(shared.value):
                chosen = (texts.half == m) | (m == WHOLE)
                if chosen.any():
                    held[m].append(counted(model, *texts.of(model, chosen)))
                if sum(len(k) for k, _ in held[m]) > 2 * HELD:
                    yield from passed(m, HELD)
        for m in range(len(held)):
            if held[m]:
                yield from passed(m)

    summed = _tasks(rows).mapInArrow(read, "model int, key long, " + ", ".join(f"{c} long" for c in names)).groupBy("model", "key").agg(*(F.sum(c).alias(c) for c in names))
    found = summed.where("key < 0 or c0 > 1").toArrow()
    shared.destroy()
    of = found["model"].to_numpy()
    out = []
    for m in range(len(models)):
        mine = of == m
        sums = np.stack([found[c].to_numpy()[mine] for c in names], axis=1).astype(float)
        sums[:, 1:] /= UNIT
        out.append((found["key"].to_numpy()[mine], sums))
    return out


def _held_out(rows: DataFrame, models: list[_Models], share: float) -> list[np.ndarray]:
    """For each candidate margin what ``_judged`` gives over all labelled texts, each judged by the model of the other half."""
    topics = models[WHOLE].topics
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = np.zeros((len(MARGINS), 3, len(topics)), np.int64)
        for batch in sliced(batches, 512):
            texts = _Labelled(shared.value[WHOLE], batch)
            for m in HALVES:
                chosen = texts.half != m
                if chosen.any():
                    ids, owner, labels = texts.of(shared.value[m], chosen)
                    tables = _shares(shared.value[m], ids, owner, len(labels), [np.full(len(topics), x) for x in MARGINS])
                    judged += [_judged(t, labels, share) for t in tables]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(judged.size)), pa.array(judged.ravel())], ["place", "n"])

    found = _tasks(rows).mapInArrow(read, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(MARGINS) * 3 * len(topics), np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return list(out.reshape(len(MARGINS), 3, len(topics)))


def fitted(rows: DataFrame, topics: list[str], share: float = 0.25, rounds: int = 2, least_gain: float = 2.5, weights: tuple[float, float, float] = (0.4, 0.55, 0.05)) -> _Models:
    """Models from rows ``(_id, values, topics)`` of all labelled documents, with margins calibrated by training on each half and judging the other.

    ``values`` are the hashes of a text's tokens and ``topics`` the places of its subjects. Texts are in the half of their id, so that repeated rows are in the same.
    """
    words, texts = _vocabulary(rows)
    models = [_Models(topics, words, weights) for _ in (*HALVES, WHOLE)]
    for m in HALVES:  # the words of one text of a half are unknown to its model
        models[m].known[2:] = texts[:, m] > 1
    for at in range(rounds + 1):
        for model, sums in zip(models, _counts(rows, models, at == 0, least_gain)):
            model.train(*sums)
    models[WHOLE].margins = _margins(_held_out(rows, models, share))
    return models[WHOLE]


#: Labelled ids that are broadcast (about 80 bytes each); beyond, the join is Spark's choice.
BROADCAST_LABELS = 1_000_000


def _training(docs: DataFrame, labels: DataFrame, topics: list[str], id_col: str, text_col: str, topic_col: str, skip_residue: bool) -> DataFrame:
    """One scan for both fits: the hashed tokens of all labelled documents, and the evidence of residue from all records."""
    place = F.array_position(F.lit(topics), F.col(topic_col)).cast("int") - 1
    given = labels.select(F.col(id_col).alias("_key"), place.alias("_topic")).where("_topic >= 0").groupBy("_key").agg(F.sort_array(F.collect_set("_topic")).alias("_topics"))
    if labels.count() <= BROADCAST_LABELS:
        given = F.broadcast(given)
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    joined = source.join(given, "_key", "left").select(F.xxhash64("_key"), "_text", "_topics")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hasher = residue.WholeEvidence(), WordHasher()
        for batch in sliced(batches):
            ids, texts, marks = (batch.column(k).to_pylist() for k in range(3))
            rows = [("label", key, hasher([*_tokens(text), STOP]).tobytes(), None, mark) for key, text, mark in zip(ids, texts, marks) if mark]
            if skip_residue:
                rows += [(*r, None) for r in found.rows(texts)]
            yield _arrow(rows)
        if skip_residue:
            yield _arrow([(*r, None) for r in found.rest()])

    return joined.mapInArrow(read, "kind string, _id long, values binary, counts binary, topics array<int>")


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "_id", "values", "counts", "topics"])


def subjects(
    docs: DataFrame, labels: DataFrame, topics: DataFrame, skip_residue: bool = True, share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", topic_col: str = "topic"
) -> DataFrame:
    """``(id, topic)``: the subjects of each document.

    Null and empty texts, texts without a sentence on any subject, and rows without an id have none; with ``skip_residue`` records without content have none
    either. Repeated rows give their subjects once. Without labels or topics nothing has a subject. All labelled documents and all records count in the two
    fits, whose sums are added up in tasks; texts are read twice, once for both fits and once for both scores.
    """
    schema = docs.select(F.col(id_col)).schema.add(topic_col, "string")
    names = sorted(r[0] for r in topics.select(topic_col).where(F.col(topic_col).isNotNull()).distinct().collect())  # the fixed list of subjects
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    rows, path = scratch(_training(docs, labels, names, id_col, text_col, topic_col, skip_residue), "kind")
    models = fitted(rows.where("kind = 'label'").select("_id", "values", "topics"), names, share)
    weights = residue.fitted_whole(rows) if skip_residue else np.zeros(residue.FEATURES, np.float32)
    remove(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast((models, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value
        scorer, numbered = residue.Scorer(w), _WordIds(m)
        for batch in sliced(batches, 256):
            texts = batch.column(1).to_pylist()
            lists = [[*_tokens(text), STOP] for text in texts]
            ids, owner = m.placed(numbered(lists), [len(x) for x in lists])
            got = accepted(_shares(m, ids, owner, len(lists), [m.margins])[0], share)
            if skip_residue:
                got[scorer.residue(texts)] = False
            row, column = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row.astype(np.int32))), pa.array([m.topics[k] for k in column], pa.string())], schema.names)

    found = docs.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).mapInArrow(score, schema)
    return found.distinct()
