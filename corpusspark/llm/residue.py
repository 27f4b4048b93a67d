"""Problem 8: records that hold template residue, filler or an error page instead of content.

Method: positive-unlabelled naive Bayes. Records in which every passage carries an unmistakable mark (an unfilled placeholder, an HTTP
status, a script notice, filler Latin) are trusted positives, all of which count; all others are unlabelled, and a bounded sample of
them stands for them. Expectation-maximisation re-estimates which of those are residue and so learns the wording that comes with the
marks. All passages of all records are then scored with the learned weights, and a record is residue when none of its passages is content.
Texts are read twice: once for the fit and once for the scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .hashing import sliced

BITS = 18
FEATURES = 1 << BITS
_VARIABLE = re.compile(r"(?=[{$<%@#_~\[T])(?:\{\{.*?\}\}|\$\{.*?\}|\{%.*?%\}|<%.*?%>|([%@#_~])\1[A-Za-z]\w*?\1\1|<<\w+>>|\[INSERT [^\]\n]*\]|<your [^>\n]*>|(?<!\[)\[[A-Z][a-z]+(?: [A-Za-z]+)?\](?![\](])|\bTODO: fill in [\w ]*)")
_PATH = re.compile(r"(?<![\w.])/[a-z][\w.-]*(?:/[\w.-]+)+", re.I)
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.(?:invalid|example|test|com|org|net|html?|php)\b", re.I)
_TLD = re.compile(r"\.(?:invalid|example|test|com|org|net|html?|php)\b", re.I)
_MARKS = ("{", "$", "<", "%", "[", "TODO", "##", "@@", "__", "~~")
_TOKEN = re.compile(r"[^\W_]+|[-<>{}=\"|]|\n|[.!?](?=\s+[^\W\d_a-z])")
_STOP = re.compile(r"[.!?](?=\s+[A-Z])")
_SIGNS = '-<>{}="|'
_KEPT = "".join(c.lower() if c.isalnum() or c in _SIGNS or c == "\0" else " " for c in map(chr, range(128)))
_HEX = re.compile(r"(?=.*\d)(?=.*[a-f])[0-9a-f]{6,}\Z")
#: Marks that make a passage trusted on their own when nothing else in the record contradicts.
TRUSTED = re.compile(
    r"\{\{.*?\}\}|\$\{\w+\}|\{%.*?%\}|<%.*?%>|([%@#_~])\1[A-Za-z]\w*?\1\1|<<\w+>>|\[INSERT [^\]\n]*\]|<your [^>\n]*>|\bTODO: fill in\b|\blorem ipsum\b|javascript|noscript|\b[45]\d\d\b.*(?:error|not found|forbidden|unavailable|unauthori[sz]ed)"
    r"|\b(?:not found|access denied|forbidden|service unavailable|bad gateway|internal server error)\b|traceback \(most recent call last\)|\"error\"\s*:|<error>"
    r"|\b(?:p[áa]gina no encontrada|acceso denegado|error interno del servidor|servicio no disponible|no se encontr[óo] la direcci[óo]n)\b"
    r"|\b(?:seite nicht gefunden|zugriff verweigert|interner serverfehler|dienst nicht verf[üu]gbar|auf diesem server nicht gefunden)\b"
    r"|\b(?:page (?:introuvable|non trouv[ée]e)|acc[èe]s (?:refus[ée]|interdit)|erreur interne du serveur|service (?:indisponible|non disponible))\b"
    r"|(?<!\[)\[[A-Z][a-z]+(?: [A-Za-z]+)?\](?![\](])|^HTTP/\d(?:\.\d)? [45]\d\d\b|\b(?:scripts|skripte)\b",
    re.I,
)
#: In small letters, what a match of ``TRUSTED`` always has a part of; and the letters beyond ASCII that stand for one of ASCII where case is ignored.
_HINTS = (
    "{{", "${", "{%", "<%", "%%", "@@", "##", "__", "~~", "<<", "[", "<your ", "todo: fill in", "lorem ipsum", "script", "skript", "error", "not found", "forbidden", "unavailable", "unauthori",
    "access denied", "bad gateway", "traceback", "http/", "gina no encontrada", "acceso denegado", "servicio no disponible", "no se encontr", "seite nicht", "zugriff", "serverfehler", "dienst nicht",
    "auf diesem server", "page introuvable", "page non trouv", "s refus", "s interdit", "erreur interne", "service indisponible", "service non disponible",
)
_AS_ASCII = "\u017f\u0130\u0131\u212a"
#: The longer words of the usual filler Latin (fixed values).
FILLER = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip"
    " commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
_FRONT = re.compile(r"\A\s*---\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_HEADING = re.compile(r"(?m)^[ \t]*(?:#(?!#\w+##).*|=+[ \t]*|-+[ \t]*|\*[ \t]*\*[ \t]*\*.*)$")
_RULES = ("#", "---", "===", "**", "* *", "*\t*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])")


def is_trusted(passage: str) -> bool:
    """Whether a passage has a mark, or at least half of its longer words are filler."""
    low = passage.lower()
    if (any(map(low.__contains__, _HINTS)) or any(map(passage.__contains__, _AS_ASCII))) and TRUSTED.search(passage):
        return True
    words = re.findall(r"[^\W\d_]{4,}", low)
    return bool(words) and 2 * sum(w in FILLER for w in words) >= len(words)


def _body(text: str) -> str:
    """A text without its front matter and heading lines."""
    body = text.replace("\r", "")
    if body.lstrip().startswith("---"):
        body = _FRONT.sub("", body, count=1)
    return _HEADING.sub("", body) if any(map(body.__contains__, _RULES)) else body


def passages(text: str) -> list[str]:
    """The sentences of a text's lines; front matter and heading lines are left out."""
    return [s for line in _body(text).split("\n") if line.strip() for s in _SENTENCE.split(line.strip())]


def _tokens(body: str) -> list[str]:
    """What ``_TOKEN`` finds; texts of ASCII are split at spaces, which is faster, and have small letters and a full stop for each break."""
    if not body.isascii() or "\0" in body:
        return _TOKEN.findall(body)
    body = _STOP.sub("\0", body).replace("\n", "\0").translate(_KEPT)
    for sign in _SIGNS:
        if sign in body:
            body = body.replace(sign, f" {sign} ")
    return body.replace("\0", " . ").split()


class _Ids(dict):
    """A hash of each token, whose last bit says whether the token is a word; 0 for breaks."""

    def __init__(self) -> None:
        super().__init__({"\n": 0, ".": 0, "!": 0, "?": 0})

    def __missing__(self, token: str) -> int:
        plain = token.casefold()
        if plain.isdigit():
            plain = "0"
        elif _HEX.match(plain):
            plain = "0x"
        word = plain[0].isalpha() and not "\ue000" <= plain[0] <= "\uf8ff"
        self[token] = found = (xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) | 2) & ~1 | word
        return found


class _Features:
    """Hashed words and word pairs of passages; numbers, hashes, paths, hosts and variables stand for their kind."""

    def __init__(self) -> None:
        self.cache = _Ids()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of all texts: the word's feature, the pair's feature, and whether it is a word; each passage's start and text."""
        return self.of_bodies([_body(text) for text in texts])

    def of_bodies(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.cache) > 500_000:
            self.cache = _Ids()
        cache, ids, lengths = self.cache, [], []
        for body in bodies:
            if any(map(body.__contains__, _MARKS)):
                body = _VARIABLE.sub(" vvariable ", body)
            if "/" in body:
                body = _PATH.sub(" vpath ", body)
            if _TLD.search(body):
                body = _HOST.sub(" vhost ", body)
            tokens = _tokens(body)
            ids += map(cache.__getitem__, tokens)
            ids.append(0)
            lengths.append(len(tokens) + 1)
        token = np.array(ids, np.uint64)
        if not len(token):
            return token.astype(np.int64), token.astype(np.int64), token.astype(bool), token.astype(np.int64), token.astype(np.int64)
        shift = np.uint64(64 - BITS)
        factor = np.uint64(0x9E3779B97F4A7C15)
        single = ((token * factor) >> shift).astype(np.int64)
        single[token == 0] = -1
        before = np.concatenate((np.zeros(1, np.uint64), token[:-1]))
        pair = (((before * np.uint64(0xC2B2AE3D27D4EB4F) ^ token) * factor) >> shift).astype(np.int64)
        pair[(token == 0) & (before == 0)] = -1
        starts = np.concatenate(([0], np.flatnonzero(token[:-1] == 0) + 1))
        owner = np.repeat(np.arange(len(lengths)), lengths)[starts]
        return single, pair, (token & np.uint64(1)).astype(bool), starts, owner


def is_trusted_record(text: str) -> bool:
    """Whether every passage of more than three words has a mark, and one in forty of all passages."""
    return _is_trusted_body(_body(text))


def _is_trusted_body(body: str) -> bool:
    marked = count = 0
    for line in body.split("\n"):
        line = line.strip()
        for passage in _SENTENCE.split(line) if line else ():
            trusted = is_trusted(passage)
            if not trusted and len(passage.split()) > 3:
                return False
            marked += trusted
            count += 1
    return marked * 40 >= count > 0


EVIDENCE = "kind string, _id long, features array<int>, counts array<long>"


class Evidence:
    """What the fit needs of the records that one task sees: the summed features of all trusted ones, and the features of the sampled others."""

    def __init__(self) -> None:
        self.featured, self.counts, self.trusted = _Features(), np.zeros(FEATURES, np.int64), 0

    def _of(self, text: str) -> np.ndarray:
        single, pair, *_ = self.featured([text])
        found = np.unique(np.concatenate((single, pair)))
        return found[found >= 0]

    def rows(self, ids: list, texts: list[str], sampled: list[bool]) -> list[tuple]:
        out = []
        for key, text, chosen in zip(ids, texts, sampled):
            if is_trusted_record(text):
                self.counts[self._of(text)] += 1
                self.trusted += 1
            elif chosen:
                out.append(("open", key, self._of(text).astype(np.int32), None))
        return out

    def rest(self) -> list[tuple]:
        """The sums over the task's trusted records; the row's id is their number."""
        found = np.flatnonzero(self.counts)
        return [("trusted", self.trusted, found.astype(np.int32), self.counts[found])]


class WholeEvidence:
    """What the fit over all records needs of those that one task sees: the features of each one that is not trusted, and the sums over both kinds."""

    def __init__(self) -> None:
        self.featured = _Features()
        self.sums = {"trusted": np.zeros(FEATURES, np.int64), "every": np.zeros(FEATURES, np.int64)}
        self.number = {"trusted": 0, "every": 0}

    def rows(self, texts: list[str]) -> Iterator[tuple[str, int | None, bytes, bytes | None]]:
        for at in range(0, len(texts), 256):
            bodies = [_body(text) for text in texts[at : at + 256]]
            single, pair, _, starts, owner = self.featured.of_bodies(bodies)
            bounds = np.append(starts[np.flatnonzero(np.diff(owner, prepend=-1))], len(single))
            record = np.repeat(np.arange(len(bodies), dtype=np.int32) << BITS, np.diff(bounds))
            both = np.concatenate([(f.astype(np.int32) + record)[f >= 0] for f in (single, pair)])  # the record's place above the feature
            both.sort()
            both = both[np.diff(both, prepend=np.int32(-1)) > 0]  # each once
            ends = np.searchsorted(both, np.arange(len(bodies) + 1) << BITS)
            both &= FEATURES - 1
            for k, body in enumerate(bodies):
                found = both[ends[k] : ends[k + 1]]
                kind = "trusted" if _is_trusted_body(body) else "every"
                self.sums[kind][found] += 1
                self.number[kind] += 1
                if kind == "every":
                    yield "open", None, found.tobytes(), None

    def rest(self) -> Iterator[tuple[str, int | None, bytes, bytes | None]]:
        """The sums over the task's trusted and other records; the second value is their number."""
        for kind, sums in self.sums.items():
            found = np.flatnonzero(sums)
            yield kind, self.number[kind], found.astype(np.int32).tobytes(), sums[found].tobytes()


def sampled(df: DataFrame, id_col: str, sample: int) -> Column:
    """Whether a record is in the sample (by the hash of its id); its expected size is ``sample`` rows. The rows are counted without reading texts."""
    share = min(1.0, sample / max(df.count(), 1))
    return F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * share))


def _evidence(df: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Evidence()
        for batch in batches:
            yield _arrow(found.rows(*(batch.column(k).to_pylist() for k in range(3))))
        yield _arrow(found.rest())

    source = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return source.select(F.xxhash64(id_col), F.col(text_col), sampled(df, id_col, sample)).mapInArrow(read, EVIDENCE)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "_id", "features", "counts"])


def fitted(evidence: DataFrame, share: float, rounds: int = 8, floor: float = 1e-4) -> np.ndarray:
    """The log weight of each feature for content against residue, from rows as ``Evidence`` makes them.

    All trusted records count in full, summed by Spark to one row a feature; ``share`` is the share of the others that was sampled. The others start as
    content, and each round takes them for residue as far as the weights say so.
    """
    weights = np.zeros(FEATURES)
    sums = evidence.where("kind = 'trusted'")
    n_trusted = sums.agg(F.sum("_id")).first()[0] or 0
    data = evidence.where("kind = 'open'").select("_id", "features").toArrow().sort_by("_id")  # bounded by the sample
    if not n_trusted or not data.num_rows:
        return weights.astype(np.float32)
    table = sums.select(F.explode(F.arrays_zip("features", "counts")).alias("x")).groupBy("x.features").agg(F.sum("x.counts").alias("n")).toArrow()  # at most FEATURES rows
    trusted = np.zeros(FEATURES)
    trusted[table["features"].to_numpy()] = table["n"].to_numpy()
    lists = data["features"].combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    ends = np.concatenate(([0], np.cumsum(lengths)))
    blocks = [(k, min(k + 2_000, len(lengths))) for k in range(0, len(lengths), 2_000)]  # bounds what a round holds besides the features
    residue = np.zeros(len(lengths))
    every = np.zeros(FEATURES)
    for k, m in blocks:
        every += np.bincount(flat[ends[k] : ends[m]], minlength=FEATURES)
    for _ in range(rounds):
        taken = np.zeros(FEATURES)
        for k, m in blocks:
            taken += np.bincount(flat[ends[k] : ends[m]], weights=np.repeat(residue[k:m], lengths[k:m]), minlength=FEATURES)
        weights, prior = _estimated(trusted, every, taken, n_trusted, len(residue), residue.sum(), share, floor)
        for k, m in blocks:
            owner = np.repeat(np.arange(m - k), lengths[k:m])
            score = np.bincount(owner, weights=weights[flat[ends[k] : ends[m]]], minlength=m - k) + prior
            residue[k:m] = 1.0 / (1.0 + np.exp(np.clip(score, -50, 50)))
    return weights.astype(np.float32)


def _estimated(trusted: np.ndarray, every: np.ndarray, taken: np.ndarray, n_trusted: int, n_open: int, n_taken: float, share: float, floor: float) -> tuple[np.ndarray, float]:
    """Each feature's log weight and the prior, from the sums over trusted records, over all others, and over these as far as they are taken for residue."""
    good, bad = every - taken, trusted + taken / share
    n_good, n_bad = n_open - n_taken, n_trusted + n_taken / share
    weights = np.log((np.maximum(good, 0) + 0.05) / (n_good + 0.1)) - np.log((bad + max(0.05, floor * n_bad)) / (n_bad + 0.1))
    weights[trusted + every < 2] = 0.0  # seen in one record only: no evidence of either
    return weights, np.log(max(n_good / share, 1) / max(n_bad, 1))


#: What a record counts that is taken for residue for sure; whole numbers add up to the same in any order.
_UNIT = 1 << 32


def _added(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], columns: list[str]) -> np.ndarray:
    """The sums over all tasks of the tables (a row for each feature, and a last one) that ``sums`` makes in each; at most FEATURES + 1 rows reach the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sums(batches):
            some = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, table[some].T)], ["feature", *columns])

    tasks = rows.coalesce(3 * rows.sparkSession.sparkContext.defaultParallelism)  # each task sends one table, whatever it reads
    found = tasks.mapInArrow(read, "feature long, " + ", ".join(f"{c} long" for c in columns)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((FEATURES + 1, len(columns)))
    for k, c in enumerate(columns):
        out[found["feature"].to_numpy(), k] = found[c].to_numpy()
    return out


def fitted_whole(evidence: DataFrame, rounds: int = 8, floor: float = 1e-4) -> np.ndarray:
    """The weights of ``fitted`` from all records: rows ``(kind, _id, values, counts)`` as ``WholeEvidence`` makes them.

    The driver has sums only. Each round reads the features of all records that are not trusted and adds up in the tasks how far they are taken for residue.
    """
    kinds = ("trusted", "every")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        table = np.zeros((FEATURES + 1, 2), np.int64)
        for batch in batches:
            for kind, number, values, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                table[np.frombuffer(values, np.int32), kinds.index(kind)] += np.frombuffer(counts, np.int64)
                table[FEATURES, kinds.index(kind)] += number
        yield table

    sums = _added(evidence.where(F.col("kind").isin(*kinds)).select("kind", "_id", "values", "counts"), first, list(kinds))
    (trusted, every), (n_trusted, n_open) = sums[:-1].T, sums[-1]
    if not n_trusted or not n_open:
        return np.zeros(FEATURES, np.float32)
    rows = evidence.where("kind = 'open'").select("values")
    weights, prior = _estimated(trusted, every, np.zeros(FEATURES), n_trusted, n_open, 0.0, 1.0, floor)
    for _ in range(rounds - 1):
        shared = rows.sparkSession.sparkContext.broadcast((weights, prior))

        def taken(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[np.ndarray]:
            w, before = shared.value
            table = np.zeros((FEATURES + 1, 1), np.int64)
            for batch in sliced(batches):
                lists = batch.column(0).to_pylist()
                flat, lengths = np.frombuffer(b"".join(lists), np.int32), np.array([len(x) for x in lists]) // 4
                score, some = np.full(len(lists), before), lengths > 0
                if some.any():
                    score[some] += np.add.reduceat(w[flat], (np.cumsum(lengths) - lengths)[some])
                units = np.rint(_UNIT / (1.0 + np.exp(np.clip(score, -50, 50))))
                each = np.repeat(units, lengths)
                table[:FEATURES, 0] += np.bincount(flat[each > 0], weights=each[each > 0], minlength=FEATURES).astype(np.int64)
                table[FEATURES, 0] += int(units.sum())
            yield table

        sums = _added(rows, taken, ["taken"])[:, 0] / _UNIT
        shared.destroy()
        weights, prior = _estimated(trusted, every, sums[:-1], n_trusted, n_open, sums[-1], 1.0, floor)
    return weights.astype(np.float32)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 40_000) -> np.ndarray:
    """The weights from one scan; ``sample`` bounds the unlabelled records of the fit, all trusted ones count."""
    return fitted(stored(_evidence(df, id_col, text_col, sample), "kind"), min(1.0, sample / max(df.count(), 1)))


class Scorer:
    """Counts the passages of records by kind: content, residue, neutral."""

    def __init__(self, weights: np.ndarray, content_at: float = 4.0, least_words: int = 4) -> None:
        self.featured, self.weights = _Features(), np.append(weights, np.float32(0))  # the last entry is that of no feature
        self.content_at, self.least_words = content_at, least_words
        self.learned = bool(weights.any())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each record is residue, and its counts."""
        counts, w = np.zeros((len(texts), 3), np.int64), self.weights
        for k in range(0, len(texts), 256):
            single, pair, word, starts, owner = self.featured(texts[k : k + 256])
            if not len(starts):
                continue
            value = np.add.reduceat(w[single] + w[pair], starts)
            words = np.add.reduceat(word.astype(np.int64), starts)
            some = np.add.reduceat((single >= 0).astype(np.int64), starts) > 0
            content = some & (value >= self.content_at) & (words >= self.least_words)
            bad = some & (value < 0)
            for column, kind in enumerate((content, bad, some & ~content & ~bad)):
                counts[k : k + 256, column] += np.bincount(owner[kind], minlength=len(texts[k : k + 256]))
        verdict = (counts[:, 1] > 0) & (counts[:, 0] == 0)
        if self.learned:  # wording that the models don't know: the marks decide
            for k in np.flatnonzero((counts[:, 0] == 0) & ~verdict & (counts[:, 2] > 0)):
                verdict[k] = is_trusted_record(texts[k])
        return verdict, counts


    def residue(self, texts: list[str], head: int = 400) -> np.ndarray:
        """Whether each record is residue: as above, but one whose first lines (of ``head`` characters or more) have content is none, and only the others are read to their end."""
        bodies = [_body(text) for text in texts]
        heads = [b[: end + 1 if (end := b.find("\n", head)) >= 0 else len(b)] for b in bodies]
        single, pair, word, starts, owner = self.featured.of_bodies(heads)
        verdict = np.zeros(len(texts), bool)
        if not len(starts):
            return verdict
        value = np.add.reduceat(self.weights[single] + self.weights[pair], starts)
        words = np.add.reduceat(word.astype(np.int64), starts)
        some = np.add.reduceat((single >= 0).astype(np.int64), starts) > 0
        content = some & (value >= self.content_at) & (words >= self.least_words)
        rest = np.flatnonzero(np.bincount(owner[content], minlength=len(texts)) == 0)
        verdict[rest] = self([texts[k] for k in rest])[0]
        return verdict


def residue_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 40_000, content_at: float = 4.0, least_words: int = 4) -> DataFrame:
    """``(id, residue, n_content, n_residue, n_neutral)``: the passages of each record by kind, and the decision.

    A passage of at least ``least_words`` words with a log weight of ``content_at`` or more is content; one with a negative weight is residue; menu
    lines and the like are neutral. A record is residue when it has residue and no content, or no content and nothing but marks. Null texts have no row, empty ones no passages,
    so they are no residue. Rows are scored one by one: repeated rows repeat, an empty table or one without any trusted record gives no residue.
    """
    weights = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, sample))
    schema = df.select(F.col(id_col)).schema
    schema.add("residue", "boolean").add("n_content", "integer").add("n_residue", "integer").add("n_neutral", "integer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value, content_at, least_words)
        for batch in batches:
            verdict, counts = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdict), *(pa.array(counts[:, c].astype(np.int32)) for c in range(3))], schema.names)

    return df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(score, schema)
