"""Language identification by unigram pieces, marginalised over all segmentations.

The vocabulary is that of a public tokenizer, fixed. For each language the pieces' probabilities are fitted by EM over the
words of labelled texts; a word's probability is the sum over all its segmentations of the product of its pieces'
probabilities, by the forward algorithm. A text's score is the sum over its words (runs of letters, in lower case).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, mix, slices, trimmed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts to learn from, in each language, about so many (chosen by a hash of the id); the words of whole texts count.
SAMPLE_TEXTS = 1500
MARK = "▁"
#: Sums along a word are scaled anew after so many letters, so that words of any length stay within range.
STEP = 32
#: Bytes of text, and distinct words of it, that a worker handles at a time.
SLICE, WORDS = 4 << 20, 1 << 14
#: Keeps products of probabilities within range: each letter counts this factor, taken off at the end.
_SCALE = 16.0
_UNKNOWN = 1e-7


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the mark of a word's begin."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    normal = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted(p for p in set(normal) if (t := p.removeprefix(MARK)).isalpha() and t == t.lower() or p == MARK)


class Lattice:
    """Finds all vocabulary pieces inside many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.tables = {}
        for k in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == k], np.int32)
            if len(ids):
                points = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, k)
                h = np.zeros(len(ids), np.uint64)
                for j in range(k):
                    h = self._step(h, points[:, j])
                order = np.argsort(h)
                there = np.zeros(1 << 18, bool)
                there[h >> np.uint64(46)] = True
                self.tables[k] = h[order], ids[order], there

    @staticmethod
    def _step(h: np.ndarray, point: np.ndarray) -> np.ndarray:
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + point.astype(np.uint64) + np.uint64(1))

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of marked words, longest first: their numbers, begins and lengths, and by piece length k the piece that begins at each
        letter (-1: none; n: one unknown letter)."""
        joined = MARK + MARK.join(words.to_pylist())
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero(points == ord(MARK))
        size = np.diff(np.r_[begin, len(points)])
        left = np.repeat(size, size) - (np.arange(len(points)) - np.repeat(begin, size))  # letters to the word's end
        found = []
        h = np.zeros(len(points), np.uint64)
        here = np.arange(len(points))
        for k in range(1, min(self.longest, int(size.max(initial=1))) + 1):
            here = here[left[here] >= k]
            h[here] = self._step(h[here], points[here + k - 1])
            out = np.full(len(points), -1, np.int32)
            if k == 1:
                out[:] = self.n
            if k in self.tables:
                hashes, ids, there = self.tables[k]
                maybe = here[there[h[here] >> np.uint64(46)]]
                i = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                good = hashes[i] == h[maybe]
                out[maybe[good]] = ids[i[good]]
            found.append(out)
        order = np.argsort(-size, kind="stable")
        return order, begin[order], size[order], found

    @staticmethod
    def rescaled(sums: list[np.ndarray], shifts: list[np.ndarray], window: range, m: int) -> np.ndarray:
        """Divides the sums of a window by their largest, for the first m words, and notes its logarithm, which is returned."""
        most = np.zeros((m, *sums[window[0]].shape[1:]))
        for j in window:
            k = min(m, len(sums[j]))
            np.maximum(most[:k], sums[j][:k], out=most[:k])
        most[most <= 0] = 1.0
        for j in window:
            k = min(m, len(sums[j]))
            sums[j][:k] /= most[:k]
            shifts[j] = shifts[j].copy()
            shifts[j][:k] += np.log(most[:k])
        return np.log(most)

    def forward(self, at: np.ndarray, long: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled forward sums after 0, 1, ... letters for the words that have as many, and the logarithms to add to theirs; p:
        pieces by languages, unknown last."""
        shift = np.zeros((len(at), p.shape[1]))
        sums, shifts = [np.ones((len(at), p.shape[1]))], [shift]
        for end in range(1, int(long[0]) + 1 if len(long) else 1):
            m = int(np.searchsorted(-long, -end, "right"))
            total = np.zeros((m, p.shape[1]))
            for k in range(1, min(end, len(found)) + 1):
                piece = found[k - 1][at[:m] + end - k]
                i = np.flatnonzero(piece >= 0)
                if len(i):
                    total[i] += sums[end - k][i] * p[piece[i]]
            sums.append(total)
            shifts.append(shift[:m])
            if end % STEP == 0:
                shift = shift.copy()
                shift[:m] += self.rescaled(sums, shifts, range(max(0, end - len(found) + 1), end + 1), m)
        return sums, shifts

    def backward(self, at: np.ndarray, long: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same from the words' ends, for one language: at each place for the words that reach it."""
        top = int(long[0])
        shift = np.zeros(len(at))
        sums: list = [None] * (top + 1)
        shifts: list = [None] * (top + 1)
        for begin in range(top, -1, -1):
            m = int(np.searchsorted(-long, -begin, "right"))
            sums[begin] = (long[:m] == begin).astype(float)
            for k in range(1, min(top - begin, len(found)) + 1):
                j = int(np.searchsorted(-long, -(begin + k), "right"))
                piece = found[k - 1][at[:j] + begin]
                i = np.flatnonzero(piece >= 0)
                sums[begin][i] += p[piece[i]] * sums[begin + k][i]
            shifts[begin] = shift[:m]
            if begin % STEP == 0 and begin:
                shift = shift.copy()
                shift[:m] += self.rescaled(sums, shifts, range(begin, min(top, begin + len(found) - 1) + 1), m)
        return sums, shifts

    def scaled(self, p: np.ndarray, pieces: list[str]) -> np.ndarray:
        return p * np.array([_SCALE ** len(x) for x in pieces] + [_SCALE])[:, None]

    def log_probability(self, words: pa.Array, scaled: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability by language."""
        if not len(words):
            return np.zeros((0, scaled.shape[1]))
        word, at, long, found = self.look(words)
        sums, shifts = self.forward(at, long, found, scaled)
        out = np.empty((len(words), scaled.shape[1]))
        for n in np.unique(long):
            i = slice(int(np.searchsorted(-long, -n, "left")), int(np.searchsorted(-long, -n, "right")))
            out[word[i]] = np.log(np.maximum(sums[n][i], 1e-300)) + shifts[n][i] - n * np.log(_SCALE)
        return out

    def expected(self, words: pa.Array, weight: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """How often each piece stands in the words' segmentations, by their posterior under one language."""
        out = np.zeros(self.n + 1)
        if not len(words):
            return out
        word, at, long, found = self.look(words)
        flat = scaled[:, 0]
        (sums, shifts), (back, after) = self.forward(at, long, found, scaled), self.backward(at, long, found, flat)
        with np.errstate(divide="ignore"):  # sums of nothing are 0
            fore = [np.log(x[:, 0]) + y[:, 0] for x, y in zip(sums, shifts, strict=True)]
            rest = [np.log(x) + y for x, y in zip(back, after, strict=True)]
        whole = rest[0]
        for begin in range(int(long[0])):
            for k in range(1, min(int(long[0]) - begin, len(found)) + 1):
                m = int(np.searchsorted(-long, -(begin + k), "right"))
                piece = found[k - 1][at[:m] + begin]
                i = np.flatnonzero(piece >= 0)
                share = flat[piece[i]] * np.exp(fore[begin][i] + rest[begin + k][i] - whole[i])
                out += np.bincount(piece[i], weight[word[i]] * share, self.n + 1)
        return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, which of them each word is, and its text."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.split_pattern(pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, r"\PL+", " ")), " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    code, text = coded.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
    some = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0  # a text without a letter gives one empty word
    keep = some[code]
    return coded.dictionary, code[keep], text[keep]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # pieces and the unknown letter, by language
    prior: np.ndarray


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, sample_texts: int = SAMPLE_TEXTS, rounds: int = 4, smoothing: float = 0.05) -> Model:
    """Fits (text, lang) rows with an id. Null languages and texts without letters teach nothing. The expectation step runs
    over a distributed table of (language, word, count); what comes back has a row for each language and piece at most."""
    known = labelled.where(F.col("lang").isNotNull())
    have = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(have), pieces_of(vocabulary)
    lattice = Lattice(pieces)
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    if not languages:
        return Model([], pieces, p, np.zeros(0))
    share = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(min(1.0, sample_texts / have[name])))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, code, text = words_of(part.column("text"))
                of = part.column("lang").dictionary_encode()
                u, n = np.unique(of.indices.to_numpy()[text].astype(np.int64) * (len(words) + 1) + code, return_counts=True)
                yield pa.record_batch({"lang": of.dictionary.take(u // (len(words) + 1)), "word": words.take(u % (len(words) + 1)), "n": n})

    words = cut(sample.mapInArrow(trimmed(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            scaled = lattice.scaled(sent.value, pieces)
            for batch in batches:
                code = np.searchsorted(languages, np.array(batch.column("lang").to_pylist()))
                for i in np.unique(code):
                    at = np.flatnonzero(code == i)
                    total[:, i] += lattice.expected(batch.column("word").take(at), batch.column("n").to_numpy()[at].astype(float), scaled[:, i : i + 1])
            row, column = np.nonzero(total)
            yield pa.record_batch({"language": column, "piece": row, "n": total[row, column]})

        got = words.mapInArrow(trimmed(expect), "language long, piece long, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros_like(p)
        n[got["piece"], got["language"]] = got["n"]
        p = (n + smoothing) / (n.sum(0) + smoothing * len(n))
        p[-1] = _UNKNOWN
        sent.unpersist()
    total = np.array([have[x] for x in languages], float)
    return Model(languages, pieces, p, np.log(total / total.sum()))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """All columns with lang_pred, score, the posterior of that language (ties: the first by name), and per_letter, the natural
    logarithm of the text's probability in that language for each letter or mark of a word (0 where nothing is predicted).

    `und` and 0 for null texts and texts without a letter, or if nothing was learnt. Whole texts count; each row is its own.
    Only texts go to Python; the other columns wait in the JVM."""
    lattice = Lattice(model.pieces)
    sent = documents.sparkSession.sparkContext.broadcast((model.languages, lattice, lattice.scaled(model.probability, model.pieces), model.prior))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, lattice, scaled, prior = sent.value
        m = len(languages)
        for batch in batches:
            done = []
            for part in slices(pa.record_batch({"text": batch}), "text", SLICE):
                words, code, text = words_of(part.column("text"))
                n = part.num_rows
                has = np.bincount(text, minlength=n) > 0
                best, score, each = np.zeros(n, int), np.zeros(n), np.zeros(n)
                if m:
                    log = np.empty((len(words), m))
                    for i in range(0, len(words), WORDS):
                        log[i : i + WORDS] = lattice.log_probability(words.slice(i, WORDS), scaled)
                    z = np.stack([np.bincount(text, log[code, j], n) for j in range(m)], 1) + prior
                    best = z.argmax(1)
                    score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                    letters = np.bincount(text, (pc.utf8_length(words).to_numpy(zero_copy_only=False) + 1)[code], n)
                    each = (z - prior)[np.arange(n), best] / np.maximum(letters, 1)
                has &= m > 0
                name = np.array([*languages, "und"], object)[np.where(has, best, m)]
                done.append(pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, each, 0.0))], ["lang_pred", "score", "per_letter"]))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("per_letter", pa.float64())]))

    # not deterministic for the optimizer, so that a filter on the result doesn't run the model twice
    column = F.arrow_udf(trimmed(predict), "lang_pred string, score double, per_letter double").asNondeterministic()(F.col("text"))
    columns = [c for c in documents.columns if c not in ("lang_pred", "score", "per_letter")]
    found = documents.select(*columns, column.alias("__found"))
    return found.select(*columns, "__found.lang_pred", "__found.score", "__found.per_letter")


def held_out(m: int = 3, remainder: int = 1) -> Column:
    return crc_mod("doc_id", m) == remainder
