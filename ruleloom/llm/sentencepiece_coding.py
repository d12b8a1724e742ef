"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (its spaces with what follows them). The distinct ones of a slice are sorted, so that they
form a trie in depth-first order, and the forward pass keeps the states of the path to the last word: a word starts from the
states of the prefix that it shares with the one before.

A forward state is the best segmentation of a prefix, kept as its last piece and where that begins. For a unigram model the
best has the largest sum of scores. For a merge (BPE) model the segmentation that merging gives is wanted, which no sum of
scores yields; there a piece may follow a segmentation only if merging the last piece and it leaves both as they are, and
exactly one last piece passes. Letters outside the vocabulary become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces, and pairs of pieces whose fit, a worker remembers from one slice to the next, about. Of words the older
#: half is forgotten when it wasn't used again.
REMEMBERED = 1 << 18
#: Bytes of text that are encoded at a time; what words have in common is remembered, so that small parts cost little.
PART = 1 << 20


class Coder:
    """Pieces and scores as plain data, so that it can be sent to workers."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: list[int], merges: bool = True):
        self.merges = merges
        skip = {*byte_ids, *special}
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.piece, self.score, self.byte_ids = pieces, scores, byte_ids
        self.longest = max(map(len, self.id_of))
        of_byte = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        raw = [of_byte.get(i, b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        # pieces that merging can make at all
        self.ends = {p: i for p, i in self.id_of.items() if not merges or len(p) == 1 or self.merged(p) == [p]}
        self._follows: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def load(path: str = MODEL, merges: bool = True) -> Coder:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in n]
        of = {p: i for i, p in enumerate(pieces) if m.is_byte(i)}
        return Coder(pieces, [m.get_score(i) for i in n], [of[f"<0x{b:02X}>"] for b in range(256)], [i for i in n if m.is_control(i) or m.is_unknown(i)], merges)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (got := self._follows.get(key)) is None:
            if len(self._follows) >= REMEMBERED:
                self._follows.clear()
            x, y = self.piece[a], self.piece[b]
            got = self._follows[key] = self.merged(x + y) == [x, y]
        return got

    def states(self, words: list[str]) -> Iterator[list[int]]:
        """The pieces of each of the sorted words."""
        last: list[int] = [-1]  # the last piece of the best segmentation of so many letters; -2: a letter without a piece
        begin: list[int] = [0]
        total: list[float] = [0.0]
        extend = self._merge if self.merges else self._sum
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], total[shared + 1 :]
            extend(word, shared + 1, last, begin, total)
            out, at = [], len(word)
            while at:
                if last[at] >= 0:
                    out.append(last[at])
                else:
                    out += [self.byte_ids[b] for b in reversed(word[begin[at] : at].encode())]
                at = begin[at]
            out.reverse()
            before = word
            yield out

    def _merge(self, word: str, first: int, last: list[int], begin: list[int], _: list[float]) -> None:
        """Adds the states from `first` letters on: the one last piece that fits what stands before it."""
        get, known, longest = self.ends.get, self._follows.get, self.longest
        for end in range(first, len(word) + 1):
            start, low, choice = end - 1, end - longest, -2
            at = start
            while start >= 0 and start >= low:
                i = get(word[start:end])
                if i is not None:
                    before = last[start]
                    if before < 0:
                        choice, at = i, start
                        break
                    ok = known(before << 20 | i)
                    if ok is None:
                        ok = self.follows(before, i)
                    if ok:
                        choice, at = i, start
                        break
                start -= 1
            last.append(choice)
            begin.append(at)

    def _sum(self, word: str, first: int, last: list[int], begin: list[int], total: list[float]) -> None:
        """Adds the states from `first` letters on: the last piece with the largest sum of scores."""
        for end in range(first, len(word) + 1):
            choice, at, best = -2, end - 1, total[end - 1] - 1e6
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                i = self.ends.get(word[start:end])
                if i is not None and ((value := total[start] + self.score[i]) > best or choice == -2):
                    choice, at, best = i, start, value
            last.append(choice)
            begin.append(at)
            total.append(best)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end and how many each text has. Null is empty; U+2581 in a text counts as a space, as in the library."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
        size, none = pc.binary_length(texts).to_numpy(zero_copy_only=False), pa.scalar("", pa.large_string())
        marked = pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, none), none)
        offsets = np.frombuffer(marked.buffers()[1], np.int64, len(marked) + 1, marked.offset * 8)
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = data == 0x20
        cut[1:] &= data[:-1] != 0x20
        first = offsets[:-1][size > 0]
        cut[first] = True
        start = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, len(data)].astype(np.int64)), pa.py_buffer(data.tobytes())).dictionary_encode()
        distinct = [w.replace(" ", MARK) for w in words.dictionary.to_pylist()]
        known, older = self._known, self._older
        known.update((w, older[w]) for w in distinct if w not in known and w in older)
        new = sorted(w for w in distinct if w not in known)
        known.update(zip(new, map(tuple, self.states(new)), strict=True))
        coded = [known[w] for w in distinct]
        if len(known) > REMEMBERED // 2:
            self._known, self._older = {}, known
        count = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int32, int(count.sum()))
        code = words.indices.to_numpy()
        n = count[code]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(count) - count)[code] - (ends - n), n)]
        by_text = np.r_[0, ends][np.searchsorted(start, offsets)]
        return ids, np.diff(by_text)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts; a text's first space is the mark that encoding puts before it. Bytes that aren't UTF-8 become U+FFFD."""
        n = self.raw_size[ids]
        ends = np.cumsum(n)
        data = self.raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_at[ids] - (ends - n), n)]
        at = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        keep = np.ones(len(data), bool)
        heads = at[:-1][np.diff(at) > 0]
        keep[heads] = data[heads] != 0x20
        offsets = np.r_[0, np.cumsum(keep)][at].astype(np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())


def encode_texts(documents: DataFrame, coder: Coder | None = None) -> DataFrame:
    """All columns with ids, n_tokens and round_trip (whether decoding gives the text again; null is an empty text).

    A null or empty text has no ids. Whole texts count, each row is its own. A text with U+2581 comes back with spaces."""
    return _mapped(documents, coder, "ids array<int>, n_tokens long, round_trip boolean", "text", _encoded)


def decode_ids(documents: DataFrame, coder: Coder | None = None) -> DataFrame:
    """All columns with decoded, the text of ids (null ids: null)."""
    return _mapped(documents, coder, "decoded string", "ids", _decoded)


def _encoded(coder: Coder, texts: pa.Array) -> list[pa.Array]:
    ids, n = coder.encode(texts)
    back = coder.decode(ids, n)
    return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids)), pa.array(n), pc.equal(back, pc.fill_null(texts, "").cast(pa.large_string()))]


def _decoded(coder: Coder, ids: pa.Array) -> list[pa.Array]:
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = coder.decode(ids.flatten().to_numpy(zero_copy_only=False), n).cast(pa.string())
    return [pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), out)]


def _mapped(documents: DataFrame, coder: Coder | None, ddl: str, column: str, f) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(ddl)
    old = [x for x in documents.schema.fields if x.name not in new.names]
    schema = StructType([*old, *new.fields])
    sent = documents.sparkSession.sparkContext.broadcast(coder or Coder.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, column, PART) if column == "text" else (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                made = f(sent.value, part.column(column))
                yield pa.record_batch([*(part.column(x.name).cast(kinds.field(x.name).type) for x in old), *(a.cast(kinds.field(x.name).type) for a, x in zip(made, new.fields, strict=True))], names=kinds.names)

    extra = [column] if column not in [x.name for x in old] else []
    return documents.select(*(x.name for x in old), *extra).mapInArrow(trimmed(run), schema)
