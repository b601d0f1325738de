"""SentencePiece ids of whole texts for merge-type vocabularies, by a score-ordered agenda.

The library joins the adjacent pair of symbols whose piece has the best score, the
leftmost of equals, until no pair is a piece. No piece of such a vocabulary goes on
past a word into the next space (tested when it is loaded), so the agenda of a text is
that of its words, a word being a run of spaces and what follows it. The distinct words
of a batch share one agenda held in arrays: every round joins each word's best pair and
looks up the two pairs that this makes. Long words have a heap of their own. Every
batch's ids are compared with those of the library for the whole texts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import finish_steps, give_back, process_cache, sliced, texts
from tallystone.llm.tokens import vocabulary

SPACE = "▁"
LONG = 48  # symbols; longer words take the heap
_WORD = re.compile("^[^ ]+| +[^ ]*")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + counts[i] - 1 of all i in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


class Pieces:
    """A merge-type vocabulary: symbols, the pairs that join, and the bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.vocab_size()
        odd = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i)}
        if any(m.is_unused(i) for i in range(n)) or m.encode("x  y ", out_type=str)[0][0] != SPACE or m.decode(m.encode("  x  y ")) != "  x  y ":
            raise ValueError("only vocabularies that keep all spaces and have no unused pieces")
        names = [m.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if i not in odd}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece goes past its word")
        self.begin, self.end, self.unknown = m.bos_id(), m.eos_id(), m.unk_id()
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # symbols are pieces, and characters that only occur inside pieces
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.n = n
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        self.char_of = np.zeros(max(symbols.values(), default=0) + 1, np.uint32)
        self.char_of[[i for p, i in symbols.items() if len(p) == 1]] = [ord(p) for p in symbols if len(p) == 1]
        keys, joined = [], []
        for p, i in normal.items():
            for at in range(1, len(p)):
                left, right = symbols.get(p[:at]), symbols.get(p[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.concatenate([np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]])
        self.joined = np.concatenate([np.array(joined, np.int64)[order], [0]]).astype(np.int32)
        self.score = np.array([m.get_score(i) for i in range(n)], np.float32)
        # bytes of every id as they stand in the text
        raw = [bytes([int(names[i][3:5], 16)]) if m.is_byte(i) else b"" if i in odd else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.size_of = np.array([len(r) for r in raw], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(joined piece, its score; -inf where the pair is no piece)."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        piece = self.joined[at]
        return piece, np.where(hit, self.score[np.where(hit, piece, 0)], np.float32(-np.inf))

    def agenda(self, chars: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left, their number by word) of words given as characters in a row; an unknown character is -1 - its code."""
        symbol = self.of_char[chars]
        symbol = np.where(symbol < 0, -1 - chars.astype(np.int64), symbol).astype(np.int32)
        word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        done_symbols, done_words = [], []
        long = np.flatnonzero(counts > LONG)
        if len(long):
            ends = np.cumsum(counts)
            for w in long.tolist():
                out = self._heap(symbol[ends[w] - counts[w] : ends[w]])
                done_symbols.append(out)
                done_words.append(np.full(len(out), w, np.int32))
            short = (counts <= LONG)[word]
            symbol, word = symbol[short], word[short]
        piece, score = np.zeros(len(symbol), np.int32), np.full(len(symbol), -np.inf, np.float32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        piece[inner], score[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.maximum.reduceat(score, starts)
            over = np.repeat(best == -np.inf, sizes)
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                live = ~over
                symbol, word, piece, score = symbol[live], word[live], piece[live], score[live]
                sizes, best = sizes[best > -np.inf], best[best > -np.inf]
                if not len(symbol):
                    break
            at = np.flatnonzero(score == np.repeat(best, sizes))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbol[at] = piece[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, piece, score = symbol[keep], word[keep], piece[keep], score[keep]
            at = at - np.arange(len(at))
            new = np.concatenate([at, at[at > 0] - 1])
            inside = new + 1 < len(word)
            inside[inside] = word[new[inside]] == word[new[inside] + 1]
            score[new[~inside]] = np.where(word[new[~inside]] == word[np.minimum(new[~inside] + 1, len(word) - 1)], score[new[~inside]], -np.inf)
            score[at[len(word) == at + 1]] = -np.inf
            new = new[inside]
            piece[new], score[new] = self._pairs(symbol[new], symbol[new + 1])
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(counts))

    def _heap(self, symbol: np.ndarray) -> np.ndarray:
        """The agenda of one long word."""
        n = len(symbol)
        held, size = symbol.tolist(), [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        piece, score = self._pairs(symbol[:-1], symbol[1:])
        agenda = [(-s, i, 2, p) for i, (s, p) in enumerate(zip(score.tolist(), piece.tolist(), strict=True)) if s > -np.inf]
        heapq.heapify(agenda)
        known = dict(zip(zip(symbol[:-1].tolist(), symbol[1:].tolist(), strict=True), zip(piece.tolist(), score.tolist(), strict=True), strict=True))
        while agenda:
            _, i, both, p = heapq.heappop(agenda)
            j = after[i]
            if not size[i] or j == n or size[i] + size[j] != both:
                continue  # one of the two was joined meanwhile
            held[i], size[i], size[j], after[i] = p, both, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n:
                    pair = (held[a], held[b])
                    if pair not in known:
                        got, s = self._pairs(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))
                        known[pair] = (int(got[0]), float(s[0]))
                    got, s = known[pair]
                    if s > -np.inf:
                        heapq.heappush(agenda, (-s, a, size[a] + size[b], got))
        return np.array([h for h, s in zip(held, size, strict=True) if s], np.int32)

    def _ids(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: a character without a piece is the pieces of its bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.n))
        if not len(odd):
            return symbol.astype(np.uint32), counts
        chars = np.where(symbol[odd] < 0, -1 - symbol[odd], self.char_of[np.maximum(symbol[odd], 0)])
        parts = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
        times = np.ones(len(symbol), np.int64)
        times[odd] = [len(p) for p in parts]
        ids = np.repeat(symbol, times).astype(np.uint32)
        first = np.cumsum(times) - times
        ids[_ranges(first[odd], times[odd])] = np.concatenate(parts)
        owner = np.repeat(np.arange(len(counts)), counts)
        return ids, np.bincount(owner, times, len(counts)).astype(np.int64)

    def encode(self, column: pa.Array, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row without begin and end, their offsets by text) of a string array without nulls."""
        given = column.cast(pa.large_string())
        column, n = pc.replace_substring(given, SPACE, " "), len(column)
        odd = pc.or_(pc.match_substring(column, "  "), pc.or_(pc.equal(column, ""), pc.starts_with(column, " "))).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(column, " ")
        if odd.any():
            lists = {i: [w[1:] if w[0] == " " else w for w in _WORD.findall(" " + column[i].as_py())] if len(column[i].as_py()) else [] for i in np.flatnonzero(odd).tolist()}
            sizes = np.diff(words.offsets.to_numpy())
            sizes = np.array([len(lists[i]) if i in lists else sizes[i] for i in range(n)])
            edges, parts = np.flatnonzero(np.diff(np.concatenate([[True], odd, [True]]))), []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                if hi > lo:
                    parts.append(pa.array([w for i in range(lo, hi) for w in lists[i]], pa.large_string()) if odd[lo] else words.slice(lo, hi - lo).flatten())
            flat = pa.chunked_array(parts, pa.large_string()).combine_chunks()
        else:
            sizes, flat = np.diff(words.offsets.to_numpy()), words.flatten()
        coded = flat.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        lengths = pc.utf8_length(distinct).to_numpy().astype(np.int64) + 1
        joined = "".join(f" {w}" for w in distinct.to_numpy(zero_copy_only=False))
        symbols, counts = self.agenda(_codes(joined), lengths)
        own, counts = self._ids(symbols, counts)
        firsts = np.cumsum(counts) - counts
        ids = own[_ranges(firsts[code], counts[code])]
        ends = np.concatenate([[0], np.cumsum(counts[code])])
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if check:
            theirs = self.library.encode(given.to_pylist(), num_threads=1)
            if not np.array_equal(offsets, np.cumsum([0, *map(len, theirs)])) or not np.array_equal(ids, np.fromiter((i for t in theirs for i in t), np.uint32, len(ids))):
                raise ValueError("ids differ from those of the sentencepiece library")
        return ids, offsets


def pieces(path: str) -> Pieces:
    """The worker's vocabulary for a file."""
    cache = process_cache("pieces")
    if path not in cache:
        cache[path] = Pieces(path)
    return cache[path]


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text.

    ``id_col`` is cast to long and kept as it is, null or repeated. A null text is empty;
    an empty text has only the ids for begin and end. A text of any length is encoded
    whole, in a batch of its own if it is over 2 MB. Other columns are not read. An empty
    table gives no rows. ``check`` compares every batch with the library and fails on a
    difference.
    """
    finish_steps(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in sliced(batches, "text", 2 << 20):
            ids, offsets = vocabulary.encode(batch.column("text"), check)
            rows = np.arange(len(offsets) - 1)
            if begin:
                ids = np.insert(ids, offsets[:-1], np.uint32(vocabulary.begin))
                offsets = offsets + np.append(rows, len(rows))
            if end:
                ids = np.insert(ids, offsets[1:], np.uint32(vocabulary.end))
                offsets = offsets + np.append(rows, len(rows))
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(4 * offsets.astype(np.int64)), raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.cast(pa.binary())], names=["doc_id", "ids"])
        give_back()

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and text, as the library's decode(ids) gives it; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces(model).library
        for batch in sliced(batches, "ids", 8 << 20):
            ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids")), pa.array(library.decode(ids, num_threads=1), pa.string())], names=["doc_id", "ids", "text"])

    plain = rows.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return plain.mapInArrow(run, "doc_id long, ids binary, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with begin and end ids, and decoded again."""
    model = vocabulary("piece_bpe_32k.model")
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
