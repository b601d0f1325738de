"""Token ids of whole texts, by the tokenizers library, one call per distinct piece of text.

A text is cut where no token can cross (before a single space or line end, or at
white space that the vocabulary drops). Distinct pieces of a batch are encoded
once, joined into one text, and looked up after that; the ids are those of
encoding every text whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallystone.llm.common import process_cache

_WIDE = "\x85\xa0  -     　"  # white space beyond ASCII
#: Texts with these are encoded whole: white space that does not stand alone, marks used here, special tokens.
_RUN = f"[\t\r\x0b\x0c\\x00{_WIDE}]|[ \n][ \n]|<\\|"
_ODD = f"[\\x00\x1c-\x1f~{_WIDE}]|<\\|"
KEEP = 400_000  # pieces a worker remembers; beyond that only the often used ones stay


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts; ``path`` is a tokenizers JSON file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        by_id = sorted(self.tok.get_vocab().items(), key=lambda x: x[1])
        self.word_ends = sum(w.endswith("</w>") for w, _ in by_id) > 1000
        if self.word_ends:
            self.mark = self.tok.encode("~", add_special_tokens=False).ids
            assert len(self.mark) == 1
            self.ends_word = np.zeros(max(i for _, i in by_id) + 1, bool)
            self.ends_word[[i for w, i in by_id if w.endswith("</w>")]] = True
        else:  # byte-level: a token stands for as many bytes as it has characters
            self.bytes_of = np.zeros(max(i for _, i in by_id) + 1, np.int64)
            self.bytes_of[[i for _, i in by_id]] = [len(w) for w, _ in by_id]
        self.known: dict[str, int] = {}
        self.ids, self.used, self.rows = np.zeros(0, np.uint32), 0, 0
        self.begins, self.counts, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self):
        """Keep the pieces used most, half of what may be kept at most."""
        hits = self.hits[: self.rows]
        least = max(2, int(np.partition(hits, -(KEEP // 2))[-(KEEP // 2)]) + 1)
        keep = hits >= least
        pieces = [p for p, k in zip(self.known, keep, strict=True) if k]
        begins, counts = self.begins[: self.rows][keep], self.counts[: self.rows][keep]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)
        self.ids, self.used, self.rows = self.ids[at], len(at), len(pieces)
        self.begins, self.counts, self.hits = ends - counts, counts, hits[keep]
        self.known = dict(zip(pieces, range(len(pieces)), strict=True))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces of all texts in a row, their number by text, texts to be encoded whole instead)."""
        odd = pc.match_substring_regex(column, _ODD if self.word_ends else _RUN)
        column = pc.if_else(odd, pa.scalar("", column.type), column)
        if self.word_ends:
            lists = pc.ascii_split_whitespace(column)
        else:  # a first piece is marked; the others follow a space or line end
            marked = pc.binary_join_element_wise(pa.scalar("\x00", column.type), pc.replace_substring(column, "\n", " \n"), pa.scalar("", column.type))
            lists = pc.split_pattern(marked, " ")
        return lists.flatten(), np.diff(lists.offsets.to_numpy()), np.flatnonzero(odd.to_numpy(zero_copy_only=False))

    def _learn(self, pieces: list[str]) -> None:
        nothing = "" if self.word_ends else "\x00"
        if nothing in pieces:
            pieces = [p for p in pieces if p != nothing]
            self._add([nothing], np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64))
        for lo in range(0, len(pieces), 4000):
            self._learn_some(pieces[lo : lo + 4000])

    def _learn_some(self, pieces: list[str]) -> None:
        if self.word_ends:
            letters = [p for p in pieces if p.isalpha()]  # one word each, so word ends part them
            if letters:
                ids = self._whole([" ".join(letters)])[0]
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(letters):
                    counts = np.diff(ends, prepend=0)
                    self._add(letters, ids, ends - counts, counts)
                    pieces = [p for p in pieces if not p.isalpha()]
            if not pieces:
                return
            ids = np.array(self.tok.encode_batch_fast([" ~ ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            edges = np.concatenate([[-1], np.flatnonzero(ids == self.mark[0]), [len(ids)]])
            begins, counts = edges[:-1] + 1, np.diff(edges) - 1
        else:
            # a first piece follows a line end, whose token is left out; pieces of white space alone would run together
            blank = [p for p in pieces if p in ("", "\n")]
            pieces = [p for p in pieces if p not in ("", "\n")]
            real = [("\n" + p[1:] if p[0] == "\x00" else p if p[0] == "\n" else " " + p) for p in pieces]
            ids = self._whole(["".join(real)])[0]
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(r.encode()) for r in real]), "right")
            first = np.array([p[0] == "\x00" for p in pieces], np.int64)
            begins = np.concatenate([[0], ends])[:-1] + first
            counts = ends - begins
            for p in blank:
                own = self._whole([p or " "])[0]
                begins, counts = np.append(begins, len(ids)), np.append(counts, len(own))
                ids = np.concatenate([ids, own])
            pieces = pieces + blank
        assert len(counts) == len(pieces)
        self._add(pieces, ids, begins, counts)

    def _add(self, pieces: list[str], ids: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        need, rows = self.used + len(ids), self.rows + len(pieces)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * need, np.uint32)])
        if rows > len(self.begins):
            grow = np.zeros(2 * rows, np.int64)
            self.begins, self.counts, self.hits = (np.concatenate([x[: self.rows], grow]) for x in (self.begins, self.counts, self.hits))
        self.ids[self.used : need] = ids
        self.begins[self.rows : rows], self.counts[self.rows : rows] = self.used + begins, counts
        self.known.update(zip(pieces, range(self.rows, rows), strict=True))
        self.used, self.rows = need, rows

    def encode(self, texts: list[str] | pa.Array, step: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their offsets by text)."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(column).to_numpy()) // step
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(column)]
        parts = [self._encode(column.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo]
        offsets = np.concatenate([[0], *(p[1] for p in parts)]).astype(np.int64).cumsum()
        return (np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)), offsets

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.rows > KEEP:
            self._forget()
        flat, pieces, odd = self._pieces(column)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.known.get
        rows = np.array([known(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            missing = distinct[new].tolist()
            self._learn(missing)
            rows[new] = [self.known[p] for p in missing]
        codes = rows[coded.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
        self.hits[rows] += np.bincount(coded.indices.to_numpy(), minlength=len(rows))
        lengths = self.counts[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.begins[codes] - (ends - lengths), lengths)
        ids = self.ids[at]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])]
        counts = np.diff(bounds)
        if len(odd):
            whole = dict(zip(odd.tolist(), self._whole(column.take(pa.array(odd)).to_pylist()), strict=True))
            parts = [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(column))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    cache = process_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]
