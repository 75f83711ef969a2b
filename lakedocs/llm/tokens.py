"""Encoding whole texts with the tokenizers library, once for each distinct piece of many texts.

Texts are handled in slices of ``TEXT_BYTES``; each is cut into pieces, every distinct piece of a
slice goes through the library once, and the texts' ids are put together from them. A cut must
not change the ids. It is made

* at a blank between characters that aren't white space, for tokenizers whose pre-tokenizer
  starts a token at such a blank (byte-level BPE, ``lead``) or drops white space (word BPE,
  ``drop``); a text with other white space beside a blank is encoded whole under ``lead``;
* between a letter and the ASCII signs that end a piece, which are never of one token. The letter
  is of the Latin blocks up to U+024F but U+0130: their lower case and their composed forms are
  one letter again. (U+0130 becomes i and a mark, and marks merge with the signs after them.)

Memory follows the slice and its largest text, not the corpus. Between slices the ids of at most
``KEPT`` short pieces are kept, the first ones that were met: a frequent word is early among them.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank beside other white space, as Unicode has it.
_ODD_BLANK = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: Texts encoded together.
TEXT_BYTES = 16 << 20
#: Pieces whose ids are kept between slices, and the bytes of the longest of them.
KEPT, KEPT_BYTES = 1 << 20, 32
#: Fewer pieces than these are not worth the look-up.
_FEW = 2_000
_SIGNS = ".,!?;:*&%$#|"
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_TAILED = f"[{_LATIN}][.,!?;:*&%$#|]+$"
_WORD = f"^[{_LATIN}]+$"


class _Table:
    """Ids of strings, one after the other; entry 0 has none."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder, self.sizes, self.parts, self.n = encoder, [np.zeros(1, np.int64)], [np.empty(0, np.uint32)], 1

    def add(self, strings: pa.Array) -> int:
        """The entry of the first of ``strings``; the others follow."""
        base, (sizes, ids) = self.n, self.encoder.learn(strings)
        self.sizes.append(sizes)
        self.parts.append(ids)
        self.n += len(strings)
        return base

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.concatenate(self.sizes).astype(np.int32)
        return sizes, (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32), np.concatenate(self.parts)


class PieceEncoder:
    """Ids of texts as uint32 arrays. ``blanks``: 'lead' if a blank belongs to the piece after
    it, 'drop' if blanks have no ids, 'whole' to cut nothing."""

    def __init__(self, path: str, blanks: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        plain = [(k, x.content) for k, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word)]
        self.mark_id, self.mark = max(plain, default=(None, None))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max([*vocabulary.values(), self.mark_id or 0]) + 1, bool)
        self.closes = self.opens.copy()
        for token, k in vocabulary.items():
            self.opens[k], self.closes[k] = token.startswith("Ġ"), token.endswith("</w>")
        self.kept, self.kept_sizes, self.kept_ids = pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(texts)
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def learn(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of different strings; through the library go those that are not kept."""
        if len(strings) < _FEW:
            return self._learn(strings)
        at = np.asarray(pc.fill_null(pc.index_in(strings, value_set=self.kept), -1))
        known = at >= 0
        fresh = strings.filter(pa.array(~known))
        new_sizes, new_ids = self._learn(fresh)
        sizes = np.empty(len(strings), np.int64)
        sizes[known], sizes[~known] = self.kept_sizes[at[known]], new_sizes
        of = np.repeat(known, sizes)
        ids = np.empty(len(of), np.uint32)
        n = sizes[known]
        starts = (np.cumsum(self.kept_sizes, dtype=np.int64) - self.kept_sizes)[at[known]]
        ids[of] = self.kept_ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ids[~of] = new_ids
        self._keep(fresh, new_sizes, new_ids)
        return sizes, ids

    def _keep(self, strings: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        short = np.asarray(pc.binary_length(strings)) <= KEPT_BYTES
        short &= np.cumsum(short) <= KEPT - len(self.kept)
        if short.any():
            self.kept = pa.concat_arrays([self.kept, strings.filter(pa.array(short))])
            self.kept_ids = np.concatenate([self.kept_ids, ids[np.repeat(short, sizes)]])
            self.kept_sizes = np.concatenate([self.kept_sizes, sizes[short].astype(np.int32)])

    def _learn(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids). Many strings go through the library as one text and are
        told apart by their first token (a leading blank), their last (a word's end) or a special
        token between them."""
        if not len(strings):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        if self.blanks == "lead":
            easy = pc.match_substring_regex(strings, r"^ [^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$")
        else:
            easy = pc.match_substring_regex(strings, _WORD)
        apart = np.asarray(easy.cast(pa.uint8())).astype(bool)
        parts = [self._joined(strings.filter(easy), "" if self.blanks == "lead" else " "), self._joined(strings.filter(pc.invert(easy)), self.mark)]
        if apart.all() or not apart.any():
            return parts[0] if apart.all() else parts[1]
        sizes = np.empty(len(strings), np.int64)
        sizes[apart], sizes[~apart] = parts[0][0], parts[1][0]
        of = np.repeat(apart, sizes)
        ids = np.empty(len(of), np.uint32)
        ids[of], ids[~of] = parts[0][1], parts[1][1]
        return sizes, ids

    def _joined(self, strings: pa.Array, joint: str | None, n: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
        sizes, all_ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for low in range(0, len(strings), n):
            part = strings[low : low + n].to_pylist()
            found = None
            if joint is not None:
                ids = np.array(self._whole([joint.join(part)])[0], np.uint32)
                if joint == self.mark:
                    at = np.flatnonzero(ids == self.mark_id)
                    size, ids = np.diff(at, prepend=-1, append=len(ids)) - 1, np.delete(ids, at)
                elif joint == " ":
                    size = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
                else:
                    size = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
                if len(size) == len(part) and size.sum() == len(ids):
                    found = size, ids
            if found is None:  # one of them has signs that the tokenizer takes for others
                found = self._each(part)
            sizes.append(found[0])
            all_ids.append(found[1])
        return np.concatenate(sizes), np.concatenate(all_ids)

    def _codes(self, pieces: pa.Array, lead: str, table: _Table) -> np.ndarray:
        """Two entries a piece: its words and the signs after them."""
        tailed = pc.match_substring_regex(pieces, _TAILED)
        cores = pc.if_else(tailed, pc.utf8_rtrim(pieces, characters=_SIGNS), pieces)
        cut = np.asarray(pc.subtract(pc.binary_length(pieces), pc.binary_length(cores)))
        coded = cores.dictionary_encode()
        words = pc.binary_join_element_wise(pa.scalar(lead), coded.dictionary, pa.scalar("")) if lead else coded.dictionary
        codes = np.zeros((len(pieces), 2), np.int32)
        codes[:, 0] = table.add(words) + np.asarray(coded.indices)
        for k in np.unique(cut[cut > 0]).tolist():  # lengths of the signs
            rows = np.flatnonzero(cut == k)
            tails = pc.utf8_slice_codeunits(pieces.take(pa.array(rows)), -k).dictionary_encode()
            codes[rows, 1] = table.add(tails.dictionary) + np.asarray(tails.indices)
        return codes

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts that may be cut at blanks."""
        lists = pc.split_pattern(texts, " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        del lists
        index, pieces, table = np.asarray(coded.indices), coded.dictionary, _Table(self)
        if self.blanks == "lead":
            some = at[:-1][np.diff(at) > 0]
            first, back = np.unique(index[some], return_inverse=True)
            lone = self._codes(pieces.take(pa.array(first)), "", table)
            codes = self._codes(pieces, " ", table)
        else:
            codes = self._codes(pieces, "", table)
        sizes, starts, flat = table.close()
        size = sizes[codes].sum(1)[index]
        if self.blanks == "lead":
            size[some] = sizes[lone].sum(1)[back]
        # A row of pieces is gathered in runs that stay in the processor's cache.
        out = []
        for low in range(0, len(index), 1 << 15):
            words = codes[index[low : low + (1 << 15)]]
            if self.blanks == "lead":
                a, b = np.searchsorted(some, (low, low + len(words)))
                words[some[a:b] - low] = lone[back[a:b]]
            words = words.ravel()
            n = sizes[words]
            end = np.cumsum(n, dtype=np.int32)
            out.append(flat[np.repeat(starts[words] - (end - n), n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)])
        ids = np.concatenate(out) if out else np.empty(0, np.uint32)
        bound = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at]
        return ids, np.diff(bound)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids), ``end`` appended to each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.ones(len(texts), bool)
        if self.blanks == "drop":
            odd[:] = False
        elif self.blanks == "lead":
            odd = np.asarray(pc.match_substring_regex(texts, _ODD_BLANK).cast(pa.uint8())).astype(bool)
        ids, sizes = self._cut(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, np.uint32), np.empty(0, np.int64))
        if odd.any():
            whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
            plain = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ())
            parts = [np.array(next(whole), np.uint32) if x else next(plain) for x in odd]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        if end is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end))
            sizes = sizes + 1
        return ids, sizes


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, blanks: str) -> PieceEncoder:
    """One encoder a Python worker, kept between tasks: the tokenizer, no texts."""
    if (path, blanks) not in _encoders:
        _encoders[path, blanks] = PieceEncoder(path, blanks)
    return _encoders[path, blanks]
