"""Token ids of whole batches of texts.

A text is cut at white space, and between a letter and the punctuation behind it: two
places that the tokenizer's own splitting also cuts.  Each distinct piece of a batch is
encoded once and its ids are laid out with array operations.  Encoded pieces are remembered
per process, as bytes, up to a bound.
"""

from __future__ import annotations

import itertools
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not install this

#: Pieces of one kind of character go to the model itself, past normalising and splitting,
#: which would leave them as they are.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-/:-@\[-`{-~]+|[0-9]")
_BATCH_BYTES = 4 << 20
_REMEMBERED = 120_000
_open: dict[str, Encoder] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(ord("ß"), ord("ÿ") + 1)]
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def width(self, *more: int) -> int:
        """Bytes that hold any id of the vocabulary, and ``more``."""
        return 2 if max(self.whole.get_vocab_size() - 1, *more) < 1 << 16 else 4

    def pieces(self, found: list[str]) -> list[bytes]:
        """The ids of each piece, four bytes each."""
        out, rest = [], []
        for i, piece in enumerate(found):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    if _PLAIN.fullmatch(piece):
                        ids = _packed([
                            t.id for t in self.model.tokenize(piece.translate(self.bytes))])
                    else:
                        rest.append(i)
                if ids is not None:
                    self.young[piece] = ids
            out.append(ids)
        for i, done in zip(rest, self.whole.encode_batch(
                [found[i] for i in rest], add_special_tokens=False)):
            out[i] = self.young[found[i]] = _packed(done.ids)
        if len(self.young) > _REMEMBERED:
            self.old, self.young = self.young, {}
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` behind each text, and where each text begins (and the last ends)."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():  # may hold special tokens, which are found in whole texts
            return self._mixed(texts, special.to_numpy(zero_copy_only=False), end)
        return self._plain(texts, end)

    def _plain(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(
            pc.ascii_lower(texts), r"(\pL)([.,!?;:#*$%&]+)", r"\1 \2")
        lists = pc.ascii_split_whitespace(cut)
        firsts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        # splitting leaves empty pieces where a text begins or ends with white space
        ids = self.pieces(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.concatenate([[0], np.cumsum(sizes)])
        each = sizes[code]
        at = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(begin[code] - at[:-1], each) + np.arange(at[-1])]
        ends = at[firsts]
        out = np.insert(out, ends[1:], np.uint32(end))
        return out, ends + np.arange(len(ends))

    def _mixed(self, texts, special, end):
        some = np.flatnonzero(special)
        ids, starts = self._plain(pc.if_else(pa.array(special), "", texts), end)
        parts = np.split(ids, starts[1:-1])
        encoded = self.whole.encode_batch(texts.take(pa.array(some)).to_pylist(),
                                          add_special_tokens=False)
        for i, done in zip(some, encoded):
            parts[i] = np.array([*done.ids, end], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def slices(batch: pa.RecordBatch, column: str = "text"):
    """A batch in slices of bounded size of text (at least one row each)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    group = np.cumsum(sizes) // _BATCH_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in itertools.pairwise(bounds):
        if b > a:
            yield batch.slice(a, b - a)
