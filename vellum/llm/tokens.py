"""Token ids of whole texts, word by word, with a bounded memory of words in each Python worker.

White space parts pre-tokens in the word-level vocabularies that this serves, so a text's ids are its words' ids in
sequence. Arrow splits the texts of a batch and finds their distinct words; each of those is looked up or encoded once,
and numpy gathers the ids of all texts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings remembered in a worker (about 80 MB); the memory is emptied when it is full.
KNOWN = 400_000
#: Runs encoded in one call.
JOINED = 10_000
#: A run of Latin letters, all of them precomposed (the normalizer only lowers their case, and the run is one pre-token), and marks after it.
_PLAIN = "^(?P<letters>[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)(?P<marks>[!\"#$%&()*+,./:;<=>?@^_`{|}~\\[\\]\\\\-]*)$"
_workers: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Store:
    """Ids of strings, end to end in one array that grows; the empty string has none."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.start, self.size = array("q", [0]), array("q", [0])
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at.update(zip(names, range(len(self.size), len(self.size) + len(names)), strict=True))
        self.start.frombytes((self.used + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int64).tobytes())
        self.used += len(ids)


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` from each start on, end to end."""
    before = np.cumsum(size) - size
    return ids[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Words:
    """Encodes texts to unsigned 32-bit ids (little-endian, as executors are); for vocabularies that lower the case and part words at white space and marks."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.lowers = self.tokenizer.normalizer is not None
        # for runs of lower-case letters or marks, parted by blanks: what is left of the tokenizer's work
        self.runs = Tokenizer.from_file(path)
        self.runs.encode_special_tokens = True
        self.runs.normalizer = None
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.lowers = self.lowers and bool(suffix)
        #: Whether an id ends a run: the fast encoding doesn't say where in its text an id is from.
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items() if self.lowers else ():
            self.ends[i] = token.endswith(suffix)
        self.known = Store()

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _places(self, strings: pa.DictionaryArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, in the store, of each string's ids; new strings are learned: odd ones whole, the others as runs."""
        names, get = strings.dictionary.to_pylist(), self.known.at.get
        codes = strings.indices.to_numpy()
        whole = np.zeros(len(names), bool)
        whole[codes[odd]] = True
        at = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        runs = [names[i] for i in new[~whole[new]].tolist()]
        for a in range(0, len(runs), JOINED):
            part = runs[a : a + JOINED]
            ids = np.array(self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            self.known.add(part, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if others := [names[i] for i in new[whole[new]].tolist()]:
            self.known.add(others, *self._whole(others))
        for i in new.tolist():
            at[i] = get(names[i])
        return np.frombuffer(self.known.start, np.int64)[at][codes], np.frombuffer(self.known.size, np.int64)[at][codes]

    def encode(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text's followed by ``end``, and the offsets of each text's."""
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
        if not self.lowers:  # another kind of vocabulary
            ids, size = self._whole(texts.to_pylist())
            offsets = np.concatenate([[0], np.cumsum(size)])
        elif not len(texts):
            ids, offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        else:
            if len(self.known.at) > KNOWN:
                self.known.clear()
            split = pc.ascii_split_whitespace(texts)
            first = split.offsets.to_numpy() - split.offsets[0].as_py()
            found = split.flatten().dictionary_encode()
            words, which = found.dictionary, found.indices.to_numpy()
            parts = pc.extract_regex(words, _PLAIN)
            odd = np.asarray(parts.is_null())
            heads = pc.if_else(parts.is_null(), words, pc.utf8_lower(pc.struct_field(parts, "letters")))
            marks = pc.fill_null(pc.struct_field(parts, "marks"), "")
            head, n_head = self._places(heads.dictionary_encode(), odd)
            mark, n_mark = self._places(marks.dictionary_encode(), np.zeros(len(odd), bool))
            # first the ids of each distinct word, then those of all words
            own = gathered(self.known.ids, np.stack([head, mark], 1).ravel(), np.stack([n_head, n_mark], 1).ravel())
            size = n_head + n_mark
            ids = gathered(own, (np.cumsum(size) - size)[which], size[which])
            offsets = np.concatenate([[0], np.cumsum(size[which])])[first]
        if end is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def encoder(path: str, special_as_text: bool = False) -> Words:
    """The worker's encoder for a vocabulary file."""
    key = (path, special_as_text)
    if key not in _workers:
        _workers[key] = Words(path, special_as_text)
    return _workers[key]
