"""Whole-text BPE ids, encoding each distinct word once per worker.

The vocabulary file's own rules make words independent: its normaliser never joins
characters across ASCII white space, and its splitter cuts words there and drops it.
A text's ids are therefore the ids of its parts, one after the other. Chunks between
white space that hold only Latin-1 letters, ASCII digits and ASCII punctuation are
cut further where the splitter cuts (letter runs, single digits, punctuation runs)
and lower-cased as the normaliser does; any other chunk stays whole. Parts are found
and hashed in vectorised passes over the bytes; only parts not met before go to the
tokenizers library.
"""

from __future__ import annotations

import os

import numpy as np

from pointloom.llm import words as W
from pointloom.llm.common import trim

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct parts after which a worker's cache starts anew; bounds its memory.
CACHE = 300_000
_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[0x21:0x7F] = _PUNCT
_KINDS[ord("0") : ord("9") + 1] = _DIGIT
_KINDS[ord("a") : ord("z") + 1] = _KINDS[ord("A") : ord("Z") + 1] = _LETTER
_KINDS[ord("'")] = _OTHER  # may start a contraction
_KINDS[W.SPACE] = _SPACE
_MARK = "\n"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _parts(texts: list[str | None]):
    """The bytes (folded where safe), each part's start, length, hash and whether it is one whole unsafe chunk, and each text's end."""
    data, ends = W.joined(texts)
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    folded = W._LOWER[data]
    if len(lead):
        second = data[lead + 1]
        good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = _LETTER
        folded[lead[good & (second <= 0x9E)] + 1] += 32
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[special] = _OTHER
    inside = kind != _SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    unsafe = np.flatnonzero(kind == _OTHER)
    if len(unsafe):
        chunks = np.unique(np.searchsorted(starts, unsafe, "right") - 1)
        for a, b in zip(starts[chunks].tolist(), stops[chunks].tolist(), strict=True):
            kind[a:b] = _OTHER
            folded[a:b] = data[a:b]
    new = inside.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    starts = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    return folded, starts, lengths, W.hash_spans(folded, starts, lengths, inside), kind[starts] == _OTHER, ends


class Encoder:
    """Encodes texts with the library's ids; keeps the ids of parts met before."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or default_path()
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(_MARK, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.words.get_vocab(with_added_tokens=False)
        suffix = self.words.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary needs a word-end suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.n_ids, self.start, self.length = 0, np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, hashes: list[int], parts: list[str], whole: np.ndarray) -> None:
        found: list[np.ndarray] = []
        count = np.empty(len(parts), np.int32)
        plain = np.flatnonzero(~whole)
        for k in range(0, len(plain), 2000):
            at = plain[k : k + 2000]
            ids = np.array(self.words.encode(_MARK.join([parts[i] for i in at]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(at):
                raise ValueError("the vocabulary does not end each word with one word-end token")
            count[at] = np.diff(cuts, prepend=0)
            found.append(ids)
        others = np.flatnonzero(whole)
        for i in others:
            found.append(np.array(self.whole.encode(parts[i], add_special_tokens=False).ids, np.uint32))
            count[i] = len(found[-1])
        order = np.concatenate([plain, others])
        self.place.update(zip([hashes[i] for i in order], range(len(self.place), len(self.place) + len(order)), strict=True))
        fresh = np.concatenate(found)
        while self.n_ids + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(1 << 16, len(self.ids)), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(fresh)] = fresh
        count = count[order]
        self.start = np.concatenate([self.start, self.n_ids + np.cumsum(count) - count])
        self.length = np.concatenate([self.length, count])
        self.n_ids += len(fresh)

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one uint32 array, and each text's number of ids (None: no ids)."""
        if len(self.place) > CACHE:
            self._clear()
        data, starts, lengths, hashes, whole, ends = _parts(texts)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = known.tolist()
        get = self.place.get
        places = np.array([get(h, -1) for h in keys], np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            raw, at = data.tobytes(), first[new]
            spans = zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)
            self._learn([keys[i] for i in new], [raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans], whole[at])
            places[new] = [get(keys[i]) for i in new]
        places = places[inverse]
        n, begin = self.length[places].astype(np.int64), self.start[places]
        upto = np.cumsum(n)
        ids = self.ids[np.arange(int(upto[-1]), dtype=np.int64) + np.repeat(begin - upto + n, n)]
        per_text = np.searchsorted(starts, ends)
        total = np.concatenate([[0], upto])[per_text]
        return ids, np.diff(total, prepend=0)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, n = self.flat(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


_ENCODERS: dict[str | None, Encoder] = {}


def release() -> None:
    """Lets go of the worker's encoders and their words."""
    _ENCODERS.clear()
    trim()


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; kept until ``release``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
