"""Token ids of whole texts with the tokenizers library, one distinct word at a time.

A byte-pair tokenizer that splits at white space gives a word the same ids
wherever it stands, so each Arrow batch is split and dictionary-encoded, only
words not met before go through the library (many at once), and the ids of the
texts are gathered. Texts for which the split at white space could differ from
the tokenizer's own, and those that hold one of its added tokens (such as
<|endoftext|>, which the library gives its one id), go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the ASCII kind, as the tokenizers' patterns see it.
_ODD_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A text with a space within a run of white space, or with such odd space, isn't cut at its spaces.
_NOT_BY_SPACES = r"[ \t\n\x0b\x0c\r] |[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = " \t\n\x0b\x0c\r"


class WordTokenizer:
    """Ids of texts. The cache keeps the first cache_words words, which bounds its memory; others are encoded anew."""

    def __init__(self, path: str, cache_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        # word_bpe marks the ends of words and drops white space; byte_bpe keeps each byte
        self.drops_space = any(k.endswith("</w>") for k in vocab)
        self.bytes_of = np.zeros(self.vocab_size, np.int64)
        for k, i in vocab.items():
            self.bytes_of[i] = len(k.removesuffix("</w>")) if self.drops_space else len(k)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.not_by_words = "|".join(added if self.drops_space else [_NOT_BY_SPACES, *added])
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _many(self, words: list[str], sep: str) -> list[bytes] | None:
        """Ids of words from one call on their concatenation; None if their ends can't be told."""
        if not words:
            return []
        ids = np.array(self.tok.encode_batch_fast([sep.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        lower = self.drops_space
        n = pc.binary_length(pa.array([w if w.isascii() else w.lower() for w in words] if lower else words, pa.string())).to_numpy().astype(np.int64)
        gap = 0 if lower else len(sep)
        stop = np.cumsum(n + gap) - gap
        ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        i, j = np.searchsorted(ends, stop - n), np.searchsorted(ends, stop)
        if j[-1] >= len(ends) or ends[-1] != stop[-1] or (ends[i] != stop - n).any() or (ends[j] != stop).any():
            return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * i).tolist(), (4 * j).tolist())]

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks; they are kept while there is room."""
        if self.drops_space:
            kinds = [([w for w in words if not _ODD_SPACE.search(w)], " ")]
        else:
            kinds = [([w for w in words if w[0] == " " and len(w) > 1 and w[1] not in _SPACE and w[-1] not in _SPACE], ""),
                     ([w for w in words if w[0] not in _SPACE and w[-1] not in _SPACE], "\n")]
        out: dict[str, bytes] = {}
        for some, sep in kinds:
            for i in range(0, len(some), 20_000):  # an encoding takes some 100 bytes a token while it lasts
                part = some[i:i + 20_000]
                if (ids := self._many(part, sep)) is not None:
                    out.update(zip(part, ids))
        for w in words:
            if w not in out:
                out[w] = self.whole(w).tobytes()
        room = self.cache_words - len(self.cache)
        if room > 0:
            self.cache.update(out if len(out) <= room else dict(zip(words[:room], map(out.__getitem__, words[:room]))))
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end id after each; offsets of the texts in them). Null is the empty text."""
        texts = pc.fill_null(texts, "")
        own: dict[int, np.ndarray] = {}
        if self.not_by_words:
            flags = pc.match_substring_regex(texts, self.not_by_words)
            for i in np.flatnonzero(flags.to_numpy(zero_copy_only=False)).tolist():
                own[i] = self.whole(texts[i].as_py())
            if own:
                texts = pc.if_else(flags, "", texts)
        parts = pc.ascii_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten()
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        if not self.drops_space:
            # units have the space before them, but for the first of each text
            at = offsets[:-1][offsets[1:] > offsets[:-1]]
            first = flat.take(pa.array(at)).to_pylist()
            index = index.astype(np.int64)
            index[at] = len(words) + np.arange(len(at))
            words = [" " + w for w in words] + first
        blobs = list(map(self.cache.get, words))
        if new := [k for k, b in enumerate(blobs) if b is None]:
            ids_of = self._new(list(dict.fromkeys(words[k] for k in new)))
            for k in new:
                blobs[k] = ids_of[words[k]]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ids = np.frombuffer(b"".join(blobs), np.uint32)
        start = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        take = np.repeat(start[index] - (ends - n), n) + np.arange(int(n.sum()))
        body = ids[take]
        per = np.concatenate([[0], ends])[offsets]
        if own:
            pieces = [own[i] if i in own else body[per[i]:per[i + 1]] for i in range(len(texts))]
            body = np.concatenate(pieces) if pieces else body
            per = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        at = per[1:]
        out = np.insert(body, at, np.uint32(end)) if len(at) else body
        return out, per + np.arange(len(per))


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; workers live on from task to task, and so do their words."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its texts hold about `most` bytes; one long text is never cut."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // most
    cuts = [0, *((np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        yield batch.slice(i, j - i)
