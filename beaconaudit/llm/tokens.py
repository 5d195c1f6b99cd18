"""Token ids of whole texts, by the tokenizers library, with every distinct word encoded once.

The vocabulary's pre-tokenizer drops white space and never makes a token across it, and its
normalizer does not look across it, so a text's ids are the ids of its words in order. A batch is
split into words, its distinct words are encoded (those seen before come from a bounded cache), and
numpy puts the ids together. Encoding is the costly part, and texts repeat their words.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Appended to every document.
END_ID = 1
#: Words whose ids a worker remembers; beyond it the cache starts anew. Results do not depend on it.
CACHE_WORDS = 700_000
#: Characters encoded at once, which bounds a worker's memory for texts that are not larger.
CHUNK_CHARS = 6_000_000

# A word of plain Latin letters and marks after it: the letters are one pre-token and the marks
# another, whatever stands around them. Anything else is given to the library as it is.
_MARKS = ".,!?;:*$%&#|()\"-"
_LETTERS = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[" + _MARKS + "]*$"


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        names = self.library.get_vocab()
        size = max(names.values()) + 1
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.levels = max(1, (size - 1).bit_length())
        self._ends = np.zeros(size, bool)
        self._ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {"": b""}

    def _ids(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, letters: list[str]) -> None:
        """Puts the ids of new words of plain letters into the cache, thousands of words in one call."""
        for first in range(0, len(letters), 4096):
            part = letters[first:first + 4096]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part):
                raw, size = ids.tobytes(), self.dtype.itemsize
                ends *= size
                starts = np.concatenate([[0], ends[:-1]])
                self._known.update(zip(part, [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]))
            else:
                self._known.update((word, self._ids(word)) for word in part)

    def _encode_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, and where each text's begin and the last one's end."""
        words = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(words.flatten())
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # a distinct word is two pieces: letters (or a whole other word), and the marks after them
        plain = pc.match_substring_regex(distinct, _PLAIN)
        letters = pc.utf8_rtrim(distinct, characters=_MARKS)
        marks = pc.if_else(plain, pc.utf8_ltrim(distinct, characters=_LETTERS), "")
        pieces = pc.dictionary_encode(pc.if_else(plain, pc.utf8_lower(letters), distinct))
        tails = pc.dictionary_encode(marks)
        heads, ends = _strings(pieces.dictionary), _strings(tails.dictionary)
        is_plain = np.zeros(len(heads), bool)
        is_plain[pieces.indices.to_numpy(zero_copy_only=False)] = plain.to_numpy(zero_copy_only=False)
        if len(self._known) > CACHE_WORDS:
            self._known = {"": b""}
        known = self._known
        new = [(w, p) for w, p in zip(heads, is_plain.tolist()) if w not in known]
        self._learn([w for w, p in new if p])
        for word in [w for w, p in new if not p] + [w for w in ends if w not in known]:
            known[word] = self._ids(word)
        ids = [known[w] for w in heads] + [known[w] for w in ends]
        flat = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        pair = np.stack([pieces.indices.to_numpy(zero_copy_only=False),
                         tails.indices.to_numpy(zero_copy_only=False) + len(heads)], axis=1).astype(np.int32)
        order = pair[index].ravel()
        lengths = sizes[order]
        done = np.cumsum(lengths)
        source = np.repeat(starts[order] - (done - lengths), lengths)
        source += np.arange(len(source))
        bounds = np.asarray(words.offsets, np.int64) * 2
        return flat[source], np.concatenate([[0], done])[bounds - bounds[0]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: empty), the end id included."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else texts.combine_chunks(), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[np.ndarray] = []
        first, end_id = 0, np.array([END_ID], self.dtype)
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS)))
            ids, bounds = self._encode_chunk(texts.slice(first, last - first))
            out += [np.concatenate([ids[s:e], end_id]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            first = last
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    return Encoder(vocabulary)
