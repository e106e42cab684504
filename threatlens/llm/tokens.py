"""Token ids with the ``tokenizers`` library, word by word through a bounded cache.

Byte-level BPE never merges across the pieces of its splitting pattern, and a
space before a non-space always begins a piece.  So a column of texts is cut at
its spaces, its distinct words are looked up in a pool of known ones, and ids
are gathered for all texts at once.  Words that the pool lacks are encoded many
in one call and cut apart again by the byte lengths of their tokens.  Texts with
the string of a special token go to the library as they are.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORDS_PER_CALL = 4000
_POOL = 1 << 24          # ids
_MARKS = ".,;:!?"
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def byte_lengths(tokenizer) -> np.ndarray:
    """Bytes of each entry; an entry's letters stand for one byte each, special tokens for their string."""
    lengths = np.zeros(tokenizer.get_vocab_size(), "i8")
    for entry, i in tokenizer.get_vocab().items():
        lengths[i] = len(entry)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        lengths[i] = len(token.content.encode())
    return lengths


class _Pool:
    """Runs of ids in one array, by slot; slot 0 is empty."""

    def __init__(self):
        self.ids, self.starts, self.lengths = np.empty(1 << 16, "<u4"), np.zeros(1, "i8"), np.zeros(1, "i8")
        self.used = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Slots of new runs."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), "<u4")])
        self.ids[self.used:self.used + len(ids)] = ids
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(ids)
        return range(first, len(self.starts))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the slots one after the other, and where each ends."""
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at + np.repeat(self.starts[slots] - ends + lengths, lengths)], ends


class Encoder:
    """Ids of texts.

    ``entries`` bounds the words known; a full pool starts anew.  Special tokens' strings in
    a text become special ids, as the library does by itself, unless ``plain`` is set.
    """

    def __init__(self, vocabulary: str, plain: bool = False, entries: int = 900_000):
        from tokenizers import Tokenizer
        self._whole = Tokenizer.from_file(vocabulary)
        self._whole.encode_special_tokens = plain
        self._model, self.vocabulary_size = self._whole.model, self._whole.get_vocab_size()
        self._special = [] if plain else [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._byte_lengths, self._letters = byte_lengths(self._whole), byte_letters()
        self._entries = entries
        self._forget()

    def _forget(self) -> None:
        self._pool = _Pool()
        self._words: dict[str, int] = {"": 0}           # slots of what follows a space
        self._firsts: dict[str, int] = {"": 0}          # slots of what begins a text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        ids, offsets = self.encode_column(pa.array(texts, pa.string()))
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip(offsets, offsets[1:])]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and one more offsets than texts; null and empty texts have no ids."""
        if len(self._words) + len(self._firsts) > self._entries or self._pool.used > _POOL:
            self._forget()
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        code, words, left = coded.indices.to_numpy(), coded.dictionary.to_pylist(), {}
        heads = offsets[:-1]
        head_code = np.unique(code[heads])
        after = np.ones(len(code), bool)
        after[heads] = False
        unused = np.ones(len(words), bool)
        unused[code[after]] = False
        loose = _loose(coded.dictionary, words)
        for i in np.flatnonzero(loose | unused).tolist():
            words[i], left[i] = "", words[i]
        slots = self._slots(words)[code]
        first_of = np.zeros(len(words), "i8")
        first_of[head_code] = self._slots([left.get(i) or words[i] for i in head_code.tolist()], first=True)
        slots[heads] = first_of[code[heads]]
        whole = self._with_special(texts)
        odd = whole.copy()
        if loose.any():
            at = np.flatnonzero(loose[code] & after)
            odd[np.searchsorted(offsets, at, "right") - 1] = True
        for i in np.flatnonzero(odd):
            slots[offsets[i]:offsets[i + 1]] = 0
            slots[offsets[i]] = self._alone(texts[int(i)].as_py(), bool(whole[i]))
        ids, ends = self._pool.gather(slots)
        return ids, np.concatenate([[0], ends])[offsets]

    def _with_special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for content in self._special:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return found

    def _alone(self, text: str, whole: bool) -> int:
        """A slot with the ids of one text that has runs of white space, or special tokens."""
        if whole:
            ids = np.array(self._whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        else:
            out: list[list[str]] = []
            for word in text.split(" "):
                if not out or word and not word[0].isspace():
                    out.append([word])
                else:
                    out[-1].append(word)
            head, *words = (" ".join(w) for w in out)
            ids, _ = self._pool.gather(np.concatenate([self._slots([head], first=True), self._slots(words)]).astype("i8"))
        return self._pool.add(ids, np.array([len(ids)]))[0]

    def _slots(self, words: list[str], first: bool = False) -> np.ndarray:
        """The slot of each word; empty words have none of their own."""
        known = self._firsts if first else self._words
        found = list(map(known.get, words))
        if None in found:
            gone = [i for i, slot in enumerate(found) if slot is None]
            new = list({words[i] for i in gone})
            self._learn(known, new, "") if first else self._learn_words(new)
            for i in gone:
                found[i] = known[words[i]]
        return np.array(found, "i8")

    def _learn_words(self, words: list[str]) -> None:
        """New words; marks after a word are pieces of their own, so they are encoded apart from it."""
        known, cores, marked = self._words, set(), []
        for word in words:
            core = word.rstrip(_MARKS)
            if core and len(core) < len(word) and core[-1] <= "\u024f" and core[-1].isalpha():
                marked.append((word, core, word[len(core):]))
                if core not in known:
                    cores.add(core)
            else:
                cores.add(word)
        self._learn(known, list(cores), " ")
        if marked:
            marks = self._slots([m for _, _, m in marked], first=True)
            pairs = np.stack([[known[core] for _, core, _ in marked], marks], 1).ravel()
            ids, ends = self._pool.gather(pairs)
            slots = self._pool.add(ids, np.diff(ends[1::2], prepend=0))
            known.update(zip([w for w, _, _ in marked], slots))

    def _learn(self, known: dict[str, int], words: list[str], before: str) -> None:
        single, together, alone = [], [], []
        for word in words:
            if word.isalpha() and word.isascii():
                single.append(word)         # one piece of the splitting pattern
            elif not before or word[-1].isspace():
                alone.append(word)          # white space at an end would merge with the next word's space
            else:
                together.append(word)
        merge, mark = self._model.tokenize, self._letters[0x20] if before else ""
        self._keep(known, single, [[t.id for t in merge(mark + word)] for word in single])
        for at in range(0, len(together), _WORDS_PER_CALL):
            some = together[at:at + _WORDS_PER_CALL]
            ids = np.array(self._whole.encode_batch_fast([before + before.join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            stops = np.searchsorted(np.cumsum(self._byte_lengths[ids]), ends, "left") + 1
            known.update(zip(some, self._pool.add(ids, np.diff(stops, prepend=0))))
        if alone:
            made = self._whole.encode_batch_fast([before + w for w in alone], add_special_tokens=False)
            self._keep(known, alone, [e.ids for e in made])

    def _keep(self, known: dict[str, int], words: list[str], ids: list[list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        known.update(zip(words, self._pool.add(flat, np.fromiter(map(len, ids), "i8", len(ids)))))


def _loose(column: pa.Array, words: list[str]) -> np.ndarray:
    """Which words are empty or begin with white space: it stays with the word before it."""
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, "<i8")[column.offset:column.offset + len(column) + 1]
    letters = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(1, "u1")
    first = letters[np.minimum(starts[:-1], len(letters) - 1)]
    out = starts[1:] == starts[:-1]
    for i in np.flatnonzero((first <= 0x20) | (first >= 0x80)).tolist():
        out[i] = out[i] or words[i][0].isspace()
    return out


def larger(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many rows or bytes: words are looked up once a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One per Python worker and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one task, one core
    return Encoder(vocabulary)
