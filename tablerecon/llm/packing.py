"""Operator 10: pack documents by cutting each into pieces of power-of-two length.

Every document is its token ids and an end id.  It is cut into pieces whose
lengths are the binary digits of its length, full sequences first, so a piece
is a sequence of its own: no sequence crosses documents and none is padded.
Pieces of equal length form a bucket, in which sequences are numbered by task
and by their place in it, so that packing is one map without a shuffle.  The
numbers are the same in every run over a table that was written; rows that
come in changing order, as after a shuffle, should be stored first.

Token ids are looked up by word.  That is exact for tokenizers that drop white
space and cut between letters and other signs after normalising; a tokenizer
is tried on samples of that, and if it cuts otherwise, whole texts are encoded.
Signs after a word are looked up apart from it; words of ASCII letters alone are
lower-cased first and go straight to the tokenizer's model, if lower-casing is
all that the tokenizer does to such letters before.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as often as they occur; a null id stays null; no rows give no rows.
Columns besides id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from string import ascii_letters, punctuation
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import forget, once

if TYPE_CHECKING:
    from tokenizers import Encoding, Tokenizer

MAX_LENGTH = 2048
END_ID = 1
#: Memory of the words a worker keeps, by estimate, and text it looks up at once.
KEPT_BYTES = 64 << 20
LOOKUP_BYTES = 2 << 20
#: Bytes of a kept word besides its own and its ids'.
ENTRY_BYTES = 200
#: Signs that are looked up apart when they end a word.
SIGNS = punctuation
#: Bits of a sequence's number for its length and its task.
LENGTH_BITS, TASK_BITS = 6, 26

#: Letters before signs and spaces as a word tokenizer must cut them.
_SAMPLES = [["Word", "."], ["don't", "!?"], ["é", "..."], ["漢字", ","], ["a1b", ";"], ["x", ":"], ["Б", "?!"]]


class WordIds:
    """Token ids of texts, encoding each distinct run of non-space only once.

    Punctuation is cut off a word only behind a letter, judged after the
    tokenizer's own normalising: that may split a letter into a letter and a
    mark, and marks stay with the punctuation that follows.  What is kept are
    the words without it, and the punctuation by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        # A sign that an added token holds may not be cut off it.
        self.signs = "".join(c for c in SIGNS if not any(c in t for t in self.added))
        self.letters = self._letters_only()
        self.ends: dict[str, bool] = {}
        self.by_word = self._cuts_words()
        self._clear()

    def _clear(self) -> None:
        """Keep the empty word only, as number 0."""
        self.kept: dict[str, int] = {"": 0}
        self.ids, self.upto = np.empty(0, "<u4"), np.zeros(2, np.int32)
        self.size = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4")

    def _cuts_words(self) -> bool:
        samples = [*_SAMPLES, *(["ab", s] for s in self.signs), ["ab", self.signs]]
        whole = self._ids(" ".join(a + b for a, b in samples)).tolist()
        lines = self._ids("\n".join(a + "\t" + b + " \r" for a, b in samples)).tolist()
        return whole == lines == np.concatenate([self._ids(t) for pair in samples for t in pair]).tolist()

    def _letters_only(self) -> Tokenizer | None:
        """The same model for words of a-z, if all that the tokenizer does to ASCII letters before is to lower their case."""
        from tokenizers import Tokenizer, pre_tokenizers

        normalizer, splitter, lower = self.encoder.normalizer, self.encoder.pre_tokenizer, ascii_letters.lower()
        if not normalizer or not splitter or any(t.isalpha() for t in self.added):
            return None
        if normalizer.normalize_str(ascii_letters) != lower or [u for u, _ in splitter.pre_tokenize_str(lower)] != [lower]:
            return None
        plain = Tokenizer(self.encoder.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        whole = plain.encode(lower + " ab", add_special_tokens=False).ids
        return plain if whole == self._ids(ascii_letters + " AB").tolist() else None

    def _ends_in_letter(self, last: str) -> bool:
        """Whether a last character stays a letter; one that joins the character before it does too."""
        if last not in self.ends:
            normalizer = self.encoder.normalizer
            self.ends[last] = last.isalpha() and (normalizer.normalize_str(last) if normalizer else last)[-1:].isalpha()
        return self.ends[last]

    def _encode_words(self, words: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """In which order these words are encoded, how many ids each has, and the ids."""
        plain, letters, ascii_words, alone = [], [], [], []
        for i, w in enumerate(words):
            if w.isalpha():
                (plain if self.letters and w.isascii() else letters).append(i)
            else:
                (ascii_words if w.isascii() else alone).append(i)
        order: list[int] = []
        lengths: list[np.ndarray] = []
        made: list[np.ndarray] = []
        # Many words go in one call: a run of letters is one unit of the tokenizer.
        for at, encoder, begin in ((plain, self.letters, _units), (letters, self.encoder, _units), (ascii_words, self.encoder, _places)):
            for a in range(0, len(at), 1024):
                part = at[a : a + 1024]
                text = [words[i] for i in part]
                encoding = encoder.encode(" ".join(text), add_special_tokens=False)
                starts = begin(encoding, text)
                if starts is None:
                    alone += part
                    continue
                ids = np.array(encoding.ids, "<u4")
                order += part
                lengths.append(np.diff(starts, append=len(ids)))
                made.append(ids)
        single = [self._ids(words[i]) for i in alone]
        return order + alone, [*lengths, np.fromiter(map(len, single), np.int64, len(single))], made + single

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Where the ids of these distinct words are kept, made if they are not yet."""
        numbers = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            order, lengths, made = self._encode_words(unknown)
            numbers[new[order]] = np.arange(len(self.kept), len(self.kept) + len(new))
            self._keep(unknown, numbers[new].tolist(), np.concatenate(lengths), np.concatenate([self.ids, *made]))
        return numbers

    def _keep(self, words: list[str], numbers: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.size += sum(map(len, words)) + 4 * (len(ids) - len(self.ids)) + ENTRY_BYTES * len(words)
        self.kept.update(zip(words, numbers))
        self.ids = ids
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(lengths)]).astype(np.int32)

    def _make_room(self, words: list[str]) -> None:
        """Once too much is kept, keep only what these distinct words need, as they are the likeliest to come again."""
        if self.size > KEPT_BYTES:
            words = [w for w in words if w and w in self.kept]
            lists = self._lists().take(pa.array(map(self.kept.__getitem__, words), pa.int32()))
            self._clear()
            self._keep(words, range(1, len(words) + 1), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())

    def _lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(self.upto, self.ids)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these distinct words, one after another, and where those of each begin."""
        bare = pc.ascii_rtrim(words, self.signs)
        cut = np.subtract(*(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in (words, bare)))
        signed = np.flatnonzero(cut)
        last = pc.utf8_slice_codeunits(bare.take(pa.array(signed)), -1).dictionary_encode()
        letter = np.array([self._ends_in_letter(c) for c in last.dictionary.to_pylist()], bool)
        cuttable = letter[last.indices.to_numpy()]
        uncut = np.zeros(len(words), bool)
        uncut[signed[~cuttable]] = True
        signed = signed[cuttable]
        bare = pc.if_else(pa.array(uncut), words, bare)
        if self.letters:
            bare = pc.if_else(pc.ascii_is_alpha(bare), pc.ascii_lower(bare), bare)
        bare = bare.dictionary_encode()
        distinct = bare.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._make_room(distinct)
        # Each word is two units, the second of them mostly empty.
        units = np.zeros(2 * len(words), np.int64)
        units[::2] = self._numbers(distinct)[bare.indices.to_numpy()]
        signs = [w[-n:] for w, n in zip(words.take(pa.array(signed)).to_numpy(zero_copy_only=False), cut[signed].tolist())]
        different = list(set(signs))
        numbers = dict(zip(different, self._numbers(different).tolist()))
        units[2 * signed + 1] = [numbers[s] for s in signs]
        lists = self._lists().take(pa.array(units))
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[::2]

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first row, all ids with ``end`` after each text, and where each text begins.

        What a run needed on the way is dropped, and its memory handed back, before the next.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        first = 0
        while first < len(texts):
            last = max(int(np.searchsorted(upto, upto[first] + LOOKUP_BYTES, "right")) - 1, first + 1)
            ids, starts = self._run(pc.fill_null(texts.slice(first, last - first).cast(pa.large_string()), ""), end)
            pa.default_memory_pool().release_unused()
            yield first, ids, starts
            del ids, starts
            first = last

    def _run(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts with ``end`` after each, and where each text begins.

        Words are told apart and numbered by Arrow, so that Python only sees
        the distinct ones.
        """
        if self.by_word:
            split = pc.ascii_split_whitespace(texts)
            numbered = split.flatten().dictionary_encode()
            word, at = numbered.indices.to_numpy(), split.offsets.to_numpy()
            ids, offsets = self.learn(numbered.dictionary)
        else:
            units = [self._ids(t) for t in texts.to_pylist()]
            word, at = np.arange(len(units)), np.arange(len(units) + 1)
            ids, offsets = np.concatenate(units), np.cumsum([0, *map(len, units)])
        # The tokens of the words in turn, and of one more word, the end, after each text.
        offsets = np.append(offsets, len(ids) + 1).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, np.append(ids, np.uint32(end)))
        word = np.insert(word, at[1:] - at[0], len(lists) - 1)
        taken = lists.take(pa.array(word, pa.int32()))
        starts = taken.offsets.to_numpy()[at - at[0] + np.arange(len(texts) + 1)]
        return taken.flatten().to_numpy(), starts - starts[0]


def _units(encoding: Encoding, words: list[str]) -> np.ndarray | None:
    """Where the ids of each word begin, if each is one unit of the tokenizer."""
    starts = np.flatnonzero(np.diff(np.array(encoding.word_ids, np.int64), prepend=-1))
    return starts if len(starts) == len(words) else None


def _places(encoding: Encoding, words: list[str]) -> np.ndarray | None:
    """Where the ids of each word of ASCII begin, told apart by where in the text each token does."""
    begins = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.ids))
    if (np.diff(begins) < 0).any():
        return None
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.searchsorted(begins, np.cumsum(lengths + 1) - lengths - 1)


def piece_lengths(total: int, longest: int) -> list[int]:
    """Full pieces, then the binary digits of the rest, largest first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = MAX_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, the ids.

    Each piece is a sequence; a sequence's number holds its place among those
    of its length in the task, the task and the length.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(tokenizer)
        words = once(tokenizer, lambda: WordIds(tokenizer))
        task = TaskContext.get().partitionId() << LENGTH_BITS
        numbers = [0] * longest.bit_length()
        for batch in batches:
            for first, ids, starts in words.encode(batch.column(1), end_id):
                rows: list[tuple[int, int, int, int, int, int]] = []
                data = memoryview(ids).cast("B")
                for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()), first):
                    at = a
                    for n in piece_lengths(b - a, longest):
                        digit = n.bit_length() - 1
                        number = numbers[digit] << LENGTH_BITS + TASK_BITS | task | digit
                        rows.append((r, at - a, n, zlib.crc32(data[4 * at : 4 * (at + n)]), b - a, number))
                        numbers[digit] += 1
                        at += n
                row, start, length, crc, tokens, number = (pa.array(c, pa.int64()) for c in zip(*rows))
                out = [batch.column(0).take(row), start, length, crc, tokens, number, pa.array(np.zeros(len(rows), np.int64))]
                if with_ids:
                    cuts = np.concatenate([[0], np.cumsum(length.to_numpy())]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(cuts, ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(out, names=names)

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    return source.mapInArrow(run, schema)
