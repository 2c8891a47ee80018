import json
import random
import string
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablerecon.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello  world's <|endoftext|>x",
    "",
    None,
    "a b\x1cc\x85d É é ́x\r\n\ttab",
    "word " * 5000,
    "x" * 30_000,
    "Hello  world's <|endoftext|>x",
]


def encoded(words, texts):
    """Ids of each text, without the end."""
    out = []
    for _, ids, starts in words.encode(pa.array(texts, pa.string()), 7):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            assert ids[b - 1] == 7
            out.append(ids[a : b - 1].tolist())
    return out


def test_pieces_are_the_tokenizer_s_ids(docs):
    rows = packing.pack(docs(TEXTS, "length int, n int"), PATH).collect()
    encoder = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [t for r in own for t in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}


def test_repeated_null_and_no_rows(docs):
    rows = packing.pack(docs([(None, "a"), (7, "b c d"), (7, "b c d")]), PATH, with_ids=False).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 1 + 2 * 1
    assert packing.pack(docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), PATH, longest=1000)


def test_words_of_every_letter_and_mark_before_signs():
    """Normalising can end a letter in a mark, which then stands with the signs after it."""
    encoder = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    assert words.by_word
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LMN"]
    excluded = [c for c in letters if len(unicodedata.normalize("NFC", c)) > 1 or len(c.lower()) > 1]
    assert len(excluded) > 50
    texts = [f"{c}{s}" for c in excluded for s in (".", ",;", "!", "?.", ":")]
    texts += [f"a{c}{s} {c}{s}" for c in letters for s in (".", "!?")]
    texts += ["पढ़. বড়. טּ, ששׁ! İ. İstanbul, ŉ; ǰ: ΐ? straẞe. Σ. ΣΑΣ, a\u0301. e\u0323\u0302! ﬀ. 'S. x's. '’s, 1. 1, ½. ²! a\u200d. \u200b."]
    rng = random.Random(0)
    pool = letters[::37] + excluded + list(".,;:!?'-_ \n\t\r\x0b\x0c\x1c\x85\u3000\u0301\u0338#") * 8
    texts += ["".join(rng.choices(pool, k=20)) for _ in range(6000)]
    for text, got in zip(texts, encoded(words, texts), strict=True):
        assert got == encoder.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_one_stem_are_encoded_once():
    """Neither case nor the signs after a word are a reason to run the tokenizer on it again."""
    words = packing.WordIds(PATH)
    stems = ["q" + "".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(300)]
    texts = [" ".join(f + s for f in (w, w.title(), w.upper())) for w in stems for s in ("", ".", "***", "$$$", ")", '",', "'")]
    assert encoded(words, texts) == [words.encoder.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.kept) <= len(set(stems)) + 10


def test_every_sign_next_to_words_and_added_tokens():
    encoder = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    assert not set(words.signs) & set("<|>") and set(words.signs) >= set(".,'\"$-_")
    rng = random.Random(1)
    pool = [*string.punctuation, *"aZéß1 \n", "don't", "X'S", "'Re", "İ", "J\u030c", "ड़", "\u0338", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext|>"]
    texts = ["".join(rng.choices(pool, k=12)) for _ in range(8000)]
    for text, got in zip(texts, encoded(words, texts), strict=True):
        assert got == encoder.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("change", ["cased", "added"])
def test_tokenizers_that_treat_letters_otherwise(tmp_path, change):
    """Where case counts or a word is an added token, letters are not encoded apart from the rest."""
    made = json.loads(Path(PATH).read_text())
    if change == "cased":
        made["normalizer"]["normalizers"].pop()
    else:
        made["added_tokens"] += [made["added_tokens"][0] | {"id": 49408 + i, "content": c, "special": False} for i, c in enumerate(["Abc", "e.g."])]
    (tmp_path / "t.json").write_text(json.dumps(made))
    words = packing.WordIds(str(tmp_path / "t.json"))
    assert words.letters is None and words.by_word and ("." in words.signs) == (change == "cased")
    texts = ["Word word, WORD. e.g., e.g. xe.g.x E.G. dogs'", "The word abc, and (ABC)! Abc. xAbcx Abc"]
    assert encoded(words, texts) == [words.encoder.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a.": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "t.json"))
    words = packing.WordIds(str(tmp_path / "t.json"))
    assert not words.by_word and encoded(words, ["a. b", None]) == [[0, 1], []]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 50_000)
    monkeypatch.setattr(packing, "LOOKUP_BYTES", 1000)
    words = packing.WordIds(PATH)
    texts = [f"w{i}x, w{i}y" for i in range(5000)]
    ids = encoded(words, texts)
    assert words.size < 120_000
    assert ids[::500] == [words.encoder.encode(t, add_special_tokens=False).ids for t in texts[::500]]


def test_memory_does_not_grow_with_the_batch():
    """A batch of texts is taken in short runs, and what a run needed is gone when its ids are given."""
    words, rng = packing.WordIds(PATH), random.Random(2)
    pool = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(20_000)]
    texts = pa.array([" ".join(rng.choices(pool, k=300)) for _ in range(8000)])
    before = pa.total_allocated_bytes()
    for _, ids, _ in words.encode(texts, 7):
        assert pa.total_allocated_bytes() - before < 2 * ids.nbytes + (1 << 20) < texts.nbytes


def test_piece_lengths():
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(1, 2048) == [1]
