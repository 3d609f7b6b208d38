import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from offerloom.llm.encoder import Encoder, public_tokenizer
from offerloom.llm.words import ALNUM_LOWER, SPACED, SPACED_LOWER, window_hashes, words

TEXTS = ["", None, "a", " a  b\tc\n", "Ünï codé x", "A-b_c 12.3", "   ", "x" * 300 + " y", "a b", "b a", "\x0b\x0c\r", "É é Z"]


def spelled(found, i):
    raw = found.buf.tobytes()
    return [raw[found.start[j] : found.end[j]].decode() for j in range(found.first[i], found.first[i + 1])]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_words_are_those_of_the_patterns():
    arr = pa.array(TEXTS, pa.string())
    for table, pattern, change in (
        (SPACED, r"[^\x20\x09-\x0D]+", str), (SPACED_LOWER, r"[^\x20\x09-\x0D]+", lower),
        (ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    ):
        for part in (arr, arr.slice(3, 5)):
            found = words(part, table)
            for i, t in enumerate(part.to_pylist()):
                assert spelled(found, i) == re.findall(pattern, change(t or ""))


def test_hashes_depend_on_the_word_alone():
    random.seed(1)
    pool = ["".join(random.choices("abcé", k=random.randint(1, 90))) for _ in range(500)]
    arr = pa.array([" ".join(random.choices(pool, k=50)) for _ in range(40)])
    found = words(arr, SPACED)
    raw, seen = found.buf.tobytes(), {}
    for a, b, h in zip(found.start, found.end, found.hashes()):
        assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def test_window_hashes():
    random.seed(2)
    arr = pa.array([" ".join(random.choices("abc", k=n)) for n in (0, 3, 4, 60, 5)])
    found = words(arr, SPACED)
    starts, hashes = window_hashes(found.hashes(), found.first, 4)
    want = {}
    for i, t in enumerate(arr.to_pylist()):
        w = t.split()
        for j in range(len(w) - 3):
            want[int(found.first[i]) + j] = tuple(w[j : j + 4])
    assert sorted(want) == starts.tolist()
    by = {}
    for s, h in zip(starts.tolist(), hashes.tolist()):
        assert by.setdefault(want[s], h) == h
    assert len(set(by.values())) == len(by)


def test_encoder_is_the_library():
    texts = [t or "" for t in TEXTS] + [
        "a<|endoftext|>b c <|startoftext|>", "don't I'll  x y z\x85q\x1cw", "İI ΑΣ ΣΑΣ 12 345 ǅ ǆ Ǆ ŉ ß ẞ ĳ Ĳ",
        "##" + "#" * 200, "a\x00b \x00 c", "Hello!! (World). x..y A.B. wow!'s ok:) ...", "é ́x"
    ]
    e = Encoder(public_tokenizer())
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    e.MOST_PIECES = 3  # both generations
    for _ in range(3):
        assert [e.encode([t])[0] for t in texts] == want
    plain = Encoder(public_tokenizer(), special_as_text=True)
    assert 49407 not in np.frombuffer(plain.encode(["a<|endoftext|>b"])[0], "<u4")


def test_other_tokenizers_encode_as_the_library_does():
    texts = ["Hello world, this is New York.", "", "  two  spaces\n", "don't", "Ünï 123"]
    seen = 0
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        try:
            path = public_tokenizer(name)
        except Exception:
            continue
        e = Encoder(path)
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.apart == (name == "word_bpe_49k.json")
        seen += 1
    assert seen


def test_any_closing_punctuation_encodes_as_the_library_does():
    import string

    e = Encoder(public_tokenizer())
    words = ["abc", "Ab", "é", "Ünd", "it", "İ", "ß", "x1", "日本", "é", "a'", ""]
    tails = [a + b for a in ["", *string.punctuation, "̸"] for b in ["", *string.punctuation, "s", "'s", "̸", "́"]]
    texts = [f"{w}{t}" for w in words for t in tails]
    found = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in found]


def test_blocks_change_no_hash(monkeypatch):
    random.seed(3)
    arr = pa.array([" ".join(random.choices(["a", "bc", "é" * 40, "x" * 300], k=n)) for n in (0, 1, 7, 200, 0, 30, 4)] + [None, " "])
    found = words(arr, SPACED)
    whole = found.hashes()
    starts, windows = window_hashes(whole, found.first, 4)
    monkeypatch.setattr("offerloom.llm.words.HASH_BYTES", 64)
    monkeypatch.setattr("offerloom.llm.words.WINDOW_WORDS", 8)
    assert found.hashes().tolist() == whole.tolist()
    again = window_hashes(whole, found.first, 4)
    assert [x.tolist() for x in again] == [starts.tolist(), windows.tolist()]


def test_hashing_takes_memory_of_a_block():
    arr = pa.array([" ".join(f"word{i % 997}" for i in range(2000))] * 200)
    found = words(arr, SPACED)
    tracemalloc.start()
    try:
        window_hashes(found.hashes(), found.first, 50)
        assert tracemalloc.get_traced_memory()[1] < 8 * arr.nbytes
    finally:
        tracemalloc.stop()
