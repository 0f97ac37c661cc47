import random
import tracemalloc

import numpy as np
import pyarrow as pa

from meshloom.llm import common, records


def test_eights_take_little_more_than_their_result():
    """Of each byte the eight from there on, in less than 20 bytes of memory a byte, the result's 8 among them."""
    rng = np.random.Generator(np.random.PCG64(4))
    for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 100):
        raw = rng.integers(0, 256, n, np.uint8)
        data = raw.tobytes() + bytes(8)
        assert common.eights(raw).tolist() == [int.from_bytes(data[k : k + 8], "little") for k in range(n + 1)]
    raw = rng.integers(0, 256, 1 << 20, np.uint8)
    tracemalloc.start()
    try:
        common.eights(raw)
        assert tracemalloc.get_traced_memory()[1] < 20 * len(raw)
    finally:
        tracemalloc.stop()


def test_word_encoder_equals_the_tokenizer_on_odd_texts():
    """Letters of Latin-1, signs among them that are none, apostrophes, other scripts, empty and null rows; once with an
    empty memory, once with a full one of which the older half is forgotten."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    some = list("abz AZ  \t\n\x0b09.,'!-_÷×éÉßÿÀþÞ ñµªЖ中\x1c\x00<>|😀")
    texts = [None if k % 97 == 0 else "".join(rng.choice(some if k % 3 else some[:16]) for _ in range(rng.randint(0, 40))) for k in range(3000)]
    tok = Tokenizer.from_file(records.TOKENIZER)
    tok.encode_special_tokens = True
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encode = records.WordEncoder(records.TOKENIZER)
    for most in (records.CACHED_WORDS, 0):
        before, records.CACHED_WORDS = records.CACHED_WORDS, most
        try:
            ids, row = encode(pa.array(texts, pa.string()))
        finally:
            records.CACHED_WORDS = before
        assert [ids[a:b].tolist() for a, b in zip(row, row[1:], strict=False)] == want
